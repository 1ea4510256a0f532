"""Registered queries: releases, dates, symbols, posts and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sitemap_bucket, title_parts
from ..operators import catalogue as c
from ..operators.snapshots import Snapshots
from ..sources import readers
from ..storage import fresh
from . import base
from .base import COMMITS_SQL, POSTS_SQL, RELEASES_SQL, SYMBOLS_SQL, commits, posts, query, releases, symbols, table

#: Compressed bytes that a group of the index sink may have.
BUDGET = 1 << 34
_KEY = "list_transform(string_split(version, '.'), lambda x: CAST(x AS INT))"


@query("ag20_release_facts", f"WITH r AS ({RELEASES_SQL}) SELECT package, arg_max(version, {_KEY}) AS latest, min(published) AS first_published, max(published) AS last_published, count(*) AS n_releases, array_to_string(list_sort(list(DISTINCT CAST(split_part(version, '.', 1) AS INT))), ',') AS majors FROM r GROUP BY package")
def _(spark, d):
    return c.release_facts(releases(spark, d)).withColumn("majors", F.array_join(F.transform("majors", lambda x: x.cast("string")), ","))


@query("w13_versions", f"WITH r AS (SELECT DISTINCT package, version FROM ({RELEASES_SQL})) SELECT package, version, row_number() OVER (PARTITION BY package ORDER BY {_KEY} DESC) AS position FROM r")
def _(spark, d):
    from pyspark.sql import Window as W

    from ..functions.text import version_key

    w = W.partitionBy("package").orderBy(F.desc(version_key("version")))
    return releases(spark, d).select("package", "version").distinct().withColumn("position", F.row_number().over(w))


@query("w17_version_plan", f"WITH r AS (SELECT DISTINCT package, version FROM ({RELEASES_SQL})), t AS (SELECT package, version, row_number() OVER (PARTITION BY package, split_part(version, '.', 1) ORDER BY {_KEY} DESC) AS rn FROM r), g AS (SELECT package, list(version ORDER BY {_KEY} DESC) AS vs FROM t WHERE rn = 1 GROUP BY package) SELECT package, vs[1] AS latest, array_to_string(vs[2:], ',') AS archives FROM g")
def _(spark, d):
    return c.version_plan(releases(spark, d)).withColumn("archives", F.array_join("archives", ","))


@query("ag19_page_dates", f"WITH c AS ({COMMITS_SQL}) SELECT path, min(ts) FILTER (change = 'A') AS published, max(ts) AS modified FROM c GROUP BY path")
def _(spark, d):
    return c.page_dates(commits(spark, d))


_SNAP = f"c AS ({COMMITS_SQL}), now AS (SELECT path, min(ts) FILTER (change = 'A') AS published, max(ts) AS modified FROM c GROUP BY path), old AS (SELECT path, min(ts) FILTER (change = 'A') AS published, max(ts) AS modified FROM c WHERE year(ts) < 1998 GROUP BY path)"


def _snapshots(spark, d):
    k = commits(spark, d)
    return c.page_dates(k.where(F.year("ts") < 1998)), c.page_dates(k)


_GR13 = f"WITH {_SNAP} SELECT coalesce(old.path, now.path) AS path, CASE WHEN old.path IS NULL THEN 'missing' WHEN now.path IS NULL THEN 'orphaned' WHEN old.published IS DISTINCT FROM now.published THEN 'published drifted' ELSE 'stale modified' END AS drift FROM old FULL JOIN now ON old.path = now.path WHERE old.path IS NULL OR now.path IS NULL OR old.published IS DISTINCT FROM now.published OR old.modified < now.modified"


@query("gr13_date_drift", _GR13)
def _(spark, d):
    return c.date_drift(*_snapshots(spark, d))


@query("gr13_digest_drift", _GR13)
def _(spark, d):
    """The same from two versions of the date table, by the digests of their buckets."""
    store = Snapshots(spark, fresh(spark, "dates"), ("path",), 64)
    return c.date_drift(*store.differing(*[store.write(x) for x in _snapshots(spark, d)]))


@query("gr14_merge_modified", f"WITH {_SNAP} SELECT old.path, old.published, greatest(old.modified, now.modified) AS modified FROM old LEFT JOIN now ON old.path = now.path")
def _(spark, d):
    return c.merge_modified(*_snapshots(spark, d))


@query("ag21_latest_over_sources", f"WITH p AS ({POSTS_SQL}) SELECT source, max(greatest(date, CASE WHEN chapter IS NOT NULL THEN date + chapter END)) AS modified FROM p GROUP BY source")
def _(spark, d):
    later = F.when(F.col("chapter").isNotNull(), F.date_add("date", F.col("chapter")))
    return posts(spark, d).groupBy("source").agg(F.max(F.greatest("date", later)).alias("modified"))


_BUCKET = "CASE WHEN regexp_matches(url, '^/api/') THEN 'api' WHEN regexp_matches(url, '^/blog/') THEN 'blog' ELSE 'pages' END"
_ALL = f"(SELECT url, date AS lastmod FROM ({POSTS_SQL}) WHERE NOT draft UNION ALL SELECT url, date '2024-05-05' FROM ({SYMBOLS_SQL}) UNION ALL SELECT path, ts FROM ({COMMITS_SQL}))"


def _all_pages(spark, d):
    a = posts(spark, d).where("NOT draft").select("url", F.col("date").alias("lastmod"))
    return a.unionByName(symbols(spark, d).select("url", F.lit("2024-05-05").cast("date").alias("lastmod"))).unionByName(commits(spark, d).select(F.col("path").alias("url"), F.col("ts").alias("lastmod")))


@query("ag22_bucket_lastmod", f"SELECT {_BUCKET} AS bucket, max(lastmod) AS lastmod, count(*) AS n FROM {_ALL} GROUP BY 1")
def _(spark, d):
    return c.latest_per_bucket(_all_pages(spark, d).withColumn("bucket", sitemap_bucket("url")))


@query("pf23_sitemap_buckets", f"SELECT {_BUCKET} AS bucket, count(DISTINCT url) AS n FROM {_ALL} GROUP BY 1")
def _(spark, d):
    return _all_pages(spark, d).groupBy(sitemap_bucket("url").alias("bucket")).agg(F.countDistinct("url").alias("n"))


@query("gr11_lastmod", f"SELECT url, coalesce(CASE WHEN chapter % 4 = 0 THEN date + 9 END, CASE WHEN draft THEN date + 5 END, date) AS lastmod FROM ({POSTS_SQL})")
def _(spark, d):
    p = posts(spark, d).withColumns({"released": F.when(F.col("chapter") % 4 == 0, F.date_add("date", 9)), "modified": F.when(F.col("draft"), F.date_add("date", 5)), "page_date": F.lit(None).cast("date")})
    return c.page_lastmod(p).select("url", "lastmod")


@query("gr12_priority", f"SELECT url, CASE WHEN regexp_matches(url, '^/api/') THEN 0.6 WHEN regexp_matches(url, '^/blog/') THEN 0.7 ELSE 0.8 END::DOUBLE AS priority, 'monthly' AS freq FROM (SELECT DISTINCT url FROM {_ALL})")
def _(spark, d):
    p, f = c.priority(F.col("url"))
    return _all_pages(spark, d).select("url").distinct().select("url", p.alias("priority"), f.alias("freq"))


@query("gr15_status_records", f"WITH r AS ({RELEASES_SQL}), f AS (SELECT package, max(published) AS checked, CASE WHEN package = 'pkg-3' THEN '' ELSE 'x' END AS latest FROM r GROUP BY package) SELECT package, unnest(list_filter([CASE WHEN latest = '' THEN 'no latest' END, CASE WHEN package = 'pkg-5' THEN 'no license' END, CASE WHEN date_diff('day', checked, date '1999-01-01') > 14 THEN 'old' END], lambda x: x IS NOT NULL)) AS problem FROM f")
def _(spark, d):
    f = releases(spark, d).groupBy("package").agg(F.max("published").alias("checked")).withColumns({"latest": F.when(F.col("package") == "pkg-3", "").otherwise("x"), "license": F.when(F.col("package") != "pkg-5", "MIT")})
    return c.stale_records(f, "1999-01-01")


_F2 = f"r AS ({RELEASES_SQL}), o AS (SELECT package, count(*) AS n, max(published) AS last FROM r WHERE year(published) < 1998 GROUP BY package), w AS (SELECT package, count(*) AS n, max(published) AS last FROM r GROUP BY package)"


@query("gr16_field_diff", f"WITH {_F2}, j AS (SELECT coalesce(o.package, w.package) AS package, CAST(o.n AS VARCHAR) AS n0, CAST(w.n AS VARCHAR) AS n1, CAST(o.last AS VARCHAR) AS l0, CAST(w.last AS VARCHAR) AS l1 FROM o FULL JOIN w ON o.package = w.package) SELECT package, 'n' AS field, n0 AS was, n1 AS now FROM j WHERE n0 IS DISTINCT FROM n1 UNION ALL SELECT package, 'last', l0, l1 FROM j WHERE l0 IS DISTINCT FROM l1")
def _(spark, d):
    r = releases(spark, d)
    f = lambda x: x.groupBy("package").agg(F.count("*").alias("n"), F.max("published").alias("last"))
    return c.field_diff(f(r.where(F.year("published") < 1998)), f(r), "package", "n", "last")


@query("j16_stale_versions", f"WITH r AS ({RELEASES_SQL}), p AS (SELECT package, arg_max(version, {_KEY}) AS latest FROM r GROUP BY package), v AS (SELECT package, arg_max(version, {_KEY}) AS version FROM r WHERE year(published) < 1997 AND package <> 'pkg-1' GROUP BY package) SELECT package, latest, version, latest IS DISTINCT FROM version AS stale FROM p LEFT JOIN v USING (package)")
def _(spark, d):
    r = releases(spark, d)
    return c.stale_versions(c.release_facts(r).select("package", "latest"), c.release_facts(r.where((F.year("published") < 1997) & (F.col("package") != "pkg-1"))).select("package", F.col("latest").alias("version")))


@query("j15_symbols_only_in_a", f"WITH s AS ({SYMBOLS_SQL}) SELECT DISTINCT symbol FROM s WHERE package = 'brand2' AND symbol NOT IN (SELECT symbol FROM s WHERE package = 'brand3')")
def _(spark, d):
    s = symbols(spark, d)
    return s.where("package = 'brand2'").select("symbol").distinct().join(s.where("package = 'brand3'"), "symbol", "left_anti")


@query("j17_changed_urls", f"WITH k AS (SELECT DISTINCT path FROM ({COMMITS_SQL}) WHERE year(ts) >= 1999), l AS (SELECT DISTINCT path FROM ({COMMITS_SQL}) WHERE change = 'A') SELECT path, path IN (SELECT path FROM l) AS live FROM k")
def _(spark, d):
    k = commits(spark, d)
    new, live = k.where(F.year("ts") >= 1999).select("path").distinct(), k.where("change = 'A'").select("path").distinct()
    return new.join(live, "path", "left_semi").withColumn("live", F.lit(True)).unionByName(new.join(live, "path", "left_anti").withColumn("live", F.lit(False)))


@query("j20_archived_pages", f"WITH s AS ({SYMBOLS_SQL}) SELECT a.url, coalesce(b.url, '/api/' || a.package || '/latest/') AS target FROM (SELECT DISTINCT url, package FROM s WHERE deprecated) a LEFT JOIN (SELECT DISTINCT url FROM s WHERE summary <> '') b ON a.url = b.url")
def _(spark, d):
    s = symbols(spark, d)
    a, b = s.where("deprecated").select("url", "package").distinct(), s.where("summary <> ''").select("url", F.col("url").alias("t")).distinct()
    return a.join(b, "url", "left").select("url", F.coalesce("t", F.concat(F.lit("/api/"), "package", F.lit("/latest/"))).alias("target"))


@query("j21_authors", f"WITH p AS ({POSTS_SQL}) SELECT author, count(*) AS n, max(date) AS last, min(url) AS first_url FROM p JOIN (SELECT DISTINCT 'a' || (n_nationkey % 9) AS author FROM nation WHERE n_nationkey <> 4) USING (author) GROUP BY author")
def _(spark, d):
    a = table(spark, d, "nation").where("n_nationkey <> 4").select(F.concat(F.lit("a"), F.col("n_nationkey") % 9).alias("author")).distinct()
    return posts(spark, d).join(a, "author").groupBy("author").agg(F.count("*").alias("n"), F.max("date").alias("last"), F.min("url").alias("first_url"))


@query("j2_curated_join", f"WITH p AS ({POSTS_SQL}) SELECT url, coalesce(CASE WHEN chapter = 3 THEN 'curated' END, title) AS summary FROM p")
def _(spark, d):
    p = posts(spark, d)
    front = p.where("chapter = 3").select("url", F.lit("curated").alias("s"))
    return p.join(front, "url", "left").select("url", F.coalesce("s", "title").alias("summary"))


@query("j1_anchor_check", "SELECT page_id AS url, CASE WHEN page_id % 4 = 1 THEN 's1' ELSE '' END AS anchor, page_id % 4 <> 1 AS unanchored FROM pages")
def _(spark, d):
    from ..operators.markdown import verified_anchors

    p = table(spark, d, "pages").select(F.col("page_id").alias("url"), F.concat(F.lit("s"), F.col("page_id") % 4).alias("anchor"))
    return verified_anchors(p, p.select("url", F.lit("s1").alias("id")))


@query("ag15_shared_names", f"WITH s AS ({SYMBOLS_SQL}) SELECT symbol, count(DISTINCT package) AS n_packages, count(DISTINCT signature) AS n_signatures, count(DISTINCT signature) = 1 AS identical FROM s GROUP BY symbol HAVING count(DISTINCT package) > 1")
def _(spark, d):
    return c.shared_names(symbols(spark, d))


@query("ag18_summary_coverage", f"WITH s AS ({SYMBOLS_SQL}) SELECT package, count(*) AS n, round(100 * avg(CASE WHEN summary <> '' THEN 1.0 ELSE 0.0 END), 6) AS pct, round(100 * avg(CASE WHEN summary <> '' THEN 1.0 ELSE 0.0 END), 6) >= 80 AS ok FROM s GROUP BY package")
def _(spark, d):
    return c.coverage(symbols(spark, d), 80)


@query("ag23_topic_hubs", f"WITH t AS (SELECT url, unnest(list_distinct(topics)) AS topic FROM ({POSTS_SQL})) SELECT topic, count(*) AS n FROM t GROUP BY topic HAVING count(*) >= 3")
def _(spark, d):
    return c.topic_hubs(posts(spark, d))


_RELATED = f"p AS ({POSTS_SQL}), t AS (SELECT url, unnest(list_distinct(topics)) AS topic FROM p), o AS (SELECT a.url, b.url AS other, count(*) AS overlap FROM t a JOIN t b USING (topic) WHERE a.url <> b.url GROUP BY ALL)"


@query("w10_related", f"WITH {_RELATED}, r AS (SELECT o.*, row_number() OVER (PARTITION BY o.url ORDER BY overlap DESC, date DESC, other) AS position FROM o JOIN p ON p.url = other) SELECT * FROM r WHERE position <= 4")
def _(spark, d):
    return c.related(posts(spark, d), 4, backfill=False)


@query("w9_related_backfilled", f"WITH {_RELATED}, x AS (SELECT a.url, b.url AS other, coalesce(overlap, 0)::BIGINT AS overlap, b.date FROM p a JOIN p b ON a.url <> b.url LEFT JOIN o ON o.url = a.url AND o.other = b.url), r AS (SELECT url, other, overlap, row_number() OVER (PARTITION BY url ORDER BY overlap DESC, date DESC, other) AS position FROM x) SELECT * FROM r WHERE position <= 9")
def _(spark, d):
    return c.related(posts(spark, d), 9)


@query("w18_guides", f"WITH p AS ({POSTS_SQL}), i AS (SELECT DISTINCT lang AS url, ['t1', 't4', 'u' || length(lang)] AS topics FROM documents), t AS (SELECT url, unnest(topics) AS topic, generate_subscripts(topics, 1) AS pos FROM i), q AS (SELECT url AS post, date, unnest(list_distinct(topics)) AS topic FROM p), f AS (SELECT t.url, post, date, min(pos) AS pos FROM t JOIN q USING (topic) GROUP BY ALL), r AS (SELECT url, post, row_number() OVER (PARTITION BY url ORDER BY pos, date DESC, post) AS position FROM f) SELECT * FROM r WHERE position <= 6")
def _(spark, d):
    items = table(spark, d, "documents").select(F.col("lang").alias("url"), F.array(F.lit("t1"), F.lit("t4"), F.concat(F.lit("u"), F.length("lang"))).alias("topics")).distinct()
    return c.guides(items, posts(spark, d))


@query("w11_chapters", f"SELECT url, chapter FROM ({POSTS_SQL}) ORDER BY chapter NULLS LAST, url")
def _(spark, d):
    return c.chapters(posts(spark, d)).select("url", "chapter")


@query("w12_tiers", f"WITH p AS ({POSTS_SQL}) SELECT url, CASE WHEN lang = 'en' AND draft THEN 0 WHEN lang = 'en' THEN 1 WHEN chapter IS NOT NULL THEN 2 ELSE 3 END AS tier FROM p")
def _(spark, d):
    p = posts(spark, d)
    return c.tiered(p, [(F.col("lang") == "en") & F.col("draft"), F.col("lang") == "en", F.col("chapter").isNotNull()]).select("url", "tier")


@query("w19_newest", f"SELECT url, date FROM ({POSTS_SQL}) WHERE NOT draft ORDER BY date DESC, url LIMIT 20")
def _(spark, d):
    return c.newest(posts(spark, d).where("NOT draft"), 20).select("url", "date")


@query("w5_two_per_group", f"WITH r AS (SELECT url, author, date, row_number() OVER (PARTITION BY author ORDER BY date DESC, url) AS n FROM ({POSTS_SQL})) SELECT url, author FROM r WHERE n <= 2")
def _(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("author").orderBy(F.desc("date"), "url")
    return posts(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 2").select("url", "author")


@query("s4_union_of_tiers", f"SELECT grp, count(*) AS n, count(title) AS titled FROM (SELECT 0 AS grp, title FROM ({POSTS_SQL}) UNION ALL SELECT 1, symbol FROM ({SYMBOLS_SQL}) UNION ALL SELECT 2, NULL FROM benchmark) GROUP BY grp")
def _(spark, d):
    a = posts(spark, d).select(F.lit(0).alias("grp"), "title")
    u = a.unionByName(symbols(spark, d).select(F.lit(1).alias("grp"), F.col("symbol").alias("title"))).unionByName(table(spark, d, "benchmark").select(F.lit(2).alias("grp")), allowMissingColumns=True)
    return u.groupBy("grp").agg(F.count("*").alias("n"), F.count("title").alias("titled"))


_S9 = "WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT k, v FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)) WHERE k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"


@query("s9_upsert", _S9)
def _(spark, d):
    o = table(spark, d, "orders")
    part = lambda on: o.where(on).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return c.upsert(part("o_orderstatus <> 'F'"), part("o_orderstatus = 'F'"), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("s9_versioned_upsert", _S9)
def _(spark, d):
    """The same as a second version of a stored table: touched buckets are written, the others taken over."""
    o = table(spark, d, "orders")
    part = lambda on: o.where(on).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    live = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    store = Snapshots(spark, fresh(spark, "prices"), ("k",), 64)
    store.write(part("o_orderstatus <> 'F'"))
    gone = o.select(F.col("o_custkey").alias("k")).distinct().join(live.hint("merge"), "k", "left_anti")
    return store.read(store.upsert(part("o_orderstatus = 'F'"), gone))


@query("io14_symbol_feed", f"SELECT symbol AS name, 'package' AS kind, package, url, summary, deprecated FROM ({SYMBOLS_SQL}) WHERE regexp_matches(url, '^/api/[^/]+/latest/')")
def _(spark, d):
    name, kind = title_parts("symbol")
    s = symbols(spark, d).where(F.col("url").rlike("^/api/[^/]+/latest/"))
    return s.select(name.alias("name"), kind.alias("kind"), "package", "url", "summary", "deprecated").orderBy("name", "url")


@query("io15_post_feed", f"SELECT title, url, author, array_to_string(topics, ',') AS topics, strftime(date, '%Y-%m-%d') AS day FROM ({POSTS_SQL}) WHERE NOT draft")
def _(spark, d):
    return posts(spark, d).where("NOT draft").select("title", "url", "author", F.array_join("topics", ",").alias("topics"), F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("io16_peer_feed", f"SELECT url, false AS external FROM ({POSTS_SQL}) WHERE lang = 'en' UNION ALL SELECT url, true FROM ({POSTS_SQL}) WHERE lang <> 'en'")
def _(spark, d):
    p = posts(spark, d)
    return c.cross_published(p.where("lang = 'en'").select("url"), p.where("lang <> 'en'").select("url"))


@query("io17_archived_inventory", f"WITH r AS ({RELEASES_SQL}) SELECT DISTINCT package || '/' || version AS page FROM r WHERE regexp_matches(version, '^[12]\\.\\d+\\.\\d+$')")
def _(spark, d):
    r = releases(spark, d).where(F.col("version").rlike(r"^[12]\.\d+\.\d+$"))
    return r.select(F.concat_ws("/", "package", "version").alias("page")).distinct().orderBy("page")


@query("io11_index_sizes", f"""SELECT lang, sum(octet_length(encode('{{"title":' || to_json(title) || ',"url":' || to_json(url) || '}}')))::BIGINT AS n_bytes FROM ({POSTS_SQL}) GROUP BY lang""")
def _(spark, d):
    """Bytes of JSON text by group, as the sink writes them within its compressed budget."""
    p = posts(spark, d).select(F.col("lang").alias("grp"), "title", "url")
    return readers.write_index(p, fresh(spark, "index-files"), BUDGET).select(F.col("grp").alias("lang"), "n_bytes")


@query("f14_iso_dates", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")).distinct()


@query("f13_majors", f"SELECT package, CAST(split_part(version, '.', 1) AS INT) AS major, count(*) AS n FROM ({RELEASES_SQL}) GROUP BY ALL")
def _(spark, d):
    from ..functions.text import major

    return releases(spark, d).groupBy("package", major("version").alias("major")).agg(F.count("*").alias("n"))


__all__ = ["base"]
