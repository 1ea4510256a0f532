"""Catalogue facts: releases, dates, orders of pages and related items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import major, version_key
from ..storage import cut


def release_facts(releases: DataFrame) -> DataFrame:
    """releases (package, version, published) -> latest version by number, first and last date, count, majors in order."""
    return releases.groupBy("package").agg(
        F.max_by("version", version_key("version")).alias("latest"), F.min("published").alias("first_published"), F.max("published").alias("last_published"),
        F.count("*").alias("n_releases"), F.array_sort(F.collect_set(major("version"))).alias("majors"),
    )


def version_plan(releases: DataFrame, archives: bool = True) -> DataFrame:
    """(package, latest, archives): the highest release of each past major, newest major first; none if archives is off."""
    w = W.partitionBy("package", major("version")).orderBy(F.desc(version_key("version")))
    top = releases.select("package", "version").distinct().withColumn("rn", F.row_number().over(w)).where("rn = 1")
    g = top.groupBy("package").agg(F.sort_array(F.collect_list(F.struct(version_key("version").alias("v"), "version")), asc=False).alias("xs"))
    names = F.transform("xs", lambda x: x["version"])
    return g.select("package", names[0].alias("latest"), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))).alias("archives") if archives else F.array().cast("array<string>").alias("archives"))


def page_dates(commits: DataFrame) -> DataFrame:
    """commits (path, ts, change) -> published (first add) and modified (last commit)."""
    return commits.groupBy("path").agg(F.min(F.when(F.col("change") == "A", F.col("ts"))).alias("published"), F.max("ts").alias("modified"))


def renamed(commits: DataFrame, limit: int = 6) -> DataFrame:
    """commits (path, ts, change, source) with the path that each page has today: a rename takes the old path's history along, by its last rename. Paths that
    come back or move more than limit times keep their own name."""
    from .graph import follow

    last = cut(commits.where("change = 'R' AND source <> path").groupBy("source").agg(F.max_by("path", F.struct("ts", "path")).alias("target")), "renames")
    moved = last.select(F.col("source").alias("url"))
    to = cut(follow(moved, last, limit).where("problem IS NULL").select(F.col("url").alias("path"), "final"), "renamed")
    return commits.join(to.hint("merge"), "path", "left").select(F.coalesce("final", "path").alias("path"), "ts", "change")


def date_drift(snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """(path, drift) between two tables (path, published, modified): missing, orphaned, published drifted, stale modified."""
    a, b = snapshot.toDF("path", "p0", "m0"), now.toDF("path", "p1", "m1")
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "path", "full")
    drift = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "orphaned").when(~F.col("p0").eqNullSafe(F.col("p1")), "published drifted").when(F.col("m0") < F.col("m1"), "stale modified")
    return j.select("path", drift.alias("drift")).where("drift IS NOT NULL")


def merge_modified(snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """snapshot with the modified dates of now where they are later; publish dates stay."""
    j = snapshot.join(now.select("path", F.col("modified").alias("_m")), "path", "left")
    return j.select("path", "published", F.greatest("modified", "_m").alias("modified"))


def page_lastmod(pages: DataFrame) -> DataFrame:
    return pages.withColumn("lastmod", F.coalesce("released", "modified", "page_date", "date"))


def priority(url):
    """(priority, change frequency) of a page by its url."""
    p = F.when(url == "/", 1.0).when(url.rlike("^/(?:tutorial|get-started)/"), 0.9).when(url.rlike("^/api/"), 0.6).when(url.rlike("^/blog/"), 0.7).otherwise(0.8)
    return p, F.when((url == "/") | url.rlike("^/blog/$"), "weekly").otherwise("monthly")


def stale_records(records: DataFrame, today, days: int = 14) -> DataFrame:
    """records (package, latest, license, checked) with a problem: a field without value, or a check older than days."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"no {c}")) for c in ("latest", "license", "checked")], F.when(F.datediff(F.lit(today).cast("date"), "checked") > days, "old")))
    return records.select("package", F.explode(gaps).alias("problem"))


def field_diff(old: DataFrame, new: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, field, was, now) of the fields that differ, null-safe; rows on one side only differ in every field that has a value."""
    a = old.select(key, *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields])
    b = new.select(key, *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields])
    every = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").alias("was"), F.col(f"_b_{f}").alias("now")) for f in fields])
    return a.join(b, key, "full").select(key, F.explode(every).alias("x")).select(key, "x.*").where(~F.col("was").eqNullSafe(F.col("now")))


def stale_versions(published: DataFrame, documented: DataFrame) -> DataFrame:
    """published (package, latest) against documented (package, version): stale where they differ or nothing is documented."""
    return published.join(documented, "package", "left").withColumn("stale", ~F.col("latest").eqNullSafe(F.col("version")))


#: Topics that an item may have: the work for it is that of all their subsets.
MAX_TOPICS = 12


def _parts_of(key):
    """All subsets of a sorted topic list but the empty one; an item with more than MAX_TOPICS is an error."""
    n = F.when(F.size(key) > MAX_TOPICS, F.raise_error(F.lit(f"an item has more than {MAX_TOPICS} topics"))).otherwise(F.size(key)).cast("int")
    masks = F.when(n > 0, F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(masks, lambda m: F.filter(key, lambda x, i: F.getbit(m, i) == 1))


def _newest_of(items: DataFrame, key: str, n: int) -> DataFrame:
    """(key, top): the n newest items of each key as an array of struct<date, url, ...>; the window's limit is applied before the shuffle, too."""
    w = W.partitionBy(key).orderBy(F.desc("date"), "url")
    rows = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    others = [c for c in items.columns if c != key]
    return rows.groupBy(key).agg(F.collect_list(F.struct(*others)).alias("top"))


def related(items: DataFrame, n: int = 5, backfill: bool = True) -> DataFrame:
    """items (url, date, topics) -> (url, other, overlap, position): others by shared topics, then date, then url; backfill adds others without any.

    Items are asked for by topic set, not one by one. Whoever shares exactly the topics T with an item and is among its n best is among the n + 1 newest that have
    all of T, so those of every subset of a set are all candidates: the work is linear in the items, however many share a topic.
    """
    keyed = items.select("url", "date", F.array_sort(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>")))).alias("key"))
    subset = lambda df: df.select("*", F.explode(_parts_of(F.col("key"))).alias("part"))
    top = _newest_of(subset(keyed).select("part", "date", "url", "key"), "part", n + 1)
    sets = subset(keyed.select("key").distinct()).hint("merge").join(top, "part").select("key", F.explode("top").alias("o")).distinct()
    best = sets.groupBy("key").agg(  # at most n + 1 for each subset
        F.slice(F.array_sort(F.collect_list(F.struct((-F.size(F.array_intersect("key", "o.key"))).alias("o"), (-F.unix_date(F.col("o.date").cast("date"))).alias("d"), F.col("o.url").alias("url")))), 1, n + 1).alias("best")
    )
    x = keyed.select("url", "key").hint("merge").join(best, "key", "left")
    shared = F.transform(F.filter(F.coalesce("best", F.array().cast("array<struct<o:int,d:int,url:string>>")), lambda b: b["url"] != F.col("url")), lambda b: F.struct(b["url"].alias("other"), (-b["o"]).cast("long").alias("overlap")))
    if backfill:
        # At most n of the newest can be the item itself or among its best, so 2 n + 1 of them are enough.
        newest = items.select("date", "url").orderBy(F.desc("date"), "url").limit(2 * n + 1)
        newest = newest.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_date(F.col("date").cast("date"))).alias("d"), "url"))), lambda x: x["url"]).alias("newest"))
        x = x.crossJoin(F.broadcast(newest))  # one row
        rest = F.filter("newest", lambda u: (u != F.col("url")) & ~F.exists(shared, lambda b: b["other"] == u))
        shared = F.concat(shared, F.transform(rest, lambda u: F.struct(u.alias("other"), F.lit(0).cast("long").alias("overlap"))))
    return x.select("url", F.posexplode(F.slice(shared, 1, n)).alias("i", "b")).select("url", "b.other", "b.overlap", (F.col("i") + 1).alias("position"))


def topic_hubs(items: DataFrame, least: int = 3) -> DataFrame:
    t = items.select("url", F.explode(F.array_distinct("topics")).alias("topic"))
    return t.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "topic")


def guides(items: DataFrame, posts: DataFrame, n: int = 6) -> DataFrame:
    """(url, post, position): posts by the order of the item's topics, each once, at most n.

    The n newest posts of each topic are enough, as none of them comes later for having another topic as well; lists of topics are joined once, however many items have them.
    """
    top = _newest_of(posts.select("url", "date", F.explode(F.array_distinct("topics")).alias("topic")), "topic", n)
    lists = items.select("topics").distinct().select("topics", F.posexplode("topics").alias("at", "topic"))
    first = lists.hint("merge").join(top, "topic").select("topics", "at", F.explode("top").alias("p")).groupBy("topics", "p").agg(F.min("at").alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", (-F.unix_date(F.col("p.date").cast("date"))).alias("d"), F.col("p.url").alias("post"))))  # at most n for each topic
    best = first.groupBy("topics").agg(F.slice(order, 1, n).alias("best"))
    out = items.select("url", "topics").hint("merge").join(best, "topics").select("url", F.posexplode("best").alias("i", "b"))
    return out.select("url", "b.post", (F.col("i") + 1).alias("position"))


def chapters(items: DataFrame) -> DataFrame:
    return items.orderBy(F.col("chapter").asc_nulls_last(), "url")


def tiered(items: DataFrame, tiers) -> DataFrame:
    """items (url) in the order of tiers (conditions), then url; each url once, in its first tier; items of no tier go last."""
    tier = F.lit(len(tiers))
    for i, on in reversed(list(enumerate(tiers))):
        tier = F.when(on, i).otherwise(tier)
    w = W.partitionBy("url").orderBy("tier")
    return items.withColumn("tier", tier).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("tier", "url")


def newest(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.desc("date"), "url").limit(n)


def latest_per_bucket(pages: DataFrame) -> DataFrame:
    return pages.groupBy("bucket").agg(F.max("lastmod").alias("lastmod"), F.count("*").alias("n"))


def shared_names(symbols: DataFrame) -> DataFrame:
    """symbols (package, symbol, signature) -> names that several packages have, and whether their signatures are one."""
    return symbols.groupBy("symbol").agg(F.countDistinct("package").alias("n_packages"), F.countDistinct("signature").alias("n_signatures")).where("n_packages > 1").withColumn("identical", F.col("n_signatures") == 1)


def coverage(symbols: DataFrame, floor: float) -> DataFrame:
    """(package, n, pct, ok): share of symbols with prose."""
    g = symbols.groupBy("package").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.when(F.coalesce("summary", F.lit("")) != "", 1.0).otherwise(0.0)), 6).alias("pct"))
    return g.withColumn("ok", F.col("pct") >= floor)


def upsert(old: DataFrame, new: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Rows of new keys, rows of old for other keys, and only keys that are live."""
    carried = old.join(new.select(key).distinct(), key, "left_anti")
    return carried.unionByName(new).join(live.select(key).distinct(), key, "left_semi")


def cross_published(one: DataFrame, two: DataFrame | None) -> DataFrame:
    """Both feeds with external telling which are the peer's; a missing peer gives the own feed alone."""
    own = one.withColumn("external", F.lit(False))
    return own if two is None else own.unionByName(two.withColumn("external", F.lit(True)), allowMissingColumns=True)
