"""Registered queries over links, redirects and page sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import url_path
from ..operators import graph as g
from ..operators import redirects as rd
from .base import EDGES_SQL, page_edges, query, table

PLAN = (("core", "3.4.2", ("2.0.26", "1.15.0")), ("rpc", "3.7.2", ("2.1.0", "1.17.1")), ("cache", "5.1.2", ()), ("net", "1.0.3", ()))
RENAMED = (("old-cache", "cache"), ("gone", "nowhere"))


def plan(spark):
    return spark.createDataFrame([(p, v, list(a)) for p, v, a in PLAN], "package string, latest string, archives array<string>"), spark.createDataFrame(list(RENAMED), "old string, package string")


def api_urls(spark, d):
    """Versioned paths by fixed arithmetic on orders."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pkg = F.element_at(F.array(*[F.lit(x) for x in ("core", "rpc", "cache", "net", "old-cache", "other")]), (k % 6 + 1).cast("int"))
    seg = F.when(k % 5 == 0, "latest").when(k % 7 == 0, "2.0.26").otherwise(F.concat(k % 6, F.lit("."), k % 3, F.lit("."), k % 9))
    tail = F.when(k % 4 == 0, "/").when(k % 4 == 1, F.concat(F.lit("/"), pkg, F.lit("."), k % 11, F.lit("/"))).when(k % 4 == 2, F.concat(F.lit("/"), pkg, F.lit("/"))).otherwise("/")
    return o.select(F.when(k % 10 == 9, F.concat(F.lit("/api/"), pkg, F.lit("/"))).otherwise(F.concat(F.lit("/api/"), pkg, F.lit("/"), seg, tail)).alias("path"), F.when(k % 3 == 0, 404).otherwise(200).alias("status")).distinct()


API_SQL = """u0 AS (SELECT o_orderkey AS k, (['core', 'rpc', 'cache', 'net', 'old-cache', 'other'])[o_orderkey % 6 + 1] AS pkg FROM orders),
u AS (SELECT DISTINCT CASE WHEN k % 10 = 9 THEN '/api/' || pkg || '/' ELSE '/api/' || pkg || '/' || CASE WHEN k % 5 = 0 THEN 'latest' WHEN k % 7 = 0 THEN '2.0.26' ELSE (k % 6) || '.' || (k % 3) || '.' || (k % 9) END ||
  CASE WHEN k % 4 = 0 THEN '/' WHEN k % 4 = 1 THEN '/' || pkg || '.' || (k % 11) || '/' WHEN k % 4 = 2 THEN '/' || pkg || '/' ELSE '/' END END AS path, CASE WHEN k % 3 = 0 THEN 404 ELSE 200 END AS status FROM u0),
pl AS (SELECT * FROM (VALUES ('core', '3.4.2', ['2.0.26', '1.15.0']), ('rpc', '3.7.2', ['2.1.0', '1.17.1']), ('cache', '5.1.2', []::VARCHAR[]), ('net', '1.0.3', []::VARCHAR[])) t(package, latest, archives)),
rn AS (SELECT * FROM (VALUES ('old-cache', 'cache')) t(old, npkg)),
p AS (SELECT path, status, regexp_extract(path, '^/api/([^/]+)', 1) AS pkg, regexp_extract(path, '^/api/[^/]+/([^/]+)', 1) AS seg, regexp_extract(path, '^/api/[^/]+/[^/]+(/.*)$', 1) AS rest FROM u),
j AS (SELECT p.*, latest, archives, npkg, list_filter(string_split(rest, '/'), lambda s: s <> '') AS parts, rest IN ('/' || pkg || '/', '/' || pkg) AS dupe FROM p LEFT JOIN pl ON package = pkg LEFT JOIN rn ON old = pkg),
x AS (SELECT *, CASE WHEN len(parts) > 0 THEN parts[-1] ELSE '' END AS page, CASE WHEN dupe OR rest = '' THEN '/' ELSE rest END AS tail, seg = 'latest' OR coalesce(list_contains(archives, seg), false) AS kept, TRY_CAST(split_part(seg, '.', 1) AS INT) AS mj,
  CAST(split_part(latest, '.', 1) AS INT) AS ml FROM j),
y AS (SELECT *, list_filter(archives, lambda a: CAST(split_part(a, '.', 1) AS INT) = mj)[1] AS arch FROM x),
rv AS (SELECT path, status, CASE WHEN npkg IS NOT NULL THEN CASE WHEN page = '' OR page = pkg THEN '/api/' || npkg || '/latest/' ELSE '/api/' || npkg || '/latest/' || CASE WHEN starts_with(page, pkg || '.') THEN npkg || substr(page, length(pkg) + 1) ELSE page END || '/' END
  WHEN latest IS NULL THEN NULL WHEN seg = '' THEN '/api/' || pkg || '/latest/' WHEN kept AND dupe THEN '/api/' || pkg || '/' || seg || '/' WHEN kept OR NOT regexp_matches(seg, '^\\d+\\.\\d+\\.\\d+$') THEN NULL
  WHEN mj = ml THEN '/api/' || pkg || '/latest' || tail WHEN arch IS NOT NULL THEN '/api/' || pkg || '/' || arch || tail ELSE '/api/' || pkg || '/latest/' END AS target FROM y)"""


@query("rd1_versioned", f"WITH {API_SQL} SELECT path, status, target FROM rv")
def _(spark, d):
    return rd.versioned(api_urls(spark, d), *plan(spark))


@query("rd2_renamed", f"WITH {API_SQL} SELECT path, status, target FROM rv WHERE starts_with(path, '/api/old-cache/')")
def _(spark, d):
    return rd.versioned(api_urls(spark, d).where("path LIKE '/api/old-cache/%'"), *plan(spark))


@query("rd7_replay_audit")
def _(spark, d):
    u = api_urls(spark, d)
    pages = rd.versioned(u, *plan(spark)).where("target IS NOT NULL").select(F.col("target").alias("path")).distinct().where(F.pmod(F.xxhash64("path"), F.lit(3)) > 0)
    return rd.audit(u.select("path").distinct(), pages, *plan(spark))


def _legacy(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("classes", "interfaces", "modules", "enums")]), (k % 4 + 1).cast("int"))
    return p.select(F.when(k % 5 == 0, F.concat(F.lit("/api/rpc/latest/rpc."), F.lit("Sym"), k % 9, F.lit("/"))).otherwise(F.concat(F.lit("/api/core/1.15.0/"), kind, F.lit("/Item"), k % 50, F.lit(".html"))).alias("path"), F.lit(404).alias("status")).distinct()


def _side_tables(spark):
    ex = spark.createDataFrame([("rpc", "core", f"sym{i}") for i in range(0, 9, 2)], "from_package string, to_package string, symbol string")
    moved = spark.createDataFrame([("rpc/latest/rpc.sym1", "rpc/latest/rpc.symbol")], "old string, new string")
    arch = spark.createDataFrame([(f"core/1.15.0/core.item{i}",) for i in range(0, 50, 3)], "page string")
    return ex, moved, arch


_LEGACY_SQL = """lu AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN '/api/rpc/latest/rpc.Sym' || (p_partkey % 9) || '/' ELSE '/api/core/1.15.0/' || (['classes', 'interfaces', 'modules', 'enums'])[p_partkey % 4 + 1] || '/Item' || (p_partkey % 50) || '.html' END AS path FROM part),
lx AS (SELECT path, TRY_CAST(regexp_extract(path, 'Sym(\\d+)/', 1) AS INT) AS sym, TRY_CAST(regexp_extract(path, 'Item(\\d+)[.]html', 1) AS INT) AS item FROM lu)"""
_SALVAGE = """CASE WHEN sym % 2 = 0 THEN '/api/core/latest/core.sym' || sym || '/' WHEN sym = 1 THEN '/api/rpc/latest/rpc.symbol/' WHEN sym IS NOT NULL THEN NULL
 WHEN contains(path, '/modules/') THEN '/api/core/1.15.0/' WHEN item % 3 = 0 THEN '/api/core/1.15.0/core.item' || item || '/' ELSE '/api/core/1.15.0/' END"""


@query("rd3_rd4_rd5_salvage", f"WITH {_LEGACY_SQL} SELECT path, 404 AS status, {_SALVAGE} AS salvage FROM lx")
def _(spark, d):
    return rd.salvaged(_legacy(spark, d), *_side_tables(spark))


@query("rd6_resolution", f"WITH {_LEGACY_SQL}, {API_SQL} SELECT path, 404 AS status, {_SALVAGE} AS location FROM lx UNION ALL SELECT path, status, target FROM rv")
def _(spark, d):
    return rd.resolve(_legacy(spark, d).unionByName(api_urls(spark, d)), *plan(spark), *_side_tables(spark))


RULES = (("/api/core/1.3.0/*", "/api/core/1.15.0/:splat", 301), ("/api/core/*", "/core/:splat", 302), ("/api/rpc/latest/", "/rpc/", 301), ("/api/net/*", "/net/", 301), ("/api/*", "/all/:splat", 308))


@query("rd8_rules", f"""WITH {API_SQL}, r AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}', '{t}', {c})" for i, (s, t, c) in enumerate(RULES))}) t(i, src, tgt, code)),
h AS (SELECT path, arg_min({{'l': CASE WHEN ends_with(src, '/*') THEN replace(tgt, ':splat', substr(path, length(src))) ELSE tgt END, 'c': code}}, i) AS m FROM (SELECT DISTINCT path FROM u) JOIN r ON CASE WHEN ends_with(src, '/*') THEN starts_with(path, substr(src, 1, length(src) - 1)) ELSE path = src END GROUP BY path)
SELECT u.path, m.l AS location, m.c AS status FROM (SELECT DISTINCT path FROM u) u LEFT JOIN h USING (path)""")
def _(spark, d):
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule_idx int, source string, target string, status int")
    return rd.apply_rules(api_urls(spark, d).select("path").distinct(), rules)


_E = r"""e0 AS (SELECT url AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)<(?:a|area|link|img|script|iframe|source)\b[^>]*?\s(?:href|src)="([^"]*)"', 1))) AS raw FROM pages),
e1 AS (SELECT src, raw, regexp_extract(src, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin, coalesce(nullif(regexp_extract(src, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM e0),
e2 AS (SELECT src, raw, CASE WHEN regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN raw WHEN starts_with(raw, '//') THEN regexp_extract(src, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || raw WHEN starts_with(raw, '/') THEN origin || raw WHEN starts_with(raw, '#') OR raw = '' THEN regexp_replace(src, '#.*$', '') || raw ELSE origin || regexp_replace(path, '[^/]*$', '') || raw END AS "full" FROM e1),
e3 AS (SELECT src, raw, regexp_replace("full", '#.*$', '') AS dst, regexp_extract("full", '#(.*)$', 1) AS frag FROM e2),
e4 AS (SELECT *, regexp_replace(lower(regexp_extract(dst, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS dh, regexp_replace(lower(regexp_extract(src, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS sh FROM e3)"""


@query("gr1_link_kinds", f"WITH {_E} SELECT src, raw, dst, frag, CASE WHEN regexp_matches(raw, '(?i)^(?:mailto|tel|javascript|data):') THEN 'ignored' WHEN starts_with(raw, '#') THEN 'same-page' WHEN dh = sh THEN 'internal' ELSE 'external' END AS kind FROM e4")
def _(spark, d):
    return g.edges(table(spark, d, "pages"))


@query("gr2_reachable", f"""WITH RECURSIVE e AS ({EDGES_SQL}), r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 64) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def _(spark, d):
    return g.reachable(page_edges(spark, d), spark.createDataFrame([(0,)], "node long"))


@query("gr3_redirect_chains", """WITH h AS (SELECT page_id AS s, page_id - 1 AS t FROM pages WHERE page_id % 10 <> 0), x AS (SELECT page_id AS url, least(page_id % 10, 6) AS n FROM pages) SELECT url, url - n AS final, CAST(n AS INT) AS n_hops, CASE WHEN url % 10 > 6 THEN 'too many redirects' END AS problem FROM x""")
def _(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("url"))
    return g.follow(p, p.where("url % 10 <> 0").select(F.col("url").alias("source"), (F.col("url") - 1).alias("target")))


_IDS = "ids AS (SELECT page_id AS url, 'p' || (page_id % 4) AS id FROM pages)"


def _typed_edges(spark, d):
    e = page_edges(spark, d)
    p = table(spark, d, "pages").select(F.col("page_id").alias("url"))
    return e.withColumn("frag", F.when(F.col("src") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("src") % 4))), p, p.select("url", F.concat(F.lit("p"), F.col("url") % 4).alias("id"))


_STATUS = f"WITH e AS ({EDGES_SQL}), f AS (SELECT src, dst, CASE WHEN src % 3 = 0 THEN '' ELSE 'p' || (src % 4) END AS frag FROM e), {_IDS}, st AS (SELECT f.*, CASE WHEN p.page_id IS NULL THEN 'status 404' WHEN frag <> '' AND ids.id IS NULL THEN 'missing anchor' END AS reason FROM f LEFT JOIN pages p ON p.page_id = dst LEFT JOIN ids ON ids.url = dst AND ids.id = frag)"


@query("j10_link_status", f"{_STATUS} SELECT src, dst, frag, reason FROM st")
def _(spark, d):
    return g.link_status(*_typed_edges(spark, d)).select("src", "dst", "frag", "reason")


@query("gr4_broken_links", f"{_STATUS} SELECT DISTINCT src, dst, reason FROM st WHERE reason IS NOT NULL")
def _(spark, d):
    return g.broken(*_typed_edges(spark, d))


@query("ag25_broken_by_page", f"{_STATUS} SELECT src, count(*) AS n, string_agg(dst || ' ' || reason, ',' ORDER BY dst || ' ' || reason) AS broken FROM (SELECT DISTINCT src, dst, reason FROM st WHERE reason IS NOT NULL) GROUP BY src")
def _(spark, d):
    b = g.broken(*_typed_edges(spark, d)).withColumn("x", F.concat("dst", F.lit(" "), "reason"))
    return b.groupBy("src").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("x")), ",").alias("broken"))


@query("j9_dangling_deep_links", f"{_STATUS} SELECT DISTINCT dst, frag FROM st WHERE reason = 'missing anchor'")
def _(spark, d):
    e, _, ids = _typed_edges(spark, d)
    p = table(spark, d, "pages").select(F.col("page_id").alias("dst"))
    deep = e.where("frag <> ''").hint("merge").join(p, "dst", "left_semi").select("dst", "frag").distinct()
    return deep.hint("merge").join(ids.toDF("dst", "frag"), ["dst", "frag"], "left_anti")


_NEXT = """linked AS (SELECT p.url, p.html || '<a href="' || n.url || '">next</a>' AS html FROM pages p JOIN pages n ON n.page_id = p.page_id + 1)"""


@query("gr5_external", f"WITH {_NEXT}, {_E.replace('FROM pages', 'FROM linked')}, x AS (SELECT dst, dh AS host FROM e4 WHERE dh <> sh) SELECT dst, host, host = 'example.com' OR ends_with(host, '.example.com') AS allowed, count(*) AS n_links FROM x GROUP BY ALL")
def _(spark, d):
    """Every page links the next one, which is on another host as a rule."""
    p = table(spark, d, "pages").select("page_id", "url", "html")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("to"))
    linked = p.join(nxt.hint("merge"), "page_id").select("url", F.concat("html", F.lit('<a href="'), "to", F.lit('">next</a>')).alias("html"))
    return g.external_inventory(g.edges(linked), spark.createDataFrame([("example.com",)], "host string"))


_BARE = "regexp_replace(url, '[?#].*$', '')"


@query("ag14_duplicate_urls", "SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS url, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    """Paths that pages of several hosts claim."""
    return g.duplicates(table(spark, d, "pages").select(url_path("url").alias("url")), "url")


_MAP = f"sm AS (SELECT {_BARE} || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END AS loc FROM pages WHERE page_id % 4 <> 1), pg AS (SELECT DISTINCT {_BARE} || '/' AS url, bool_or(page_id % 9 = 0) OVER (PARTITION BY {_BARE}) AS noindex FROM pages)"


@query("gr6_sitemap_audit", f"""WITH {_MAP}, n AS (SELECT loc, count(*) AS n FROM sm GROUP BY loc), j AS (SELECT n.*, noindex FROM n LEFT JOIN pg ON loc = url),
pr AS (SELECT loc, unnest(list_filter([CASE WHEN NOT starts_with(loc, 'http://') THEN 'foreign origin' END, CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN NOT ends_with(loc, '/') THEN 'shape' END, CASE WHEN starts_with(loc, 'http://') AND noindex IS NULL THEN 'missing' END, CASE WHEN noindex THEN 'noindex' END], lambda x: x IS NOT NULL)) AS problem FROM j)
SELECT loc, problem FROM pr UNION ALL SELECT url, 'unlisted' FROM pg WHERE NOT noindex AND url NOT IN (SELECT loc FROM sm)""")
def _(spark, d):
    p = table(spark, d, "pages").withColumn("bare", F.regexp_replace("url", "[?#].*$", ""))
    sm = p.where("page_id % 4 <> 1").select(F.concat("bare", F.when(F.col("page_id") % 3 == 0, "/").otherwise("")).alias("loc"))
    pg = p.groupBy(F.concat("bare", F.lit("/")).alias("url")).agg(F.max(F.col("page_id") % 9 == 0).alias("noindex"))
    return g.sitemap_audit(sm, pg, "http:/")


@query("j7_sitemap_vs_index", "WITH a AS (SELECT url FROM pages WHERE page_id % 3 <> 0), b AS (SELECT url FROM pages WHERE page_id % 4 <> 0) SELECT url, 'missing' AS side FROM (SELECT url FROM a EXCEPT SELECT url FROM b) UNION ALL SELECT url, 'extra' FROM (SELECT url FROM b EXCEPT SELECT url FROM a)")
def _(spark, d):
    p = table(spark, d, "pages")
    return g.set_diff(p.where("page_id % 3 <> 0"), p.where("page_id % 4 <> 0"), "url")


@query("j8_stale_records", f"SELECT DISTINCT {_BARE} AS url FROM pages WHERE page_id % 2 = 0 AND {_BARE} NOT IN (SELECT {_BARE} FROM pages WHERE page_id % 2 = 1)")
def _(spark, d):
    p = table(spark, d, "pages").withColumn("url", F.regexp_replace("url", "[?#].*$", ""))
    return p.where("page_id % 2 = 0").select("url").distinct().join(p.where("page_id % 2 = 1").select("url"), "url", "left_anti")


@query("s5_submitted", "SELECT url FROM pages WHERE page_id % 2 = 0 AND NOT contains(url, '.net') EXCEPT SELECT url FROM pages WHERE page_id % 6 = 0")
def _(spark, d):
    p = table(spark, d, "pages")
    return p.where("page_id % 2 = 0").where(~F.col("url").contains(".net")).select("url").subtract(p.where("page_id % 6 = 0").select("url"))


@query("s6_unlisted", "SELECT url FROM pages WHERE page_id % 2 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")
def _(spark, d):
    p = table(spark, d, "pages")
    return p.where("page_id % 2 = 0").select("url").join(p.where("page_id % 5 = 0").select("url"), "url", "left_anti")


@query("s7_twins", "SELECT CAST(page_id AS VARCHAR) AS key FROM pages WHERE page_id % 7 = 0 OR (page_id % 5 = 0 AND html <> upper(html))")
def _(spark, d):
    p = table(spark, d, "pages")
    left = p.select(F.concat(F.lit("/a/"), "page_id").alias("path"), F.col("html").alias("content"))
    right = p.where("page_id % 7 <> 0").select(F.concat(F.lit("/b/"), "page_id").alias("path"), F.when(F.col("page_id") % 5 == 0, F.upper("html")).otherwise(F.col("html")).alias("content"))
    return g.twin_differences(left.unionByName(right), "/a/", "/b/").select("key")


def structured(spark, d):
    """Blocks by fixed arithmetic on pages: some are broken, some pages have none, some nodes refer to others that are not there, ids contradict each other."""
    i = F.col("page_id")
    graph = F.concat(F.lit('{"@graph":[{"@id":"#a","@type":"Person","name":"n'), i % 3, F.lit('"},{"@id":"#b","@type":"Article","author":{"@id":"#'), F.when(i % 3 == 0, "a").otherwise("zz"), F.lit('"},"about":{"@id":"/of/'), i % 4, F.lit('"}}]}'))
    block = F.when(i % 11 == 0, "{broken").when(i % 2 == 0, graph).otherwise(F.concat(F.lit('{"@id":"#p'), i % 5, F.lit('","@type":"Person"}')))
    pages = table(spark, d, "pages").select(F.concat(F.lit("/of/"), i % 3, F.lit("/"), i).alias("url"), i)
    return pages, g.json_nodes(pages.where("page_id % 13 <> 0").select("url", block.alias("block")))


_NODES = """pg AS (SELECT page_id AS i, '/of/' || (page_id % 3) || '/' || page_id AS url FROM pages), bl AS (SELECT * FROM pg WHERE i % 13 <> 0), ok AS (SELECT * FROM bl WHERE i % 11 <> 0), ev AS (SELECT * FROM ok WHERE i % 2 = 0), od AS (SELECT * FROM ok WHERE i % 2 = 1)"""


@query("gr10_structured_data", f"""WITH {_NODES}, un AS (SELECT url, NULL AS id, 'unparseable' AS problem FROM bl WHERE i % 11 = 0 UNION ALL SELECT url, '#zz', 'dangling' FROM ev WHERE i % 3 <> 0 UNION ALL SELECT url, '/of/' || (i % 4), 'dangling' FROM ev
UNION ALL SELECT min(url), '#a', 'contradicting' FROM ev HAVING count(DISTINCT i % 3) > 1 UNION ALL SELECT min(url), '#b', 'contradicting' FROM ev HAVING count(DISTINCT (i % 3 = 0, i % 4)) > 1
UNION ALL SELECT url, '#p' || (i % 5), 'anonymous person' FROM od UNION ALL SELECT url, NULL, 'missing' FROM pg WHERE i % 13 = 0 UNION ALL SELECT url, '#b', 'wrong about' FROM ev WHERE i % 4 <> i % 3) SELECT DISTINCT * FROM un""")
def _(spark, d):
    pages, nodes = structured(spark, d)
    return g.json_audit(nodes, ("email",), pages, ("Article", "^(/of/[0-9]+)/.*$", "$1"))


@query("ag17_node_types", f"WITH {_NODES} SELECT type, sum(n)::BIGINT AS n FROM (SELECT 'Person' AS type, count(*) AS n FROM ok UNION ALL SELECT 'Article', count(*) FROM ev) GROUP BY type HAVING sum(n) > 0 ORDER BY n DESC, type LIMIT 8")
def _(spark, d):
    """The eight most frequent types; the cut is the feature."""
    return g.node_types(structured(spark, d)[1]).orderBy(F.desc("n"), "type").limit(8)


@query("gr7_index_audit", """WITH p AS (SELECT page_id AS i, '/p/' || page_id AS url FROM pages), r AS (SELECT '/p/' || (i + CASE WHEN i % 10 = 0 THEN 100000 ELSE 0 END) AS url, CASE WHEN i % 13 = 0 THEN '' ELSE 't' END AS title FROM p),
f AS (SELECT i, url, i % 8 AS e, (i % 3 = 0)::INT AS a, (i % 6 = 0)::INT AS b FROM p),
un AS (SELECT url, 'stale' AS problem FROM r WHERE url NOT IN (SELECT url FROM p) UNION ALL SELECT url, 'dangling anchor' FROM p WHERE i % 3 <> 1 UNION ALL SELECT url, 'malformed' FROM r WHERE title = '' UNION ALL SELECT url, 'range' FROM p WHERE i % 8 < 3
UNION ALL SELECT url, 'not covered' FROM p WHERE url NOT IN (SELECT url FROM r) UNION ALL SELECT url, CASE WHEN i % 17 = 0 THEN 'no mirror' WHEN i % 4 = 0 THEN 'no heading' ELSE 'unbalanced fence' END FROM f
WHERE e > 3 AND (i % 17 = 0 OR i % 4 = 0 OR (CASE WHEN e > 4 THEN a ELSE 0 END + CASE WHEN e > 6 THEN b ELSE 0 END) % 2 = 1)) SELECT DISTINCT * FROM un""")
def _(spark, d):
    """Records, ranges and mirrors by fixed arithmetic on pages: mirrors of ten lines with a heading on line 3 and fences on lines 4 and 6, each on some pages only."""
    p, i, no = table(spark, d, "pages"), F.col("page_id"), F.col("no")
    url = F.concat(F.lit("/p/"), i).alias("url")
    pages = p.select(url)
    recs = p.select(F.concat(F.lit("/p/"), i + F.when(i % 10 == 0, 100_000).otherwise(0)).alias("url"), F.when(i % 13 == 0, "").otherwise("t").alias("title"))
    secs = p.select(url, F.concat(F.lit("s"), i % 3).alias("anchor"), F.lit(3).alias("start"), (i % 8).cast("int").alias("end"))
    line = F.when((no == 3) & (i % 4 != 0), "## part").when(((no == 4) & (i % 3 == 0)) | ((no == 6) & (i % 6 == 0)), "```").otherwise("text")
    lines = p.where("page_id % 17 <> 0").select("page_id", url, F.explode(F.sequence(F.lit(0), F.lit(9))).alias("no")).select("url", "no", line.alias("line"))
    return g.index_audit(recs, secs, pages, pages.select("url", F.lit("s1").alias("id")), lines)
