"""Registered queries over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import half_hour, has_mirror, slug, url_host, visitor_digest
from ..operators import traffic as t
from ..storage import fresh, stored
from .base import REQUESTS_SQL, query, requests

SALT = "pepper"


def _case(column: str, rules, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN " + (f"'{v}'" if v is not None else "NULL") for p, v in rules) + f" ELSE {default} END"


def _under(host: str, suffixes) -> str:
    return "(" + " OR ".join(f"{host} = '{s}' OR ends_with({host}, '.{s}')" for s in suffixes) + ")"


_FAMILY = [_case("user_agent", [(f"(?i){a[0]}", a[k]) for a in t.AGENTS]) for k in (1, 2, 3)]
_BRAND = "CASE WHEN " + _under("h", ("example.org", "example.com")) + " THEN 'internal' " + " ".join(f"WHEN {_under('h', hs)} THEN '{b}'" for b, hs in t.BRANDS) + " ELSE 'other' END"
AGENT_SQL = f"""req AS ({REQUESTS_SQL}),
a0 AS (SELECT *, CASE WHEN user_agent = '' THEN 'no-user-agent' ELSE {_FAMILY[0]} END AS c0, CASE WHEN user_agent = '' THEN 'Unidentified' ELSE {_FAMILY[1]} END AS o0,
  CASE WHEN user_agent = '' THEN NULL ELSE {_FAMILY[2]} END AS k0, {_case('path', t.SURFACES)} AS s0, regexp_matches(user_agent, '{t.SELF_DECLARED_BOT}') AS botish,
  CASE WHEN sec_fetch_dest <> '' THEN sec_fetch_dest = 'document' ELSE contains(accept, 'text/html') END AS document FROM req),
a1 AS (SELECT *, c0 IS NULL AND NOT botish AND document AND contains(user_agent, 'Mozilla/') AS browser FROM a0),
a2 AS (SELECT *, c0 IS NOT NULL OR s0 IS NOT NULL OR browser OR botish AS counted FROM a1),
agents AS (SELECT event_id, ts, host, path, user_agent, referrer, ip, cookie, status, browser,
  CASE WHEN counted THEN coalesce(c0, CASE WHEN browser THEN 'browser' WHEN botish THEN 'unnamed-bot' ELSE 'unclassified' END) END AS crawler,
  CASE WHEN counted THEN coalesce(o0, CASE WHEN browser THEN 'Browser' ELSE 'Unidentified' END) END AS operator,
  CASE WHEN counted THEN coalesce(k0, CASE WHEN c0 IS NULL AND browser THEN 'user' END, CASE WHEN botish THEN 'unknown' WHEN s0 IN ('markdown-mirror','llms.txt','llms-full.txt','symbol-index') THEN 'assistant.other' ELSE 'unknown' END) END AS kind,
  CASE WHEN counted THEN coalesce(s0, 'html') END AS surface FROM a2)"""
REFERRER_SQL = f"""r0 AS (SELECT *, regexp_replace(lower(regexp_extract(referrer, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS h FROM agents),
refs AS (SELECT *, CASE WHEN referrer = '' THEN 'none' WHEN h = '' THEN 'invalid' ELSE h END AS referrer_host, CASE WHEN referrer = '' THEN 'none' WHEN h = '' THEN 'other' ELSE {_BRAND} END AS ai_source FROM r0)"""
_SLUG = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
VISITS_SQL = f"""WITH {AGENT_SQL}, {REFERRER_SQL},
v0 AS (SELECT *, CASE WHEN browser THEN substr(sha256(ip || chr(10) || user_agent || chr(10) || '{SALT}'), 1, 32) END AS visitor FROM refs WHERE kind IS NOT NULL),
visits AS (SELECT event_id, ts, coalesce(CASE WHEN browser THEN nullif(regexp_extract(cookie, '(?:^|;\\s*)_ga=GA\\d+\\.\\d+\\.(\\d+\\.\\d+)', 1), '') END, visitor, {_SLUG('operator')} || '.' || {_SLUG('crawler')}) AS client_id,
  coalesce(substr(visitor, 1, 16), {_SLUG('crawler')}) || '-' || ((epoch_us(ts) // 1000) // 1800000) AS visit_id, crawler, operator, kind, surface, CAST(status AS VARCHAR) AS status,
  CASE WHEN ends_with(host, '.com') THEN 'com' ELSE 'org' END AS edition, path, nullif(referrer, '') AS page_referrer, referrer_host, ai_source FROM v0)
"""


def _visits(spark, d):
    return t.visits(requests(spark, d), SALT)


@query("tr1_agent_classes", f"WITH {AGENT_SQL} SELECT event_id, crawler, operator, kind, surface, browser FROM agents")
def _(spark, d):
    return t.with_agent(requests(spark, d)).select("event_id", "crawler", "operator", "kind", "surface", "browser")


@query("tr2_surfaces", f"WITH req AS ({REQUESTS_SQL}) SELECT coalesce({_case('path', t.SURFACES)}, 'html') AS surface, count(*) AS n FROM req GROUP BY 1")
def _(spark, d):
    return requests(spark, d).groupBy(F.coalesce(t.first_match(F.col("path"), t.SURFACES), F.lit("html")).alias("surface")).agg(F.count("*").alias("n"))


@query("tr3_client_flags", f"WITH {AGENT_SQL} SELECT browser, botish, document, count(*) AS n FROM a1 GROUP BY ALL")
def _(spark, d):
    r = t.with_agent(requests(spark, d))
    document = F.when(F.col("sec_fetch_dest") != "", F.col("sec_fetch_dest") == "document").otherwise(F.col("accept").contains("text/html"))
    return r.groupBy("browser", F.col("user_agent").rlike(t.SELF_DECLARED_BOT).alias("botish"), document.alias("document")).agg(F.count("*").alias("n"))


@query("tr4_kinds", f"WITH {AGENT_SQL} SELECT kind, crawler, count(*) AS n FROM agents WHERE kind IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return t.with_agent(requests(spark, d)).where("kind IS NOT NULL").groupBy("kind", "crawler").agg(F.count("*").alias("n"))


@query("tr5_referrers", f"WITH {AGENT_SQL}, {REFERRER_SQL} SELECT referrer, referrer_host, ai_source, count(*) AS n FROM refs GROUP BY ALL")
def _(spark, d):
    r = t.with_referrer(requests(spark, d), ("example.org", "example.com"))
    return r.groupBy("referrer", "referrer_host", "ai_source").agg(F.count("*").alias("n"))


@query("tr6_visitors", f"WITH req AS ({REQUESTS_SQL}) SELECT substr(sha256(ip || chr(10) || user_agent || chr(10) || '{SALT}'), 1, 32) AS visitor, count(*) AS n FROM req GROUP BY 1")
def _(spark, d):
    return requests(spark, d).groupBy(visitor_digest("ip", "user_agent", SALT).alias("visitor")).agg(F.count("*").alias("n"))


@query("tr7_half_hours", "SELECT (epoch_us(ts) // 1000) // 1800000 AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, d):
    from .base import table

    return table(spark, d, "events").groupBy(half_hour("ts").alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("tr8_editions", f"WITH req AS ({REQUESTS_SQL}) SELECT CASE WHEN ends_with(host, '.com') THEN 'com' ELSE 'org' END AS edition, status, count(*) AS n FROM req GROUP BY ALL")
def _(spark, d):
    return requests(spark, d).groupBy(F.when(F.col("host").endswith(".com"), "com").otherwise("org").alias("edition"), "status").agg(F.count("*").alias("n"))


@query("tr9_visits", VISITS_SQL + "SELECT * EXCLUDE (ts), (epoch_us(ts) // 1000) AS ts_ms FROM visits")
def _(spark, d):
    return _visits(spark, d).withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


_TR10 = VISITS_SQL + "SELECT (epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) // 1000) AS window_ms, kind, surface, count(*) AS n_events FROM visits GROUP BY ALL"


@query("tr10_half_hour_rollup", _TR10)
def _(spark, d):
    return t.tumbling(_visits(spark, d), "kind", "surface").select(F.unix_millis("window_start").alias("window_ms"), "kind", "surface", "n_events")


@query("tr10_stream_accounts", _TR10)
def _(spark, d):
    """The visits as a stream of files in an order that brings most of them late: closed, open and late rows add up to the batch's counts."""
    from ..streaming import traffic as st

    path = fresh(spark, "visit-stream")
    for part in range(2):
        _visits(spark, d).where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    visits = _visits(spark, d)
    source = spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    st.split_late(source, f"{path}/split", f"{path}/cp-split").awaitTermination()
    counts = st.window_counts(st.on_time_stream(spark, f"{path}/split", visits.schema), "kind", "surface")
    st.write(counts, f"{path}/counts", f"{path}/cp-counts").awaitTermination()
    all_ = st.accounted(spark, f"{path}/split", f"{path}/counts", f"{path}/cp-counts", "kind", "surface")
    return all_.select(F.unix_millis("window_start").alias("window_ms"), "kind", "surface", (F.col("n_closed") + F.col("n_open") + F.col("n_late")).alias("n_events"))


@query("ag24_traffic_rollup", VISITS_SQL + "SELECT kind, crawler, operator, surface, status, edition, ai_source, count(*) AS n_events, count(DISTINCT visit_id) AS n_sessions FROM visits GROUP BY ALL")
def _(spark, d):
    return t.rollup(_visits(spark, d), *t.DIMENSIONS)


@query("ag24_traffic_cube", VISITS_SQL + "SELECT kind, edition, count(*) AS n_events, count(DISTINCT visit_id) AS n_sessions FROM visits GROUP BY CUBE (kind, edition)")
def _(spark, d):
    return _visits(spark, d).cube("kind", "edition").agg(F.count("*").alias("n_events"), F.countDistinct("visit_id").alias("n_sessions"))


def _sketches(spark, d):
    """Half-hour sketches of the visits. Stored."""
    return stored(spark, "visit-sketches", (f"{d}/events.parquet",), lambda: t.half_hour_sketches(_visits(spark, d), "kind", "edition"))


@query("ag24_sketched_cube")
def _(spark, d):
    """The cube from stored half hours."""
    return t.sketched_cube(_sketches(spark, d), "kind", "edition")


@query("ag24_sketch_error", VISITS_SQL + "SELECT kind, edition, count(*) AS n_events, count(DISTINCT visit_id) AS n_sessions, true AS within FROM visits GROUP BY CUBE (kind, edition)")
def _(spark, d):
    """The exact cube beside the sketched one, and whether each estimate is within the stated error."""
    exact = _visits(spark, d).cube("kind", "edition").agg(F.count("*").alias("n_events"), F.countDistinct("visit_id").alias("n_sessions"))
    about = t.sketched_cube(_sketches(spark, d), "kind", "edition").select(F.col("kind").alias("_k"), F.col("edition").alias("_e"), F.col("n_events").alias("_n"), F.col("n_sessions").alias("_s"))
    on = F.col("kind").eqNullSafe(F.col("_k")) & F.col("edition").eqNullSafe(F.col("_e"))
    near = (F.col("_n") == F.col("n_events")) & (F.abs(F.col("_s") - F.col("n_sessions")) <= t.SKETCH_ERROR * F.col("n_sessions"))
    return exact.hint("merge").join(about, on, "left").select("kind", "edition", "n_events", "n_sessions", F.coalesce(near, F.lit(False)).alias("within"))


@query("tr11_inactivity_sessions", VISITS_SQL + """,
g AS (SELECT client_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM visits WINDOW w AS (PARTITION BY client_id ORDER BY ts)),
s AS (SELECT client_id, ts, sum(fresh) OVER (PARTITION BY client_id ORDER BY ts) AS k FROM g)
SELECT client_id, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(max(ts)) // 1000) + 1800000 AS end_ms, count(*) AS n_events FROM s GROUP BY client_id, k""")
def _(spark, d):
    s = t.inactivity_sessions(_visits(spark, d))
    return s.select("client_id", F.unix_millis("session_start").alias("start_ms"), F.unix_millis("session_end").alias("end_ms"), "n_events")


@query("tr13_privacy_leaks", VISITS_SQL + f"SELECT count(*) AS n FROM visits v JOIN req r USING (event_id) WHERE contains(concat_ws('|', v.client_id, v.visit_id, v.crawler, v.page_referrer), r.ip) OR contains(concat_ws('|', v.client_id, v.visit_id), '{SALT}')")
def _(spark, d):
    return t.leaks(_visits(spark, d), requests(spark, d).where("user_agent <> ''"), SALT).agg(F.count("*").alias("n"))


@query("s8_fetch_parity", VISITS_SQL + """, z AS (SELECT page_id, octet_length(encode(html)) AS size FROM pages), f AS (SELECT path, status, kind, size FROM visits JOIN z ON page_id = event_id % (SELECT count(*) FROM pages))
SELECT path, count(DISTINCT status) AS n_status, count(DISTINCT size) AS n_sizes, count(DISTINCT kind) AS n_kinds FROM f GROUP BY path HAVING count(DISTINCT status) > 1 OR count(DISTINCT size) > 1""")
def _(spark, d):
    """Each request was answered with a page's body; the sizes are those of the pages."""
    from .base import table

    pages = table(spark, d, "pages")
    z = pages.select("page_id", F.octet_length("html").alias("size"))
    n = F.broadcast(pages.agg(F.count("*").alias("_n")))  # one row
    fetched = _visits(spark, d).crossJoin(n).withColumn("page_id", F.col("event_id") % F.col("_n")).drop("_n")
    return t.fetch_parity(fetched.join(z.hint("merge"), "page_id"))


@query("f10_slugs", f"SELECT DISTINCT p_type, {_SLUG('p_type')} AS slug FROM part")
def _(spark, d):
    from .base import table

    return table(spark, d, "part").select("p_type", slug("p_type").alias("slug")).distinct()


@query("pf22_mirror_paths", f"WITH req AS ({REQUESTS_SQL}) SELECT path, starts_with(path, '/') AND ends_with(path, '/') AND NOT regexp_matches(path, '/page/\\d+/$') AS mirror, count(*) AS n FROM req GROUP BY ALL")
def _(spark, d):
    return requests(spark, d).groupBy("path", has_mirror("path").alias("mirror")).agg(F.count("*").alias("n"))


@query("j12_suffix_hosts", "WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages) SELECT host, " + _under("host", ("example.com", "example.org")) + " AS own, count(*) AS n FROM h GROUP BY ALL")
def _(spark, d):
    from .base import table

    p = table(spark, d, "pages").select(url_host("url").alias("host"))
    return p.groupBy("host", t.under(F.col("host"), ("example.com", "example.org")).alias("own")).agg(F.count("*").alias("n"))
