"""Registration of queries with their DuckDB equivalents, and the small inputs that several share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index):
    """values[index], counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# A request log from events, by fixed arithmetic on its ids: synthetic, and the same in both dialects.
AGENT_TEXTS = (
    "Mozilla/5.0 (X11; Linux x86_64) Chrome/126.0", "Mozilla/5.0 (compatible; GPTBot/1.2; +https://bots.example/gpt)", "ChatGPT-User/1.0", "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "PerplexityBot/1.0", "curl/8.5.0", "", "Mozilla/5.0 (compatible; NewThing-bot/0.1)", "Cursor/0.42", "Mozilla/5.0 (Windows NT 10.0) Firefox/127.0", "python-requests/2.32", "SomeTool/1.0",
)
PATHS = ("/", "/docs/start/", "/llms.txt", "/blog/post-1/index.md", "/robots.txt", "/api/search-index.json", "/assets/site.css", "/sitemap-blog.xml", "/tutorial/")
REFERRERS = ("", "https://www.google.com/", "https://chat.openai.com/c/1", "https://docs.example.org/x", "not a url", "https://perplexity.ai/search?q=a", "https://sub.claude.ai/", "https://WWW.Other.example.net/p")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(i % 3 == 0, "docs.example.com").otherwise("docs.example.org").alias("host"), pick(PATHS, i % len(PATHS)).alias("path"),
        pick(AGENT_TEXTS, u % len(AGENT_TEXTS)).alias("user_agent"), pick(REFERRERS, (i * 7 + u) % len(REFERRERS)).alias("referrer"),
        F.concat(F.lit("10."), u % 200, F.lit("."), u % 7, F.lit(".1")).alias("ip"), F.when(u % 5 == 0, F.concat(F.lit("a=1; _ga=GA1.2."), u, F.lit(".170"))).otherwise("").alias("cookie"),
        F.when(i % 4 == 0, "application/json").otherwise("text/html,*/*").alias("accept"), F.when(i % 4 == 1, "document").when(i % 4 == 2, "image").otherwise("").alias("sec_fetch_dest"),
        F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"),
    )


REQUESTS_SQL = f"""
SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'docs.example.com' ELSE 'docs.example.org' END AS host,
  ({lit_list(PATHS)})[event_id % {len(PATHS)} + 1] AS path, ({lit_list(AGENT_TEXTS)})[user_id % {len(AGENT_TEXTS)} + 1] AS user_agent,
  ({lit_list(REFERRERS)})[(event_id * 7 + user_id) % {len(REFERRERS)} + 1] AS referrer, '10.' || (user_id % 200) || '.' || (user_id % 7) || '.1' AS ip,
  CASE WHEN user_id % 5 = 0 THEN 'a=1; _ga=GA1.2.' || user_id || '.170' ELSE '' END AS cookie,
  CASE WHEN event_id % 4 = 0 THEN 'application/json' ELSE 'text/html,*/*' END AS accept,
  CASE WHEN event_id % 4 = 1 THEN 'document' WHEN event_id % 4 = 2 THEN 'image' ELSE '' END AS sec_fetch_dest,
  CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status
FROM events"""

# Releases and commits stand in for what a registry or a repository would give: only their shape is the point.


def releases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    v = F.concat(k % 4, F.lit("."), k % 11, F.lit("."), k % 23)
    return o.select(F.concat(F.lit("pkg-"), F.col("o_custkey") % 60).alias("package"), v.alias("version"), F.col("o_orderdate").cast("date").alias("published"))


RELEASES_SQL = "SELECT 'pkg-' || (o_custkey % 60) AS package, (o_orderkey % 4) || '.' || (o_orderkey % 11) || '.' || (o_orderkey % 23) AS version, CAST(o_orderdate AS DATE) AS published FROM orders"


def commits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("/page/"), F.col("l_partkey"), F.lit("/")).alias("path"), F.col("l_shipdate").cast("date").alias("ts"), F.when(F.col("l_linenumber") == 1, "A").otherwise("M").alias("change"))


COMMITS_SQL = "SELECT '/page/' || l_partkey || '/' AS path, CAST(l_shipdate AS DATE) AS ts, CASE WHEN l_linenumber = 1 THEN 'A' ELSE 'M' END AS change FROM lineitem"


def symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.regexp_replace("p_name", "[^A-Za-z]", "")
    return p.select(
        F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")).alias("package"), name.alias("symbol"), F.concat("p_type", F.lit("("), F.col("p_size") % 5, F.lit(")")).alias("signature"),
        F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("summary"), (k % 13 == 0).alias("deprecated"),
        F.concat(F.lit("/api/"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("/latest/"), name, F.lit("."), k, F.lit("/")).alias("url"),
    )


SYMBOLS_SQL = """SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS package, regexp_replace(p_name, '[^A-Za-z]', '', 'g') AS symbol, p_type || '(' || (p_size % 5) || ')' AS signature,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS summary, p_partkey % 13 = 0 AS deprecated,
  '/api/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '/latest/' || regexp_replace(p_name, '[^A-Za-z]', '', 'g') || '.' || p_partkey || '/' AS url FROM part"""


def posts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    topics = F.array(F.concat(F.lit("t"), i % 7), F.concat(F.lit("t"), i % 11), F.concat(F.lit("u"), i % 97))
    return d.select(
        F.concat(F.lit("/blog/"), i, F.lit("/")).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.expr("date_add(date'2024-01-01', int(doc_id % 700))").alias("date"),
        topics.alias("topics"), F.concat(F.lit("a"), i % 9).alias("author"), F.when(i % 3 == 0, (i % 40).cast("int")).alias("chapter"), (i % 17 == 0).alias("draft"), "lang", "source",
    )


POSTS_SQL = """SELECT '/blog/' || doc_id || '/' AS url, split_part(text, chr(10), 1) AS title, date '2024-01-01' + CAST(doc_id % 700 AS INTEGER) AS date,
  ['t' || (doc_id % 7), 't' || (doc_id % 11), 'u' || (doc_id % 97)] AS topics, 'a' || (doc_id % 9) AS author, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 40 AS INTEGER) END AS chapter, doc_id % 17 = 0 AS draft, lang, source FROM documents"""


def page_edges(spark, sf_dir):
    """Edges between pages by fixed arithmetic, so that links have targets."""
    p = table(spark, sf_dir, "pages").select("page_id")
    n = F.broadcast(p.agg(F.count("*").alias("n")))
    e = p.crossJoin(n).select(F.col("page_id").alias("src"), F.explode(F.array((F.col("page_id") * 2 + 1) % F.col("n"), (F.col("page_id") * 3) % F.col("n"), F.col("page_id") + 7)).alias("dst"), "n")
    return e.select("src", "dst").distinct()


EDGES_SQL = "SELECT DISTINCT page_id AS src, unnest([(page_id * 2 + 1) % n, (page_id * 3) % n, page_id + 7]) AS dst FROM pages, (SELECT count(*) AS n FROM pages)"
