"""Request-traffic analytics: a stateless classification that runs on batches and streams alike, and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_match, ga_client_id, half_hour, slug, url_host, visitor_digest

# User-agent families (pattern, crawler, operator, kind), first match wins; kind None: the path decides.
AGENTS = (
    ("GPTBot", "GPTBot", "OpenAI", "ai.training"),
    ("ChatGPT-User", "ChatGPT-User", "OpenAI", "assistant.chat"),
    ("OAI-SearchBot", "OAI-SearchBot", "OpenAI", "ai.search"),
    ("ClaudeBot", "ClaudeBot", "Anthropic", "ai.training"),
    ("Claude-Web", "Claude-Web", "Anthropic", "ai.search"),
    ("Claude-User", "Claude-User", "Anthropic", "assistant.chat"),
    ("anthropic-ai", "anthropic-ai", "Anthropic", "ai.training"),
    ("PerplexityBot", "PerplexityBot", "Perplexity", "ai.search"),
    ("Perplexity-User", "Perplexity-User", "Perplexity", "assistant.chat"),
    ("Google-Extended", "Google-Extended", "Google", "ai.training"),
    ("Googlebot", "Googlebot", "Google", "search"),
    ("Google-CloudVertexBot", "Vertex", "Google", "ai.search"),
    ("Applebot-Extended", "Applebot-Extended", "Apple", "ai.training"),
    ("Applebot", "Applebot", "Apple", "search"),
    ("Amazonbot", "Amazonbot", "Amazon", "search"),
    ("meta-externalagent", "Meta-ExternalAgent", "Meta", "ai.training"),
    ("facebookexternalhit", "facebookexternalhit", "Meta", "infra"),
    ("bingbot", "BingBot", "Microsoft", "search"),
    ("CCBot", "CCBot", "Common Crawl", "ai.training"),
    ("Bytespider", "Bytespider", "ByteDance", "ai.training"),
    ("DeepSeek", "DeepSeekBot", "DeepSeek", "ai.training"),
    ("MistralAI-User", "MistralAI-User", "Mistral", "assistant.chat"),
    ("cohere-ai", "cohere-ai", "Cohere", "ai.training"),
    ("YouBot", "YouBot", "You.com", "ai.search"),
    ("Diffbot", "Diffbot", "Diffbot", "ai.training"),
    ("Baiduspider", "Baiduspider", "Baidu", "search"),
    ("YandexBot", "YandexBot", "Yandex", "search"),
    ("DuckDuckBot", "DuckDuckBot", "DuckDuckGo", "search"),
    ("claude-code", "Claude Code", "Anthropic", "assistant.ide"),
    (r"\bCursor\b", "Cursor", "Cursor", "assistant.ide"),
    ("Windsurf", "Windsurf", "Windsurf", "assistant.ide"),
    ("Codeium", "Codeium", "Windsurf", "assistant.ide"),
    ("Copilot", "Copilot", "GitHub", "assistant.ide"),
    (r"\bCline\b", "Cline", "Cline", "assistant.ide"),
    (r"\bAider\b", "Aider", "Aider", "assistant.ide"),
    (r"\bDevin\b", "Devin", "Cognition", "assistant.ide"),
    (r"\bZed\b", "Zed", "Zed", "assistant.ide"),
    ("^(?:node|undici|axios|python-requests|httpx|aiohttp|Go-http-client|curl|wget)", "http-client", "Generic client", None),
)
# Paths made for agents.
SURFACES = (
    (r"/index\.md$", "markdown-mirror"),
    (r"^/llms\.txt$", "llms.txt"),
    (r"^/llms-full\.txt$", "llms-full.txt"),
    (r"^/api/search-index\.json$", "symbol-index"),
    (r"^/robots\.txt$", "robots.txt"),
    (r"sitemap[^/]*\.xml$", "sitemap"),
)
AGENT_ONLY = ("markdown-mirror", "llms.txt", "llms-full.txt", "symbol-index")
SELF_DECLARED_BOT = r"(?i)bot[/;)\s]|bot$|crawler|spider|\+https?://"
# Answer services by brand and their hosts.
BRANDS = (
    ("chatgpt", ("chatgpt.com", "chat.openai.com", "openai.com")),
    ("perplexity", ("perplexity.ai",)),
    ("claude", ("claude.ai",)),
    ("gemini", ("gemini.google.com", "bard.google.com", "aistudio.google.com", "notebooklm.google.com")),
    ("copilot", ("copilot.microsoft.com", "copilot.cloud.microsoft", "edgeservices.bing.com")),
    ("grok", ("grok.com",)),
    ("deepseek", ("deepseek.com", "chat.deepseek.com")),
    ("mistral", ("mistral.ai", "chat.mistral.ai")),
    ("meta", ("meta.ai",)),
    ("you", ("you.com",)),
    ("poe", ("poe.com",)),
    ("phind", ("phind.com",)),
    ("kagi", ("kagi.com",)),
    ("qwen", ("qwen.ai", "chat.qwen.ai")),
    ("felo", ("felo.ai",)),
    ("genspark", ("genspark.ai",)),
    ("liner", ("liner.com",)),
    ("iask", ("iask.ai",)),
    ("komo", ("komo.ai",)),
    ("andisearch", ("andisearch.com",)),
)


def under(host: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether host is one of the suffixes or below it."""
    out = F.lit(False)
    for s in suffixes:
        out = out | (host == s) | host.endswith("." + s)
    return out


def with_agent(df: DataFrame) -> DataFrame:
    """df (user_agent, path, accept, sec_fetch_dest) with crawler, operator, kind, surface and browser.

    kind is null where nothing about the request is worth an event: an ordinary page or file fetched by an unnamed client.
    """
    ua = F.coalesce("user_agent", F.lit(""))
    rule = first_match(ua, [(f"(?i){a[0]}", i) for i, a in enumerate(AGENTS)])
    # The rule is found once, in a projection of its own; everything else about the family is an array's element.
    df = df.withColumn("_rule", F.explode(F.array(F.when(ua == "", F.lit(-1)).otherwise(rule))))
    of = lambda field: F.get(F.array(*[F.lit(a[field]) for a in AGENTS]), F.when(F.col("_rule") >= 0, F.col("_rule")))
    none = F.col("_rule") == -1
    df = df.withColumns({"_crawler": F.when(none, "no-user-agent").otherwise(of(1)), "_operator": F.when(none, "Unidentified").otherwise(of(2)), "_kind": of(3), "_surface": first_match(F.col("path"), SURFACES)}).drop("_rule")
    found = F.col("_crawler").isNotNull()
    botish = ua.rlike(SELF_DECLARED_BOT)
    dest = F.coalesce("sec_fetch_dest", F.lit(""))
    document = F.when(dest != "", dest == "document").otherwise(F.coalesce("accept", F.lit("")).contains("text/html"))
    browser = ~found & ~botish & document & ua.contains("Mozilla/")
    counted = found | F.col("_surface").isNotNull() | browser | botish
    by_path = F.when(botish, "unknown").when(F.col("_surface").isin(*AGENT_ONLY), "assistant.other").otherwise("unknown")
    kind = F.coalesce("_kind", F.when(~found & browser, "user"), by_path)
    other = F.when(browser, "browser").when(botish, "unnamed-bot").otherwise("unclassified")
    return df.withColumns(
        {
            "crawler": F.when(counted, F.coalesce("_crawler", other)),
            "operator": F.when(counted, F.coalesce("_operator", F.when(browser, "Browser").otherwise("Unidentified"))),
            "kind": F.when(counted, kind),
            "surface": F.when(counted, F.coalesce("_surface", F.lit("html"))),
            "browser": browser,
        }
    ).drop("_crawler", "_operator", "_kind", "_surface")


def with_referrer(df: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """df (referrer) with referrer_host and ai_source: none, invalid and other, internal, or a brand."""
    ref = F.coalesce("referrer", F.lit(""))
    host = url_host(ref)
    df = df.withColumn("_host", F.explode(F.array(F.coalesce(host, F.lit("")))))
    host = F.col("_host")
    # A host's suffixes meet the brands' hosts in a map, the longest first.
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    table = F.create_map(*[F.lit(x) for name, hosts in BRANDS for h in hosts for x in (h, name)])
    brand = F.get(F.array_compact(F.transform(suffixes, lambda x: F.try_element_at(table, x))), F.lit(0))
    return df.withColumns(
        {
            "referrer_host": F.when(ref == "", "none").when(host == "", "invalid").otherwise(host),
            "ai_source": F.when(ref == "", "none").when(host == "", "other").when(under(host, own), "internal").otherwise(F.coalesce(brand, F.lit("other"))),
        }
    ).drop("_host")


def visits(requests: DataFrame, salt: str | None, own: tuple[str, ...] = ("example.org", "example.com")) -> DataFrame:
    """One event for each request that counts; the projection keeps no state, so a stream takes it as it is.

    Browsers are told apart by a salted digest and dropped without a salt; others go by their family. The session is the half hour by the clock.
    Neither the address, the agent text nor the salt is in the result.
    """
    df = with_referrer(with_agent(requests), own).where("kind IS NOT NULL")
    digest = F.when(F.col("browser"), visitor_digest("ip", "user_agent", salt))
    df = df.withColumn("_visitor", digest).where(~F.col("browser") | F.col("_visitor").isNotNull())
    family = F.concat(slug("operator"), F.lit("."), slug("crawler"))
    session = F.concat(F.coalesce(F.substring("_visitor", 1, 16), slug("crawler")), F.lit("-"), half_hour("ts"))
    edition = F.when(F.col("host").endswith(".com"), "com").otherwise("org")
    return df.select(
        "event_id", "ts",
        F.coalesce(F.when(F.col("browser"), ga_client_id("cookie")), "_visitor", family).alias("client_id"),
        session.alias("visit_id"), "crawler", "operator", "kind", "surface", F.col("status").cast("string").alias("status"), edition.alias("edition"),
        "path", F.nullif("referrer", F.lit("")).alias("page_referrer"), "referrer_host", "ai_source",
    )


DIMENSIONS = ("kind", "crawler", "operator", "surface", "status", "edition", "ai_source")


def rollup(events: DataFrame, *dims: str) -> DataFrame:
    """Events and distinct sessions by dims."""
    return events.groupBy(*dims).agg(F.count("*").alias("n_events"), F.countDistinct("visit_id").alias("n_sessions"))


#: Logarithm of a sketch's registers, and four of its relative standard errors (1.04 over the root of their number): 3.3 %.
LG_K = 14
SKETCH_ERROR = 4 * 1.04 / 2 ** (LG_K / 2)


def half_hour_sketches(events: DataFrame, *dims: str, watermark: str | None = None) -> DataFrame:
    """(window_start, dims..., n_events, sessions): a mergeable sketch of the distinct visits of each half hour, for storage. Later roll-ups read these rows,
    never the events again; with a watermark the same plan runs on a stream."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy(F.window("ts", "30 minutes").alias("w"), *dims).agg(F.count("*").alias("n_events"), F.hll_sketch_agg("visit_id", LG_K).alias("sessions"))
    return out.select(F.col("w.start").alias("window_start"), *dims, "n_events", "sessions")


def merged_sketches(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each half hour and dims of both tables: what came late joins what was stored."""
    dims = [c for c in stored.columns if c not in ("n_events", "sessions")]
    return stored.unionByName(new).groupBy(*dims).agg(F.sum("n_events").alias("n_events"), F.hll_union_agg("sessions").alias("sessions"))


def _of_sketches(groups):
    return groups.agg(F.sum("n_events").alias("n_events"), F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("n_sessions"))


def sketched_rollup(sketches: DataFrame, *dims: str) -> DataFrame:
    """rollup() from stored sketches: events exactly, distinct sessions within SKETCH_ERROR."""
    return _of_sketches(sketches.groupBy(*dims))


def sketched_cube(sketches: DataFrame, *dims: str) -> DataFrame:
    """All combinations of dims from stored sketches, as sketched_rollup()."""
    return _of_sketches(sketches.cube(*dims))


def tumbling(events: DataFrame, *dims: str, watermark: str | None = None) -> DataFrame:
    """Events by half hour and dims; with a watermark the same plan closes windows on a stream."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy(F.window("ts", "30 minutes").alias("w"), *dims).agg(F.count("*").alias("n_events"))
    return out.select(F.col("w.start").alias("window_start"), *dims, "n_events")


def inactivity_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Sessions that end after a pause, for each client."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy("client_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return out.select("client_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def leaks(events: DataFrame, requests: DataFrame, salt: str) -> DataFrame:
    """Rows of events that hold an address, an agent text or the salt in any column; it should be empty."""
    raw = F.concat_ws("\x00", *[F.col(c).cast("string") for c in events.columns if c not in ("event_id", "ts")])
    own = requests.select("event_id", "ip", "user_agent")
    return events.withColumn("_all", raw).join(own.hint("merge"), "event_id").where(F.col("_all").contains(F.col("ip")) | F.col("_all").contains(F.col("user_agent")) | F.col("_all").contains(salt)).select(*events.columns)


def fetch_parity(log: DataFrame) -> DataFrame:
    """Paths that answered different kinds of clients with different status or size."""
    g = log.groupBy("path").agg(F.countDistinct("status").alias("n_status"), F.countDistinct("size").alias("n_sizes"), F.countDistinct("kind").alias("n_kinds"))
    return g.where("n_status > 1 OR n_sizes > 1")
