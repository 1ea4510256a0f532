"""Secret scans with multipart credential linking, from DataFrame functions only.

A credential has up to three parts: an access identifier, a secret and an endpoint. Base matches stand for themselves. Weak candidates (bare
random-looking tokens) are reported only if complementary parts, an access identifier or an endpoint, stand in the same scope: the same document within
SCOPE code points. Secrets of every kind (assignments, hex keys, weak candidates) are linked to their nearest access identifier and their nearest endpoint. The
interval join is an equi-join on document and bins of SCOPE code points; spans do not overlap, so a bin holds at most SCOPE / 7 parts, whatever the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, row_key
from .spans import joined, of_kind, overlap_free, raw_spans

SCOPE = 400
KINDS = ("assign", "access", "hex")
# The base patterns; the value of an assignment is checked for its 8 characters afterwards.
_NAME = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _NAME + r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++"
_VALUE = r"^" + _NAME + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# Weak parts and endpoints.
# A weak token has 20 characters or more, of any length, or is a dotted one (a signed token) with such a part; digit, capital and small letter may
# stand anywhere in it. Dotted tokens have no slash, so hosts and paths of URLs are none. Possessive repeats keep the scan linear.
_PLAIN = r"(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+"
_HOLDS = "".join(rf"(?=[{rest}]*+(?:\.[{rest}]++)*+\.?+[{one}])" for rest, one in (("A-Za-z_-", "0-9"), ("a-z0-9_-", "A-Z"), ("A-Z0-9_-", "a-z")))
_DOTTED = _HOLDS + r"(?=(?:[A-Za-z0-9_-]{1,19}+\.)*+[A-Za-z0-9_-]{20})[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++"
WEAK = rf"(?<![A-Za-z0-9+/=_.-])(?:{_DOTTED}|{_PLAIN})={{0,2}}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:https?|amqps?|postgres(?:ql)?|mysql|redis|mongodb|ftp)://[^\s\"'<>]{1,200}+"


def _found(docs: DataFrame) -> DataFrame:
    """(k, th, doc_id, assign, access, hex, weak, endpoint): arrays of struct<start, end> for each row."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    t = F.col("_text")
    df = raw_spans(df, "_text", "assign", ASSIGN, t.rlike(_NAME))
    df = raw_spans(df, "_text", "access", ACCESS, t.contains("AKIA"))
    df = raw_spans(df, "_text", "hex", HEX)
    df = raw_spans(df, "_text", "weak", WEAK)
    df = raw_spans(df, "_text", "endpoint", ENDPOINT, t.contains("://"))
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["hit"], _VALUE, 1)) >= 8))
    thin = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(c)
    return df.select("k", F.xxhash64("_text").alias("th"), "doc_id", *[thin(c) for c in (*KINDS, "weak", "endpoint")])


def linked(found: DataFrame) -> DataFrame:
    """(k, th, kind, start, end, access, endpoint): each secret with an access identifier or an endpoint in scope, and the nearest of each (of equally
    near ones the first; null if there is none). Weak candidates (kind weak) that touch a base span are left out."""
    spans = found.where((F.size("assign") + F.size("hex") + F.size("weak") > 0) & (F.size("access") + F.size("endpoint") > 0))
    spans = overlap_free(spans, "weak", F.concat(*KINDS), "free")
    every = F.concat(of_kind(F.col("assign"), "assign"), of_kind(F.col("hex"), "hex"), of_kind(F.col("free"), "weak"))
    own = spans.select("k", "th", F.explode(every).alias("s")).select("k", "th", "s.kind", "s.start", "s.end").distinct()
    own = own.withColumn("bin", F.explode(F.array(*[F.floor(F.col("start") / SCOPE) + i for i in (-1, 0, 1)])))
    part = F.concat(of_kind(F.col("access"), "access"), of_kind(F.col("endpoint"), "endpoint"))
    parts = spans.select("k", "th", F.explode(part).alias("p")).select("k", "th", F.floor(F.col("p.start") / SCOPE).alias("bin"), "p").distinct()
    far = F.abs(F.col("p.start") - F.col("start"))
    both = own.join(parts.hint("merge"), ["k", "th", "bin"]).where(far <= SCOPE)
    near = lambda kind: F.min(F.when(F.col("p.kind") == kind, F.struct(far.alias("far"), F.col("p.start"), F.col("p.end"))))
    got = both.groupBy("k", "th", "kind", "start", "end").agg(near("access").alias("access"), near("endpoint").alias("endpoint"))
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.start"), F.col(f"{c}.end"))).alias(c)
    return got.select("k", "th", "kind", "start", "end", place("access"), place("endpoint"))


def _link(s):
    """kind:start:end of a secret, its access identifier and its endpoint, joined by +."""
    span = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    part = lambda c: F.when(s[c].isNotNull(), span(F.lit(c), s[c]))
    return F.concat_ws("+", span(s["kind"], s), part("access"), part("endpoint"))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, n_links, links) for each row; null text counts as empty.

    spans joins base spans and linked weak candidates (kind linked, n_linked of them) by start, then kind as listed. links names the parts of each
    credential: a secret with its nearest access identifier and endpoint in scope (kind:start:end joined by +), by start, comma-joined. Rows that share an id and a text share their links.
    """
    found = cut(_found(docs), "secrets-found")
    extra = linked(found).groupBy("k", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "access", "endpoint"))).alias("links"))  # at most a text's tokens
    extra = cut(extra.toDF("lk", "lth", "links"), "secrets-linked")
    df = found.join(extra.hint("merge"), (F.col("k") == F.col("lk")) & (F.col("th") == F.col("lth")), "left")
    # Sorting structs of start, rank and end gives the order asked for.
    rank = lambda c, r, kind: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    ranked = [rank(c, r, c) for r, c in enumerate(KINDS)]
    df = df.withColumn("base", F.array_sort(F.concat(*ranked))).withColumn("linked", F.filter("links", lambda s: s["kind"] == "weak"))
    every = F.when(F.size("linked") > 0, F.array_sort(F.concat("base", rank("linked", len(KINDS), "linked")))).otherwise(F.col("base"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return df.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"), F.greatest(count("linked"), F.lit(0)).alias("n_linked"), F.greatest(count("links"), F.lit(0)).alias("n_links"),
        F.coalesce(F.array_join(F.transform("links", _link), ","), F.lit("")).alias("links"),
    )
