"""Personal data by weak supervision, from DataFrame functions only.

Base spans of four kinds come from fixed patterns. Looser patterns add candidates. Four labelers vote for or against each span or abstain: a regex labeler
(the strict form of the kind, checksums included), a gazetteer (entries passed in, public prefixes, and entries learned from the corpus: prefixes, domains and
first names whose distinct spans mostly stand in a fitting context), the words around the span, and its shape. Votes are counted by pattern, at most
3^4 a kind, and expectation-maximisation over the counts estimates each labeler's reliability and the posterior of each vote pattern. The posteriors are
soft labels for a naive-Bayes span classifier over left neighbour, context word and length; its score decides which candidates become spans, the others are
reported as rejected. Base spans always stay.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .spans import joined, luhn, n_digits, of_kind, overlap_free, raw_spans

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Look-behinds and possessive repeats only spare attempts that must fail.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Looser candidates and the labelers' words.
LOOSE = {
    "mail2": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "tel2": r"(?<![0-9+.()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
}
_CONTEXT = {
    "email": "mail|contact|write|reach", "ip": "ip|host|server|address|client|login", "card": "card|visa|credit|master|payment|karte|tarjeta|carte",
    "phone": "tel|phone|call|fax|mobile|cell", "mail2": "mail|contact|write|reach", "tel2": "tel|phone|call|fax|mobile|cell",
    "ssn": "ssn|social|security|tax", "iban": "iban|bank|account|konto|compte|cuenta", "name": "name|contact|dear|regards|signed|by",
}
_AGAINST = "order|invoice|version|serial|part|sku|isbn|issn|ref|ticket|model|error|page|lot|batch"
_PUBLIC = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$", "ip": r"^(?:10|127|172|192)\.", "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|33|34|44|49)(?![0-9])", "mail2": r"(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$", "iban": "^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE)",
}
# The strict forms; kinds with a checksum have it besides.
_STRICT = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$", "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "card": r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5}$", "phone": r"^\+[1-9][^()]*(?:\([0-9]+\)[^()]*)?$",
    "mail2": r"(?:\[at\]|\(at\)).*(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,24}$", "tel2": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": "^[A-Z]{2}(?!00|01|99)[0-9]{2}", "name": r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
}
# The part of a span that a gazetteer lists (group 1).
_ENTRY = {
    "email": "@(.+)$", "ip": r"^([0-9]+\.[0-9]+)\.", "card": "^((?:[0-9][ -]?){6})", "phone": r"^(\+[0-9]{1,3})", "mail2": r"(?:\[at\]|\(at\)) ?(.+)$", "tel2": r"^\(?([0-9]{3})",
    "ssn": "^([0-9]{3})", "iban": "^([A-Z]{2}[0-9]{2} ?[A-Z0-9]{4})", "name": r" (\p{Lu}\p{Ll}+)",
}
#: Kinds with a checksum: one that fails is refused whatever speaks for it.
CHECKED = ("iban",)
#: Slots of the learned gazetteer for each kind; entries that share one share their vote.
SLOTS = 8192
#: Distinct spans that an entry needs to be learned.
SUPPORT = 3
_ALL = (*KINDS, *LOOSE)


def _base(df: DataFrame) -> DataFrame:
    """df (with _text) and the arrays email, ip, card, phone of base matches that pass."""
    t = F.col("_text")
    df = raw_spans(df, "_text", "email", EMAIL, t.contains("@"))
    df = raw_spans(df, "_text", "ip", IP, t.rlike(r"[0-9]\.[0-9]"))
    df = raw_spans(df, "_text", "card", CARD, t.rlike("[0-9]{2}|[0-9][ -][0-9]"))
    df = raw_spans(df, "_text", "phone", PHONE, t.contains("+"))
    keep = {
        "ip": lambda s: s["hit"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda s: F.when(n_digits(s["hit"]).between(13, 19), luhn(s["hit"])).otherwise(False),
        "phone": lambda s: n_digits(s["hit"]).between(9, 15),
    }
    return df.withColumns({k: F.filter(k, f) for k, f in keep.items()})


def _vote(yes, no=None):
    return F.when(yes, 1).otherwise(0) if no is None else F.when(yes, 1).when(no, -1).otherwise(0)


def _candidates(df: DataFrame) -> DataFrame:
    for k, pattern in LOOSE.items():
        guard = {"mail2": F.col("_text").rlike(r"[\[(]at[\])]"), "iban": F.col("_text").rlike("[A-Z]{2}[0-9]{2}")}.get(k)
        df = raw_spans(df, "_text", k, pattern, guard)
    return df.withColumn("found", F.concat(*[F.transform(k, _voter(k)) for k in _ALL]))


def _slot(kind: str, entry: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(entry)), F.lit(SLOTS)).cast("int") + _ALL.index(kind) * SLOTS


def mod97(hit: Column) -> Column:
    """Whether the account number passes its check: letters count from 10, the first four signs go to the end."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    value = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    digit = lambda s, i: F.when(value(i) < 58, (s * 10 + value(i) - 48) % 97).otherwise((s * 100 + value(i) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), digit) == 1


def _voter(k: str):
    def one(s):
        near = F.lower(F.concat_ws(" ", s["before"], s["after"]))
        shape = {"iban": F.length(s["hit"]).between(15, 42), "ip": ~s["before"].rlike(r"[0-9v]\.?$") & ~s["after"].rlike(r"^\.[0-9]")}.get(k, ~s["before"].rlike("[0-9]$"))
        strict = s["hit"].rlike(_STRICT[k])
        if k == "iban":
            strict = strict & mod97(s["hit"])
        word = F.regexp_extract(F.lower(s["before"]), r"([a-z]{1,20})[^a-z]*$", 1)
        fitting, other = rf"(?:^|[^a-z])(?:{_CONTEXT[k]})", rf"(?:^|[^a-z])(?:{_AGAINST})"
        entry = F.regexp_extract(s["hit"], _ENTRY[k], 1)
        return F.struct(
            F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            _vote(strict, ~strict).alias("v_regex"),
            (_vote(s["hit"].rlike(_PUBLIC[k])) if k in _PUBLIC else F.lit(0)).alias("v_gazetteer"),
            _vote(near.rlike(fitting), near.rlike(other)).alias("v_context"),
            _vote(shape, ~shape).alias("v_shape"),
            _slot(k, entry).alias("slot"), F.xxhash64(s["hit"]).alias("h"),
            F.least(F.floor(F.length(s["hit"]) / 4), F.lit(12)).cast("int").alias("f_length"),
            F.when(s["before"] == "", "none").when(s["before"].rlike("[0-9]$"), "digit").when(s["before"].rlike(r"\p{L}$"), "letter").when(s["before"].rlike(r"\s$"), "space").when(s["before"].rlike(r"[:=(\[\"']$"), "opening").otherwise("other").alias("f_left"),
            F.when(word.rlike(rf"^(?:{_CONTEXT[k]})"), "fitting").when(word.rlike(rf"^(?:{_AGAINST})"), "against").otherwise("other").alias("f_word"),
        )

    return one


def learned_gazetteer(found: DataFrame, given: DataFrame | None = None) -> tuple[list[int], list[int]]:
    """Bit maps of SLOTS bits a kind: entries that speak for a span, and entries that speak against it.

    Each distinct span counts once, so copies do not weigh. An entry with SUPPORT spans speaks for them if at least half of them have a fitting context
    somewhere and against them if none has. given (kind, entry): entries that speak for a span whatever the corpus. The maps have a fixed size.
    """
    spans = found.select(F.explode("found").alias("s")).select("s.slot", "s.h", "s.v_context")
    once = spans.groupBy("slot", "h").agg(F.max("v_context").alias("c"))
    share = once.groupBy("slot").agg(F.count("*").alias("n"), F.sum((F.col("c") == 1).cast("int")).alias("p")).where(F.col("n") >= SUPPORT)
    votes = share.select("slot", F.when(2 * F.col("p") >= F.col("n"), 1).when(F.col("p") == 0, -1).alias("vote")).where("vote IS NOT NULL")
    if given is not None:
        of = F.coalesce(*[F.when(F.col("kind") == k, _slot(k, F.col("entry"))) for k in _ALL])
        votes = votes.unionByName(given.select(of.alias("slot"), F.lit(1).alias("vote")).where("slot IS NOT NULL"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    maps = [[0] * (len(_ALL) * SLOTS // 64) for _ in range(2)]
    # At most SLOTS / 64 rows a kind and vote.
    for r in votes.groupBy((F.col("slot") / 64).cast("int").alias("w"), "vote").agg(F.bit_or(bit).alias("b")).collect():
        maps[r["vote"] < 0][r["w"]] = r["b"]
    return maps[0], maps[1]


def _with_gazetteer(found: DataFrame, maps: tuple[list[int], list[int]]) -> DataFrame:
    """found with the learned votes; a constant array holds each map."""
    constant = [F.from_json(F.lit(json.dumps(m)), "array<bigint>") for m in maps]
    has = lambda m, s: F.getbit(F.get(m, (s["slot"] / 64).cast("int")), s["slot"] % 64) == 1

    def vote(s):
        return F.when((s["v_gazetteer"] == 1) | has(constant[0], s), 1).when(has(constant[1], s), -1).otherwise(0)

    return found.withColumn("found", F.transform("found", lambda s: s.withField("v_gazetteer", vote(s))))


def expectation_maximisation(rows: list[tuple[tuple[int, ...], float]], prior: float = 0.5, rounds: int = 60):
    """Binary Dawid-Skene over (votes, count) with votes in -1, 0, 1: posterior by votes, and P(vote | class) of each labeler.

    Starts from the majority of the votes; a small constant keeps every probability above zero.
    """
    n = len(rows[0][0]) if rows else 0
    post = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in rows}
    table = {}
    for _ in range(rounds):
        mass = [1e-9 + sum(c * (post[v] if y else 1 - post[v]) for v, c in rows) for y in (0, 1)]
        prior = mass[1] / (mass[0] + mass[1])
        table = {
            (j, x, y): (0.5 + sum(c * (post[v] if y else 1 - post[v]) for v, c in rows if v[j] == x)) / (1.5 + mass[y])
            for j in range(n) for x in (-1, 0, 1) for y in (0, 1)
        }
        new = {}
        for v, _ in rows:
            z = math.log((prior + 1e-9) / (1 - prior + 1e-9)) + sum(math.log(table[j, x, 1] / table[j, x, 0]) for j, x in enumerate(v))
            new[v] = 1 / (1 + math.exp(-max(-30, min(30, z))))
        done = max((abs(new[v] - post[v]) for v in post), default=0) < 1e-9
        post = new
        if done:
            break
    return post, table


_VOTES = ("v_regex", "v_gazetteer", "v_context", "v_shape")
_FEATURES = ("f_length", "f_left", "f_word")


def train(found: DataFrame):
    """A column expression over a span struct: the classifier's log odds. found: one row a document, with found spans."""
    spans = found.select(F.explode("found").alias("s")).select("s.*")
    # One row for each kind and vote pattern: at most 9 * 3^4, whatever the corpus.
    votes = spans.groupBy("kind", *_VOTES).agg(F.count("*").alias("c")).collect()
    rows = [((r["kind"], *(r[v] for v in _VOTES)), r["c"]) for r in votes]
    post = {}
    for k in _ALL:
        own = [(v[1:], float(c)) for v, c in rows if v[0] == k]
        # The votes of all kinds estimate the labelers; a kind's own counts weigh tenfold.
        every = [(v[1:], 0.1 * c) for v, c in rows if v[0] != k]
        merged: dict = {}
        for v, c in [*own, *every]:
            merged[v] = merged.get(v, 0.0) + c
        got, _ = expectation_maximisation(sorted(merged.items()))
        post |= {(k, *v): got[v] for v, _ in own}
    keyed = {"|".join(map(str, key)): p for key, p in post.items()}
    table = lambda values: F.from_json(F.lit(json.dumps(values)), "map<string,double>")  # noqa: E731  folded to a constant
    label = F.coalesce(F.try_element_at(table(keyed), F.concat_ws("|", "kind", *[F.col(v).cast("string") for v in _VOTES])), F.lit(0.5))
    soft = spans.groupBy("kind", *_VOTES, *_FEATURES).agg(F.count("*").alias("c")).withColumn("p", label)
    long = soft.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.concat_ws("=", F.lit(f), "kind", F.col(f).cast("string")).alias("x")) for f in _FEATURES])).alias("u"), "c", "p")
    # Lengths up to 12, six kinds of left neighbours and three of words: at most 22 rows a kind.
    known = long.groupBy("u.f", "u.x").agg(F.sum(F.col("c") * F.col("p")).alias("pos"), F.sum(F.col("c") * (1 - F.col("p"))).alias("neg")).collect()
    pos, neg = 1.0 + sum(r["pos"] for r in known) / 3, 1.0 + sum(r["neg"] for r in known) / 3
    odds = {r["x"]: math.log((r["pos"] + 0.5) / (pos + 1) / ((r["neg"] + 0.5) / (neg + 1))) for r in known}
    votes = {key: math.log((p + 1e-6) / (1 - p + 1e-6)) for key, p in keyed.items() if key.split("|")[0] in LOOSE}
    base = math.log(pos / neg)

    def score(s):
        z = F.lit(base) + F.coalesce(F.try_element_at(table(votes), F.concat_ws("|", s["kind"], *[s[v].cast("string") for v in _VOTES])), F.lit(0.0))
        for f in _FEATURES:
            z = z + F.coalesce(F.try_element_at(table(odds), F.concat_ws("=", F.lit(f), s["kind"], s[f].cast("string"))), F.lit(0.0))
        return z

    return score


def personal_data(docs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, rejected) for each row; null text counts as empty, ids may be null or repeat.

    spans joins base spans and added ones by kind as listed (added kinds after them), then start; rejected joins the candidates that were refused. An added
    span never overlaps a base span; a candidate that does is neither. gazetteer (kind, entry) adds entries: domains, prefixes or first names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = _candidates(_base(rows)).select("doc_id", *KINDS, "found")
    thin = rows.select("doc_id", "found", *[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS])
    seen = cut(thin, "pii-found")
    found = _with_gazetteer(seen, learned_gazetteer(seen, gazetteer))
    score = train(found)
    df = found.withColumn("base", F.concat(*[of_kind(F.col(k), k) for k in KINDS]))
    df = overlap_free(df.withColumn("loose", F.filter("found", lambda s: s["kind"].isin(*LOOSE))), "loose", F.col("base"), "free")
    short = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), ((score(s) > 0) & ~(s["kind"].isin(*CHECKED) & (s["v_regex"] < 0))).alias("yes"))
    df = df.withColumn("loose", F.transform("free", short))
    part = lambda yes: F.transform(F.filter("loose", lambda s: s["yes"] == yes), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    df = df.withColumns({"added": part(True), "refused": part(False)})
    return df.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), joined(F.col("refused")).alias("rejected"),
    )
