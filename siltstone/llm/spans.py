"""Regex spans in code points, from built-in functions only.

regexp_extract_all gives the matches of a pattern and split the text between them; both walk the text alike, so running sums of
their lengths are the positions. The sums run in blocks, which keeps the work near linear in the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def prefix_sums(a: Column) -> Column:
    """Exclusive running sums of an array of longs, as many as it has elements."""
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")))
    block = lambda c: F.slice(a, c * _BLOCK + 1, _BLOCK)
    zero = F.lit(0).cast("long")
    sums = F.transform(blocks, lambda c: F.aggregate(block(c), zero, lambda x, y: x + y))
    grow = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    bases = F.aggregate(sums, F.array(zero), grow)
    parts = F.transform(blocks, lambda c: F.slice(F.aggregate(block(c), F.array(F.element_at(bases, c + 1)), grow), 1, F.size(block(c))))
    return F.flatten(parts)


def raw_spans(df, text: str, out: str, pattern: str, guard: Column | None = None):
    """df with out: array<struct<start long, end long, hit string, before string, after string>> of the leftmost non-overlapping matches.

    before and after are up to 48 code points of the text between neighbouring matches. guard: rows where it is false cannot match.
    """
    hits, gaps, ends = f"_{out}_hits", f"_{out}_gaps", f"_{out}_sums"
    ok = F.col(text).isNotNull() if guard is None else F.col(text).isNotNull() & guard
    df = df.withColumn(hits, F.when(ok, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    both = F.transform(hits, lambda h, i: (F.length(h) + F.length(F.get(gaps, i))).cast("long"))
    df = df.withColumn(ends, F.when(F.size(hits) > 0, prefix_sums(both)).otherwise(F.array().cast("array<long>")))
    one = lambda h, i: F.struct(
        (F.get(ends, i) + F.length(F.get(gaps, i))).alias("start"),
        (F.get(ends, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
        h.alias("hit"),
        F.right(F.get(gaps, i), F.lit(48)).alias("before"),
        F.left(F.get(gaps, i + 1), F.lit(48)).alias("after"),
    )
    return df.withColumn(out, F.transform(hits, one)).drop(hits, gaps, ends)


def overlap_free(df, spans: str, base: Column, out: str):
    """df with out: those of spans (structs with start, end) that overlap none of base.

    base is sorted by start and cut into blocks that know their extent, and a span looks only into blocks it meets. Columns that a lambda reads are
    referred to twice, so that Catalyst computes them once a row and not once an element.
    """
    by, blocks = f"_{out}_by", f"_{out}_blocks"
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    thin = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    df = df.withColumn(by, F.when(F.size(spans) > 0, F.array_sort(thin)).otherwise(none))
    part = lambda c: F.slice(F.col(by), c * _BLOCK + 1, _BLOCK)
    block = lambda c: F.struct(part(c).alias("spans"), F.get(by, c * _BLOCK)["start"].alias("start"), F.array_max(F.transform(part(c), lambda b: b["end"])).alias("end"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(by) - 1) / _BLOCK).cast("int"))
    df = df.withColumn(blocks, F.when(F.size(by) > 0, F.transform(numbers, block)))
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter(spans, lambda s: ~F.exists(blocks, lambda c: meet(c, s) & F.exists(c["spans"], lambda b: meet(b, s))))
    return df.withColumn(out, F.when(F.col(blocks).isNull(), F.col(spans)).otherwise(free)).drop(by, blocks)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str | Column) -> Column:
    """The spans as struct<start, end, kind>."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), k.alias("kind")))


def luhn(hit: Column) -> Column:
    """Whether the digits of hit pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(hit, "[^0-9]", ""))
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.ascii(F.substring(digits, i, F.lit(1))) - 48
    doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    return F.aggregate(at, F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def n_digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))
