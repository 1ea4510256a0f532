"""Line dedup by a deletion-neighbourhood join.

The unit of edit is the word and the bound is one: two lines are near if one word inserted, deleted or replaced
makes them equal. A line emits all variants with up to one word deleted, as 64-bit keys. Lines that delete the
same position to the same variant are within one replacement; a line equal to another's variant is within one
insertion. Both are groups in which the smallest position is all that is needed, so a template filled in
millions of ways costs one row a line and never all pairs.

Variants of every word would be as many keys as words, so a line first has to share half of itself: one edit
leaves either the first or the last half of a line as it is. Of the lines of MIN_HALVES words or more only those that share
a half with another distinct line emit variants; a bitmap of fixed size tells the second scan which, and its false hits only
add keys. Shorter lines have few variants and always emit them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, row_key, trim

MIN_WORDS = 1  # blank lines are never dropped
MIN_NEAR = 4  # shorter lines are dropped only as exact repeats
MIN_HALVES = 8  # pairs of shorter lines are found without the halves filter
MAP_BITS = 24  # words of 32 bits in the bitmap: 2 ** (MAP_BITS - 5)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


_LEN = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed in one go; a single longer text is a chunk of its own.
CHUNK = 1 << 20


def split_words(line: str) -> list[bytes]:
    """Lower-case words between ASCII white space."""
    return line.lower().encode().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int):
    """Powers of the base and of its inverse, at least n."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK + 2)
        _pow = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
        _inv = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _INV, np.uint64))])
    return _pow, _inv


def _forget() -> None:
    """Let go of the powers that a long text took: a worker that later stages use again would hold them for good."""
    global _pow, _inv
    _pow = _inv = np.ones(1, np.uint64)
    trim()


class _Lines:
    """Polynomial hashes of all words and lines of some texts, without a loop over words.

    size: words of each line; first: index of its first word; pre: running sums over all words; doc, no: where each line stands.
    """

    def __init__(self, texts: list[str]):
        self.raw = raw = "\n".join(texts).lower().encode()
        b = np.frombuffer(raw, np.uint8)
        counts = np.array([t.count("\n") + 1 for t in texts])
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.no = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.ends = np.append(np.flatnonzero(b == 10), len(b))
        space = _SPACE[b]
        word = np.concatenate([[False], ~space, [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, stops = edges[0::2], edges[1::2]
        p, inv = _powers(len(b) + 2)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=sums[1:])
        hashes = _mix((sums[stops] - sums[starts]) * inv[starts] + (stops - starts).astype(np.uint64) * _LEN)
        line = np.searchsorted(self.ends, starts)
        self.size = np.bincount(line, minlength=len(self.ends))
        self.first = np.cumsum(self.size) - self.size
        within = np.arange(len(starts)) - np.repeat(self.first, self.size)
        self.pre = np.zeros(len(starts) + 1, np.uint64)
        np.cumsum(hashes * p[within], out=self.pre[1:])
        self.total = self.pre[self.first + self.size] - self.pre[self.first]
        self.h = _mix(self.total + self.size.astype(np.uint64) * _LEN)

    def halves(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of lines at, flat; how many each): hashes of the first and last h words, for h = n // 2 and (n - 1) // 2, so
        that lines of n and n - 1 words meet; none for short lines."""
        _, inv = _powers(int(self.size.max(initial=0)) + 2)
        n, s = self.size[at], self.first[at]
        out = []
        for h in (n // 2, (n - 1) // 2):
            tag = (4 * h).astype(np.uint64) * _LEN
            out.append(self.pre[s + h] - self.pre[s] + tag)
            out.append((self.pre[s + n] - self.pre[s + n - h]) * inv[n - h] + tag + _LEN)
        many = np.where(n < MIN_HALVES - 1, 0, np.where(n % 2 == 1, 2, 4))
        keys = _mix(np.stack(out, 1))
        return keys[np.arange(4) < many[:, None]], many

    def variants(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of lines at, flat; how many each): the line's own hash; for lines of MIN_NEAR words or more then the hash without word
        i for each i (equal to the own hash of that shorter line), and the same mixed with i."""
        _, inv = _powers(2)
        n = np.where(self.size[at] >= MIN_NEAR, self.size[at], 0)
        many = 1 + 2 * n
        base = np.cumsum(many) - many
        keys = np.zeros(int(many.sum()), np.uint64)
        keys[base] = self.h[at]
        i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rep = lambda x: np.repeat(x, n)
        w = rep(self.first[at]) + i
        head, tail = self.pre[w] - self.pre[rep(self.first[at])], self.pre[rep(self.first[at] + self.size[at])] - self.pre[w + 1]
        v = _mix(head + tail * inv[1] + (rep(self.size[at]) - 1).astype(np.uint64) * _LEN)
        keys[rep(base) + 1 + i] = v
        keys[rep(base) + 1 + rep(n) + i] = _mix(v ^ ((i + 1).astype(np.uint64) * _BASE))
        return keys, many

    def text(self, i: int) -> str:
        start = self.ends[i - 1] + 1 if i else 0
        return b" ".join(self.raw[start : self.ends[i]].split()).decode()


def _chunks(batch):
    """Row ranges of a batch whose texts make about CHUNK bytes."""
    texts, start, size = batch.column(2).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, texts[start:]


def _lists(flat: np.ndarray, many: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _occurrences(src: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            k, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for start, texts in _chunks(b):
                with np.errstate(over="ignore"):
                    x = _Lines(texts)
                    at = np.flatnonzero(x.size >= MIN_WORDS)
                    keys = _lists(*x.halves(at))
                row = start + x.doc[at]
                cols = [pa.array(k[row]), pa.array(th[row]), pa.array(x.no[at].astype(np.int32)), pa.array(x.h[at].view(np.int64)), keys]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "th", "no", "h", "keys"])
        _forget()

    return src.mapInArrow(run, "k long, th long, no int, h long, keys array<long>")


def _neighbourhood(src: DataFrame, bitmap) -> DataFrame:
    """Short lines and lines in the bitmap with their keys: first the line itself, then its variants, then its variants with their position."""

    def run(batches):
        bits = bitmap.value
        for b in batches:
            k = b.column(0).to_numpy()
            for start, texts in _chunks(b):
                with np.errstate(over="ignore"):
                    x = _Lines(texts)
                    slot = (x.h & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                    marked = ((bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1).astype(bool)
                    at = np.flatnonzero((x.size >= MIN_NEAR - 1) & (marked | (x.size < MIN_HALVES)))
                    # Of a line that repeats within the chunk the earliest is sent.
                    at = at[np.lexsort((x.no[at], k[start + x.doc[at]]))]
                    at = at[np.unique(x.h[at], return_index=True)[1]]
                    keys = _lists(*x.variants(at))
                cols = [pa.array(k[start + x.doc[at]]), pa.array(x.no[at].astype(np.int32)), pa.array(x.h[at].view(np.int64)), pa.array([x.text(i) for i in at.tolist()], pa.string()), keys]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "no", "h", "line", "keys"])
        _forget()

    return src.mapInArrow(run, "k long, no int, h long, line string, keys array<long>")


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one inserted, deleted or replaced word, or none, makes the lists equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _verify(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ok = [within_one(x.split(" "), y.split(" ")) for x, y in zip(b.column("line").to_pylist(), b.column("other").to_pylist())]
            yield b.select(["h", "qk", "qno"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "h long, qk long, qno int")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(k, th, no): the lines to drop, by row key and hash of their text, and line number from 0."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    src = docs.select(row_key().alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))
    occ = cut(_occurrences(src), "lines")
    classes = cut(occ.groupBy("h").agg(F.min(F.struct("k", "no")).alias("p"), F.first("keys").alias("keys")).select("h", "p.k", "p.no", "keys"), "classes")
    halves = classes.select("h", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    near = halves.join(shared.hint("merge"), "key", "left_semi")
    slot = F.col("h").bitwiseAND(F.lit((1 << MAP_BITS) - 1).cast("long"))
    marks = near.select(F.shiftright(slot, 5).alias("w"), F.expr("shiftleft(1L, int(h & 31))").alias("b"))
    bits = np.zeros(1 << (MAP_BITS - 5), np.int64)
    got = marks.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2 ** (MAP_BITS - 5) rows
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
    hood = _neighbourhood(src, spark.sparkContext.broadcast(bits.astype(np.uint32)))
    hood = cut(hood.groupBy("h").agg(F.min(F.struct("k", "no")).alias("p"), F.first("line").alias("line"), F.first("keys").alias("keys")), "hood")

    # A line's own hash meets the variants of longer lines; variants with their position meet each other.
    n = F.floor((F.size("keys") - 1) / 2)
    e = hood.select("h", "p", n.alias("n"), F.posexplode("keys").alias("i", "key"))
    e = e.select("h", "p", "key", F.when(F.col("i") == 0, 0).when(F.col("i") <= F.col("n"), 1).otherwise(2).alias("role"))
    mins = e.groupBy("key").agg(
        F.min(F.when(F.col("role") == 0, F.struct("p", "h"))).alias("own"),
        F.min(F.when(F.col("role") == 1, F.struct("p", "h"))).alias("longer"),
        F.min(F.when(F.col("role") == 2, F.struct("p", "h"))).alias("same"),
        F.count("*").alias("c"),
    )
    mins = mins.where("c > 1").drop("c")
    other = F.when(F.col("role") == 0, F.col("longer")).when(F.col("role") == 1, F.col("own")).otherwise(F.col("same"))
    pairs = e.join(mins.hint("merge"), "key").select("h", "p", other.alias("q")).where("q is not null and q.p < p and q.h <> h")
    pairs = cut(pairs.select("h", F.col("q.h").alias("qh"), F.col("q.p.k").alias("qk"), F.col("q.p.no").alias("qno")).distinct(), "line-pairs")
    one = hood.select("h", "line")
    two = hood.select(F.col("h").alias("qh"), F.col("line").alias("other"))
    true = _verify(pairs.join(one.hint("merge"), "h").join(two.hint("merge"), "qh").select("h", "qk", "qno", "line", "other"))
    losers = true.groupBy("h").agg(F.lit(True).alias("near"))
    verdict = cut(classes.select("h", "k", "no").join(losers.hint("merge"), "h", "left").select("h", F.col("k").alias("pk"), F.col("no").alias("pno"), F.coalesce("near", F.lit(False)).alias("near")), "verdict")
    repeat = (F.col("k") != F.col("pk")) | (F.col("no") != F.col("pno"))
    return occ.select("k", "th", "no", "h").join(verdict.hint("merge"), "h").where(repeat | F.col("near")).select("k", "th", "no")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of text, and the columns _lines and _dropped.

    Lines are split at newlines and compared as lower-cased words. Of lines with MIN_WORDS words or more, one stays if
    it is the first of its equals (by doc_id, then line number) and no line within one edited word comes before
    it; near lines need MIN_NEAR words in the longer one. Blank lines stay. A null text stays null with no
    lines; a null doc_id sorts first. Rows that share a doc_id hold the same positions: an equal line at an equal position
    stays in each of them. A document may be left empty but is kept.
    """
    drops = dropped_lines(docs).distinct().groupBy("k", "th").agg(F.collect_list("no").alias("gone"))
    drops = cut(drops.withColumnsRenamed({"k": "gk", "th": "gth"}), "drops")
    # The other columns travel in a struct, so no name of theirs can clash.
    others = [c for c in docs.columns if c not in ("text", "_lines", "_dropped")]
    own = F.struct(*[docs[f"`{c}`"].alias(c) for c in others]) if others else F.struct()
    d = docs.select(own.alias("own"), docs["text"].alias("text"), row_key().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    d = d.join(drops.hint("merge"), (F.col("k") == F.col("gk")) & (F.col("th") == F.col("gth")), "left").withColumn("lines", F.split("text", "\n", -1))
    # Numbers of the lines that stay, by a hash set; texts that lose none are not put together again.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone").cast("array<int>"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    # In a step of its own, before columns of docs get their names back.
    d = d.select(
        "own",
        F.when(F.size("gone") > 0, kept).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("_lines"),
        F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("_dropped"),
    )
    back = [F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns if c not in ("_lines", "_dropped")]
    return d.select(*back, "_lines", "_dropped")


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document with its remaining text."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.greatest("_dropped", F.lit(0)).cast("long").alias("n_dropped"), "text")
