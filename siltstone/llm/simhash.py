"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints are cut into m groups of correlated bits. With thresholds t_1..t_m (each -1 or more) that
sum to radius - m + 1, two fingerprints within the radius agree on some group i within t_i bits. Each
fingerprint gets its own thresholds: a dynamic program takes those with the least estimated number of
candidates, from a histogram of the groups' values (at most 65,536 counts a group, whatever the input).
The probe side lists all values within t_i bits, an equi-join meets the index side, and the join condition
verifies the true distance, so no unverified pair leaves the join.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, cross_pairs, cut, own_columns, row_key, tree, trim, with_key

FP_RADIUS = 3  # of the 3-word fingerprints that op10 links
WORD_RADIUS = 7  # of the word fingerprints that propose near copies; they are verified exactly
WORD_GROUPS = 5  # of 12 or 13 bits; with the size classes a row is probed as often in a large table as in a small one
SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_MINIMA = 8, 3  # keys of least shingle hashes
FAR_RADIUS = 20  # bits beyond which a shared key's pair is not looked at; of pairs at the similarity 99 in 100 lie within 14
LEADERS = 3
HIST_BITS = 16
T_MAX = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.random.default_rng(77).integers(0, 2**64, BANDS * BAND_MINIMA, np.uint64)


def _majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
    if weights is None:
        on = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    else:
        on = weights @ bits > weights.sum() / 2
    return int(np.packbits(on).view(np.int64)[0])


def shingle_fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of 3-word shingles: A-Z lower-cased, ASCII white space splits. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [h(b" ".join(words), 42)]
    else:
        hashes = [h(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:])]
    return _majority(np.array(hashes, dtype=np.uint64))


def word_fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of single words, weighted 1 + ln(count): a few changed words move few bits."""
    counts: dict[bytes, int] = {}
    for w in (text or "").lower().encode().split():
        counts[w] = counts.get(w, 0) + 1
    if not counts:
        return 0
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(w, 42) for w in counts], dtype=np.uint64)
    return _majority(hashes, 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))))


def fingerprints(docs: DataFrame, kind: str = "shingle") -> DataFrame:
    """(k long, th long, fp long): row key, hash of the text, fingerprint. Null text counts as empty."""
    f = shingle_fingerprint if kind == "shingle" else word_fingerprint

    def run(batches):
        for b in batches:
            fp = pa.array([f(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], names=["k", "th", "fp"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_key().alias("k"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(
        run, "k long, th long, fp long"
    )


def _grouped_bits(fps: DataFrame, widths: list[int]) -> list[list[int]]:
    """Greedy groups of correlated bits, from the co-occurrence counts of all fingerprints."""

    def run(batches):
        co, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8)).reshape(-1, 64).astype(np.float32)
            x = x.reshape(-1, 8, 8)[:, :, ::-1].reshape(-1, 64)  # column i is bit i
            co += x.T @ x
            n += len(x)
        if n:
            i, j = np.divmod(np.arange(4096), 64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i), pa.array(j), pa.array(co.ravel()), pa.array(np.full(4096, n))], names=["i", "j", "c", "n"]
            )

    got = fps.select("fp").mapInArrow(run, "i long, j long, c double, n long").groupBy("i", "j").agg(F.sum("c"), F.sum("n"))
    co, n = np.zeros((64, 64)), 1
    for i, j, c, k in got.collect():
        co[i, j], n = c, k
    p = co / n
    one = np.diag(p)
    sd = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    corr = np.abs((p - np.outer(one, one)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for w in widths:
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].max(), -b))]
        while len(group) < w:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for at, b in enumerate(bits):
        out |= ((fp >> np.int64(b)) & np.int64(1)) << np.int64(at)
    return out


def _ball(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(width), k)], np.int64)


def _group_count(n: int, radius: int) -> int:
    """How many groups: the least of probe rows plus a tenth of the pairs they meet; every choice finds all links."""

    def cost(m: int) -> float:
        w, total = 64 / m, radius - m + 1
        t = [total // m + (i < total % m) for i in range(m)]
        if max(t) > T_MAX or min(t) < 0:
            return math.inf
        probes = sum(sum(math.comb(round(w), k) for k in range(x + 1)) for x in t)
        return n * (probes + m) + 0.1 * n * n * probes / 2**w

    return min(range(2, radius + 2), key=cost)


def _least_size(size: np.ndarray) -> np.ndarray:
    """The size of the smallest set that can have a similarity of SIMILARITY to one of this size."""
    return np.ceil(size * SIMILARITY - 1e-6).astype(np.int64)


def _most_size(size: np.ndarray) -> np.ndarray:
    """The size of the largest such set."""
    return np.floor(size / SIMILARITY + 1e-6).astype(np.int64)


def _size_class(size: np.ndarray) -> np.ndarray:
    """Sizes from one power of two to the next; 0 is with 1."""
    return np.frexp(np.maximum(size, 1).astype(np.float64))[1].astype(np.int64) - 1


class Pigeonhole:
    """Index and probe rows over fps (id long, fp long, and any columns named in carry).

    With sized, fps has a column size too, of the sets that are to be verified: rows whose sizes rule the similarity out do not meet. Classes of sizes
    are part of the keys; a row is probed in the one or two classes that such sizes fall into.
    """

    def __init__(self, fps: DataFrame, radius: int, groups: int | None = None, sized: bool = False):
        self.radius, self.n, self.sized = radius, fps.count(), sized
        self.m = groups or _group_count(max(self.n, 1), radius)
        self.carry = ("size",) if sized else ()
        widths = [64 // self.m + (i < 64 % self.m) for i in range(self.m)]
        self.groups = _grouped_bits(fps, widths) if self.n else [[*range(sum(widths[:i]), sum(widths[: i + 1]))] for i in range(self.m)]
        self.hist = self._histograms(fps)

    def _histograms(self, fps: DataFrame) -> list[np.ndarray]:
        groups = [g[:HIST_BITS] for g in self.groups]

        def run(batches):
            sums = [np.zeros(1 << len(g), np.int64) for g in groups]
            for b in batches:
                fp = b.column(0).to_numpy()
                for s, g in zip(sums, groups):
                    np.add.at(s, _gather(fp, g), 1)
            for i, s in enumerate(sums):
                v = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i)), pa.array(v), pa.array(s[v])], names=["g", "v", "c"])

        out = [np.zeros(1 << len(g)) for g in groups]
        rows = fps.select("fp").mapInArrow(run, "g long, v long, c long").groupBy("g", "v").agg(F.sum("c").alias("c")).toArrow()
        for g, v, c in zip(*(rows.column(x).to_numpy() for x in ("g", "v", "c"))):
            out[g][v] = c
        return out

    def _estimates(self) -> list[np.ndarray]:
        """For each group an array [value, t + 1]: candidates plus probes at threshold t (-1: none)."""
        tables = []
        for g, h in zip(self.groups, self.hist):
            w, v = len(g), np.arange(len(h))
            t_max = min(T_MAX, max(0, self.radius - self.m + 1 + (self.m - 1)))
            est = np.zeros((len(h), t_max + 2))
            for t in range(t_max + 1):
                seen = sum(h[v ^ x] for x in _ball(min(w, HIST_BITS), t)) / 2.0 ** max(0, w - HIST_BITS)
                est[:, t + 1] = 0.1 * seen * math.comb(w, t) / math.comb(min(w, HIST_BITS), t) + sum(math.comb(w, k) for k in range(t + 1))
            tables.append(est)
        return tables

    def index(self, fps: DataFrame, *carry: str) -> DataFrame:
        keys = []
        for i, g in enumerate(self.groups):
            bit = [F.shiftleft(F.shiftright("fp", b).bitwiseAND(F.lit(1).cast("long")), at) for at, b in enumerate(g)]
            value = bit[0]
            for x in bit[1:]:
                value = value.bitwiseOR(x)
            keys.append(value + F.lit(i * 2**40))
        rows = fps.select(F.explode(F.array(*keys)).alias("key"), "id", "fp", *self.carry, *carry)
        if not self.sized:
            return rows
        # The binary digits of a size, less one, are its class.
        return rows.withColumn("key", F.col("key") + (F.length(F.bin(F.greatest("size", F.lit(1)))) - 1) * F.lit(2**44))

    def _fits(self, one: str, two: str):
        """The fingerprints of two sides (f and the letter) lie within the radius, and the sizes (s and the letter) allow the similarity."""
        near = F.bit_count(F.col(f"f{one}").bitwiseXOR(F.col(f"f{two}"))) <= self.radius
        if not self.sized:
            return near
        least, most = F.least(f"s{one}", f"s{two}"), F.greatest(f"s{one}", f"s{two}")
        return near & (least >= most * F.lit(SIMILARITY) - 1e-6)

    def probe(self, fps: DataFrame, *carry: str) -> DataFrame:
        spark = fps.sparkSession
        tables, groups, total, m = spark.sparkContext.broadcast(self._estimates()), self.groups, self.radius - self.m + 1, self.m
        sized = self.sized

        def run(batches):
            tabs = tables.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                fp = batch.column(1).to_numpy()
                values = [_gather(fp, g) for g in groups]
                classes = [(np.zeros(len(fp), np.int64), np.ones(len(fp), bool))]
                if sized:
                    size = batch.column(2).to_numpy()
                    low, high = _size_class(_least_size(size)), _size_class(_most_size(size))
                    classes = [(low, np.ones(len(fp), bool)), (high, high > low)]
                # dp[s]: the least cost of the groups so far with thresholds that sum to s - i (each is at least -1)
                span = total + m
                dp, back = np.full((len(fp), span + 1), np.inf), []
                dp[:, 0] = 0
                for i, v in enumerate(values):
                    est = tabs[i][v & (len(tabs[i]) - 1)]
                    new, arg = np.full_like(dp, np.inf), np.zeros(dp.shape, np.int8)
                    for t in range(est.shape[1]):
                        cost = dp[:, : span + 1 - t] + est[:, t : t + 1]
                        better = cost < new[:, t:]
                        new[:, t:][better] = cost[better]
                        arg[:, t:][better] = t
                    dp = new
                    back.append(arg)
                at, rows = np.full(len(fp), span), np.arange(len(fp))
                for i in reversed(range(m)):
                    t = back[i][rows, at]
                    for k in np.unique(t):
                        if k == 0:
                            continue
                        own = np.flatnonzero(t == k)
                        ball = _ball(len(groups[i]), int(k) - 1)
                        step = max(1, 400_000 // len(ball))
                        for s in range(0, len(own), step):
                            o = own[s : s + step]
                            key = (values[i][o][:, None] ^ ball[None, :]).ravel() + i * 2**40
                            o = np.repeat(o, len(ball))
                            for cls, own_class in classes:
                                has = own_class[o]
                                part = batch.take(pa.array(o[has]))
                                yield pa.RecordBatch.from_arrays([pa.array(key[has] + cls[o[has]] * 2**44), *part.columns], names=["key", *names])
                    at = at - t

        names = ["id", "fp", *self.carry, *carry]
        kinds = dict(fps.dtypes)
        return fps.select(*names).mapInArrow(run, "key long, " + ", ".join(f"{c} {kinds[c]}" for c in names))

    def _named(self, rows: DataFrame, side: str, *carry: str) -> DataFrame:
        """rows of the index, probe or leaders under the names of one side of a join: key, id as a, fp as fa, size as sa."""
        return rows.toDF("key", side, f"f{side}", *[f"s{side}"] * self.sized, *carry)

    def links(self, fps: DataFrame) -> DataFrame:
        """(a, b): ids of all fingerprints within the radius whose comp differs (fps: id, fp, comp)."""
        p = self._named(self.probe(fps, "comp"), "a", "ca")
        x = self._named(self.index(fps, "comp"), "b", "cb")
        on = (p["key"] == x["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & self._fits("a", "b")
        return p.hint("merge").join(x, on).select("a", "b").distinct()

    def active(self, fps: DataFrame) -> DataFrame:
        """The rows of fps (id, fp) that have another one within the radius."""
        p, x = self._named(self.probe(fps), "a"), self._named(self.index(fps), "b")
        found = p.hint("merge").join(x, (p["key"] == x["key"]) & (F.col("a") != F.col("b")) & self._fits("a", "b"), "left_semi")
        return found.select(F.col("a").alias("id"), F.col("fa").alias("fp"), *[F.col("sa").alias(c) for c in self.carry]).distinct()

    def stars(self, fps: DataFrame, seed: int) -> DataFrame:
        """(a, b): each id with one leader of each of its index buckets, if within the radius; a bucket of g rows gives g pairs."""
        x = self.index(fps)
        lead = x.groupBy("key").agg(F.min_by(F.struct("id", "fp", *self.carry), F.struct(F.xxhash64("id", F.lit(seed)), "id")).alias("l"), F.count("*").alias("c"))
        lead = self._named(lead.where("c > 1").select("key", "l.*"), "b")
        met = self._named(x, "a").join(lead.hint("merge"), "key").where((F.col("a") != F.col("b")) & self._fits("a", "b"))
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_components(fps: DataFrame, radius: int = FP_RADIUS) -> DataFrame:
    """fps (k, fp) -> (fp, component_id): fingerprints linked at radius bits or fewer, directly or through others.

    Rows with equal fingerprints are one class, named by its smallest k. Leaders of the buckets are linked
    first; the complete probe then leaves out pairs that are connected already, so a dense group of g
    fingerprints does not become g * g rows, and no link between components is lost.
    """
    classes = cut(fps.groupBy("fp").agg(F.min("k").alias("id")), "fp-classes")
    gph = Pigeonhole(classes, radius)
    first = connected_components(gph.stars(classes, 0))
    known = cut(
        classes.join(first.hint("merge"), "id", "left").select("id", "fp", F.coalesce("component_id", "id").alias("comp")), "fp-known"
    )
    edges = gph.links(known).unionByName(first.select(F.col("id").alias("a"), F.col("component_id").alias("b")))
    comps = connected_components(edges)
    return classes.join(comps.hint("merge"), "id", "left").select("fp", F.coalesce("component_id", "id").alias("component_id"))


def near_components(docs: DataFrame, radius: int = FP_RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents.

    Null text counts as empty; texts without words have fingerprint zero and are linked like any other. Repeated
    rows and ids keep one row each. A null doc_id stays null and sorts first: its component_id is the smallest
    non-null id only if it reaches none smaller, that is, it is null where a null id is in the component.
    """
    fps = cut(fingerprints(docs).select("k", "fp"), "fps")
    comps = fingerprint_components(fps, radius)
    null = F.lit(-(2**63)).cast("long")
    return fps.join(comps.hint("merge"), "fp").select(
        F.nullif("k", null).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif("component_id", null).alias("component_id"),
    )


def _shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles (fewer words: the whole sequence; none: empty)."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ h[j : j + len(out)]) * _ODD
            out ^= out >> np.uint64(29)
    return np.unique(out)


def _shingle_set(text: str | None) -> bytes:
    return _shingles(text).tobytes()


def _shared_keys(shingles: np.ndarray) -> list[int]:
    """BANDS keys, each of BAND_MINIMA least hashes of the shingles: sets with a similarity of 0.8 share one of them in 997 of 1,000 cases, whatever the edit."""
    if not len(shingles):
        return []
    with np.errstate(over="ignore"):
        least = [int(((shingles ^ s) * _ODD).min()) for s in _SALTS]
    pack = lambda j: b"".join(x.to_bytes(8, "little") for x in least[j : j + BAND_MINIMA])
    return [xxhash.xxh64_intdigest(pack(j), j) - (1 << 63) for j in range(0, len(least), BAND_MINIMA)]


def copy_marks(docs: DataFrame) -> DataFrame:
    """(k, th, fp, size, keys): row key, hash of the text, word fingerprint, number of distinct shingles, and the keys that likely copies share."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            fp = pa.array(map(word_fingerprint, texts), pa.int64())
            sets = [_shingles(t) for t in texts]
            size, keys = pa.array(map(len, sets), pa.int64()), pa.array(map(_shared_keys, sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, size, keys], names=["k", "th", "fp", "size", "keys"])
        trim()

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_key().alias("k"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "k long, th long, fp long, size long, keys array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of SIMILARITY or more."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    one = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    full = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "sa", "sb")
    return full.mapInArrow(run, "a long, b long")


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(k, component_id): documents linked by equal texts or a 5-word shingle similarity of 0.8 or more.

    Word fingerprints within WORD_RADIUS bits propose pairs, exact shingle sets verify them. Texts with much put in front, behind or cut away lie further
    apart, so what is not connected yet is proposed once more by shared keys of least shingle hashes, and verified alike. Only documents with a
    neighbour or a shared key send their shingles.
    """
    rows = cut(copy_marks(docs), "copy-marks")
    classes = cut(rows.groupBy("th", "fp").agg(F.min("k").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys")), "word-classes")
    gph = Pigeonhole(classes.select("id", "fp", "size"), WORD_RADIUS, WORD_GROUPS, sized=True)
    act = cut(gph.active(classes.select("id", "fp", "size")), "active")
    flat = classes.select("id", "fp", F.explode("keys").alias("key"))
    many = flat.groupBy("key").agg(F.count("*").alias("c"), *[F.min_by(F.struct("id", "fp"), F.xxhash64("id", F.lit(s))).alias(f"l{s}") for s in range(LEADERS)]).where("c > 1")
    many = cut(many.select("key", F.array_distinct(F.array(*[f"l{s}" for s in range(LEADERS)])).alias("leads")), "key-leads")
    flat = cut(flat.join(many.select("key").hint("merge"), "key", "left_semi"), "keys")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_shingle_set(t) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "set"])
        trim()

    wanted = act.select("id").unionByName(flat.select("id")).distinct()
    named = classes.join(wanted.hint("merge"), "id", "left_semi").select("id", "th")
    texts = docs.select(row_key().alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = texts.join(named.hint("merge"), ["id", "th"]).select("id", "text").dropDuplicates(["id"])
    sets = cut(found.mapInArrow(run, "id long, set binary"), "sets")

    edges = cut(_verified(gph.stars(act, 0).unionByName(gph.stars(act, 1)).unionByName(gph.stars(act, 2)).distinct(), sets), "edges")
    comps = cut(connected_components(edges), "comps")
    known = cut(act.join(comps.hint("merge"), "id", "left").select("id", "fp", "size", F.coalesce("component_id", "id").alias("comp")), "known")
    edges = cut(tree(comps).unionByName(_verified(cut(gph.links(known), "pairs"), sets)), "edges")

    comps = cut(connected_components(edges), "comps")
    with_comp = lambda df: df.join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= FAR_RADIUS
    leads = many.select("key", F.explode("leads").alias("l")).select("key", F.col("l.id").alias("b"), F.col("l.fp").alias("fb"))
    near = flat.join(leads.hint("merge"), "key").where((F.col("id") != F.col("b")) & close("fp", "fb")).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    apart = near.join(comps.select(F.col("id").alias("a"), F.col("component_id").alias("ca")).hint("merge"), "a", "left").join(comps.select(F.col("id").alias("b"), F.col("component_id").alias("cb")).hint("merge"), "b", "left")
    apart = cut(apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "pairs")
    edges = cut(tree(comps).unionByName(_verified(apart, sets)), "edges")

    comps = cut(connected_components(edges), "comps")
    pairs = cross_pairs(cut(with_comp(flat), "keys"), lambda a, b: close(a["fp"], b["fp"]), "fp")
    comps = connected_components(tree(comps).unionByName(_verified(cut(pairs, "pairs"), sets)))
    return (
        rows.select("k", "th", "fp")
        .join(classes.select("id", "th", "fp").hint("merge"), ["th", "fp"])
        .join(comps.hint("merge"), "id", "left")
        .select("k", F.coalesce("component_id", "id").alias("component_id"))
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest doc_id stays.

    Columns are those of docs, whatever their names. Rows that share a doc_id stay or go together: decisions are by id. A null
    doc_id counts as the smallest. An empty table stays empty.
    """
    groups = near_copy_groups(docs)
    keep = cut(groups.where("k = component_id").select(F.col("k").alias("kept")).distinct(), "kept")
    return own_columns(with_key(docs, "k").join(keep.hint("merge"), F.col("k") == F.col("kept"), "left_semi"), docs)
