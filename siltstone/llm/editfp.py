"""Document fingerprints by randomised edit embedding.

A walk reads the text with one pointer and one clock; at each tick a random bit, shared by all documents and chosen by the
tick and the letter, tells whether the pointer moves on. Few edits leave two walks together most of the time, so edit distance
becomes Hamming distance between what is read at each tick. As the bits are known beforehand, a table gives how long each letter
holds the pointer, and a letter costs one step. The fingerprint samples SAMPLES ticks, those of least priority under a
shared random order among the ticks that the walk takes, and keeps one byte of the letters at each; for a longer and a shorter walk these
samples agree in their common part. Bands of sampled values then propose pairs, which the full fingerprints verify.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, cross_pairs, cut, row_key, tree

SAMPLES = 96
BANDS, BAND_ROWS = 16, 5
NEAR = 0.8
_PERIOD = 4096  # of the shared bits
_CLASSES = 256  # of letters
_ABREAST = 48  # texts that array steps pay for
LEADERS = 3


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _hold() -> np.ndarray:
    """hold[letter class * period + tick]: ticks until the pointer moves on."""
    bits = np.random.default_rng(20240229).random((_CLASSES, _PERIOD)) < 0.5
    out = np.zeros((_CLASSES, _PERIOD), np.int64)
    wait = np.full(_CLASSES, 1)
    for j in range(2 * _PERIOD - 1, -1, -1):
        wait = np.where(bits[:, j % _PERIOD], 1, wait + 1)
        out[:, j % _PERIOD] = wait
    return np.ascontiguousarray(out).ravel()


_HOLD = _hold().astype(np.int32)
_HOLD_LIST = _HOLD.tolist()


_samples: dict[int, np.ndarray] = {}


def sample_ticks(total: int) -> np.ndarray:
    """The ticks under total with the least priorities, at most SAMPLES, in order of priority."""
    level = max(7, int(total - 1).bit_length())
    if level not in _samples:
        ticks = np.arange(1 << level, dtype=np.uint64)
        pri = _mix(ticks + np.uint64(0x9E3779B97F4A7C15))
        if level > 12:  # enough of them lie in the lower half
            few = np.flatnonzero(pri < np.uint64(int(2**64 * (8 * SAMPLES / (1 << level)))))
        else:
            few = np.arange(1 << level)
        _samples[level] = few[np.argsort(pri[few], kind="stable")]
    order = _samples[level]
    return order[order < total][:SAMPLES]


_CLASS_OF = (_mix(np.arange(0x110000, dtype=np.uint64)) & np.uint64(_CLASSES - 1)).astype(np.int32)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(codes: np.ndarray) -> np.ndarray:
    return _CLASS_OF[codes]


def _alone(classes: np.ndarray, clock: np.ndarray, first: int) -> None:
    """Fill clock from place first on for one text: cheaper than array steps where few texts walk side by side."""
    now, hold = int(clock[first]), _HOLD_LIST
    for s in range(first, len(classes), 1 << 20):
        steps = (classes[s : s + (1 << 20)] * _PERIOD).tolist()
        way = list(accumulate(steps, lambda t, c: t + hold[c + (t & _PERIOD - 1)], initial=now))
        clock[s + 1 : s + 1 + len(steps)] = way[1:]
        now = way[-1]


def _walks(parts: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """For each array of letter classes the clock before each letter and after the last, from the clocks in begin."""
    out: list[np.ndarray] = [None] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    s = 0
    while s < len(order):
        longest = len(parts[order[s]])
        group = order[s : s + max(1, min(1024, 3_000_000 // (longest + 1)))]
        s += len(group)
        sizes = np.array([len(parts[i]) for i in group])
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # parts longer than each position
        together = int(np.searchsorted(-alive, -(_ABREAST - 1), side="left"))  # places that many parts have
        clock = np.zeros((together + 1, len(group)), np.int32)
        clock[0] = now = begin[group].astype(np.int32)
        if together:
            grid = np.zeros((together, len(group)), np.int32)
            for col, i in enumerate(group):
                n = min(sizes[col], together)
                grid[:n, col] = parts[i][:n] * _PERIOD
            for i in range(together):
                a = alive[i]
                now = now[:a]
                now = now + _HOLD[grid[i, :a] + (now & _PERIOD - 1)]
                clock[i + 1, :a] = now
        for col, i in enumerate(group):
            n = min(int(sizes[col]), together)
            out[i] = own = np.empty(sizes[col] + 1, np.int32)
            own[: n + 1] = clock[: n + 1, col]
            if n < sizes[col]:
                _alone(parts[i], own, n)
    return out


def _values(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One byte of the four letters from each place on."""
    padded = np.concatenate([codes, np.zeros(3, np.uint32)]).astype(np.uint64)
    with np.errstate(over="ignore"):
        v = padded[at]
        for j in (1, 2, 3):
            v = v * np.uint64(0x100000001B3) + padded[at + j]
    return (_mix(v) & np.uint64(0xFF)).astype(np.uint8)


def _sketch(codes: np.ndarray, clock: np.ndarray) -> str:
    """Ticks of the whole walk (8 hex digits), then one byte for each sampled tick."""
    total = int(clock[-1])
    if not len(codes):
        return "00000000"
    ticks = sample_ticks(total)
    at = np.searchsorted(clock, ticks, side="right") - 1
    return f"{total:08x}" + _values(codes, at).tobytes().hex()


def grids(codes: np.ndarray, clock: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(level, ticks inside, SAMPLES values) on the fixed ticks of the walk's level and of the level it would have a quarter longer.

    Two walks whose lengths differ by a quarter or less share a level, and there their values stand at the same places. Values inside are
    never 0, ticks beyond the walk are.
    """
    total = int(clock[-1])
    if not len(codes):
        return []
    out = []
    for level in sorted({max(7, int(x - 1).bit_length()) for x in (total, total + total // 4)}):
        ticks = sample_ticks(1 << level)
        inside = ticks < total
        at = np.where(inside, np.searchsorted(clock, ticks, side="right") - 1, 0)
        out.append((level, int(inside.sum()), (np.maximum(_values(codes, at), 1) * inside).astype(np.uint8).tobytes()))
    return out


def likeness(a: str, b: str) -> float:
    """Share of the longer walk's sampled ticks at which both fingerprints hold the same value; two empty ones: 1."""
    if a == b:
        return 1.0
    ta, tb = int(a[:8], 16), int(b[:8], 16)
    if ta < tb:
        a, b, ta, tb = b, a, tb, ta
    if not tb:
        return 0.0
    va, vb = (np.frombuffer(bytes.fromhex(x[8:]), np.uint8) for x in (a, b))
    inside = sample_ticks(ta) < tb
    # The shorter walk has a sample at each tick that the longer one has below tb, in the same order.
    short = sample_ticks(tb)
    pos = np.flatnonzero(np.isin(short, sample_ticks(ta)[inside], assume_unique=True))
    return float((va[inside] == vb[pos]).sum() / len(va))


def fingerprint_batch(texts: list[str]) -> list[str]:
    codes = [_letters(t) for t in texts]
    clocks = _walks([_classes(c) for c in codes], np.zeros(len(texts), np.int64))
    return [_sketch(c, k) for c, k in zip(codes, clocks)]


def _with_edits(texts: list[str]):
    """For all but the last text: fingerprints, edited texts, their fingerprints, grids; the last only lends its letters.

    An edited text begins like its own, so its walk goes on from the clock at the cut.
    """
    codes = [_letters(t) for t in texts]
    n = len(texts) - 1
    clocks = _walks([_classes(c) for c in codes], np.zeros(len(texts), np.int64))
    edited, tails, begin = [], [], []
    for i in range(n):
        keep = len(codes[i]) - len(codes[i]) // 2
        tail = codes[i + 1][: len(codes[i]) // 2]
        edited.append(np.concatenate([codes[i][:keep], tail]))
        tails.append(_classes(tail))
        begin.append(clocks[i][keep])
    more = _walks(tails, np.array(begin, np.int64))
    fps = [_sketch(c, k) for c, k in zip(codes, clocks)]
    efps = [_sketch(e, np.concatenate([clocks[i][: len(e) - len(tails[i])], more[i]])) for i, e in enumerate(edited)]
    grid = [[{"level": a, "n": m, "v": v} for a, m, v in grids(codes[i], clocks[i])] for i in range(n)]
    return fps, [e.tobytes().decode("utf-32-le", "surrogatepass") for e in edited], efps, grid


def _ranges(docs: DataFrame, parts: int):
    """Bounds of ranges of k in ascending order (counts of ids only)."""
    ids = docs.select(row_key().alias("k"))
    cuts = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    return np.array(sorted(set(cuts)), np.int64)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, grids) for each row.

    The next document is the one with the next smaller doc_id (null last); after the last comes the first. Null text counts as empty. Rows
    that share an id follow each other in the order of their text. A single row is its own next.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _ranges(docs, parts)

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, k.to_numpy(), side="right"))

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(row_key().alias("k"), text.alias("text")).withColumn("part", part_of("k"))
    # The largest k of each part: one row a part. That row is lent to the part before it, the very first to the last.
    tops = sorted(tuple(r) for r in docs.select(row_key().alias("k")).withColumn("part", part_of("k")).groupBy("part").agg(F.max("k")).collect())
    lend = [(p, top, tops[i - 1][0]) for i, (p, top) in enumerate(tops)]
    heads = F.broadcast(spark.createDataFrame(lend, "part int, k long, to int"))
    lent = rows.join(heads, ["part", "k"]).groupBy("to", "k").agg(F.min("text").alias("text"))
    both = rows.select(F.col("part").alias("to"), "k", "text", F.lit(False).alias("lent")).unionByName(lent.select("to", "k", "text", F.lit(True).alias("lent")))
    both = both.repartitionByRange(parts, "to").sortWithinPartitions("to", "lent", F.desc("k"), "text")

    def run(batches):
        held: list[tuple[int, str]] = []
        size = 0

        def flush(last: str):
            keys, texts = [k for k, _ in held], [t for _, t in held]
            fps, edited, efps, grid = _with_edits([*texts, last])
            null = -(2**63)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([None if k == null else k for k in keys], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                    pa.array(fps[:-1]),
                    pa.array(efps),
                    pa.array([likeness(a, b) for a, b in zip(fps, efps)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(fps, fps[1:])], pa.float64()),
                    pa.array(grid, pa.list_(pa.struct([("level", pa.int32()), ("n", pa.int32()), ("v", pa.binary())]))),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "grids"],
            )

        for b in batches:
            for k, t, lent_row in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if lent_row:
                    if held:
                        yield flush(t)
                    held, size = [], 0
                    continue
                if held and size > 1_500_000:
                    yield flush(t)
                    held, size = [], 0
                held.append((k, t))
                size += len(t) + 64
        if held:
            raise RuntimeError("a part ended without the row lent to it")

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, grids array<struct<level:int,n:int,v:binary>>"
    return both.mapInArrow(run, schema)


_LONGS = SAMPLES // 8


def _near(a: dict, b: dict):
    """Whether the grids of two rows, given by the names of their columns n, v0, v1..., agree in NEAR of the ticks that the longer walk takes; ticks beyond both are
    equal and do not count."""
    # Each byte is folded to four bits, zero only if the bytes are equal; adding fifteen then carries into the fifth bit if they are not.
    low, fifth = "1085102592571150095L", "1157442765409226768L"

    def differing(i: int) -> str:
        x = f"({a[f'v{i}']} ^ {b[f'v{i}']})"
        return f"bit_count(((({x} | shiftrightunsigned({x}, 4)) & {low}) + {low}) & {fifth})"

    differ = " + ".join(map(differing, range(_LONGS)))
    longer = f"greatest({a['n']}, {b['n']})"
    return F.expr(f"{longer} - ({differ}) >= {NEAR} * {longer}")


def near_classes(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fingerprint, grids) -> (fingerprint, class_id): linked by grids that agree in NEAR or more, found through equal bands.

    Equal fingerprints are one class, named by the smallest id; empty texts have no grids and no class. Each band hashes BAND_ROWS values of one
    level's grid. LEADERS rows of each band are compared with all of it first. What is connected then needs no comparison: bands with
    one component fall away, and the other bands' rows meet in blocks; the join condition verifies, so only true links leave a join.
    """
    classes = cut(fps.where(F.size("grids") > 0).groupBy("fingerprint").agg(F.min(row_key()).alias("id"), F.first("grids").alias("grids")), "edit-classes")
    flat = classes.select("id", F.explode("grids").alias("g")).select("id", "g.level", "g.n", "g.v")

    def bands(batches):
        for b in batches:
            ids, levels, keys = [], [], []
            for i, level, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for j in range(BANDS):
                    part = v[j * BAND_ROWS : (j + 1) * BAND_ROWS]
                    if any(part):
                        ids.append(i)
                        levels.append(level)
                        keys.append(int.from_bytes(hashlib.blake2b(bytes([level, j]) + part, digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(levels, pa.int32()), pa.array(keys, pa.int64())], names=["id", "level", "key"])

    keys = cut(flat.select("id", "level", "v").mapInArrow(bands, "id long, level int, key long"), "edit-bands")
    leads = [F.min_by("id", F.xxhash64("id", F.lit(seed))).alias(f"lead{seed}") for seed in range(LEADERS)]
    full = keys.groupBy("key").agg(F.count("*").alias("c"), *leads).where("c > 1")
    full = cut(full.select("key", F.array_distinct(F.array(*[f"lead{seed}" for seed in range(LEADERS)])).alias("leads")), "edit-full")
    longs = [F.conv(F.hex(F.substring("v", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"v{i}") for i in range(_LONGS)]
    rows = flat.select("id", "level", "n", *longs)
    shared = cut(keys.join(full.select("key").hint("merge"), "key").join(rows.hint("merge"), ["id", "level"]), "edit-shared")

    names = ["n", *[f"v{i}" for i in range(_LONGS)]]
    side = lambda df, c: df.select("key", F.col("id").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in names])
    lead = side(shared.join(full.select("key", F.explode("leads").alias("id")).hint("merge"), ["key", "id"]).dropDuplicates(["key", "id"]), "b")
    near = _near(*({v: f"{v}_{c}" for v in names} for c in "ab"))
    stars = side(shared, "a").join(lead.hint("merge"), "key").where((F.col("a") != F.col("b")) & near)
    stars = cut(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edit-stars")
    comps = cut(connected_components(stars), "edit-comps")
    known = cut(shared.join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id"), "edit-known")
    rest = cut(cross_pairs(known, _near, *names), "edit-rest")
    links = tree(comps).unionByName(rest)
    comps = connected_components(links)
    return classes.join(comps.hint("merge"), "id", "left").select("fingerprint", F.coalesce("component_id", "id").alias("class_id"))
