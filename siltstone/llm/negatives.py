"""Hard negatives by threshold joins over an inverted index of vectors.

The index holds blocks of rows, dimension by dimension, in an order of falling energy. A batch of anchors of bounded size meets every block with a score
threshold for each anchor. A row is left out of the lists of all dimensions from the first one on where the norm of what remains is below the least
threshold (over anchors of norm one), and out of the index if that is the first. Partial scores are accumulated along the lists; a pair whose partial score and
remaining norms cannot reach its anchor's threshold is pruned, and what is left is scored exactly. Thresholds start high and fall for the anchors whose
windows are not full yet. Only the best few of each anchor leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

POSITIVES, NEGATIVES = 5, 5
#: A window reaches from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 80, 100
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: Bytes of the anchors' matrix that a pass broadcasts; rows of an index block, and anchors that meet it at a time; dimensions accumulated between two
#: prunings; the share of live pairs under which a block is scored pair by pair.
BATCH_BYTES, BLOCK_ROWS, TILE, STEP, SPARSE = 16_000_000, 1_024, 512, 16, 0.02
#: First thresholds of the positives, in shares of the anchor's norm times the largest norm; the last round takes every row.
POSITIVE_ROUNDS = (0.45, 0.25, float("-inf"))
#: First threshold of the negatives, in shares of the least window's upper end; the last is the least window's lower end.
NEGATIVE_ROUND = 0.93
_SLACK = 1e-9  # of floating-point bounds, relative to the norms

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id long, label long, x array<double>): the rows that take part, one for each vec_id, with the label changed where vec_id is divisible by RELABEL_EVERY."""
    v = F.col("vec_id").cast("long")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    label = F.col("label").cast("long")
    own = ok.select(v.alias("vec_id"), F.struct(F.when(v % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label).alias("label"), F.col("embedding").alias("x")).alias("r"))
    return own.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", F.col("r.x").cast("array<double>").alias("x"))


def integers(xs: list, dims: int, order: np.ndarray | None = None) -> np.ndarray:
    """floor(256 x) of vectors as doubles, which hold them exactly; shorter vectors end in zeros."""
    out = np.zeros((len(xs), dims))
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    out = np.floor(256.0 * out)
    return out if order is None else out[:, order]


def _energies(dims: int):
    """One row a task: sums of squares by dimension, and the largest squared norm."""

    def run(batches):
        total, most = np.zeros(dims), 0.0
        for b in batches:
            q = integers(b["x"].to_pylist(), dims)
            total += (q * q).sum(0)
            most = max(most, float((q * q).sum(1).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([most])], names=["energy", "most"])

    return run


_BLOCK = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("q", pa.binary())])


def _packed(dims: int, order: np.ndarray):
    """Rows -> index blocks, dimension by dimension."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                q = integers(part["x"].to_pylist(), dims, order)
                ids, labels = (part[c].to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (ids, labels, np.ascontiguousarray(q.T).tobytes())], schema=_BLOCK)

    return run


def _exact(a: np.ndarray, x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Integer inner products of pairs (rows of x, rows of a): as doubles where every sum is below 2**53, else as Python integers."""
    i, j = pairs
    if not len(i):
        return np.zeros(0, dtype=np.int64)
    reach = np.sqrt(float((x * x).sum(1).max()) * float((a * a).sum(1).max()))
    if reach < 2.0**53:
        out = np.empty(len(i), dtype=np.int64)
        for at in range(0, len(i), 65_536):  # some pairs at a time, as each takes a row of either side
            out[at : at + 65_536] = np.einsum("pd,pd->p", x[i[at : at + 65_536]], a[j[at : at + 65_536]])
        return out
    whole = [sum(int(u) * int(v) for u, v in zip(x[p], a[q])) for p, q in zip(i, j)]
    if any(abs(s) >= 2**63 for s in whole):
        raise OverflowError("a score leaves 64 bits")
    return np.array(whole, dtype=np.int64)


def threshold_pairs(a: np.ndarray, at_least: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row of x, row of a, score) whose score reaches at_least of the row of a; x and a share the order of dimensions.

    x: (rows, dims), a: (anchors, dims), integers held as doubles.
    """
    dims = x.shape[1]
    left = lambda m: np.sqrt(np.maximum(0.0, np.cumsum((m * m)[:, ::-1], 1)[:, ::-1]))  # noqa: E731  norms of what remains from each dimension on
    x_left, a_left = (np.hstack([left(m), np.zeros((len(m), 1))]) for m in (x, a))
    norms = a_left[:, 0]
    unit = float(np.min(np.where(norms > 0, at_least / np.maximum(norms, 1e-300), np.where(at_least > 0, np.inf, -np.inf)), initial=np.inf))
    # A row's last indexed dimension: beyond it the norm that remains is below the least threshold of an anchor of norm one.
    length = (x_left[:, :dims] >= unit * (1 - _SLACK)).sum(1) if unit > 0 else np.full(len(x), dims)
    rows = np.argsort(-length, kind="stable")
    rows = rows[: int(np.searchsorted(-length[rows], 0))]  # the others are not in the index at all
    cols = np.arange(len(a))
    partial = np.zeros((len(rows), len(cols)))
    end, reach = 0, float(x_left[:, 0].max(initial=0.0)) * float(norms.max(initial=0.0))
    slack = _SLACK * (reach + 1)
    for end in range(STEP, dims + STEP, STEP):
        begin, end = end - STEP, min(end, dims)
        listed = int(np.searchsorted(-length[rows], -begin, side="left"))  # rows with a dimension from begin on in their lists
        partial[:listed] += (x[rows[:listed], begin:end]) @ a[cols, begin:end].T
        # A row whose lists have ended has what remained there as its bound.
        seen = np.minimum(end, np.maximum(STEP * np.ceil(length[rows] / STEP).astype(int), STEP))
        rest = x_left[rows, np.minimum(seen, dims)]
        alive = np.empty(partial.shape, dtype=bool)
        for r in np.unique(seen):
            some = seen == r
            alive[some] = partial[some] + np.outer(rest[some], a_left[cols, min(r, dims)]) + slack >= at_least[cols]
        keep_rows, keep_cols = alive.any(1), alive.any(0)
        rows, cols, alive, partial = rows[keep_rows], cols[keep_cols], alive[np.ix_(keep_rows, keep_cols)], partial[np.ix_(keep_rows, keep_cols)]
        if not alive.size or alive.mean() < SPARSE or end == dims:
            break
    i, j = np.nonzero(alive) if alive.size else (np.zeros(0, int), np.zeros(0, int))
    full = end == dims and reach < 2.0**53  # then the sums of rows that are indexed whole are the scores
    known = (length[rows[i]] == dims) if full else np.zeros(len(i), dtype=bool)
    score = np.zeros(len(i), dtype=np.int64)
    score[known] = partial[i[known], j[known]]
    i, j = rows[i], cols[j]
    score[~known] = _exact(a, x, (i[~known], j[~known]))
    hit = score >= at_least[j]
    return i[hit], j[hit], score[hit]


def _unpack(row_q: bytes, dims: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(row_q, dtype="<f8").reshape(dims, -1).T)


def _best(groups: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < n]


def _joined(dims: int, a: np.ndarray, at_least: np.ndarray, split):
    """Index blocks -> best rows (group, id, score) of each group; split gives the groups and rows of pairs (anchor, id, label, score)."""

    def run(batches):
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        n = max(POSITIVES, NEGATIVES)
        for b in batches:
            for ids, labels, q in zip(*(b[c].to_pylist() for c in ("ids", "labels", "q"))):
                x, row_ids, row_labels = _unpack(q, dims), np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                found = [held]
                for at in range(0, len(a), TILE):
                    i, j, score = threshold_pairs(a[at : at + TILE], at_least[at : at + TILE], x)
                    group, of = split(j + at, row_ids[i], row_labels[i], score)
                    new = group, row_ids[i][of], score[of]
                    top = _best(*new, n)
                    found.append(tuple(h[top] for h in new))
                both = tuple(np.concatenate(c) for c in zip(*found))
                top = _best(*both, n)
                held = tuple(h[top] for h in both)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()) for h in held], names=["grp", "id", "score"])

    return run


def _top(index: DataFrame, dims: int, a: np.ndarray, at_least: np.ndarray, split, n: int) -> DataFrame:
    """(grp, id, score, rank): the n best of each group over all blocks, written."""
    found = index.mapInArrow(_joined(dims, a, at_least, split), "grp long, id long, score long")
    w = W.partitionBy("grp").orderBy(F.desc("score"), "id")
    return cut(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n), "best")


def _positives(index: DataFrame, dims: int, ids, labels, a, most: float) -> np.ndarray:
    """The scores and ids of each anchor's positives: (anchors, POSITIVES, 2), -1 in a missing one's mask column."""
    out = np.zeros((len(ids), POSITIVES, 3), dtype=np.int64)
    open_ = np.arange(len(ids))
    norms = np.sqrt((a * a).sum(1))
    for share in POSITIVE_ROUNDS:
        if not len(open_):
            break
        at_least = share * norms[open_] * most if np.isfinite(share) else np.full(len(open_), -np.inf)
        own_ids, own_labels = ids[open_], labels[open_]

        def split(j, row_ids, row_labels, score, own_ids=own_ids, own_labels=own_labels):
            of = np.flatnonzero((row_labels == own_labels[j]) & (row_ids != own_ids[j]))
            return j[of].astype(np.int64), of

        # At most POSITIVES rows for each anchor of a batch whose size is bounded.
        got = _top(index, dims, a[open_], at_least, split, POSITIVES).select("grp", "rank", "id", "score").toPandas()
        g, r = open_[got["grp"].to_numpy()], got["rank"].to_numpy() - 1
        out[g, r] = np.stack([got["id"].to_numpy(), got["score"].to_numpy(), np.ones(len(got), np.int64)], 1)
        full = np.bincount(got["grp"].to_numpy(), minlength=len(open_)) >= POSITIVES
        open_ = open_[~full]
    return out


def _low(score: np.ndarray) -> np.ndarray:
    """The least integer s with LOW * score <= 100 * s."""
    return -((-LOW * score) // 100)


def _negatives(index: DataFrame, dims: int, ids, labels, a, pos: np.ndarray) -> DataFrame | None:
    """(grp, id, score, rank): the best rows of each window; grp is anchor * POSITIVES + place of the positive."""
    has = (pos[:, :, 2] == 1) & (pos[:, :, 1] >= 0)
    low = np.where(has, _low(pos[:, :, 1]), np.iinfo(np.int64).max)
    open_ = np.flatnonzero(has.any(1))
    floor = low.min(1)
    least_top = np.where(has, pos[:, :, 1], np.iinfo(np.int64).max).min(1)
    done = None
    for first in (True, False):
        if not len(open_):
            break
        at_least = np.maximum(floor[open_], np.ceil(NEGATIVE_ROUND * least_top[open_])) if first else floor[open_].astype(float)
        own_labels, own_pos, own_has, own_low = labels[open_], pos[open_, :, 1], has[open_], low[open_]

        def split(j, row_ids, row_labels, score, own_labels=own_labels, own_pos=own_pos, own_has=own_has, own_low=own_low):
            other = np.flatnonzero(row_labels != own_labels[j])
            s, k = score[other], j[other]
            inside = own_has[k] & (own_low[k] <= s[:, None]) & (100 * s[:, None] <= HIGH * own_pos[k])
            r, c = np.nonzero(inside)
            return (k[r] * POSITIVES + c).astype(np.int64), other[r]

        got = _top(index, dims, a[open_], at_least, split, NEGATIVES)
        # Windows above the threshold are seen whole; the others are full or not.
        n = got.groupBy("grp").count().toPandas()  # at most POSITIVES rows an anchor of the batch
        seen = np.zeros(len(open_) * POSITIVES, dtype=np.int64)
        seen[n["grp"].to_numpy()] = n["count"].to_numpy()
        full = ((seen.reshape(-1, POSITIVES) >= NEGATIVES) | ~own_has | (own_low >= at_least[:, None])).all(1)
        kept = got.sparkSession.createDataFrame([(int(k), int(o)) for k, o in enumerate(open_) if full[k]], "local long, anchor long")
        here = got.withColumn("local", F.expr(f"grp div {POSITIVES}")).join(F.broadcast(kept), "local")  # no longer than the batch
        here = here.select((F.col("anchor") * POSITIVES + F.col("grp") % POSITIVES).alias("grp"), "id", "score", "rank")
        done = here if done is None else done.unionByName(here)
        open_ = open_[~full]
    return done


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> RESULT: for each anchor (vec_id divisible by ANCHOR_EVERY) and each of its POSITIVES best other rows of its
    label, the NEGATIVES best rows of other labels whose score lies between LOW and HIGH hundredths of the positive's.

    Scores are integer inner products of floor(256 x); ties go by smaller vec_id. Rows with a null vec_id or label, or a null or non-finite vector or
    component, take no part. Of rows that repeat a vec_id the one with the smallest (label, vector) takes part. Shorter vectors, empty ones too, count as
    ending in zeros. Windows of negative positives are empty. A score beyond 64 bits raises OverflowError. An empty table gives an empty result; other
    columns are not read. Anchors are broadcast in batches of BATCH_BYTES; every batch meets all rows.
    """
    spark = vectors.sparkSession
    rows = cut(prepared(vectors), "vectors")
    dims, n_anchors = rows.agg(F.max(F.size("x")), F.sum((F.col("vec_id") % ANCHOR_EVERY == 0).cast("long"))).first()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    dims = max(1, dims)
    stats = rows.select("x").mapInArrow(_energies(dims), "energy array<double>, most double")
    energy = [0.0] * dims
    sums = stats.select("most", F.posexplode("energy").alias("d", "e")).groupBy("d").agg(F.sum("e").alias("e"), F.max("most").alias("most"))
    most = 0.0
    for r in sums.collect():  # one row a dimension
        energy[r["d"]], most = r["e"], r["most"] ** 0.5
    order = np.argsort(-np.array(energy), kind="stable")
    index = cut(rows.mapInArrow(_packed(dims, order), "ids binary, labels binary, q binary"), "index")
    passes = -(-n_anchors * dims * 8 // BATCH_BYTES)
    out = None
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    for p in range(passes):
        batch = anchors.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(passes)) == p).orderBy("vec_id").toPandas()
        if not len(batch):
            continue
        ids, labels = batch["vec_id"].to_numpy(np.int64), batch["label"].to_numpy(np.int64)
        a = integers(list(batch["x"]), dims, order)
        pos = _positives(index, dims, ids, labels, a, most)
        neg = _negatives(index, dims, ids, labels, a, pos)
        if neg is None:
            continue
        named = [(int(g), int(ids[g // POSITIVES]), int(pos[g // POSITIVES, g % POSITIVES, 0]), int(pos[g // POSITIVES, g % POSITIVES, 1])) for g in range(len(ids) * POSITIVES) if pos[g // POSITIVES, g % POSITIVES, 2]]
        names = F.broadcast(spark.createDataFrame(named, "grp long, anchor_id long, positive_id long, positive_score long"))  # POSITIVES rows an anchor of the batch
        here = neg.join(names, "grp").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = here if out is None else out.unionByName(here)
    return spark.createDataFrame([], RESULT) if out is None else out
