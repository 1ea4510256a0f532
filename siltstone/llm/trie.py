"""Prefix trie of conversations by a splitter skeleton.

A conversation becomes a path: one digest a turn. Splitters, keys (path, conv_id) of a bounded sample, cut the sorted paths into shards, and equal
paths are split by conv_id. A node whose members lie in several shards is a prefix of a splitter, so the trie of the splitters (the skeleton, broadcast)
holds every node that a shard cannot finish alone. Sorted shards finish all others in one walk with a stack as deep as the path, and give partial
aggregates for the skeleton's nodes, which are summed by node and folded from the leaves to the root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

#: At most MAX_SHARDS - 1 splitters of at most SPLIT_TURNS turns: the skeleton has at most their product of nodes, 16 bytes each.
MAX_SHARDS, SPLIT_TURNS = 512, 1024
#: Keys sampled for each splitter. They decide where shards begin, never what the result is.
SAMPLE_PER_SHARD = 16
#: Members of one chunk of a skeleton node's ends.
CHUNK = 8_192
GROUP, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"

_RECORD = "shard int, lid long, kind int, skel int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, ends string, parent long, parent_skel int"
_NODE, _PART, _ENDS = 0, 1, 2
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt_paths(convs: DataFrame) -> DataFrame:
    """(conv_id, path array<binary>, words array<long>): the rebuilt turns of each conversation as digests of role and text, and the words of each text.

    Rows are reduced to digests before the only shuffle, by conv_id - conv_id % 20, so a conversation meets the one whose head it takes without a join.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(own("role")).cast("string"), F.lit(":"), own("role"), own("text")), 256), 1, 32))
    c = F.col("conv_id").cast("long")
    rows = convs.where("conv_id IS NOT NULL").select(
        c.alias("conv_id"), (c - c % GROUP).alias("base"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.regexp_count(own("text"), F.lit(WORD)).cast("long").alias("w")).alias("t")
    )
    turns = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1))).over(W.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    none = F.expr("cast(array() AS array<struct<turn: bigint, d: binary, w: bigint>>)")
    path = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    full = turns.withColumn("head", head).withColumn("h", h).select("conv_id", path.alias("p"))
    return full.select("conv_id", F.transform("p", lambda x: x["d"]).alias("path"), F.transform("p", lambda x: x["w"]).alias("words"))


def splitters(paths: DataFrame, n: int, shards: int) -> list[tuple[tuple[bytes, ...], int]]:
    """At most shards - 1 keys of the n paths, in order: every so many of a hashed sample of about SAMPLE_PER_SHARD a shard."""
    some = paths.where(F.size("path") <= SPLIT_TURNS).where(F.pmod(F.xxhash64("conv_id", F.lit(11)), F.lit(n)) < SAMPLE_PER_SHARD * shards).select("path", "conv_id")
    placed = some.withColumn("i", F.row_number().over(W.orderBy("path", "conv_id"))).withColumn("m", F.count("*").over(W.partitionBy()))  # a bounded sample
    picked = placed.where(F.col("i") % F.ceil(F.col("m") / shards) == 0).select("path", "conv_id").collect()
    return sorted((tuple(bytes(d) for d in r["path"]), r["conv_id"]) for r in picked)[: shards - 1]


def common(a, b) -> int:
    """Length of the longest common prefix."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


class Skeleton:
    """The trie of the splitters' paths: ids[j][d] is the node of splitter j's first d turns; above[node] its parent (-1 for the root)."""

    def __init__(self, keys: list[tuple[tuple[bytes, ...], int]]):
        self.keys, self.ids, self.above, self.depth = keys, [], [], []
        for j, (path, _) in enumerate(keys):
            same = common(keys[j - 1][0], path) if j else -1
            ids = self.ids[j - 1][: same + 1] if j else []
            for d in range(same + 1, len(path) + 1):
                self.above.append(ids[-1] if ids else -1)
                self.depth.append(d)
                ids.append(len(self.above) - 1)
            self.ids.append(ids)

    def shard(self, path, conv_id: int) -> int:
        return bisect_right(self.keys, (tuple(path), conv_id))

    def nodes(self, shard: int, path) -> list[int]:
        """The skeleton nodes along a path of the shard: its common prefix with the splitter before or after the shard."""
        best: list[int] = []
        for j in (shard - 1, shard):
            if 0 <= j < len(self.keys):
                same = common(self.keys[j][0], path) + 1
                if same > len(best):
                    best = self.ids[j][:same]
        return best


def _batches(rows: list[tuple], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


_ARROW = pa.schema(
    [(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.rsplit(" ", 1) for x in _RECORD.split(", "))]
)


def _dealt(skeleton: Skeleton):
    """Adds each path's shard."""

    def deal(batches):
        for b in batches:
            shard = [skeleton.shard(p, c) for p, c in zip(b["path"].to_pylist(), b["conv_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b["conv_id"], b["path"], b["words"]], names=["shard", "conv_id", "path", "words"])

    return deal


class _Open:
    """A node whose members are still coming."""

    __slots__ = ("depth", "skel", "words", "least", "n", "children", "leaves", "saved", "sha", "ids")

    def __init__(self, depth, skel, words):
        self.depth, self.skel, self.words = depth, skel, words
        self.least, self.n, self.children, self.leaves, self.saved, self.sha, self.ids = None, 0, 0, 0, 0, None, []


def _walked(skeleton: Skeleton):
    """Rows sorted by (shard, path, conv_id) -> records in post-order: finished nodes, partial skeleton nodes, chunks of ends."""

    def walk(batches):
        out: list[tuple] = []
        stack: list[_Open] = []
        path: list[bytes] = []
        shard, lid = None, 0

        def emit(kind, x, ends):
            nonlocal lid
            out.append((shard, lid, kind, x.skel, x.depth, x.least, x.n, x.children, x.leaves, x.saved, x.words, ends, None, None))
            lid += 1

        def close():
            x = stack.pop()
            if x.skel is None:
                x.leaves = x.leaves or 1
                x.saved += (x.n - 1) * x.words
                emit(_NODE, x, (x.sha or hashlib.sha256()).hexdigest())
            else:
                if x.ids:
                    emit(_ENDS, x, ",".join(x.ids))
                emit(_PART, x, None)
            if stack:
                up = stack[-1]
                up.n += x.n
                up.least = x.least if up.least is None else min(up.least, x.least)
                if x.skel is None:
                    up.children, up.leaves, up.saved = up.children + 1, up.leaves + x.leaves, up.saved + x.saved

        for b in batches:
            for s, c, p, w in zip(*(b[k].to_pylist() for k in ("shard", "conv_id", "path", "words"))):
                if s != shard:
                    while stack:
                        close()
                    shard, lid, path = s, 0, []
                    same = -1
                else:
                    same = common(path, p)
                while len(stack) > same + 1:
                    close()
                known = skeleton.nodes(s, p)
                for d in range(len(stack), len(p) + 1):
                    stack.append(_Open(d, known[d] if d < len(known) else None, w[d - 1] if d else 0))
                path, top = p, stack[-1]
                top.n += 1
                top.least = c if top.least is None else min(top.least, c)
                if top.skel is None:
                    if top.sha is None:
                        top.sha = hashlib.sha256(str(c).encode())
                    else:
                        top.sha.update(f",{c}".encode())
                else:
                    top.ids.append(str(c))
                    if len(top.ids) >= CHUNK:
                        emit(_ENDS, top, ",".join(top.ids))
                        top.ids = []
                if len(out) >= 4096:
                    yield _batches(out, _ARROW)
                    out.clear()
        while stack:
            close()
        if out:
            yield _batches(out, _ARROW)

    return walk


def _with_parents(batches):
    """Records in reverse post-order: a node comes after its parent, whose least member is then known."""
    shard, above = None, []
    parent, skel = _ARROW.get_field_index("parent"), _ARROW.get_field_index("parent_skel")
    for b in batches:
        up, up_skel = [], []
        for s, kind, d, c, k in zip(*(b[x].to_pylist() for x in ("shard", "kind", "depth", "conv_id", "skel"))):
            if s != shard:
                shard, above = s, []
            if kind == _ENDS or d == 0:
                up.append(None)
                up_skel.append(None)
            else:
                least, of = above[d - 1]
                up.append(least if of is None else None)
                up_skel.append(of)
            if kind != _ENDS:
                del above[d:]
                above.append((c, k))
        cols = list(b.columns)
        cols[parent], cols[skel] = pa.array(up, pa.int64()), pa.array(up_skel, pa.int32())
        yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)


def _digests(batches):
    """Chunks sorted by (skel, shard, lid) -> (skel, ends_sha256), one running hash."""
    now, sha, out = None, None, []
    for b in batches:
        for k, text in zip(b["skel"].to_pylist(), b["ends"].to_pylist()):
            if k != now:
                if sha:
                    out.append((now, sha.hexdigest()))
                now, sha = k, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
    if sha:
        out.append((now, sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out])], names=["skel", "ends_sha256"])


def _reduced(spark: SparkSession, records: DataFrame, skeleton: Skeleton) -> DataFrame:
    """(skel, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of the skeleton's nodes.

    Shards' partial aggregates are summed by node; the fold over at most MAX_SHARDS * SPLIT_TURNS sums follows the skeleton from its deepest nodes up.
    """
    sums = records.where(F.col("kind") == _PART).groupBy("skel").agg(
        F.min("conv_id").alias("c"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"), F.max("words").alias("w")
    )
    of = {r["skel"]: [r["c"], r["n"], r["k"], r["l"], r["s"] + (r["n"] - 1) * r["w"]] for r in sums.collect()}
    for node in sorted(of, key=lambda x: -skeleton.depth[x]):
        x, up = of[node], of.get(skeleton.above[node])
        x[3] = x[3] or 1
        if up:
            up[2], up[3], up[4] = up[2] + 1, up[3] + x[3], up[4] + x[4]
    rows = [(k, x[0], skeleton.depth[k], of[skeleton.above[k]][0] if skeleton.above[k] >= 0 else None, *x[1:]) for k, x in of.items()]
    return spark.createDataFrame(rows, "skel int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> one row a node of the trie of rebuilt conversations (RESULT): its smallest member, depth, the parent's
    smallest member, members, children, childless nodes and saved tokens of its subtree, and the digest of the ids that end there.

    A rebuilt conversation is the first h turns of conversation c - c % 20 and c's own after its first h; h = crc32(c) % 4. Turns come by turn, null first;
    equal turns by the digest of role and text; repeated rows are turns of their own. A null role or text is empty; rows without conv_id take no part; an
    empty table has no node, not even a root. Other columns are not read. One path (16 bytes a turn, no text) is held at a time, so long texts weigh nothing;
    the ids that end in one node are hashed as a stream, in chunks if the node is in the skeleton.
    """
    spark = convs.sparkSession
    paths = cut(rebuilt_paths(convs), "paths")
    n = paths.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    shards = max(2, min(MAX_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    skeleton = Skeleton(splitters(paths, n, shards))
    dealt = paths.mapInArrow(_dealt(skeleton), "shard int, conv_id long, path array<binary>, words array<long>").repartitionById(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    walked = dealt.mapInArrow(_walked(skeleton), _RECORD).sortWithinPartitions("shard", F.desc("lid")).mapInArrow(_with_parents, _RECORD)
    records = cut(walked, "trie")
    local = records.where(F.col("kind") == _NODE)
    if not skeleton.keys:
        return local.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    chunks = records.where(F.col("kind") == _ENDS).select("skel", "shard", "lid", "ends").repartition("skel").sortWithinPartitions("skel", "shard", "lid")
    ends = chunks.mapInArrow(_digests, "skel int, ends_sha256 string")
    top = cut(_reduced(spark, records, skeleton).join(ends.hint("merge"), "skel", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "skeleton")
    of = F.broadcast(top.select(F.col("skel").alias("parent_skel"), F.col("conv_id").alias("upper")))  # the skeleton is bounded
    below = local.join(of, "parent_skel", "left").select(
        "conv_id", "depth", F.coalesce("parent", "upper").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )
    return below.unionByName(top.drop("skel"))
