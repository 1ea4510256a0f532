"""Shared folder, lineage cuts and connected components used by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Settings while a table is written: its shuffle files are dropped once it is there, and Python gets few texts at a time, as some are very long.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _OWN[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, lost executors cost
    no recomputation, and joins see the true size. The session's own settings come back afterwards."""
    spark = df.sparkSession
    path = fresh(spark, name)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Hand freed memory back, as an idle worker keeps what it once had beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def with_key(docs: DataFrame, name: str) -> DataFrame:
    """(own, name): the columns of docs in a struct, so that none of their names can clash, and the row key."""
    return docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("own"), row_key().alias(name))


def own_columns(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of the struct of with_key."""
    return packed.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def row_key(doc_id: str = "doc_id"):
    """doc_id as a key that is never null: null sorts before every other id."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: A node with more than this share of all rows is met by a broadcast, so at most 1 / HUB_SHARE nodes are.
HUB_SHARE = 0.002


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """rows (a, b), n of them at most -> (a, b, m): m is the least of the b that share an a.

    Hubs, of which there can be at most 1 / HUB_SHARE, get theirs by a broadcast; their rows stay where they are.
    """
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
    bound = max(32, HUB_SHARE * n)
    hubs = F.broadcast(least.where(F.col("c") > bound).select("a", "m"))
    rest = least.where(F.col("c") <= bound).select("a", "m")
    one = rows.join(hubs, "a").select("a", "b", "m")
    return one.unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(rest.hint("merge"), "a").select("a", "b", "m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long), a <> b -> (id, component_id): the smallest id reachable, for ids that have an edge.

    Large-star / small-star contraction: every round is two aggregations and joins on node ids, in which nodes of very high degree are
    broadcast with their minimum. Each round is cut. Empty edges give an empty result; repeated edges count once. Raises if max_rounds are not enough.
    """
    e = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc",
    )
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            _with_least(both, 2 * before[0])
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        joined = _with_least(cut(large, "cc-large"), before[0])
        small = (
            joined.select("a", F.col("m").alias("b"))
            .unionByName(joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        e = cut(small, "cc")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    own = e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(own)


def tree(comps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what comps (id, component_id) connects."""
    return comps.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))


#: Rows of one key that a task compares with as many others.
BLOCK = 2_000


def cross_pairs(rows: DataFrame, near, *values: str) -> DataFrame:
    """rows (key, id, comp, values...) -> (a, b), a < b: distinct ids of different components that share a key and for which near holds.

    near takes two dicts of the values' column names, one for each side; it is part of the join's condition, so no other pair leaves the join. Keys
    with one component have nothing to link and fall away. The rows of a key are dealt to blocks of about BLOCK; block i meets the blocks from i on,
    each two in a cell of their own, and in cell (i, i) each pair counts once: a key with very many rows is spread over many tasks.
    """
    mixed = rows.groupBy("key").agg(F.count("*").alias("_c"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    live = cut(rows.join(mixed.select("key", "_c").hint("merge"), "key"), "mixed").withColumn("_s", F.ceil(F.col("_c") / BLOCK).cast("int"))
    live = live.withColumn("_i", F.pmod(F.xxhash64("id", F.lit(3)), F.col("_s")).cast("int"))
    x = live.withColumn("_j", F.explode(F.sequence("_i", F.col("_s") - 1))).withColumn("cell", F.col("_i") * F.col("_s") + F.col("_j")).withColumn("own", F.col("_i") == F.col("_j"))
    y = live.withColumn("_h", F.explode(F.sequence(F.lit(0), "_i"))).withColumn("cell", F.col("_h") * F.col("_s") + F.col("_i"))
    side = lambda df, t, *more: df.select(*[F.col(c).alias(f"{c}_{t}") for c in ("key", "cell", "id", "comp", *values)], *more)
    x, y = side(x, "x", "own"), side(y, "y")
    once = ~F.col("own") | (F.col("id_x") < F.col("id_y"))
    on = (F.col("key_x") == F.col("key_y")) & (F.col("cell_x") == F.col("cell_y")) & (F.col("comp_x") != F.col("comp_y")) & once & near(*({v: f"{v}_{t}" for v in values} for t in "xy"))
    return x.hint("merge").join(y, on).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
