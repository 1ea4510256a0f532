"""Tables that jobs write for themselves: where they go, lineage cuts, and tables that several jobs of a session read."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_HELD: dict[tuple, object] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset a session within one process gets a temporary one, which goes
    when the process ends; on a cluster it is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        path = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[context.applicationId] = "file://" + path
    return _OWN[context.applicationId]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: its lineage ends, it is computed once however often it is used, and joins see its true size."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A partition may hold so many times the share of rows that each core would have.
UNEVEN = 2


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if one of its partitions holds many more rows than others: a file of one row group is read by one task however long it is. The count
    reads no column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = [r["n"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()]  # a row a partition
    return df.repartition(max(cores, len(n))) if n and max(n) * cores > UNEVEN * sum(n) else df


def append_bucketed(df: DataFrame, name: str, path: str, buckets: int, *by: str, partition: str | None = None) -> DataFrame:
    """The table name at path with the rows of df added, in one file a bucket of the columns by (and value of the column partition). Joins on by that use as
    many partitions do not shuffle it, however often rows were added."""
    out = df.repartition(buckets, *by).sortWithinPartitions(*([partition] if partition else []), *by).write.mode("append").format("parquet")
    if partition:
        out = out.partitionBy(partition)
    out.option("compression", "zstd").option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
    return df.sparkSession.table(name)


def in_place(df: DataFrame, name: str, path: str, buckets: int, *by: str) -> DataFrame:
    """The table name at path with the rows of df, which has as many partitions, dealt by the columns by: a task writes the file of one bucket, so its rows
    are not sorted by bucket first."""
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, "2")
    try:
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *by).saveAsTable(name)
    finally:
        conf.set(key, before)
    return df.sparkSession.table(name)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return
    it = fs.listFiles(where, True)
    while it.hasNext():
        yield it.next()


def version(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files under the paths: it changes when a table is written again."""
    seen = sorted((p, f.getPath().getName(), f.getLen(), f.getModificationTime()) for p in paths for f in _files(spark, p))
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:16]


def held(spark: SparkSession, name: str, sources: tuple[str, ...], build: Callable[[], object], path_of: Callable[[object], str]):
    """What build() gave for this name and this version of the sources in this session, as long as its files are there; built again otherwise."""
    key = (spark.sparkContext.applicationId, name, sources, version(spark, *sources))
    if key in _HELD and any(True for _ in _files(spark, path_of(_HELD[key]))):
        return _HELD[key]
    _HELD[key] = build()
    return _HELD[key]


def stored(spark: SparkSession, name: str, sources: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A table built once a session for each version of its sources, and read by every job that asks for it."""

    def write():
        path, df = fresh(spark, name.split(" ")[0]), build()
        df.write.option("compression", "zstd").parquet(path)
        return path, df.schema

    path, schema = held(spark, name, sources, write, lambda x: x[0])
    return spark.read.schema(schema).parquet(path)
