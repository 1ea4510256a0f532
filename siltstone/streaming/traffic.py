"""The traffic operators over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from ..operators import traffic

REQUEST_SCHEMA = "event_id LONG, ts TIMESTAMP, host STRING, path STRING, user_agent STRING, referrer STRING, ip STRING, cookie STRING, accept STRING, sec_fetch_dest STRING, status INT"


def request_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Request logs that arrive as Parquet files; event ids are taken once within the watermark."""
    raw = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])


def visit_stream(requests: DataFrame, salt: str | None) -> DataFrame:
    return traffic.visits(requests, salt)


def window_counts(events: DataFrame, *dims: str) -> DataFrame:
    """Half-hour counts in append mode: a window is written once the watermark has passed it; later rows are dropped and counted in
    the query's progress. The state is one row for each open window and value of dims."""
    return traffic.tumbling(events, *dims)


def sessions(events: DataFrame) -> DataFrame:
    return traffic.inactivity_sessions(events)


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A Parquet sink with exactly-once files, run until the input there is now is done."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HALF_HOUR = 1800


def split_late(events: DataFrame, path: str, checkpoint: str, delay_seconds: int = 3600) -> StreamingQuery:
    """Events into path/on_time and, where their half hour was closed before they came, path/late: no row is lost without a trace.

    A half hour is closed once the latest time of earlier batches less the delay has passed its end. Each batch writes its two parts and its latest time under
    its own number, so a batch that is run again after a failure replaces what it wrote.
    """
    spark = events.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            seen = spark.read.schema("batch_id long, latest double").parquet(f"{path}/latest") if number else None
            before = seen.where(F.col("batch_id") < number).agg(F.max("latest")).first()[0] if seen is not None else None
            closed = F.lit(False) if before is None else (F.floor(F.unix_micros("ts") / 1e6 / HALF_HOUR) + 1) * HALF_HOUR <= before - delay_seconds
            late = F.coalesce(closed, F.lit(False))
            rows.where(~late).write.mode("overwrite").parquet(f"{path}/on_time/batch_id={number}")
            rows.where(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={number}")
            rows.agg(F.max(F.unix_micros("ts") / 1e6).alias("latest")).write.mode("overwrite").parquet(f"{path}/latest/batch_id={number}")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_time_stream(spark: SparkSession, path: str, schema: StructType, delay_seconds: int = 3600) -> DataFrame:
    """The stream of what split_late() let through. Its own watermark never passes that of the split, so no row of it is dropped."""
    return spark.readStream.schema(StructType(list(schema.fields)).add("batch_id", LongType())).parquet(f"{path}/on_time").drop("batch_id").withWatermark("ts", f"{delay_seconds} seconds")


def accounted(spark: SparkSession, path: str, counts: str, checkpoint: str, *dims: str) -> DataFrame:
    """(window_start, dims..., n_closed, n_open, n_late) of window_counts() over on_time_stream(): closed half hours from its sink, open ones from its state as
    the checkpoint holds it, and late rows from the side table. Their sum is what a batch over all rows counts."""
    names = ["window_start", *dims]
    closed = spark.read.parquet(counts).select(*names, F.col("n_events").alias("n_closed"))
    state = spark.read.format("statestore").load(checkpoint)
    open_ = state.select(F.col("key.window.start").alias("window_start"), *[F.col(f"key.{d}").alias(d) for d in dims], F.col("value.count").alias("n_open"))
    rows = spark.read.parquet(f"{path}/late")
    late = rows.groupBy(F.window("ts", "30 minutes").alias("w"), *dims).agg(F.count("*").alias("n_late")).select(F.col("w.start").alias("window_start"), *dims, "n_late")
    parts = [p.select(*names, *[(F.col(c) if c in p.columns else F.lit(0).cast("long")).alias(c) for c in ("n_closed", "n_open", "n_late")]) for p in (closed, open_, late)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("n_closed", "n_open", "n_late")])
