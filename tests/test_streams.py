"""Late rows of a stream are accounted for."""

import random

from pyspark.sql import functions as F

from siltstone.operators import traffic as t
from siltstone.streaming import traffic as st

BASE = 1_700_000_000 // 1800 * 1800


def feed(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id long, at double, kind string").select("event_id", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"), "kind")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_closed_open_and_late_rows_add_up(spark, tmp_path):
    rnd, every, late = random.Random(3), [], set()
    schema, latest = None, None
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for step in range(4):
            # Time goes on by an hour and a half a run; a third of the rows are up to four hours old.
            rows = [(step * 100 + i, BASE + step * 5400 + rnd.random() * 5400 - (rnd.random() * 14400 if i % 3 == 0 else 0), rnd.choice("ab")) for i in range(100)]
            schema = feed(spark, f"{tmp_path}/in", rows)
            late |= {r[0] for r in rows if latest is not None and (r[1] // 1800 + 1) * 1800 <= latest - 3600}
            latest = max([latest or 0, *(r[1] for r in rows)])
            every += rows
            source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            st.split_late(source, f"{tmp_path}/split", f"{tmp_path}/cp-split").awaitTermination()
            q = st.write(st.window_counts(st.on_time_stream(spark, f"{tmp_path}/split", schema), "kind"), f"{tmp_path}/counts", f"{tmp_path}/cp-counts")
            q.awaitTermination()
            assert all(int(o["numRowsDroppedByWatermark"]) == 0 for p in q.recentProgress for o in p["stateOperators"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {r["event_id"] for r in spark.read.parquet(f"{tmp_path}/split/late").collect()} == late and len(late) > 20
    got = {(r["window_start"], r["kind"]): r for r in st.accounted(spark, f"{tmp_path}/split", f"{tmp_path}/counts", f"{tmp_path}/cp-counts", "kind").collect()}
    want = {(r["window_start"], r["kind"]): r["n_events"] for r in t.tumbling(spark.read.parquet(f"{tmp_path}/in"), "kind").collect()}
    assert {k: r["n_closed"] + r["n_open"] + r["n_late"] for k, r in got.items()} == want
    assert all(sum(r[c] for r in got.values()) > 0 for c in ("n_closed", "n_open", "n_late"))
