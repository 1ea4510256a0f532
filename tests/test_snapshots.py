"""Versions of a table, mergeable sketches and the gram index."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.operators import search as se
from siltstone.operators import traffic as t
from siltstone.operators.snapshots import Snapshots

ROW = "k long, name string, v double"


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/table", ("k",), 40)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_against_a_dictionary(spark, store):
    """Random upserts and deletions: every version stays readable and equals the dictionary of its time."""
    rnd, now, then = random.Random(1), {i: (i, f"n{i}", float(i)) for i in range(300)}, {}
    then[store.write(spark.createDataFrame(list(now.values()), ROW))] = dict(now)
    for step in range(3):
        changed = {k: (k, f"s{step}", None if k % 3 else rnd.random()) for k in rnd.sample(range(400), 9)}
        gone = rnd.sample(range(400), 5) + ([next(iter(changed))] if step == 1 else [])
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        then[store.upsert(spark.createDataFrame(list(changed.values()), ROW), spark.createDataFrame([(k,) for k in gone], "k long"))] = dict(now)
    assert store.versions() == list(then) == [1, 2, 3, 4]
    for v, want in then.items():
        assert sorted(map(repr, (tuple(r) for r in store.read(v).collect()))) == sorted(map(repr, want.values()))
    a, b = store.differing(1, 4)
    differs = {k for k in then[1].keys() | then[4].keys() if then[1].get(k) != then[4].get(k)}
    assert differs <= {r["k"] for r in a.collect()} | {r["k"] for r in b.collect()} and 0 < a.count() < 300


def test_only_touched_buckets_are_written_and_compared(spark, store):
    one = store.write(spark.createDataFrame([(i, "x", 0.0) for i in range(500)], ROW))
    two = store.upsert(spark.createDataFrame([(7, "y", 1.0)], ROW))
    a, b = store.manifest(one), store.manifest(two)
    moved = [k for k in b["buckets"] if b["buckets"][k][0] != a["buckets"][k][0]]
    assert len(moved) == 1 and store.differing_buckets(a, b) == [int(moved[0])]
    folder = Path(b["buckets"][moved[0]][0].removeprefix("file:"))
    assert [p.name for p in folder.glob("_bucket=*")] == [f"_bucket={moved[0]}"]
    old, new = store.differing(one, two)
    assert old.count() == a["buckets"][moved[0]][1] < 60
    assert "_bucket#" in old._jdf.queryExecution().executedPlan().toString() and "PartitionFilters: [isnotnull(_bucket" in old._jdf.queryExecution().executedPlan().toString()
    same = store.write(store.read(two).repartition(3))
    assert store.manifest(same)["root"] == b["root"] and store.differing_buckets(b, store.manifest(same)) == []
    assert [d.count() for d in store.differing(two, same)] == [0, 0]


def test_a_failed_writer_leaves_the_old_version(spark, store, monkeypatch):
    store.write(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], ROW))
    bad = spark.createDataFrame([(2, "c", 3.0)], ROW).withColumn("name", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad)
    assert store.versions() == [1] and rows(store.read()) == [(1, "a", 1.0), (2, "b", 2.0)]
    # A writer that dies between its data and its manifest.
    with monkeypatch.context() as m:
        m.setattr(store, "_finish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.upsert(spark.createDataFrame([(1, "z", 9.0)], ROW))
    assert rows(store.read()) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert store.upsert(spark.createDataFrame([(1, "z", 9.0)], ROW)) == 2 and rows(store.read()) == [(1, "z", 9.0), (2, "b", 2.0)]


def test_bad_keys_are_errors(spark, store):
    store.write(spark.createDataFrame([], ROW))
    assert rows(store.read()) == []
    with pytest.raises(ValueError, match="twice"):
        store.upsert(spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], ROW))
    with pytest.raises(Exception, match="null"):
        store.write(spark.createDataFrame([(None, "a", 1.0)], ROW))
    assert store.versions() == [1]


def test_sketches_merge(spark):
    """Half hours of two tables, one of late rows: rolled up they equal the counts within the stated error, at every level of the cube."""
    events = spark.range(60_000).select(
        F.timestamp_seconds(F.col("id") % 7200 + 1_700_000_000).alias("ts"), F.concat(F.lit("v"), F.col("id") * 7919 % 23_456).alias("visit_id"), F.when(F.col("id") % 5 == 0, "bot").otherwise("human").alias("kind"), (F.col("id") % 3).alias("edition")
    )
    on_time, late = (t.half_hour_sketches(events.where(c), "kind", "edition") for c in ("visit_id < 'v2'", "NOT visit_id < 'v2'"))
    both = t.merged_sketches(on_time, late)
    assert both.count() == t.half_hour_sketches(events, "kind", "edition").count() < on_time.count() + late.count()
    want = {(r[0], r[1]): r[2:] for r in events.cube("kind", "edition").agg(F.count("*"), F.countDistinct("visit_id")).collect()}
    got = {(r[0], r[1]): r[2:] for r in t.sketched_cube(both, "kind", "edition").collect()}
    assert got.keys() == want.keys()
    for k, (n, visits) in want.items():
        assert got[k][0] == n and abs(got[k][1] - visits) <= t.SKETCH_ERROR * visits
    one = t.sketched_rollup(both, "kind").collect()
    assert {r["kind"]: r["n_events"] for r in one} == {"bot": 12_000, "human": 48_000}
    assert len(bytes(both.agg(F.hll_union_agg("sessions")).first()[0])) < 2**t.LG_K + 100  # a byte a register, whatever the number of visits


def test_grams_equal_substrings(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choices("abc", k=n))
    vocab = spark.createDataFrame([(w,) for w in {word(rnd.randint(1, 14)) for _ in range(400)} | {"aaaaaaaaaa", "ab"}], "word string")
    terms = spark.createDataFrame([(i, word(rnd.randint(1, 7)), i % 2 == 0) for i in range(60)] + [(99, "aaaaa", True), (98, "zzzzzz", True)], "query_id long, term string, content boolean")
    grams = se.gram_index(vocab)
    assert grams.count() == vocab.agg(F.sum(F.greatest(F.lit(0), F.length("word") - 2))).first()[0]
    assert rows(se.with_infixes_by_grams(terms, grams)) == rows(se.with_infixes(terms, vocab)) and se.with_infixes(terms, vocab).count() > 80
