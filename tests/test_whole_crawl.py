"""The crawl goes as deep as the links do."""

import pytest
from pyspark.sql import functions as F

from siltstone import registry
from siltstone.operators import graph


def depths(n):
    """Breadth first over the links of the query's n pages."""
    seen, front = {0: 0}, [0]
    while front:
        new = {d for s in front if s < n for d in ((s * 2 + 1) % n, s * 3 % n, s + 7)} - seen.keys()
        seen |= {d: seen[front[0]] + 1 for d in new}
        front = sorted(new)
    return seen


def test_deep_pages_are_reached(spark, tmp_path):
    """25,000 pages need more than twelve levels."""
    n = 25_000
    spark.range(n).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    want = depths(n)
    got = {r["node"]: r["depth"] for r in registry.QUERIES["gr2_reachable"](spark, str(tmp_path)).collect()}
    assert max(want.values()) > 12 and got == want


def test_a_bound_that_is_met_is_an_error(spark):
    chain = spark.range(4).selectExpr("id AS src", "id + 1 AS dst")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert graph.reachable(chain, seeds, max_depth=4).count() == 5
    with pytest.raises(RuntimeError):
        graph.reachable(chain, seeds, max_depth=3)


def rows_written(spark, monkeypatch):
    """Count the rows of every table a crawl appends, and the plans of its levels."""
    counts, plans, real = [], [], graph.append_bucketed

    def counted(df, name, *rest, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        before = spark.table(name).count() if spark.catalog.tableExists(name) else 0
        out = real(df, name, *rest, **more)
        counts.append((name, out.count() - before))
        return out

    monkeypatch.setattr(graph, "append_bucketed", counted)
    return counts, plans


def test_rows_written_are_linear_in_pages(spark, monkeypatch):
    """A chain of 25 levels: levels are compacted, and at most three rows are written a page."""
    monkeypatch.setattr(graph, "FRESH_LEVELS", 4)
    counts, _ = rows_written(spark, monkeypatch)
    edges = spark.range(25).selectExpr("id * 10 AS src", "explode(sequence(id * 10 + 1, id * 10 + 10)) AS dst")
    got = {r["node"]: r["depth"] for r in graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: -(-i // 10) for i in range(251)}
    pages = sum(n for name, n in counts if not name.endswith("_links"))
    assert any("_old_" in name for name, _ in counts) and len(got) < pages <= 3 * len(got)


def test_links_and_visited_pages_are_not_shuffled(spark, monkeypatch):
    _, plans = rows_written(spark, monkeypatch)
    edges = spark.range(12).selectExpr("id AS src", "id + 1 AS dst")
    assert graph.reachable(edges, spark.createDataFrame([(0,)], "node long"), max_depth=13).count() == 13
    for plan in plans[3:10]:
        # Exchanged: the frontier on its way to its links, the distinct targets, and the new level on its way to its buckets.
        assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Bucketed: true") >= 2


def test_a_page_with_very_many_links(spark):
    """Hot sources are dealt to several buckets; nulls are no pages; stops are not followed."""
    hub = spark.range(1, 5001).selectExpr("0L AS src", "id AS dst")
    edges = hub.unionByName(spark.createDataFrame([(7, 9000), (8, 9001), (None, 1), (3, None), (9000, 0)], "src long, dst long"))
    seeds = spark.createDataFrame([(0,), (None,), (0,)], "node long")
    got = {r["node"]: r["depth"] for r in graph.reachable(edges, seeds, stop=F.col("node") == 8, heavy=300).collect()}
    assert got == {0: 0, 9000: 2} | {i: 1 for i in range(1, 5001)}


def test_no_links_and_no_seeds(spark):
    none = spark.createDataFrame([], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert [tuple(r) for r in graph.reachable(none, seeds).collect()] == [(1, 0)]
    assert graph.reachable(none, seeds.where("node > 1")).count() == 0
