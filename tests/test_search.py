"""Retrieval and evaluation on hand-made sections and hits."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone import registry
from siltstone.operators import evaluate as ev
from siltstone.operators import search as se

SEC = "id long, url string, heading string, body string, keywords string, emphasis string, external boolean, grp int"


def sections(spark, rows):
    return spark.createDataFrame([(i, f"/{i}/", h, b, k, e, False, g) for i, h, b, k, e, g in rows], SEC)


def order(spark, rows, query, fields=("heading", "body", "keywords", "emphasis"), adjusted=False):
    sec = sections(spark, rows)
    post = se.postings(sec, fields)
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    hits = se.coverage_floor(se.score(se.query_terms(q), se.weighted_postings(sec, post, fields=fields)))
    if adjusted:
        hits = se.adjust(hits, q, sec, post)
    return [r["id"] for r in se.rank(hits, sec).orderBy("position").collect()]


def test_field_order(spark):
    pad = "plain words that fill the section up"
    rows = [(1, "other thing", f"zebra {pad}", "", "", 0), (2, "zebra", pad, "", "", 0), (3, "other thing", pad, "", "zebra", 0), (4, "other thing", pad, "zebra", "", 0)]
    assert order(spark, rows, "zebra")[-1] == 1 and set(order(spark, rows, "zebra")) == {1, 2, 3, 4}
    assert order(spark, rows, "zebra").index(2) < order(spark, rows, "zebra").index(3)


def test_density_and_stop_words(spark):
    rows = [(1, "a", "queue retry backoff one two", "", "", 0), (2, "b", "queue retry backoff " + "filler " * 58, "", "", 0)]
    assert order(spark, rows, "queue retry backoff") == [1, 2]
    rows = [(1, "the", "the of", "", "", 0), (2, "broker", "the broker", "", "", 0)]
    assert order(spark, rows, "the broker")[0] == 2


def test_coverage_floor(spark):
    rows = [(1, "x", "alpha only", "", "", 0), (2, "y", "alpha beta", "", "", 0)]
    assert order(spark, rows, "alpha beta gamma") == [2]


def test_bonuses(spark):
    rows = [(1, "delayed job queue", "text", "", "", 0), (2, "queue job delayed", "text", "", "", 0)]
    assert order(spark, rows, "delayed job", adjusted=True) == [1, 2]
    rows = [(1, "how to retry", "retry", "", "", 0), (2, "how to retry", "retry", "", "", 2)]
    assert order(spark, rows, "how to retry", adjusted=True) == [2, 1]


def test_scope_pages_and_editions(spark):
    q = spark.createDataFrame([(1, "pkg:core send message"), (2, "plain")], "query_id long, query string")
    assert [(r["scope"], r["query"]) for r in se.scoped(q).orderBy("query_id").collect()] == [("core", "send message"), (None, "plain")]
    sec = spark.createDataFrame([(i, f"/p/#{i}", False) for i in range(4)] + [(9, "/q/", True)], "id long, url string, external boolean")
    hits = spark.createDataFrame([(1, i, float(i)) for i in (0, 1, 2, 3, 9)], "query_id long, id long, score double")
    got = se.merged_order(se.rank(hits, sec, per_page=2)).orderBy("merged_position").collect()
    assert [(r["id"], r["position"], r["external"]) for r in got] == [(3, 1, False), (2, 2, False), (9, 1, True)]


def test_lemmas(spark):
    words = spark.createDataFrame([(w,) for w in "queues matches running deferring wolves news analyses indices mice tries x".split()], "word string")
    dictionary = spark.createDataFrame([(w,) for w in "queue match run defer wolf analysis index try new".split()], "lemma string")
    exceptions = spark.createDataFrame([("mice", "mouse"), ("indices", "index")], "form string, lemma string")
    project = spark.createDataFrame([("news",)], "word string")
    got = {r["form"]: r["lemma"] for r in se.lemmas(words, dictionary, exceptions, project).collect()}
    assert got == {"queues": "queue", "matches": "match", "running": "run", "deferring": "defer", "wolves": "wolf", "mice": "mouse", "indices": "index", "tries": "try"}
    miss = se.missing_stems(spark.createDataFrame([("frobs",), ("frob",)], "word string"), dictionary, spark.createDataFrame([], "word string")).collect()
    assert [(r["stem"], r["saw_as"]) for r in miss] == [("frob", "frobs")]


def test_every_word_of_the_vocabulary_is_in_the_dictionary(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "documentations", "en", "s"), (2, "documentation x", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    assert [tuple(r) for r in registry.QUERIES["sr2_lemmas"](spark, d).collect()] == [("documentations", "documentation")]


def test_lemma_matches_weigh_less(spark):
    terms = spark.createDataFrame([(1, "queues", True)], "query_id long, term string, content boolean")
    vocab = spark.createDataFrame([("queue",), ("queues",)], "word string")
    lem = spark.createDataFrame([("queues", "queue")], "form string, lemma string")
    got = {r["match"]: r["match_weight"] for r in se.with_lemmas(terms, vocab, lem).collect()}
    assert got == {"queues": 1.0, "queue": 0.55}


def test_spelling_and_relaxing(spark):
    vocab = spark.createDataFrame([("message", 9), ("massage", 2), ("queue", 5), ("send", 4)], "word string, df long")
    empty = spark.createDataFrame([(1, "mesasge queue"), (2, "cache.get"), (3, "qqqqqq")], "query_id long, query string")
    got = {r["query_id"]: (r["query"], r["confident"]) for r in se.relaxed_queries(empty, vocab).collect()}
    assert got == {1: ("message queue", False), 2: ("cache get", True)}
    words = spark.createDataFrame([("mesasge", "message"), ("abcd", "badc"), ("abcd", "abcd"), ("abc", "abcd"), ("abcd", "abxd"), ("a", "a"), ("ab", "ba"), ("", "a")], "a string, b string")
    assert [r["x"] for r in words.select(se.one_edit(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, True, True, False, True, True]


def test_hyphens_do_not_matter(spark):
    sec = sections(spark, [(1, "Handling back-pressure", "", "", "", 0), (2, "state-of-the-art queue - plain", "", "", "", 0)])
    terms = {(r["term"], r["id"]) for r in se.postings(sec).collect()}
    assert {("backpressure", 1), ("back", 1), ("pressure", 1), ("stateoftheart", 2), ("queue", 2)} <= terms and ("queueplain", 2) not in terms
    q = spark.createDataFrame([(1, "backpressure")], "query_id long, query string")
    assert [r["id"] for r in se.search(q, sec, se.postings(sec)).collect()] == [1]


def test_only_empty_results_are_relaxed(spark):
    sec = sections(spark, [(1, "message queue", "", "", "", 0), (2, "nest micro", "", "", "", 0), (3, "massage", "", "", "", 0)])
    rows = [(1, "mesasge"), (2, "queue"), (3, "nest.micro"), (4, "zzzzzzzz"), (5, "micor.mesasge"), (6, "")]
    q = spark.createDataFrame(rows, "query_id long, query string")
    got = {(r["query_id"], r["corrected"], r["id"]) for r in se.search_relaxed(q, sec, se.postings(sec)).collect()}
    assert got == {(1, "message", 1), (2, None, 1), (3, None, 2), (5, "micro message", 1), (5, "micro message", 2)}


def test_levels_of_a_comparison(spark):
    rows = [("a", 2, 1, 50.0)] * 9 + [("b", 1, 1, 0.0)] * 9 + [("c", 1, 2, -50.0)]
    rows = [(i, *x) for i, x in enumerate(rows)]
    r = {x["level"]: x for x in ev.compare(spark.createDataFrame(rows, "query_id long, topic string, was int, now int, delta double"), 200).collect()}
    assert (r["micro"]["n"], r["micro"]["gained"], r["micro"]["lost"]) == (19, 9, 1) and r["micro"]["significant"] and r["micro"]["first_p"] < 0.05
    assert (r["macro"]["n"], r["macro"]["mean"], r["macro"]["significant"]) == (3, 0.0, False)


def test_pages_that_must_be_reached(spark):
    labels = spark.createDataFrame([(1, "/a/", [], "/r/#x"), (2, "/b/", [], "/r/"), (3, "/c/", [], None)], "query_id long, target string, also array<string>, must_reach string")
    ranked = spark.createDataFrame([(1, "/r/#y", 3, 1.0), (1, "/r/", 9, 0.5), (2, "/x/", 1, 1.0)], "query_id long, url string, position int, score double")
    out = ev.evaluate(labels, ranked)
    assert {r["query_id"]: r["must_reach_rank"] for r in out.collect()} == {1: 3, 2: None, 3: None}
    assert tuple(ev.reachability(out).first()) == (2, 50.0, 50.0)
    assert ev.evaluate(labels, ranked, strict=True).where("must_reach_rank IS NOT NULL").count() == 0


def test_counts_before_each_value(spark):
    xs = [(float(i * 37 % 101),) for i in range(500)]
    got = {r["v"]: (r["_c"], r["_before"]) for r in ev.ordered_counts(spark.createDataFrame(xs, "v double"), "v").collect()}
    flat = [x for (x,) in xs]
    assert got == {x: (flat.count(x), sum(y < x for y in flat)) for x in set(flat)}


def test_infixes(spark):
    terms = spark.createDataFrame([(1, "queue", True), (1, "get", True)], "query_id long, term string, content boolean")
    vocab = spark.createDataFrame([("queueing",), ("dequeues",), ("getter",)], "word string")
    got = {(r["term"], r["match"]): r["match_weight"] for r in se.with_infixes(terms, vocab).collect()}
    assert got == {("queue", "queue"): 1.0, ("get", "get"): 1.0, ("queue", "queueing"): 1.0, ("queue", "dequeues"): 0.75}


def test_evaluation(spark):
    labels = spark.createDataFrame([(1, "/a/", ["/b/"], "t"), (2, "/c/", [], "t"), (3, "/d/", [], "u")], "query_id long, target string, also array<string>, topic string")
    hits = [(1, "/x/", 1), (1, "/b/#s", 2), (1, "/a/", 3), (2, "/c/", 60)] + [(2, f"/n{i}/", i) for i in range(1, 60)]
    ranked = spark.createDataFrame([(q, u, p, 1.0 / p) for q, u, p in hits], "query_id long, url string, position int, score double")
    r = {x["query_id"]: x for x in ev.evaluate(labels, ranked).collect()}
    assert (r[1]["position"], r[1]["target_position"], r[1]["target_rank"]) == (2, 3, 3)
    assert r[1]["ndcg"] == pytest.approx(100 * max(1 / 3 / math.log2(3), 1 / math.log2(4))) and r[1]["accuracy"] == 90
    assert (r[2]["position"], r[2]["target_position"], r[2]["target_rank"]) == (0, 0, 60)
    assert (r[3]["returned"], r[3]["target_rank"]) == (0, None)
    m = ev.summarise(ev.evaluate(labels, ranked)).first()
    assert m["target_top10"] + m["target_buried"] + m["target_deep"] + m["target_never"] == pytest.approx(100, abs=1e-4)
    strict = {x["query_id"]: x["position"] for x in ev.evaluate(labels, ranked, strict=True).collect()}
    assert strict[1] == 3


def test_paired_tests(spark):
    def deltas(xs):
        return spark.createDataFrame([(float(x),) for x in xs], "delta double")

    assert ev.wilcoxon(deltas([0, 0, 0])).first()["p"] == 1.0
    assert ev.wilcoxon(deltas([1, 2, 3, -4, 5])).first()["p"] == 1.0
    r = ev.wilcoxon(deltas([1, 1, 2, 3, 4, 5, 6, -1])).first()
    assert (r["n"], r["better"], r["worse"], r["w"]) == (8, 7, 1, 34.0) and r["p"] < 0.05

    def pairs(b, c):
        return spark.createDataFrame([(True, False)] * b + [(False, True)] * c + [(True, True)] * 3, "was_hit boolean, is_hit boolean")

    exact = lambda b, c: min(1, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
    for b, c in ((0, 0), (3, 9), (12, 12), (1, 23)):
        assert ev.mcnemar(pairs(b, c)).first()["p"] == pytest.approx(exact(b, c) if b + c else 1.0, abs=1e-6)
    r = ev.mcnemar(pairs(5, 20)).first()
    assert not r["exact"] and r["chi2"] == pytest.approx(14**2 / 25)


def test_bootstrap(spark):
    xs = [(float(i % 10),) for i in range(400)]
    v = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "key long, value double")
    a = ev.bootstrap(v, 400).first()
    b = ev.bootstrap(v.repartition(7), 400).first()
    assert a == b and a["lo"] < a["mean"] < a["hi"]
    sd = (sum((x - 4.5) ** 2 for (x,) in xs) / 400) ** 0.5 / 20
    assert a["hi"] - a["lo"] == pytest.approx(3.92 * sd, rel=0.2)


def test_halves_and_gate(spark):
    rows = spark.createDataFrame([(t,) for t, n in (("a", 5), ("b", 4), ("c", 3), ("d", 1)) for _ in range(n)], "topic string")
    assert {r["topic"]: r["side"] for r in ev.halves(rows, "topic").collect()} == {"a": "fit", "b": "holdout", "c": "holdout", "d": "fit"}
    values = spark.createDataFrame([("p1", 50.0), ("never", 5.0)], "metric string, value double")
    limits = spark.createDataFrame([("p1", 50.5, 100.0), ("never", 0.0, 5.0)], "metric string, floor double, ceiling double")
    assert [r["metric"] for r in ev.gate(values, limits).collect()] == ["p1"]


def test_restraint_percentile_is_an_element(spark):
    s = spark.createDataFrame([(i, float(i)) for i in range(11)], "query_id long, top_score double")
    r = ev.restraint_of(s).first()
    assert (r["n"], r["median_top_score"], r["p90_top_score"]) == (11, 5.5, 10.0) and r["empty"] == pytest.approx(100 / 11, abs=1e-4)


def test_partitioning_does_not_matter(spark):
    sec = sections(spark, [(i, f"head {i % 7}", f"body word{i % 5} common text {i}", "", "", 0) for i in range(60)])
    q = spark.createDataFrame([(1, "word3 head 5")], "query_id long, query string")

    def run(s):
        return sorted(tuple(r) for r in se.rank(se.score(se.query_terms(q), se.weighted_postings(s, se.postings(s))), s).collect())

    assert run(sec) == run(sec.repartition(9))
    assert sec.select(F.col("id")).count() == 60
