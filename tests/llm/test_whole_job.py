"""Cases in which an operator once did less than the whole job."""

import time

import numpy as np
import pytest

from siltstone.llm import decontaminate, linededup, pii, secrets


@pytest.fixture(scope="module")
def bench_items(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()
    return [(r["item_id"], decontaminate.words_of(r["text"])) for r in rows]


def test_items_without_their_ends_are_found_as_whole_documents(bench_items):
    """A document that is an item with its last word left off is shorter than the item's window."""
    ix = decontaminate.ItemIndex(bench_items)
    got = [any(m[0] == i for m in ix.matches(" ".join(w[:-1]))) for i, w in bench_items if decontaminate.similarity(w[:-1], w) >= 0.8]
    assert got and np.mean(got) > 0.9


def test_every_window_at_the_similarity_is_found(bench_items):
    """Items that lose words at an end or within, amid other words, against all windows of all items."""
    ix = decontaminate.ItemIndex(bench_items)
    rng = np.random.default_rng(2)
    other = [f"o{i}" for i in range(40)]
    found = 0
    for n, (_, w) in enumerate(bench_items[:40]):
        cut = int(rng.integers(1, 5))
        at = int(rng.integers(5, len(w) - 5))
        for body in (w[:-cut], w[cut:], w[:at] + other[:cut] + w[at:], w[2:at] + other[:cut] + w[at:-1], w + w):
            for words in (body, other[:20] + body + other[20:]):
                want = {}
                for i, x in bench_items:
                    sims = [decontaminate.similarity(words[s : s + len(x)], x) for s in range(max(1, len(words) - len(x) + 1))]
                    if max(sims) >= 0.8:
                        want[i] = (round(max(sims), 6), sims.index(max(sims)))
                found += len(want)
                assert {m[0]: (round(m[1], 6), m[2]) for m in ix.matches(" ".join(words))} == want
    assert found > 100


def test_long_and_dotted_tokens_are_linked(spark):
    part = "Zk3vQ9xYtR2mPq7LwB4n"
    tokens = {
        1: (part * 4)[:64], 2: (part * 4)[:65], 3: (part * 5)[:86] + "==", 4: "q" * 90 + "Q7", 5: f"ey{part}.ey{part}.{part * 3}", 6: f"SG.{part}.x",
        7: "a1.B2.c3.d4.e5.f6.g7.h8", 8: "//Api9.example.com/" + part, 9: part * 5000, 10: ".".join([part] * 5000), 11: "q" * 90,
    }
    d = spark.createDataFrame([(i, f"see https://a.example with {t} here") for i, t in tokens.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_linked"], r["spans"]) for r in secrets.secrets(d).collect()}
    start = len("see https://a.example with ")
    want = {i: (1, f"linked:{start}:{start + len(t)}") for i, t in tokens.items()} | dict.fromkeys((7, 8, 11), (0, ""))
    assert got == want


def test_short_lines_are_deduplicated(spark):
    """Exact repeats go at every length but blank ones; lines one word apart go from four words on."""
    texts = ["Menu", "menu\n\n \nread more\na b c", "READ  more\n\na b d\na b c", "one two three four", "one two three five", "one two three", "one two zwei three four", "two three"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.line_report(d).collect()}
    assert got == {0: "Menu", 1: "\n \nread more\na b c", 2: "\na b d", 3: "one two three four", 4: "", 5: "", 6: "", 7: "two three"}


def test_lines_around_the_halves_limit(spark):
    rows = []
    for n in range(4, 11):
        for kind in range(4):
            w = [f"w{n}_{kind}_{i}" for i in range(n)]
            other = [w[:-1], [*w[: n // 2], "x", *w[n // 2 :]], ["x", *w[1:]], [*w[:-1], "x"]][kind]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.line_report(d).collect()}
    assert got == {i: "" if i % 2 else t for i, t in rows}


def test_names_of_other_columns_do_not_clash(spark):
    rows = [(1, "x", "one two three four\nfive six seven eight", 7, "n"), (2, "y", "one two three four", 8, "m"), (3, "z", None, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, `gone` string, text string, `a.b` int, k string").selectExpr("*", "1 AS th", "2 AS gk", "3 AS lines", "4 AS own", "5 AS _lines", "6 AS no")
    got = {r["doc_id"]: r.asDict() for r in linededup.dedup_lines(docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: rows[0][2], 2: "", 3: None}
    assert [(got[i]["gone"], got[i]["a.b"], got[i]["k"], got[i]["own"], got[i]["_lines"], got[i]["_dropped"]) for i in (1, 2, 3)] == [("x", 7, "n", 4, 2, 0), ("y", 8, "m", 4, 1, 1), ("z", 9, None, 4, 0, 0)]


def test_a_text_of_very_many_lines(spark, monkeypatch):
    """200,000 lines, the second half of which goes."""
    from pyspark.sql import functions as F

    lines = [f"line number {i % 100_000} of the text" for i in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    keys = lambda d: d.select(linededup.row_key().alias("k"), F.xxhash64("text").alias("th"))
    monkeypatch.setattr(linededup, "dropped_lines", lambda d: keys(d).select("k", "th", F.explode(F.sequence(F.lit(100_000), F.lit(199_999))).alias("no")))
    start = time.monotonic()
    got = linededup.dedup_lines(docs).first()
    assert got["text"].split("\n") == lines[:100_000] and got["_dropped"] == 100_000
    assert time.monotonic() - start < 30


def test_a_text_of_very_many_spans(spark):
    """Assignments and weak tokens in turn: some tokens lie in base spans, the others are linked."""
    token = "aB3dE6gH9jK2mN5pQ8sT"
    text = " ".join(f"token={token}{i:06d} https://h{i}.example/ {token}{i:06d}" for i in range(4_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    r = secrets.secrets(docs).first()
    assert (r["n_assign"], r["n_linked"]) == (4_000, 4_000)
    mail = " ".join(f"a{i}@b.example and c{i} (at) d (dot) example" for i in range(4_000))
    r = pii.personal_data(spark.createDataFrame([(1, mail)], "doc_id long, text string")).first()
    assert r["n_email"] == 4_000
    assert time.monotonic() - start < 60


def test_free_spans_against_all_pairs(spark):
    from pyspark.sql import functions as F

    from siltstone.llm.spans import overlap_free

    rng = np.random.default_rng(5)

    def spans(n, width):
        return sorted((int(s), int(s) + int(rng.integers(1, width))) for s in rng.integers(0, 30_000, n))

    rows = [(i, spans(a, w), spans(b, w)) for i, (a, b, w) in enumerate([(0, 0, 5), (50, 0, 5), (0, 50, 5), (1, 256, 9), (300, 257, 30), (900, 1500, 12), (40, 3000, 4)])]
    kind = "array<struct<start:bigint,end:bigint>>"
    d = spark.createDataFrame(rows, f"i int, s {kind}, b {kind}")
    for r in overlap_free(d, "s", F.col("b"), "free").collect():
        _, s, b = rows[r["i"]]
        assert [tuple(x) for x in r["free"]] == [x for x in s if not any(x[0] < y[1] and y[0] < x[1] for y in b)]
