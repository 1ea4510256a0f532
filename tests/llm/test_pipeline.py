"""The pipeline against a brute-force version of each stage, on a small fixture with odd rows; and copies that fingerprints alone would lose."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from siltstone.llm import decontaminate, linededup, simhash, toxicity


def order(i):
    return (i is not None, i or 0)


def groups(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)), key=order)
        top[b] = a
    return {i: find(i) for i in ids}


def brute_lines(rows):
    at = sorted(((order(i), no), tuple(linededup.split_words(x))) for i, t in rows for no, x in enumerate((t or "").split("\n")))
    first, dropped = {}, set()
    for pos, w in at:
        if not w or first.get(w) == pos:
            continue
        near = any(o != w and max(len(o), len(w)) >= linededup.MIN_NEAR and p < pos and linededup.within_one(list(w), list(o)) for o, p in first.items())
        if w in first or near:
            dropped.add((pos, w))
        first.setdefault(w, pos)
    keep = lambda i, t: "\n".join(x for no, x in enumerate(t.split("\n")) if ((order(i), no), tuple(linededup.split_words(x))) not in dropped)
    return [(i, None if t is None else keep(i, t)) for i, t in rows]


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def copy_groups(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    links = [(a, b) for v in sets.values() for a, b in zip(v, v[1:])]
    links += [(sets[x][0], sets[y][0]) for x, y in combinations(sets, 2) if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9]
    return groups({i for i, _ in rows}, links)


def copies_item(t, items):
    w = decontaminate.words_of(t)
    return any(decontaminate.similarity(w[s : s + len(x)], x) >= 0.8 for x in items for s in range(max(1, len(w) - len(x) + 1)))


@pytest.fixture(scope="module")
def table_dir(spark, docs, small_dir, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    bench = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    item = bench.orderBy("item_id").first()["text"]
    more = [(800001, f"before it\n{item}\nafter it"), (800002, "one short line"), (800003, None)]
    more += [(800004 + i, f"{x} a line that only stands in this text {i}") for i, x in enumerate(["word " * 40 + "the same words as in the next text", "word " * 40 + "the same words as in the next text"])]
    extra = spark.createDataFrame(more, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'x' AS source", "cast(length(text) AS long) AS n_chars")
    small = docs.select("doc_id", "text", "lang", "source", "n_chars")
    small.where("doc_id IS NULL OR doc_id >= 800000 OR doc_id < 70").unionByName(extra).write.parquet(f"{top}/documents.parquet")
    bench.write.parquet(f"{top}/benchmark.parquet")
    spark.read.parquet(f"{small_dir}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_whole_pipeline(spark, table_dir):
    import sentencepiece

    read = lambda name: spark.read.parquet(f"{table_dir}/{name}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    rows = [(r["doc_id"], r["text"]) for r in read("documents").collect()]
    rows = brute_lines([(i, t) for i, t in rows if model.score(t) < toxicity.THRESHOLD])
    comp = copy_groups(rows)
    items = [decontaminate.words_of(r["text"]) for r in read("benchmark").collect()]
    rows = [(i, t) for i, t in rows if comp[i] == i and not copies_item(t, items)]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "")
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = Counter((r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, table_dir).collect())
    assert got == want and 800001 not in {i for i, *_ in got} and {800002, 900010, None} <= {i for i, *_ in got}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]


def test_stages_keep_the_columns(spark, table_dir):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, table_dir).columns == docs.columns
    short = corpus_pipeline.line_dedup(spark, docs, table_dir)
    assert short.where("n_chars <> length(text)").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), table_dir).count() == 0


def test_copies_with_text_in_front_behind_or_cut_away(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 400))]
        more = [rng.choice(vocabulary) for _ in range(int(len(w) * rng.uniform(0.05, 0.24)))]
        copy = [w + more, more + w, w[len(more) * 3 // 4 :], [*w[: len(w) // 2], *more, *w[len(w) // 2 :]], [x if rng.random() > 0.02 else "x" for x in w]][i % 5]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(copy))]
    want = copy_groups(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["k"]: r["component_id"] for r in simhash.near_copy_groups(d).collect()}
    pairs = {i for i in want if want[i] != i}
    assert len(pairs) > 90 and all(got[i] in (i, want[i]) for i in want)
    assert sum(got[i] == want[i] for i in pairs) >= 0.98 * len(pairs)
