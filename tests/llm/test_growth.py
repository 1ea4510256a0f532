"""Work that must grow with the input and no faster."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from siltstone.llm import pieces, simhash


def test_probes_grow_with_the_fingerprints(spark):
    """From 40,000 to 200,000 fingerprints the index once took fewer, wider groups, and made 12 times the probe rows."""
    made = []
    for n in (40_000, 200_000):
        fps = spark.range(n).select("id", F.xxhash64("id").alias("fp"), (F.col("id") % 900 + 20).alias("size"))
        index = simhash.Pigeonhole(fps, simhash.WORD_RADIUS, simhash.WORD_GROUPS, sized=True)
        made.append(index.probe(fps).count())
    assert made[1] < 6 * made[0]


def test_size_classes_lose_no_pair(spark):
    """Fingerprints near each other, of sizes around each limit, against all pairs."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(40):
        base = int(rng.integers(-(2**63), 2**63 - 1))
        for size in (0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 15, 16, 19, 20, 21, 63, 64, 80, 81, 102, 127, 128, 160):
            flips = rng.choice(64, int(rng.integers(0, 6)), replace=False)
            fp = base
            for b in flips:
                fp ^= int(np.int64(np.uint64(1) << np.uint64(b)))
            rows.append((len(rows), fp, size + g % 3, len(rows)))
    fps = spark.createDataFrame(rows, "id long, fp long, size long, comp long").repartition(4)
    want = set()
    for a, x, s, _ in rows:
        for b, y, t, _ in rows[a + 1 :]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= simhash.WORD_RADIUS and 5 * min(s, t) >= 4 * max(s, t):
                want.add((a, b))
    index = simhash.Pigeonhole(fps.select("id", "fp", "size"), simhash.WORD_RADIUS, simhash.WORD_GROUPS, sized=True)
    assert {(r["a"], r["b"]) for r in index.links(fps).collect()} == want and len(want) > 300
    assert {r["id"] for r in index.active(fps.select("id", "fp", "size")).collect()} == {i for x in want for i in x}


def test_texts_are_cut_once_for_their_rare_parts(spark, docs, monkeypatch):
    """The lattice and the join with its codes share a shuffle; parts are counted in some documents only; every row is right."""
    import sentencepiece

    plans, counted, cut, vocabulary = {}, [], pieces.cut, pieces.vocabulary

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)

    def noted(frame, path):
        counted.append(frame.count())
        return vocabulary(frame, path)

    monkeypatch.setattr(pieces, "cut", watched)
    monkeypatch.setattr(pieces, "vocabulary", noted)
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_pieces"], list(r["ids"])) for r in pieces.encode(docs, model).collect())
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(ids := lib.encode(r["text"] or "")), ids) for r in docs.collect())
    assert got == want
    assert len(counted) == 1 and 0 < counted[0] < docs.count() / 2
    filters = {x.split("Filter ")[1].replace(" ", "") for x in plans["encoded"].splitlines() if "Filter (isnotnull(word#" in x}
    assert len({"".join(c for c in x if not c.isdigit()) for x in filters}) == 1


def test_a_fit_holds_few_prefixes(spark, tmp_path, monkeypatch):
    """A task once held all prefixes of its rows and their contexts; the stems are those of counting everything."""
    import random
    import tracemalloc
    import uuid
    from collections import defaultdict

    from siltstone.llm import toxicity

    frame = type(spark.range(0))
    rng, folder, plain = random.Random(5), str(tmp_path), frame.mapInArrow
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvwxyz", k=12))
    rows = []
    for i in range(600):
        words, toxic = [word() for _ in range(200)], int(i % 4 == 0)
        for at in rng.sample(range(200), 6):
            words[at] = rng.choice(["vermin", "verminous", "imbecile", "imbecilic", "common", "commons"] if toxic else ["common", "commons", "commune", "imbibed"])
        rows.append((i, " ".join(words), toxic))

    def watched(rows, func, schema):
        def run(batches):
            tracemalloc.start()
            yield from func(batches)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(peak))

        return plain(rows, run, schema)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = d.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = toxicity.fit(d.select("doc_id", "text"), train.select("doc_id", "toxic"))
    peaks = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert len(peaks) >= 3 and max(peaks) < 40e6, sorted(peaks)[-3:]

    contexts, seen = defaultdict(set), (defaultdict(int), defaultdict(int))
    sizes = [0, 0]
    for r in train.collect():
        words, first = r["text"].split(), {}
        for at, w in enumerate(words):
            for n in range(toxicity.MIN_STEM, min(len(w), toxicity.MAX_STEM) + 1):
                first.setdefault(w[:n], at)
        sizes[r["toxic"]] += 1
        for p, at in first.items():
            seen[r["toxic"]][p] += 1
            if r["toxic"]:
                contexts[p].add(" ".join(words[max(0, at - 1) : at] + words[at + 1 : at + 2]))
    stems, weak = toxicity._stems([(p, len(c), seen[1][p], seen[0].get(p, 0)) for p, c in contexts.items()], sizes[1], sizes[0])
    assert model.matcher.stems == sorted(stems) and {"vermin", "imbecil"} <= set(stems) and "comm" not in stems
    assert {model.matcher.stems[i] for i in model.matcher.weak} == weak
