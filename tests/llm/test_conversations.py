"""Prefix trie, hard negatives and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from siltstone.llm import chat, negatives, trie, warc

CONV = "conv_id long, turn long, role string, text string"
WORDS = re.compile("[^\x20\x09-\x0d]+")


# Prefix trie


def in_order(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in own.items()}


def trie_by_hand(rows):
    own = in_order(rows)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        full[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def below(k):
        leaves, saved = (0, 0) if kids[k] else (1, 0)
        for x in kids[k]:
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + (len(members[k]) - 1) * (len(WORDS.findall(k[-1][1])) if k else 0)

    out = []
    for k, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if full[c] == list(k))))
        leaves, saved = below(k)
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(df):
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr)


def many_conversations(seed, n=400):
    """Few texts, so that prefixes are shared; a third of the conversations are one text; ids of both signs."""
    rnd, rows = random.Random(seed), []
    texts = ["a", "a b", "", None, "c\td\n e", "é \x1f"]
    for c in [*range(-30, n), 10**12, -(2**63), 2**63 - 1]:
        if rnd.random() < 0.33:
            rows += [(c, 0, "user", "same start"), (c, 1, "assistant", "same answer")]
        else:
            rows += [(c, rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(texts)) for _ in range(rnd.randint(1, 5))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = many_conversations(seed)
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS base", "2 AS path", "3 AS skel", "'x' AS shard").repartition(3)
    assert built(df) == trie_by_hand(rows)


def test_trie_shards_do_not_matter(spark, monkeypatch):
    """Copies and a long chain over many shards, with chunks of few ids."""
    rows = many_conversations(3, 150) + [(5000 + i, t, "user", f"turn {t}") for i in range(60) for t in range(i % 12)] + [(7000 + i, t, "user", "x") for i in range(3) for t in range(90)]
    df = spark.createDataFrame(rows, CONV)
    want = trie_by_hand(rows)
    for shards, chunk in (("2", 8192), ("37", 3)):
        monkeypatch.setattr(trie, "CHUNK", chunk)
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shards)
        try:
            assert built(df) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)


def test_trie_small_tables(spark):
    assert built(spark.createDataFrame([], CONV)) == []
    assert built(spark.createDataFrame([(None, 0, "user", "a")], CONV)) == []
    for rows in ([(3, 0, "user", "a b")], [(1, None, None, None), (1, None, None, None)], [(20, 0, "user", "word " * 50_000)]):
        assert built(spark.createDataFrame(rows, CONV)) == trie_by_hand(rows)


def test_trie_splitters_are_bounded_and_sorted(spark):
    rows = spark.createDataFrame(many_conversations(4), CONV)
    paths = trie.rebuilt_paths(rows)
    keys = trie.splitters(paths, paths.count(), 16)
    assert keys == sorted(keys) and 5 <= len(keys) <= 15
    skeleton = trie.Skeleton(keys)
    # A node's ids are one for all splitters that share it, and its parent is one turn shorter.
    seen = {}
    for (path, _), ids in zip(keys, skeleton.ids):
        for d, i in enumerate(ids):
            assert seen.setdefault(i, path[:d]) == path[:d] and skeleton.depth[i] == d and (d == 0 or skeleton.above[i] == ids[d - 1])
    assert len(seen) == len({p[:d] for p, _ in keys for d in range(len(p) + 1)})


# Hard negatives

VEC = "vec_id long, embedding array<float>, label int"


def negatives_by_hand(rows):
    rows = [(v, [float(x) for x in e], k) for v, e, k in rows if v is not None and k is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    best = {}
    for v, e, k in rows:
        x = ((k + 1) % 10 if v % 7 == 0 else k, e)
        best[v] = min(best.get(v, x), x)
    q = {v: (k, [int(np.floor(256 * x)) for x in e]) for v, (k, e) in best.items()}
    score = lambda a, b: sum(x * y for x, y in zip(q[a][1], q[b][1]))
    out = []
    for a in (v for v in q if v % 100 == 0):
        s = sorted(((-score(a, b), b) for b in q if b != a))
        for p, b in [x for x in s if q[x[1]][0] == q[a][0]][:5]:
            inside = [x for x in s if q[x[1]][0] != q[a][0] and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(a, b, i + 1, c, -p, -n) for i, (n, c) in enumerate(inside)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in negatives.hard_negatives(df).select(*[c.split(" ")[0] for c in negatives.RESULT.split(", ")]).collect())


def vectors(seed, n, dims, spread):
    """Clusters (high scores), far vectors, ties, a hot label, and rows that take no part."""
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, dims))
    rows = []
    for i in range(n):
        x = centres[i % 6] + spread * g.normal(size=dims)
        x = np.round(x * 8) / 8 if i % 3 else x / np.linalg.norm(x)
        rows.append((i, [float(np.float32(v)) for v in x], 1 if i % 3 == 0 else int(g.integers(0, 10))))
    rows += [(n, None, 1), (n + 1, [1.0, None], 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] * dims, 1), (n + 4, [1.0] * dims, None), (None, [1.0] * dims, 1)]
    rows += [(n + 5, [], 1), (n + 6, [0.5], 2), rows[0], (rows[1][0], [9.0] * dims, 9)]
    return rows


@pytest.mark.parametrize("seed,dims,spread", [(1, 8, 0.2), (2, 40, 0.6), (3, 3, 2.0)])
def test_negatives_equal_brute_force(spark, seed, dims, spread, monkeypatch):
    rows = vectors(seed, 700, dims, spread)
    monkeypatch.setattr(negatives, "TILE", 3)
    monkeypatch.setattr(negatives, "BATCH_BYTES", 4 * dims * 8)  # several passes
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 AS grp", "2 AS x", "3 AS r", "4 AS rank").repartition(3)
    assert mined(df) == negatives_by_hand(rows)


def test_negatives_small_tables(spark):
    assert mined(spark.createDataFrame([], VEC)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], VEC)) == []
    for rows in ([(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2), (2, [1.0], 2)], [(0, [0.0], 1), (3, [1.0], 2), (4, [-1.0], 2)], [(100, [], 1), (1, [], 1), (2, [], 2)], [(100, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]):
        assert mined(spark.createDataFrame(rows, VEC)) == negatives_by_hand(rows)


def test_negatives_of_large_numbers(spark):
    """Sums beyond 2**53 are exact, and a score beyond 64 bits is an error."""
    rows = [(0, [3e5, 1.0], 1), (1, [2.9e5, 7.0], 1)] + [(2 + i, [2.8e5, float(i)], 2) for i in range(9)]
    big = [(v, [x * 4 for x in e], k) for v, e, k in rows]
    assert mined(spark.createDataFrame(big, VEC)) == negatives_by_hand([(v, [float(np.float32(x)) for x in e], k) for v, e, k in big])
    with pytest.raises(Exception, match="64 bits"):
        mined(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1), (2, [9e29], 2)], VEC))


@pytest.mark.parametrize("seed", range(6))
def test_threshold_pairs_lose_none(seed):
    """The index and its prunings against all pairs, at thresholds from impossible to everything, on vectors with few and many large dimensions."""
    g = np.random.default_rng(seed)
    dims = int(g.integers(1, 70))
    scale = np.exp(-g.uniform(0, 0.3) * np.arange(dims)) * 256
    x, a = np.floor(g.normal(size=(200, dims)) * scale), np.floor(g.normal(size=(9, dims)) * scale)
    x[:3], a[:1] = 0, 0
    x[5:40] *= 0.05
    x = np.floor(x)
    s = (x @ a.T).astype(np.int64)
    for q in (0.0, 0.5, 0.9, 0.99, 1.0):
        t = np.quantile(s, q, axis=0) + (q == 1.0)
        for at_least in (t, np.full(9, -np.inf), np.maximum(t, 1)):
            i, j, got = negatives.threshold_pairs(a, at_least, x)
            want = {(int(p), int(r)) for p, r in zip(*np.nonzero(s >= at_least))}
            assert len(i) == len(want) and {(int(p), int(r)) for p, r in zip(i, j)} == want and (got == s[i, j]).all()


def test_index_leaves_dimensions_out():
    """With a high threshold short vectors are not scored at all: their values may be anything of that norm."""
    a, x = np.array([[10.0, 0.0]]), np.array([[9.0, 1.0], [1.0, 1.0]])
    assert [int(v) for v in negatives.threshold_pairs(a, np.array([50.0]), x)[0]] == [0]


# Chat formatting


def digests_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows + chat.PROBE:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in own.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((c, len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


HARD = ["", " ", "</s>", "<\\/s>", "[INST] x [/INST]", "<s", "s>", "<<SYS>>\n", "\\", "[\\\\INST]", "[ROLE]a[/ROLE] b [/TURN]", "é𝄞", "x </s>", " [/INST", "a", "b", "\n", "[[INST]]", "<<s>>"]


def test_chats_equal_brute_force(spark):
    rnd, rows = random.Random(5), []
    for c in [None, *range(200)]:
        rows += [(c, rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", "assistant", "system", None, "tool", "[ROLE]", "</s>"]), rnd.choice([None, "".join(rnd.choices(HARD, k=rnd.randint(0, 6)))])) for _ in range(rnd.randint(1, 6))]
    rows += rows[:5] + [(900, t, "assistant" if t % 2 else "user", HARD[t % len(HARD)] + str(t)) for t in range(230)] + [(901, 0, "user", "long " * 200_000), (901, 1, "assistant", "</s>" * 100_000)]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS turns", "2 AS formatted", "3 AS t")
    got = chat.chat_report(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == digests_by_hand(rows)
    assert all(r["n_rewrites"] == 0 for r in got)
    lengths = {r["conv_id"]: r["formatted_chars"] for r in got}
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert all(lengths[c] == len(chat.Brackets.render([t[2:] for t in sorted(ts)])) for c, ts in own.items())


def test_chats_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], CONV)).count() == 0
    assert [r["conv_id"] for r in chat.chat_report(spark.createDataFrame([], CONV)).collect()] == [-7]


def test_escapes_are_reversible():
    rnd = random.Random(6)
    for _ in range(3000):
        text = "".join(rnd.choices([*chat.Brackets.CONTROL, *HARD, "<", "[", "/", "]"], k=rnd.randint(0, 8)))
        safe = chat.Brackets.escape(text)
        assert chat.Brackets.unescape(safe) == text and not any(c in safe for c in chat.Brackets.CONTROL)


def plain(messages):
    """Grows only: what follows never changes what is there."""
    return "#" + "".join(f"<{r}|{t}|>" for r, t in messages)


def ended(messages):
    """An end mark that the next turn takes away."""
    return plain(messages) + "END"


def forgets(messages):
    """Earlier assistant texts lose what stands before their last sentence."""
    last = len(messages) - 1
    return "#" + "".join(f"<{r}|{t if r != 'assistant' or i == last else t[-3:]}|>" for i, (r, t) in enumerate(messages))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 200])
def test_spans_of_templates_that_grow(n):
    turns = [("assistant" if i % 2 else "user", HARD[i % len(HARD)] * (i % 3)) for i in range(n)]
    full, spans, rewrites = chat.located(plain, turns)
    assert full == plain(turns) and not rewrites and len(spans) == n
    assert "".join(full[s:e] for _, s, e, *_ in spans) == full[1:]
    for (role, text), (r, s, e, lo, hi) in zip(turns, spans):
        assert r == role and full[s:e] == f"<{role}|{text}|>" and (full[lo:hi] == text if role == "assistant" else lo is None)


@pytest.mark.parametrize("n", [3, 80, 150])
def test_templates_that_rewrite_history_are_found(n):
    turns = [("assistant" if i % 2 else "user", f"text number {i}") for i in range(n)]
    for template in (ended, forgets):
        full, spans, rewrites = chat.located(template, turns)
        assert full == template(turns) and rewrites
        for (_, text), (_, s, e, lo, hi) in zip(turns, spans):
            assert s is None or lo is None or full[lo:hi] == text
    assert chat.located(ended, turns)[2] == list(range(n))
    assert chat.located(forgets, turns)[2] == list(range(2, n, 2))
    # Of the template that forgets, only what stands before the first altered turn keeps its place.
    assert [s[1] is not None for s in chat.located(forgets, turns)[1]][:2] == [True, n < 3]


# Archive


def test_archive_report_from_reconstructed_payloads(spark):
    """Copies, a repeated page_id with other payloads, urls that look like header lines, nulls, and empty tables."""
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a/", big), (2, "http://b/ WARC-Type: response", big), (3, "u\nWARC-Type: revisit", "small"), (4, None, None), (None, "http://n/", big), (5, "http://c/", other), (5, "http://d/", big), (6, "http://e/", "small"), (7, "http://f/", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS k", "2 AS i", "'z' AS file", "'h' AS head").repartition(3)
    files, headers = warc.write_archives(df)
    got = sorted((tuple(r) for r in warc.archive_report(files, headers).collect()), key=repr)
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        keeper = max(q for q, _, g in rows if q is not None and (g or "") == (h or "")) if len(body) >= 1000 else p
        revisit = len(body) >= 1000 and p != keeper
        want.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert got == sorted(want, key=repr)
    files, headers = warc.write_archives(df.limit(0))
    assert warc.archive_report(files, headers).count() == 0 and warc.reconstruct(files).count() == 0
