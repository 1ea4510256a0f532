"""Toxicity scores from a learned lexicon, a Levenshtein automaton over its trie, and the words around each hit.

Fitting takes a bounded sample of labelled rows (MAX_TRAIN). Its lexicon holds word stems that occur in toxic rows in many
different contexts and hardly in others; copies of one text share their contexts and so count once. The lexicon's trie is
intersected with the Levenshtein automaton of one edit: the product's states are made when they are first met and kept, so a word costs one
table step a letter and most words leave after two or three. A hit counts as quoted inside quotation marks or after a
reporting word, as directed near an address to the reader; a logistic model weighs exact, misspelled, quoted and directed hits.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, trim

#: Rows of labels that a fit uses at most, those with the smallest hash of their id.
MAX_TRAIN = 20_000
#: Stems that a fit keeps at most, those with the most contexts.
MAX_TERMS = 2_000
THRESHOLD = 0.7
MIN_STEM, MAX_STEM = 4, 12
MIN_SUPPORT, CLEAR = 0.02, 20
FUZZY_LEN = 5  # shorter stems match exactly only
_TOKEN = re.compile(r"[\w@$*]+")
# Words that report speech or address the reader.
_REPORT = frozenset("said says wrote writes called quoted quote quotes reported according claimed insulted dijo sagte schrieb zitiert dit écrit cité".split())
_DIRECT = frozenset("you your you're youre u ur du dein deine ihr tu te ton toi vous votre usted tú ustedes".split())
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
_WINDOW = 80
#: Rows whose texts a task holds as Python strings at once, prefixes it counts before they are handed on, words whose hits a matcher remembers.
SLICE, HELD, KNOWN = 256, 50_000, 50_000


class Matcher:
    """Finds the stem that a word begins with, exactly (weight 2) or within one edit (weight 1)."""

    def __init__(self, stems: list[str], fuzzy: set[str] | None = None, weak: set[str] = frozenset()):
        self.stems = sorted(set(stems))
        self.weak = {i for i, s in enumerate(self.stems) if s in weak}
        fuzzy = {s for s in self.stems if len(s) >= FUZZY_LEN} if fuzzy is None else fuzzy
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.open: list[bool] = [False]  # whether a stem that allows an edit lies below
        for i, s in enumerate(self.stems):
            node = 0
            for c in s:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(-1)
                    self.open.append(False)
                self.open[node] |= s in fuzzy
                node = self.children[node][c]
            self.open[node] |= s in fuzzy
            if self.end[node] < 0:
                self.end[node] = i
        self.fuzzy = fuzzy
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[int, bool] | None] = []
        self.start = self._state({(0, 0)})
        self.cache: dict[str, tuple[int, bool] | None] = {}

    def _state(self, items) -> int:
        """The state of (node, edits) pairs, closed under left-out letters."""
        todo, seen = list(items), set(items)
        while todo:
            node, e = todo.pop()
            if e == 0 and self.open[node]:
                for child in self.children[node].values():
                    if self.open[child] and (child, 1) not in seen:
                        seen.add((child, 1))
        seen = frozenset((n, e) for n, e in seen if e == 0 or (n, 0) not in seen)
        if not seen:
            return -1
        if seen not in self.states:
            self.states[seen] = len(self.items)
            self.items.append(seen)
            self.steps.append({})
            exact = [self.end[n] for n, e in seen if e == 0 and self.end[n] >= 0]
            near = [self.end[n] for n, e in seen if e == 1 and self.end[n] >= 0 and self.stems[self.end[n]] in self.fuzzy]
            self.accept.append((min(exact), True) if exact else (min(near), False) if near else None)
        return self.states[seen]

    def _step(self, state: int, c: str) -> int:
        nxt = set()
        for node, e in self.items[state]:
            kids = self.children[node]
            if c in kids and (e == 0 or self.open[kids[c]]):
                nxt.add((kids[c], e))
            if e == 0 and self.open[node]:
                nxt.add((node, 1))  # an extra letter
                nxt.update((k, 1) for x, k in kids.items() if x != c and self.open[k])  # another letter
        to = self.steps[state][c] = self._state(nxt) if nxt else -1
        return to

    def find(self, word: str) -> tuple[int, bool] | None:
        state, best = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            hit = self.accept[state]
            if hit:
                best = hit
                if hit[1]:
                    break
        return best

    def __getitem__(self, word: str):
        try:
            return self.cache[word]
        except KeyError:
            if len(self.cache) >= KNOWN:
                self.cache.clear()
            self.cache[word] = found = self.find(word) if len(word) >= MIN_STEM - 1 else None
            return found

    def __getstate__(self):
        return self.stems, self.fuzzy, {self.stems[i] for i in self.weak}

    def __setstate__(self, state):
        self.__init__(*state)


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens before and closes after the span, or a reporting word stands before it."""
    before, after = text[max(0, start - _WINDOW) : start], text[end : end + _WINDOW]
    opened = before.count('"') % 2 == 1 and '"' in after
    for o, c in zip(_OPEN[1:], _CLOSE[1:]):
        opened |= before.rfind(o) > before.rfind(c) and c in after
    return opened or not _REPORT.isdisjoint(_TOKEN.findall(before)[-4:])


N_FEATURES = 6


def features(text: str | None, m: Matcher) -> tuple[float, ...]:
    """Over the whole text: 1 + ln of the hits of clear stems (none: 0), then ln(1 + x) of the hits of less clear ones, of misspelled, quoted and
    directed ones, and of the share in a hundred words of those less clear or misspelled."""
    low = (text or "").lower()
    words = _TOKEN.findall(low)
    hits = {w for w in words if m[w]}
    if not hits:
        return (0.0,) * N_FEATURES
    exact = weak = near = quoted = direct = 0
    for t in _TOKEN.finditer(low):
        if t[0] in hits:
            stem, is_exact = m[t[0]]
            if is_quoted(low, t.start(), t.end()):
                quoted += 1
                continue
            if not is_exact:
                near += 1
            elif stem in m.weak:
                weak += 1
            else:
                exact += 1
            around = low[max(0, t.start() - _WINDOW) : t.end() + _WINDOW]
            direct += not _DIRECT.isdisjoint(_TOKEN.findall(around))
    more = math.log(exact) if exact else -1.0
    return (1 + more, *(math.log1p(x) for x in (weak, near, quoted, direct, 100 * (weak + near) / len(words))))


class Model:
    def __init__(self, matcher: Matcher, weights: list[float]):
        self.matcher, self.weights = matcher, weights

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features(text, self.matcher)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Newton steps for a ridge-penalised logistic model; coefficient 0 is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penal = np.full(x.shape[1], ridge)
    penal[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penal), x.T @ (y - p) - penal * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _support(n_toxic: int) -> float:
    """The contexts in toxic rows that a stem has at least."""
    return max(3, MIN_SUPPORT * n_toxic)


def _apart(pos: int, neg: int, n_toxic: int, n_clean: int) -> bool:
    """Whether pos toxic and neg clean rows set a stem's toxic rows apart."""
    return math.log(((pos + 0.5) / (n_toxic + 1)) / ((neg + 0.5) / (n_clean + 1))) >= 2.5 and pos >= 1.5 * neg


def _stems(rows: list[tuple[str, int, int, int]], n_toxic: int, n_clean: int) -> tuple[list[str], set[str]]:
    """From (prefix, contexts in toxic rows, toxic rows, clean rows): stems, each the longest prefix that keeps a good one's support,
    and those of them that clean rows hold more often than one in CLEAR times."""
    good = {p: contexts for p, contexts, pos, neg in rows if contexts >= _support(n_toxic) and _apart(pos, neg, n_toxic, n_clean)}
    weak = {p for p, _, pos, neg in rows if pos < CLEAR * neg}
    by_parent: dict[str, list[str]] = {}
    for p in good:
        by_parent.setdefault(p[:-1], []).append(p)
    out = set()
    for p in good:
        if p[:-1] in good:
            continue
        while kids := [k for k in by_parent.get(p, ()) if good[k] >= 0.9 * good[p]]:
            p = kids[0]
        out.add(p)
    stems = sorted(out, key=lambda p: (-good[p], p))[:MAX_TERMS]
    return stems, weak.intersection(stems)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most MAX_TRAIN labelled rows whose crc32(doc_id) mod 3 is not 1."""
    y = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    y = y.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(y), "doc_id").select("text", "toxic")


def _lists(batches):
    """The columns as lists, SLICE rows at a time: a task never holds a whole batch of texts as Python strings."""
    for b in batches:
        for s in range(0, b.num_rows, SLICE):
            yield [c.to_pylist() for c in b.slice(s, SLICE).columns]


def _prefixes(words: list[str], among: frozenset | None = None) -> dict[str, int]:
    """The prefixes of a text's words, each with the place of the first word that begins with it. among: only these; it holds the shorter prefixes of each."""
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        if len(w) >= MIN_STEM and w[:MAX_STEM] not in out:
            for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1):
                if among is not None and w[:n] not in among:
                    break
                out.setdefault(w[:n], i)
    return out


def _count_prefixes(rows: DataFrame, among: frozenset | None = None) -> DataFrame:
    """(p, n): the rows with a word that begins with p, for all prefixes or those of among. Counts leave a task when they are over HELD."""
    given = rows.sparkSession.sparkContext.broadcast(among)

    def out(n):
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["p", "n"])

    def run(batches):
        n = Counter()
        for (texts,) in _lists(batches):
            for text in texts:
                n.update(_prefixes(_TOKEN.findall(text.lower()), given.value).keys())
                if len(n) > HELD:
                    yield out(n)
                    n = Counter()
        yield out(n)
        n.clear()
        trim()

    return rows.select("text").mapInArrow(run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


def _evidence(train: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, int, int, int]]:
    """(prefix, contexts in toxic rows, toxic rows, clean rows) of all prefixes that _stems can take.

    A toxic row adds one context of a prefix at most. So toxic rows tell which prefixes have support enough, clean rows are counted for these
    only, and contexts are gathered for what hardly occurs in clean rows: no task holds the prefixes or contexts of all its rows.
    """
    least = _support(n_toxic)
    toxic, clean = train.where("toxic = 1"), train.where("toxic = 0")
    pos = {r["p"]: r["n"] for r in _count_prefixes(toxic).where(F.col("n") >= least).collect()}
    neg = {r["p"]: r["n"] for r in _count_prefixes(clean, frozenset(pos)).collect()}
    rare = train.sparkSession.sparkContext.broadcast(frozenset(p for p, n in pos.items() if _apart(n, neg.get(p, 0), n_toxic, n_clean)))

    def run(batches):
        for (texts,) in _lists(batches):
            got = set()
            for text in texts:
                words = _TOKEN.findall(text.lower())
                got.update((p, " ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2])) for p, i in _prefixes(words).items() if p in rare.value)
            yield pa.RecordBatch.from_arrays([pa.array([x[at] for x in got], pa.string()) for at in (0, 1)], names=["p", "ctx"])
        trim()

    contexts = toxic.select("text").mapInArrow(run, "p string, ctx string").distinct().groupBy("p").count().where(F.col("count") >= least)
    return [(r["p"], r["count"], pos[r["p"]], neg.get(r["p"], 0)) for r in contexts.collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn stems and weights. Without labels of both kinds the model has no stems, and its score is the share of toxic labels (0.05 without any)."""
    train = cut(training_rows(docs, labels).groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-train")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = min(0.999, max(0.001, n_toxic / (n_toxic + n_clean))) if n_toxic + n_clean else 0.05
        return Model(Matcher([]), [math.log(share / (1 - share)), *[0.0] * N_FEATURES])

    stems, weak = _stems(_evidence(train, n_toxic, n_clean), n_toxic, n_clean)

    # Stems whose misspellings are common in clean rows lose the right to an edit.
    loose = train.sparkSession.sparkContext.broadcast(Matcher(stems))

    def near(batches):
        m = loose.value
        got = Counter()
        for texts, toxics in _lists(batches):
            for text, toxic in zip(texts, toxics):
                hits = {m[w] for w in set(_TOKEN.findall(text.lower()))} - {None}
                got.update(stem for stem, exact in hits if not exact and not toxic)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], names=["stem", "n"])
        trim()

    clean_hits = {r["stem"]: r["n"] for r in train.mapInArrow(near, "stem long, n long").groupBy("stem").agg(F.sum("n").alias("n")).collect()}
    ordered = loose.value.stems
    fuzzy = {s for i, s in enumerate(ordered) if len(s) >= FUZZY_LEN and s not in weak and clean_hits.get(i, 0) <= 0.001 * n_clean}
    final = Matcher(ordered, fuzzy, weak)
    shared = train.sparkSession.sparkContext.broadcast(final)
    names = [f"x{i}" for i in range(N_FEATURES)]

    def table(batches):
        for texts, toxics in _lists(batches):
            xs = [features(t, shared.value) for t in texts]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in xs], pa.float64()) for i in range(N_FEATURES)), pa.array(toxics, pa.int32())], names=[*names, "y"])
        trim()

    xs = train.mapInArrow(table, ", ".join(f"{n} double" for n in names) + ", y int").groupBy(*names, "y").count().collect()  # MAX_TRAIN rows at most
    flat = np.array([[*r[: N_FEATURES + 1]] for r in xs for _ in range(r["count"])], float)
    return Model(final, _weights(flat[:, :-1], flat[:, -1]))


def _weights(x: np.ndarray, y: np.ndarray) -> list[float]:
    """The logistic fit; kinds of hits that the sample has too few of borrow their weight from clear hits."""
    w = _logistic(x, y)
    clear = max(w[1], 0.0)
    seen = (x > 0).sum(0)
    for at, share in ((2, 0.5), (3, 0.7), (4, 0.15), (5, 0.1)):  # less clear, misspelled, quoted, directed
        if seen[at - 1] < 30:
            w[at] = share * clear
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row; null text counts as empty and gets the score of a text without hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for ids, texts in _lists(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([m.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row. A null doc_id is not held out. Tables may be empty; of repeated labels the larger counts."""
    out = score(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under THRESHOLD; columns are those of docs, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        m = shared.value
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                yield part.filter(pa.array([m.score(t) < THRESHOLD for t in part.column(at).to_pylist()], pa.bool_()))
        trim()

    # Numbered columns, as a name with a dot is taken for a field.
    at, numbered = docs.columns.index("text"), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
