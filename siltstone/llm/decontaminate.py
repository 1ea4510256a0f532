"""Benchmark decontamination: item-sized windows, a prefix filter over shingles, exact verification.

A window has as many words as the item it may copy; a text with fewer words is one window. Similarity is the weighted
Jaccard similarity of the multisets of 5-word shingles. At SIMILARITY a window holds so many of an item's shingles that
it holds one of any set of a fifth of them, so an item is looked up by its rarest fifth alone (the prefix) and no copy
is lost. Around such a hit every window is counted as it slides, and the best one is verified on its words.

SimHash does not decide: windows that lose an item's beginning or end lie up to 13 bits and more from it at a
similarity of 0.8, so a radius either loses them or proposes nearly everything.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import own_columns, row_key, with_key

SHINGLE, SIMILARITY = 5, 0.8
#: Characters of benchmark text that one pass over the documents broadcasts, besides its last item; a larger benchmark takes more passes.
PASS_CHARS = 4_000_000
_WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_counts(words: list[str]) -> Counter:
    n = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard of two word lists: sum of the smaller over sum of the larger shingle counts."""
    x, y = shingle_counts(a), shingle_counts(b)
    both = sum((x & y).values())
    return both / ((sum(x.values()) + sum(y.values()) - both) or 1)


class ItemIndex:
    """Items (id, words), the shingles of each, and the items to look at for each shingle of a prefix."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [(i, w) for i, w in items if w]
        self.vocab: dict[str, int] = {}
        for _, w in self.items:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.shingles: list[tuple[int, np.ndarray, np.ndarray]] = []
        for _, w in self.items:
            n = min(SHINGLE, len(w))
            self.shingles.append((n, *np.unique(rolled(np.array([self.vocab[x] for x in w], np.uint64), n), return_counts=True)))
        held: dict[int, Counter] = defaultdict(Counter)
        for n, h, _ in self.shingles:
            held[n].update(h.tolist())
        anchors: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for at, (n, h, c) in enumerate(self.shingles):
            rare = np.lexsort((h, [held[n][x] for x in h.tolist()]))
            # A window may lack the shingles of total - needed places, so one of any more is in it.
            total = int(c.sum())
            needed = math.ceil((SIMILARITY - 1e-9) * total)
            size = int(np.searchsorted(np.cumsum(c[rare]), total - needed + 1)) + 1
            for x in h[rare[:size]].tolist():
                anchors[n][x].append(at)
        self.anchors = {n: (np.array(sorted(a), np.uint64), dict(a)) for n, a in anchors.items()}

    def _windows(self, at: int, h: np.ndarray, n_words: int, hits: list[int]):
        """(shared shingles, first word) of each window of item at that may hold a hit and reaches SIMILARITY, in order; h: the text's shingles."""
        n, known, c = self.shingles[at]
        total, size = int(c.sum()), len(self.items[at][1])
        width, last = min(size, n_words) - n + 1, max(n_words - size, 0)
        room, done = c.tolist(), -1
        for p in hits:
            lo, hi = max(p - width + 1, done + 1, 0), min(p, last)
            if lo > hi:
                continue
            done = hi
            part = h[lo : hi + width]
            slot = np.minimum(np.searchsorted(known, part), len(known) - 1)
            slot = np.where(known[slot] == part, slot, -1)
            most = np.cumsum(np.append(0, slot >= 0))
            if not _enough((most[width:] - most[:-width]).max(), total, width):
                continue
            slot, have, both = slot.tolist(), [0] * len(known), 0
            for i, x in enumerate(slot):
                if x >= 0:
                    both += have[x] < room[x]
                    have[x] += 1
                if i >= width and (y := slot[i - width]) >= 0:
                    have[y] -= 1
                    both -= have[y] < room[y]
                if i >= width - 1 and _enough(both, total, width):
                    yield both, lo + i - width + 1

    def matches(self, text: str | None):
        """The best window of each item at SIMILARITY or more: (item id, similarity, first word, words)."""
        words = words_of(text)
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        best: dict[int, tuple[float, int, int]] = {}
        for n, (known, where) in self.anchors.items():
            if len(words) < n:
                continue
            h = rolled(ids, n)
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            hits: dict[int, list[int]] = defaultdict(list)
            for p, x in zip(hit.tolist(), h[hit].tolist()):
                for at in where[x]:
                    hits[at].append(p)
            for at in sorted(hits):
                item, w = self.items[at]
                top = max(self._windows(at, h, len(words), hits[at]), key=lambda x: (x[0], -x[1]), default=None)
                if top is None:
                    continue
                window = words[top[1] : top[1] + len(w)]
                sim = similarity(window, w)
                was = best.get(item, (0, 0))
                if sim >= SIMILARITY - 1e-9 and (sim, -top[1]) > (was[0], -was[1]):
                    best[item] = (sim, top[1], len(window))
        return [(i, *v) for i, v in sorted(best.items())]


def _enough(both, total: int, width: int) -> bool:
    return both >= (SIMILARITY - 1e-9) * (total + width - both)


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive ids (wrapping 64-bit arithmetic)."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ (ids[j : j + len(out)] + np.uint64(1))) * _MULT
            out ^= out >> np.uint64(29)
    return out


def _passes(bench: DataFrame):
    """The items in blocks of bounded size, read part by part."""
    block, size = [], 0
    rows = bench.select(row_key("item_id").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text")
    for i, text in rows.toLocalIterator(prefetchPartitions=False):
        if block and size + len(text) > PASS_CHARS:
            yield block
            block, size = [], 0
        block.append((i, words_of(text)))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): for each document and item the best window that copies it.

    Words are runs of letters, digits and underscores in lower case; an item of fewer than five words is one
    shingle. Null or empty texts and items without words match nothing; a null id stays null. Repeated rows
    give one result; of equal windows the first counts. Items of any length are matched whole. Either table may be empty.
    """
    spark = docs.sparkSession
    null, schema = -(2**63), "doc_id long, item_id long, similarity double, first_word long, n_words long"
    src = docs.select(row_key().alias("k"), "text")
    out = None
    for block in _passes(bench):
        index = spark.sparkContext.broadcast(ItemIndex(block))

        def run(batches, index=index):
            ix = index.value
            for b in batches:
                rows = [(k, *m) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in ix.matches(t)]
                cols = list(zip(*rows)) or [()] * 5
                unset = lambda c: [None if x == null else x for x in c]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip([unset(cols[0]), unset(cols[1]), *cols[2:]], kinds)],
                    names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word"))).alias("m")).select("doc_id", "item_id", "m.*")


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that copy no benchmark item; columns are those of docs, whatever their names. Rows that share a doc_id go together."""
    bad = contaminated(docs, bench).select(row_key().alias("bad")).distinct()
    return own_columns(with_key(docs, "k").join(bad.hint("merge"), F.col("k") == F.col("bad"), "left_anti"), docs)
