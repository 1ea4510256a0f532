"""SentencePiece encoding and decoding over a relational lattice.

Words are cut between letters that no piece joins, and the distinct parts of all documents are exploded into their substrings of bounded
length and equi-joined to the piece table (a vocabulary file, so its size is bounded and it is broadcast). The edges that match are grouped by
part and folded with Spark's aggregate. A unigram table would be folded by Viterbi; the ids of a BPE model are not the best-scoring path, so the
fold for BPE applies merges: the state is a bit mask of the part's boundaries, and a merge takes away one boundary. Parts never share a
piece: a piece holds the white-space mark only in front, and no newline.

The parts that occur most (TOP_PARTS at most) are broadcast with their ids; the others travel to their documents by joins, so every part is
encoded by the lattice wherever it occurs; one that is missing is an error. Which parts are broadcast is told by the texts of one document in
COUNTED_OF; it decides by which way an id travels and no result. Parts over LATTICE_CHARS are left to the library.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, row_key, trim

LATTICE_CHARS = 60  # boundaries fit one long
TOP_PARTS = 300_000
COUNTED_OF = 8  # of so many documents one has its parts counted, to choose those that are broadcast
FINER = 4  # times the session's partitions: a task of the lattice holds few parts' edges at a time
HASHED_GROUPS = 60_000  # groups of some 30 edges
SALTS = 64  # groups that copies of one text are dealt to
_COUNTED = 150_000  # parts that a task counts before it hands them on
CHUNK = 1 << 18  # letters that are cut in one go
_MARK = "▁"


class Pieces:
    """The piece table of a model file: ids, scores, bytes, and the letter pairs that some piece joins."""

    def __init__(self, path: str):
        import sentencepiece

        self.path, self._lib = path, None
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.rows = [
            (sp.id_to_piece(i), float(sp.get_score(i)), i)
            for i in range(n)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.byte_base = sp.piece_to_id("<0x00>")
        if any(sp.piece_to_id(f"<0x{b:02X}>") != self.byte_base + b for b in range(256)):
            raise ValueError("the model has no byte pieces in a row")
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p, _, _ in self.rows):
            raise ValueError("a piece of the model spans words")
        self.longest = max(len(p) for p, _, _ in self.rows)
        # Letters that stand in a pair of some piece have a class, all others class 0, which joins none.
        pairs = {p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)}
        letters = {c: i for i, c in enumerate(sorted({c for x in pairs for c in x}), 1)}
        self.classes = np.zeros(0x110000, np.uint16)
        self.n_classes = len(letters) + 1
        apart = np.ones((self.n_classes, self.n_classes), bool)
        for c, i in letters.items():
            self.classes[ord(c)] = i
        for x in pairs:
            apart[letters[x[0]], letters[x[1]]] = False
        self.apart = apart.ravel()
        self.surface = np.full(n, b"", object)
        for p, _, i in self.rows:
            self.surface[i] = p.replace(_MARK, " ").encode()
        for b in range(256):
            self.surface[self.byte_base + b] = bytes([b])
        self.kind = np.dtype("<u2" if n <= 65536 else "<u4")

    def parts(self, texts: list[str]) -> list[list[str]]:
        """The parts of each text, white space marked: cut between letters that no piece joins, so before each word."""
        marked = [_MARK + t.replace(" ", _MARK) if t else "" for t in texts]
        whole = "".join(marked)
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        flat, counts, done = [], np.zeros(len(marked), np.int64), 0
        while done < len(whole):
            # A block after the first begins with the part that the one before could not end.
            block = whole[done : done + CHUNK]
            codes = np.frombuffer(block.encode("utf-32-le"), np.uint32)
            kinds = self.classes[codes].astype(np.int32)
            close = np.append(self.apart[kinds[:-1] * self.n_classes + kinds[1:]], done + len(block) == len(whole))
            own = ends[np.searchsorted(ends, done, side="right") : np.searchsorted(ends, done + len(block), side="right")] - done - 1
            close[own] = True
            at = np.flatnonzero(close) + 1
            if not len(at):  # one part fills the block
                return [self._sliced(m) for m in marked]
            block, codes = block[: at[-1]], codes[: at[-1]]
            sep = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in block), None)
            if sep is None:
                flat += [block[a:b] for a, b in pairwise([0, *at.tolist()])]
            else:
                flat += np.insert(codes, at[:-1], ord(sep)).tobytes().decode("utf-32-le").split(sep)
            counts += np.diff(np.searchsorted(at, ends - done, side="right"), prepend=0)
            done += int(at[-1])
        last = np.cumsum(counts).tolist()
        return [flat[a:b] for a, b in zip([0, *last], last)]

    def _sliced(self, marked: str) -> list[str]:
        """parts() of one marked text with very long parts."""
        at = [s + 1 + np.flatnonzero(self._between(marked[s : s + CHUNK + 1])) for s in range(0, len(marked), CHUNK)]
        at = [0, *np.concatenate(at).tolist(), len(marked)] if marked else []
        return [marked[a:b] for a, b in pairwise(at)]

    def _between(self, block: str) -> np.ndarray:
        kinds = self.classes[np.frombuffer(block.encode("utf-32-le"), np.uint32)].astype(np.int32)
        return self.apart[kinds[:-1] * self.n_classes + kinds[1:]]

    @property
    def lib(self):
        """The library's processor, loaded where a part needs it: workers keep the tables alone."""
        if self._lib is None:
            import sentencepiece

            self._lib = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._lib

    def slim(self) -> Pieces:
        """What workers need: no rows, no library."""
        out = copy.copy(self)
        out.rows, out._lib = [], None
        return out

    def library(self, word: str) -> list[int]:
        """The ids of one word that starts anywhere in a text."""
        if word.startswith(_MARK):
            return self.lib.encode(word[1:].replace(_MARK, " "))
        head = self.lib.encode("\n")
        got = self.lib.encode("\n" + word)
        return got[len(head) :]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.surface[ids].tolist()).decode("utf-8", "replace")[1:]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _chunks(texts):
    """The texts in lists of about CHUNK letters."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _each(column):
    """The values of an Arrow column one by one, so that a batch of long texts is never held twice."""
    return (x.as_py() for x in column)


def _own_codes(column):
    """The parts and codes of each row of a list<struct<word, code>> column, as a dict."""
    ends = np.cumsum([0, *(n or 0 for n in column.value_lengths().to_pylist())]).tolist()
    flat = column.flatten()
    words, codes = flat.field(0).to_pylist(), flat.field(1).to_pylist()
    return (dict(zip(words[a:b], codes[a:b])) for a, b in pairwise(ends))


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): every distinct part of at most LATTICE_CHARS, pre-counted by task."""

    table = docs.sparkSession.sparkContext.broadcast(pieces(path).slim())

    def run(batches):
        counts, p = Counter(), table.value

        def flush():
            rows = [(w, n) for w, n in counts.items() if len(w) <= LATTICE_CHARS]
            counts.clear()
            for s in range(0, len(rows), 50_000):
                w, n = zip(*rows[s : s + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n, pa.int64())], names=["word", "n"])

        for b in batches:
            for chunk in _chunks(_each(b.column(0))):
                for parts in p.parts(chunk):
                    counts.update(parts)
                if len(counts) > _COUNTED:
                    yield from flush()
            chunk = parts = None
        yield from flush()
        b = None
        trim()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def edges(words: DataFrame, table: Pieces) -> DataFrame:
    """words (word, n) -> one row for each substring that is a piece, and for each single letter: (word, n, start, stop, score, id);
    score and id are null for a letter without a piece."""
    spark = words.sparkSession
    known = F.broadcast(spark.createDataFrame(table.rows, "piece string, score double, id int"))
    e = words.select("word", "n", F.length("word").alias("size"))
    # No sequence is empty; explode_outer makes the optimizer infer no filter, which would tell apart shuffles that encode() has in common.
    e = e.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("size") - 1)).alias("start"))
    e = e.select("*", F.explode_outer(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.col("size") - F.col("start")))).alias("len"))
    e = e.withColumn("sub", F.substring("word", F.col("start") + 1, F.col("len")))
    e = e.join(known, F.col("sub") == F.col("piece"), "left").where("id is not null or len = 1")
    return e.select("word", "n", "start", (F.col("start") + F.col("len")).alias("stop"), "score", "id")


def lattice(words: DataFrame, table: Pieces) -> DataFrame:
    """(word, n, edges): struct<neg, start, stop, ids> of each edge; a letter without a piece has no ids here."""
    e = edges(words, table)
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(F.array().cast("array<int>"))
    edge = F.struct((-F.coalesce("score", F.lit(-1e3))).alias("neg"), "start", "stop", ids.alias("ids"))
    return e.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))


_NO_ID = (1 << 19) - 1
_LATE = 1 << 19


def late_pieces(table: Pieces) -> set[str]:
    """Pieces that could be put together from two others of which one has the lower score: a merge of these may become possible after its turn."""
    score = {p: s for p, s, _ in table.rows}
    halves = lambda p: ((p[:i], p[i:]) for i in range(1, len(p)))
    known = lambda x: len(x) == 1 or x in score
    worse = lambda x, p: len(x) > 1 and score[x] <= score[p]
    return {p for p in score if any(known(a) and known(b) and (worse(a, p) or worse(b, p)) for a, b in halves(p))}


def packed_lattice(words: DataFrame, table: Pieces) -> DataFrame:
    """(word, n, edges): struct<k, inner, span> of each edge. k holds rank (by score, best first), start, stop, whether the piece is a late one, and id, from the high
    bits down, so sorting by it sorts by score, then place; a letter without a piece has the id _NO_ID. span has a bit for each boundary from start to stop, inner for those between."""
    best = {s: r for r, s in enumerate(sorted({s for _, s, _ in table.rows}, reverse=True))}
    late = late_pieces(table)
    ranked = [(p, float(best[s]), i | (_LATE if p in late else 0)) for p, s, i in table.rows]
    e = edges(words, type("Ranked", (), {"rows": ranked, "longest": table.longest}))
    k = F.expr(f"shiftleft(bigint(coalesce(score, 0)), 32) | shiftleft(bigint(start), 26) | shiftleft(bigint(stop), 20) | bigint(coalesce(id, {_NO_ID}))")
    inner, span = F.expr("shiftleft(1L, stop) - shiftleft(1L, start + 1)"), F.expr("shiftleft(1L, stop + 1) - shiftleft(1L, start)")
    e = e.select("word", "n", F.struct(k.alias("k"), inner.alias("inner"), span.alias("span")).alias("edge"))
    return e.groupBy("word", "n").agg(F.collect_list("edge").alias("edges"))


def fold(graph: DataFrame, byte_base: int) -> DataFrame:
    """(word, n, ids): the merges of a BPE model, best score first and leftmost among equals, until none is left.

    graph is a packed lattice. One walk over the merges in that order is enough unless a merge becomes possible after its turn; only late
    pieces can, and where one does, the walk is given up (-1) and each merge is looked for from the best one on. Letters without a piece become the ids of their bytes.
    """
    g = graph.withColumn("merges", F.sort_array(F.filter("edges", lambda e: e["inner"] > 0)))
    g = g.withColumn("lates", F.filter("merges", lambda e: e["k"].bitwiseAND(F.lit(_LATE).cast("long")) > 0))
    full = F.expr("shiftleft(1L, length(word) + 1) - 1L")

    def fits(m, e):
        # One boundary inside, and with both ends three; most merges fail the first test.
        return (F.bit_count(m.bitwiseAND(e["span"])) == 3) & (F.bit_count(m.bitwiseAND(e["inner"])) == 1)

    def walk(m, e):
        then = m.bitwiseAND(F.bitwise_not(e["inner"]))
        missed = F.exists("lates", lambda x: (x["k"] < e["k"]) & fits(then, x))
        return F.when((m > 0) & fits(m, e), F.when(missed, F.lit(-1).cast("long")).otherwise(then)).otherwise(m)

    def step(m, _):
        best = F.get(F.filter("merges", lambda e: fits(m, e)), F.lit(0))
        # A mask without a merge left is negated and stays as it is.
        return F.when(m < 0, m).otherwise(F.coalesce(m.bitwiseAND(F.bitwise_not(best["inner"])), -m))

    search = F.abs(F.aggregate(F.sequence(F.lit(1), F.length("word")), full, step))
    # transform over one element evaluates its argument once.
    mask = F.transform(F.array(F.aggregate("merges", full, walk)), lambda m: F.when(m > 0, m).otherwise(search))

    # A tile has its two ends and nothing between. Tiles do not overlap, so sorting by start, above the id, gives their order.
    def of_mask(m):
        kept = F.filter("edges", lambda e: m.bitwiseAND(e["span"]) == e["span"] - e["inner"])
        return F.sort_array(F.transform(kept, lambda e: e["k"].bitwiseAND(F.lit((1 << 32) - 1).cast("long"))))

    g = g.withColumn("tiles", F.transform(mask, of_mask)[0])
    ident = lambda e: e.bitwiseAND(F.lit(_NO_ID).cast("long")).cast("int")
    start = lambda e: F.shiftright(e, 26).cast("int")
    raw = lambda e: F.hex(F.encode(F.substring("word", start(e) + 1, F.lit(1)), "UTF-8"))
    of_bytes = lambda e: F.transform(F.sequence(F.lit(0), (F.length(raw(e)) / 2).cast("int") - 1), lambda i: F.conv(F.substring(raw(e), i * 2 + 1, F.lit(2)), 16, 10).cast("int") + byte_base)
    known = F.transform("tiles", ident)
    spelt = F.flatten(F.transform("tiles", lambda e: F.when(ident(e) == _NO_ID, of_bytes(e)).otherwise(F.array(ident(e)))))
    return g.select("word", "n", F.transform(F.array(known), lambda x: F.when(F.array_contains(x, _NO_ID), spelt).otherwise(x))[0].alias("ids"))


def viterbi(graph: DataFrame) -> DataFrame:
    """(word, n, ids) for a unigram table: the path of the greatest total score, the shorter last piece among equals."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("ids")))

    def step(best, end):
        into = F.filter("edges", lambda e: e["stop"] == end)
        options = F.transform(into, lambda e: F.struct((F.get(best, e["start"])["cost"] + e["neg"]).alias("cost"), (-e["start"]).alias("s"), F.concat(F.get(best, e["start"])["ids"], e["ids"]).alias("ids")))
        top = F.array_min(options)
        return F.concat(best, F.array(F.struct(top["cost"].alias("cost"), top["ids"].alias("ids"))))

    return graph.select("word", "n", F.element_at(F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step), -1)["ids"].alias("ids"))


def _frequent(words: DataFrame) -> DataFrame:
    """At most TOP_PARTS parts: those of the least count that lets all of its equals in."""
    sizes = words.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).limit(TOP_PARTS).toArrow()
    total, least = 0, None
    for n, c in zip(sizes.column("n").to_pylist(), sizes.column("c").to_pylist()):
        total += c
        if total > TOP_PARTS:
            break
        least = n
    return words.where(F.lit(False)) if least is None else words.where(F.col("n") >= least)


def encoded_parts(vocab: DataFrame, table: Pieces) -> DataFrame:
    """(word, n, code): code holds the ids as little-endian bytes."""
    width = table.kind.itemsize
    swapped = lambda i: sum((F.shiftleft(F.shiftright(i, 8 * b).bitwiseAND(F.lit(255)), 8 * (width - 1 - b)) for b in range(1, width)), F.shiftleft(i.bitwiseAND(F.lit(255)), 8 * (width - 1)))
    code = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(swapped(i)), 2 * width, "0")), ""))
    return fold(packed_lattice(vocab, table), table.byte_base).select("word", "n", code.alias("code"))


def _cut_hashed(df: DataFrame, name: str) -> DataFrame:
    """cut() for a lattice: a part's edges follow each other, so the groups are held in hash maps of up to HASHED_GROUPS parts a task instead of being
    sorted; the session's own setting comes back afterwards."""
    conf, key = df.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(key)
    conf.set(key, str(HASHED_GROUPS))
    try:
        return cut(df, name)
    finally:
        conf.set(key, before)


class Known:
    """The broadcast parts and their ids. It travels as an Arrow table; a worker makes the dict once."""

    _made: dict[str, dict[str, bytes]] = {}

    def __init__(self, top: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, top.schema) as w:
            w.write_table(top)
        self.name, self.raw = uuid.uuid4().hex, sink.getvalue().to_pybytes()

    def get(self) -> dict[str, bytes]:
        if self.name not in self._made:
            top = pa.ipc.open_stream(self.raw).read_all()
            self._made.clear()
            self._made[self.name] = dict(zip(top.column("word").to_pylist(), top.column("code").to_pylist()))
        return self._made[self.name]


class Coder:
    """Ids of texts from the codes of their parts."""

    def __init__(self, table: Pieces, known: dict[str, bytes]):
        self.table, self.known = table, known

    def lacking(self, parts: list[str]) -> list[str]:
        """The distinct parts without a known code."""
        return [x for x in set(parts).difference(self.known) if len(x) <= LATTICE_CHARS]

    def code(self, parts: list[str], own: dict[str, bytes]) -> bytes:
        out, i = list(map(self.known.get, parts)), -1
        try:
            while True:
                i = out.index(None, i + 1)
                out[i] = own[parts[i]] if len(parts[i]) <= LATTICE_CHARS else np.array(self.table.library(parts[i]), self.table.kind).tobytes()
        except ValueError:
            return b"".join(out)
        except KeyError:
            raise RuntimeError("a part has no ids") from None


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip[, ids]) for each row.

    ids are those of sentencepiece's encode(text); ids_crc32 is over them as little-endian unsigned 32-bit integers; round_trip tells
    whether decoding gives the text back (a text with the white-space mark itself does not). Null and empty texts have no pieces. Rows that
    share an id keep a row each. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    table = pieces(path)
    fine = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = cut(vocabulary(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(COUNTED_OF)) == 0), path), "counted")
    top = _cut_hashed(encoded_parts(_frequent(counted).repartition(fine, "word"), table), "parts")
    shared = spark.sparkContext.broadcast(Known(top.select("word", "code").toArrow()))  # at most TOP_PARTS rows
    kind, light = table.kind, spark.sparkContext.broadcast(table.slim())
    # Rows with equal keys share the codes of their rare parts, and each looks up its own, so the key needs no exactness; copies of one text fall into SALTS groups.
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(text).bitwiseXOR(F.pmod(F.xxhash64(row_key()), F.lit(SALTS)))
    src = docs.select(key.alias("g"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))

    def rare(batches):
        coder = Coder(light.value, shared.value.get())
        for b in batches:
            gs, ws = [], []
            keys = iter(b.column(0).to_pylist())
            for chunk in _chunks(_each(b.column(1))):
                for parts in coder.table.parts(chunk):
                    new = coder.lacking(parts)
                    gs += [next(keys)] * len(new)
                    ws += new
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(ws, pa.string())], names=["g", "word"])
        trim()

    def ship(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = pa.array(map(press.compress, _each(b.column(1))), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), z, b.column(2)], names=["g", "z", "doc_id"])

    # The uses are shuffled by word once: the lattice over the distinct words and the join with its codes read the same shuffle. Neither column is
    # null; the filter says so for both readers, as the joins would say it for one.
    uses = src.select("g", "text").mapInArrow(rare, "g long, word string").where("word IS NOT NULL AND g IS NOT NULL").repartition(fine, "word")
    words = encoded_parts(uses.groupBy("word").agg(F.count("g").alias("n")), table)
    found = uses.hint("merge").join(words.select("word", "code"), "word").repartition("g").groupBy("g").agg(F.collect_set(F.struct("word", "code")).alias("own"))
    whole = src.withColumn("text", F.col("text").cast("binary")).mapInArrow(ship, "g long, z binary, doc_id long").hint("merge").join(found, "g", "left")

    def assemble(batches):
        p, press = light.value, zstandard.ZstdDecompressor()
        coder = Coder(p, shared.value.get())
        for b in batches:
            out = []
            rows = zip(_each(b.column(0)), _own_codes(b.column(2)))
            for chunk in _chunks(press.decompress(z).decode() for z in _each(b.column(1))):
                for t, parts in zip(chunk, p.parts(chunk)):
                    i, own = next(rows)
                    ids = np.frombuffer(coder.code(parts, own), kind)
                    row = (i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), p.decode(ids) == t)
                    out.append(row + (ids.astype(np.int32),) * with_ids)
            cols = list(zip(*out)) or [()] * (4 + with_ids)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds)], names=["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids"][: len(kinds)])

    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return _cut_hashed(whole.select("doc_id", "z", "own").mapInArrow(assemble, schema), "encoded")
