"""Token-id files: flat little-endian unsigned integers with 64-bit document offsets, memory-mapped for reading.

Documents are sorted by id over range partitions. Each partition writes one .bin (ids) and one .idx (offsets within it,
one more than it has documents); the manifest names the files of the attempts that succeeded, and a prefix sum over
its totals gives each partition its base, so that a document's start counts the ids of all documents before it.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh, row_key

END_ID = 2
#: Texts of these characters only are cut into the tokenizer's own pieces here; each piece is still encoded by the library, once
#: a worker. In them lower-casing, white space and letters mean the same to this pattern and to the tokenizer file's.
_PLAIN = re.compile("[\t\n\v\f\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
_CACHE_WORDS = 250_000  # in each of two generations: words met again outlive those met once


class Encoder:
    """Whole texts to ids with the tokenizers library, add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 65536 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces = _splits_like_plain(self.tok)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut_up = [_PIECES.findall(t.lower()) if self.pieces and "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        if len(self.cache) > _CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        new = set().union(*(ws for ws in cut_up if ws)).difference(self.cache)
        self.cache.update({w: self.older[w] for w in new.intersection(self.older)})
        new = list(new.difference(self.older))
        for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            self.cache[w] = np.array(e.ids, self.kind).tobytes()
        get = self.cache.__getitem__
        return [
            b"".join(map(get, ws)) if ws is not None else np.array(self.tok.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
            for t, ws in zip(texts, cut_up)
        ]


def _splits_like_plain(tok) -> bool:
    """Whether the tokenizer cuts plain text where _PIECES does (asked of the library, on a text with every case)."""
    probe = "It's WE'LL they're I'd 'tis x9 42 ÀÉß ÿø don't!? --'s\t\n a'b 'S \"'ve'm ''ll@1.2,3 " + "".join(map(chr, [*range(32, 127), *range(0xC0, 0x100)]))
    probe = "".join(c for c in probe if _PLAIN.fullmatch(c)).replace("<|", "< |")
    by_piece = [i for w in _PIECES.findall(probe.lower()) for i in tok.encode(w, add_special_tokens=False).ids]
    return by_piece == tok.encode(probe, add_special_tokens=False).ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _store(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs, path


def write_tokens(docs: DataFrame, tokenizer_path: str, uri: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode docs and write the files; the manifest: (part, bin, idx, width, n_docs, n_tokens, base), one row a file.

    Null text counts as empty and gets the end id alone. Rows are in ascending doc_id order (null first), rows that share an id
    in the order of their text. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    uri = uri or fresh(spark, "tokens")
    rows = docs.select(row_key().alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k", "text")

    def run(batches):
        enc, name = encoder(tokenizer_path), uuid.uuid4().hex
        fs, top = _store(uri)
        end = np.array([end_id], enc.kind).tobytes()
        first, n_docs, total = None, 0, 0
        with fs.open_output_stream(f"{top}/{name}.bin") as ids, fs.open_output_stream(f"{top}/{name}.idx") as idx:
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column(0).to_numpy()
                first = int(keys[0]) if first is None else first
                got = enc.encode(b.column(1).to_pylist())
                sizes = np.array([len(x) // enc.width + 1 for x in got], np.int64)
                idx.write(np.stack([keys, np.cumsum(sizes) - sizes + total], 1).astype("<i8").tobytes())
                for x in got:
                    ids.write(x)
                    ids.write(end)
                n_docs, total = n_docs + len(keys), total + int(sizes.sum())
            idx.write(np.array([0, total], "<i8").tobytes())
        if n_docs:
            cols = [[first], [f"{uri}/{name}.bin"], [f"{uri}/{name}.idx"], [enc.width], [n_docs], [total]]
            yield pa.RecordBatch.from_pydict(dict(zip(("first", "bin", "idx", "width", "n_docs", "n_tokens"), cols)))
        else:
            fs.delete_file(f"{top}/{name}.bin")
            fs.delete_file(f"{top}/{name}.idx")

    parts = cut(rows.mapInArrow(run, "first long, bin string, idx string, width long, n_docs long, n_tokens long"), "token-parts")
    # One row a file: the prefix sum over them is small whatever the corpus.
    found, base, out = sorted(parts.collect(), key=lambda r: r["first"]), 0, []
    for i, r in enumerate(found):
        out.append((i, r["bin"], r["idx"], r["width"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    return spark.createDataFrame(out, "part long, bin string, idx string, width long, n_docs long, n_tokens long, base long")


def _mapped(uri: str) -> pa.Buffer:
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def read_tokens(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the memory-mapped files."""
    null = -(2**63)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                flat = np.frombuffer(_mapped(row["bin"]), "<u2" if row["width"] == 2 else "<u4")
                idx = np.frombuffer(_mapped(row["idx"]), "<i8").reshape(-1, 2)
                keys, at = idx[:-1, 0], idx[:, 1]
                for s in range(0, len(keys), 4096):
                    o = range(s, min(s + 4096, len(keys)))
                    docs = [flat[at[i] : at[i + 1]] for i in o]
                    cols = [
                        pa.array([None if keys[i] == null else int(keys[i]) for i in o], pa.int64()),
                        pa.array([int(at[i]) + row["base"] for i in o], pa.int64()),
                        pa.array([len(d) for d in docs], pa.int64()),
                        pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if ids:
                        cols.append(pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(run, schema)
