"""Content-addressed WARC archive.

Payload bytes of MIN_PAYLOAD or more are stored once, in the response record of the row with the largest page_id; other
records of the same payload are revisits without it. Records are grouped by SHA-1 and SHA-256 together, so
equal digests are equal payloads. Each task writes one archive of zstd frames, one record a frame (.warc.zst); the exact
headers of each record are kept apart in a table, and joins by digest give every original record back.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh, row_key

MIN_PAYLOAD = 1000
_DATE = "1970-01-01T00:00:00Z"


def _one_line(value: str | None) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value or "")


def record_head(page_id: int | None, url: str | None, kind: str, digest: str, n: int, refers_to: int | None) -> bytes:
    """The header block of a record; refers_to is the page_id of the response that a revisit stands for."""
    uid = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uid}>", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Date: {_DATE}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {n if kind == 'response' else 0}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}", f"WARC-Original-Length: {n}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def plan(pages: DataFrame) -> DataFrame:
    """pages with k, payload_bytes, payload_digest, keeper (the page that stores the payload; null: a record of its own).

    The digest table holds no payloads; the join back is by digest, and a hot digest is pre-aggregated to one row.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select(row_key("page_id").alias("k"), "url", body.alias("body"))
    p = p.select("k", "url", "body", F.octet_length("body").cast("long").alias("n"), F.sha1("body").alias("sha1"))
    big = p.where(F.col("n") >= MIN_PAYLOAD).select("k", "sha1", "n", F.sha2("body", 256).alias("sha256"))
    groups = big.groupBy("sha1", "n", "sha256").agg(F.max("k").alias("keeper"), F.count("*").alias("c")).where("c > 1")
    # Only payloads that occur more than once need the join; they are known from digests alone.
    repeats = cut(big.join(groups.hint("merge"), ["sha1", "n", "sha256"]).where("k <> keeper").groupBy("k").agg(F.max_by("keeper", "sha1").alias("keeper"), F.first("sha1").alias("rsha1")), "repeats")
    return p.join(repeats.hint("merge") if repeats.count() else F.broadcast(repeats), "k", "left").withColumn("keeper", F.when(F.col("sha1") == F.col("rsha1"), F.col("keeper")))


def write_archives(pages: DataFrame, uri: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, headers): one row (file, records) for each archive, and (k, file, i, offset, length, head) for each record, i its number in the file.

    A null html is an empty payload, a null page_id or url an empty field. Rows that share a page_id give one record each, of which
    any may be the response that is referred to by the id. An empty table gives no archive.
    """
    spark = pages.sparkSession
    uri = uri or fresh(spark, "warc")
    null = -(2**63)

    def run(batches):
        fs, top = pafs.FileSystem.from_uri(uri)
        fs.create_dir(top, recursive=True)
        name, at, n_records, press = f"{uuid.uuid4().hex}.warc.zst", 0, 0, zstandard.ZstdCompressor(level=1)
        with fs.open_output_stream(f"{top}/{name}") as f:
            for b in batches:
                rows = []
                for k, url, body, n, sha1, keeper in zip(*(b.column(i).to_pylist() for i in range(6))):
                    kind = "response" if keeper is None else "revisit"
                    head = record_head(None if k == null else k, url, kind, sha1, n, None if keeper == null else keeper)
                    frame = press.compress(head + (body if keeper is None else b"") + b"\r\n\r\n")
                    f.write(frame)
                    rows.append((k, f"{uri}/{name}", n_records, at, len(frame), head))
                    at, n_records = at + len(frame), n_records + 1
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["k", "file", "i", "offset", "length", "head"])
        if not at:
            fs.delete_file(f"{top}/{name}")

    rows = plan(pages).select("k", "url", "body", "n", "sha1", "keeper")
    headers = cut(rows.mapInArrow(run, "k long, file string, i long, offset long, length long, head binary"), "warc-headers")
    return headers.groupBy("file").agg(F.count("*").alias("records")), headers


def read_archives(files: DataFrame, payload: bool = False) -> DataFrame:
    """One row for each record of the archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to[, payload, file, i].

    A response's digest and length are taken anew from the bytes read; a stored digest that differs is an error.
    """

    def rows_of(file: str):
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_stream(path) as f:
            reader = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
            rest = b""
            while chunk := reader.read(1 << 20):
                rest += chunk
                while (end := rest.find(b"\r\n\r\n")) >= 0:
                    size = int(rest[:end].rpartition(b"Content-Length: ")[2].partition(b"\r\n")[0])
                    if len(rest) < end + 8 + size:
                        break
                    record, rest = rest[: end + 4 + size], rest[end + 8 + size :]
                    yield parse_record(record)

    def run(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                out = []
                for i, (f, body) in enumerate(rows_of(file)):
                    stored = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    hit = f["WARC-Type"] == "revisit"
                    if not hit and hashlib.sha1(body).hexdigest() != stored:
                        raise ValueError(f"{file}: payload of {f['WARC-Record-ID']} does not match its digest")
                    page = f["WARC-Page-ID"]
                    row = (int(page) if page else None, f["WARC-Target-URI"], f["WARC-Type"], stored, int(f["WARC-Original-Length"]) if hit else len(body), int(f["WARC-Refers-To-Page"]) if hit and f["WARC-Refers-To-Page"] != "None" else None)
                    out.append(row + (None if hit else body, file, i) * payload)
                    if len(out) >= 2000:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary(), pa.string(), pa.int64()] * payload
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"] + ["payload", "file", "i"] * payload

    def batch_of(out):
        cols = list(zip(*out)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary, file string, i long" * payload
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(run, schema)


def reconstruct(files: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, file, i): every original record, a revisit's payload joined from its response. An empty table gives none."""
    r = read_archives(files, payload=True)
    stored = r.where("record_type = 'response'").select(row_key("page_id").alias("rk"), F.col("payload_digest").alias("rd"), F.col("payload").alias("body")).dropDuplicates(["rk", "rd"])
    back = r.where("record_type = 'revisit'").withColumn("rk", row_key("refers_to"))
    back = back.join(stored.hint("merge"), (back["rk"] == stored["rk"]) & (back["payload_digest"] == stored["rd"]))
    same = r.where("record_type = 'response'").select("page_id", "url", "record_type", "payload", "file", "i")
    return same.unionByName(back.select("page_id", "url", "record_type", F.col("body").alias("payload"), "file", "i"))


def archive_report(files: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record: what its header says, as the headers' table holds it, joined by file
    and number with the length and SHA-1 of its reconstructed payload, a revisit's as well."""
    field = lambda name: F.nullif(F.regexp_extract(F.decode("head", "UTF-8"), rf"(?m)^{name}: (\S*)\r\n", 1), F.lit(""))
    number = lambda name: field(name).try_cast("long")
    body = reconstruct(files).select("file", "i", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    said = headers.select("file", "i", number("WARC-Page-ID").alias("page_id"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To-Page").alias("refers_to"))
    return said.join(body.hint("merge"), ["file", "i"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
