"""WARC archives: writing, a normaliser for files gzipped as one stream, and reading by offset.

``write`` packs records into archives of one gzip stream each.  ``normalise`` inflates such a stream once,
from front to end, rewrites every record as its own gzip member, and writes a sidecar index with the
offset and length of each member, so that any record can be read alone.  ``read`` reads by that index.
Archives lie in the folder that all executors share and are opened through pyarrow.fs, which takes the
same URIs as Spark.  A file is written under a name of its own and renamed when whole, and its final
name and bytes depend on its rows alone, so that a repeated task does no harm.

Defined results: a null payload is empty; a null id is kept and never larger than another; records of
equal id and payload are all responses if their id is the largest; a null address writes no address;
control characters in an address are percent-encoded.  No rows write no archive and read as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _base as B

#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES, PIECE, LEVEL = 256 << 20, 1 << 20, 3


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Whole:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    digest = digest32(payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}/{digest}')}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)))
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to)), ("Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
    return {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:] if x)}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a gzip stream of any number of members: (header, whole record).  Holds one record at a time."""
    inflate, held, ended = zlib.decompressobj(31), bytearray(), False

    def more() -> bool:
        nonlocal inflate, ended
        raw = inflate.unused_data if inflate.eof else b""
        if not raw:
            raw = stream.read(PIECE)
        if not raw:
            ended = True
            return False
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        held.extend(inflate.decompress(raw))
        return True

    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if cut < 0:
            if held.strip():
                raise ValueError("the archive ends inside a record's header")
            return
        head = parse_head(bytes(held[:cut]))
        size = cut + 4 + int(head["content-length"]) + 4
        while len(held) < size and more():
            pass
        if len(held) < size:
            raise ValueError("the archive ends inside a record")
        yield head, bytes(held[:size])
        del held[:size]


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write archives of one gzip stream each; rows (path, n_records), read from a manifest in the folder.

    Of equal payloads of ``min_bytes`` or more the one of the largest id is the response, the others revisit it.
    """
    B.tune(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = lambda d: d.withColumn("digest", F.sha1("payload"))
    # payloads do not travel for this: only digests that occur twice, with their largest id
    twice = key(rows).filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).filter("n > 1").select("digest", "last")
    dealt = key(rows).join(twice, "digest", "left").select("id", "url", "payload", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, deflate, size, n = TaskContext.get().partitionId(), 0, None, None, 0, 0
        paths, counts = [], []

        def finish() -> None:
            out.write(deflate.flush())
            out.done()
            paths.append(path)
            counts.append(n)

        for batch in batches:
            for i, url, payload, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/mono/{part:06d}-{seq:04d}.warc.gz"
                    out, deflate, size, n = _Whole(path), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                data = record(i, url, payload, last, last is not None and i != last)
                out.write(deflate.compress(data))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    finish()
                    out, seq = None, seq + 1
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "n_records"])

    return B.written(dealt.mapInArrow(run, "path string, n_records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives with one member for each record; rows (path, index, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.flat(batches):
            name = row["path"].rpartition("/")[2].removesuffix(".gz").removesuffix(".warc")
            path, index = f"{folder}/members/{name}.warc.gz", f"{folder}/members/{name}.idx.jsonl"
            out, side, at, n = _Whole(path), _Whole(index), 0, 0
            source, where = _open(row["path"])
            with source.open_input_stream(where, compression=None) as stream:
                for head, whole in records(stream):
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = deflate.compress(whole) + deflate.flush()
                    out.write(member)
                    side.write(json.dumps({"offset": at, "length": len(member), "id": head.get("warc-record-id"), "type": head.get("warc-type"), "uri": head.get("warc-target-uri")}).encode() + b"\n")
                    at, n = at + len(member), n + 1
            out.done()
            side.done()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([index]), pa.array([n], pa.int64())], names=["path", "index", "n_records"])

    return B.written(_dealt(archives).mapInArrow(run, "path string, index string, n_records long"), "members")


def _dealt(manifest: DataFrame) -> DataFrame:
    """A manifest's few rows over as many tasks as the session shuffles to."""
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read(members: DataFrame) -> DataFrame:
    """Every record by its offset in the index: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    A response's payload is checked against its digest and its length; a revisit's payload is null.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def rows(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, (_, k) in enumerate(kinds)], names=[k for k, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.flat(batches):
            held = []
            source, where = _open(row["index"])
            with source.open_input_stream(where, compression=None) as stream:
                entries = [json.loads(x) for x in io.BytesIO(stream.read()).readlines()]
            source, where = _open(row["path"])
            with source.open_input_file(where) as archive:
                for e in entries:
                    archive.seek(e["offset"])
                    whole = zlib.decompress(archive.read(e["length"]), 31)
                    head, _, block = whole.partition(b"\r\n\r\n")
                    h = parse_head(head)
                    http, _, payload = block[: int(h["content-length"])].partition(b"\r\n\r\n")
                    size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    revisit = h["warc-type"] == "revisit"
                    if not revisit and (len(payload) != size or digest32(payload) != digest):
                        raise ValueError(f"{e['id']}: the payload does not match its digest")
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    held.append((number("page-id"), h.get("warc-target-uri"), h["warc-type"], number("refers-to-page-id"), size, digest, None if revisit else payload))
                    if len(held) == B.ARROW_ROWS:
                        yield rows(held)
                        held = []
            if held:
                yield rows(held)

    return _dealt(members.select("path", "index")).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = B.shared_dir(spark)
    out = read(normalise(write(B.table(spark, sf_dir, "pages"), folder), folder))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
x AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (list_sum(list_transform(range(0, 5), lambda b: CASE WHEN substr(bits, k * 5 + b + 1, 1) = '1' THEN (16 >> b) ELSE 0 END)) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + strpos('0123456789abcdef', substr(d, i, 1)) - 1), 4)), '') AS bits FROM x)
"""
