"""WARC archives: deduplicating writer and splittable reader (operator 2).

Writer: each task writes one ``.warc.gz`` file in which every record is a gzip member of its
own. Of records with equal payloads of ``LEAST_BYTES`` or more, the one with the least page_id
is a response and the others are revisits that name it and hold no payload. A file is written
under an attempt's own name and renamed when complete, so a repeated task leaves one file. Pages
of a payload that makes up much of the repeated rows aren't shuffled; the table of these has a bound.

Reader: files are cut into byte ranges, and each task takes some. It looks for gzip's magic
bytes from the start of its range, takes a candidate for a member only if it decompresses to a
WARC version line and a complete header, and owns the records that start inside its range (it
reads the last one beyond the range's end). After a member, the next starts at once; only the
first member of a range has to be searched for.

Edge cases: a null payload is written as an empty one. Payloads under ``LEAST_BYTES`` are always
responses. Rows that repeat the least page_id of their payload are all responses; where all
page_ids of a payload are null, all its records are. A null url or page_id leaves its header
out and reads back as null; a url that isn't a URI comes back as it was given. Columns beyond the
three are ignored. No rows give no files, which read back as no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import discard, keep, new_folder, qualified, table

LEAST_BYTES = 100
SPLIT_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
PIECE = 1 << 16
#: A payload with more than one in so many of the repeated rows is joined where its rows lie, by a broadcast.
FREQUENT = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str = DATE) -> bytes:
    """One record, not compressed; ``first``: the page_id of the response that a revisit names."""
    digest = hashlib.sha256(payload).hexdigest()
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        uri = quote(url, safe="".join(map(chr, range(33, 127))), errors="replace")
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url:  # the URI is what readers expect, this is what was given
            head.append(f"X-Page-URL-Base64: {base64.b64encode(url.encode('utf-8', 'replace')).decode()}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, n, size, attempt = None, 0, 0, uuid.uuid4().hex
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        temporary, final = f"{base}/_{part:06d}-{attempt}", f"{base}/part-{part:06d}.warc.gz"
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for page_id, url, payload, first in zip(*columns, strict=True):
                out = out or store.open_output_stream(temporary, compression=None)
                text = payload.as_py()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id.as_py(), url.as_py(), (text or "").encode(), first.as_py())) + packer.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            store.move(temporary, final)
            yield pa.RecordBatch.from_arrays([pa.array([final.rpartition("/")[2]]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write (page_id, url, payload) as WARC files; returns (file, records, bytes) of each file."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    digest = F.sha2(F.col("payload"), 256)
    long = F.octet_length("payload") >= LEAST_BYTES
    # ids and digests only; a table of the payloads that occur twice or more
    seen = held.where(long).select("page_id", digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    firsts = keep(seen.where("n > 1 and first is not null"), "warc_firsts")
    # payloads with more than 1 in FREQUENT of the repeated rows: fewer than FREQUENT, whatever the table's size
    rows_of = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = keep(firsts.where(F.col("n") * FREQUENT > rows_of).select("digest", F.col("first").alias("frequent_first")), "warc_frequent")
    # pages of frequent payloads stay where they are, the rest meet their first page by a shuffle; short payloads meet nothing
    mine = held.where(long).select("page_id", "url", "payload", digest.alias("digest")).join(F.broadcast(frequent), "digest", "left")
    named = lambda c: F.when(~F.col("page_id").eqNullSafe(F.col(c)), F.col(c)).alias("first")
    often = mine.where("frequent_first is not null").select("page_id", "url", "payload", named("frequent_first"))
    seldom = mine.where("frequent_first is null").join(firsts.join(F.broadcast(frequent), "digest", "left_anti").select("digest", "first"), "digest", "left")
    joined = often.unionByName(seldom.select("page_id", "url", "payload", named("first")))
    rows = joined.unionByName(held.where(~long).select("page_id", "url", "payload", F.lit(None).cast("long").alias("first")))
    manifest = keep(rows.mapInArrow(_write(folder, level), "file string, records long, bytes long"), "warc_manifest")
    discard(firsts, frequent)
    return manifest


class _Range:
    """Bytes of a file from a position on, read in pieces."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data = file, at, bytearray()  # data starts at ``at``
        file.seek(at)

    def more(self) -> bool:
        piece = self.file.read(PIECE)
        self.data += piece
        return bool(piece)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def header(data: bytes) -> dict[str, str] | None:
    """The fields of a WARC header, given without its empty last line; None if it isn't one."""
    fields = {}
    for line in data.split(b"\r\n")[1:]:
        name, sign, value = line.partition(b":")
        if not sign:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _member(source: _Range) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, bytes of the member) if a record's member starts where the source stands.

    A header may have any length: it is looked for until its empty line or the member's end.
    """
    unpack, out, fields, used, start, seen = zlib.decompressobj(31), bytearray(), None, 0, 0, 0
    try:
        while True:
            if used >= len(source.data) and not source.more():
                return None
            piece = source.data[used : used + PIECE]
            used += len(piece)
            out += unpack.decompress(piece)
            if fields is None:
                if not bytes(out[:5]).startswith(b"WARC/"[: len(out)]):
                    return None
                end = out.find(b"\r\n\r\n", max(0, seen - 3))
                seen = len(out)
                if end >= 0:
                    fields, start = header(bytes(out[:end])), end + 4
                    if fields is None:
                        return None
            if unpack.eof:
                break
    except zlib.error:
        return None
    if fields is None:
        return None
    length = int(fields["content-length"])
    return (fields, bytes(out[start : start + length]), used - len(unpack.unused_data)) if len(out) >= start + length else None


def records(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records that start in a range of bytes."""
    source = _Range(file, start)
    while source.at < stop:
        if len(source.data) < len(MAGIC) and not source.more():
            return
        if source.data.startswith(MAGIC) and (found := _member(source)):
            yield source.at, found[0], found[1]
            source.skip(found[2])
            continue
        k = source.data.find(MAGIC, 1)
        if k < 0:
            k = max(1, len(source.data) - len(MAGIC) + 1)
        source.skip(k)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "payload", "file", "offset"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.int64()]
        for batch in batches:
            for name, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, size = [], 0
                with store.open_input_file(f"{base}/{name}") as file:
                    for at, fields, block in records(file, start, stop):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                        kept = fields.get("warc-payload-digest", "").partition(":")[2]
                        revisit = fields["warc-type"] == "revisit"
                        digest, ok = (kept, None) if revisit else ((d := hashlib.sha256(payload).hexdigest()), d == kept and len(payload) == length)
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        url = base64.b64decode(fields["x-page-url-base64"]).decode("utf-8", "replace") if "x-page-url-base64" in fields else fields.get("warc-target-uri")
                        rows.append((number("x-page-id"), url, fields["warc-type"], number("x-refers-to-page-id"), length, digest, ok, None if revisit else payload, name, at))
                        size += len(block)
                        if size >= SPLIT_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary, file string, offset long"


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the ``.warc.gz`` files of a folder (schema ``SCHEMA``).

    ``digest_ok``: whether a response's payload has the digest and length that its headers tell.
    """
    folder = qualified(spark, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    ranges = files.where("length > 0").select("file", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"), "length")
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n, "file", "start").mapInArrow(_read(folder), SCHEMA)


def complete(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``found`` (a written table of records), if it has as many rows as the writer's manifest tells."""
    written, read_back = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.count()
    if written != read_back:
        raise ValueError(f"{written} records were written, {read_back} were read")
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload")), folder)
    found = keep(read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc_pages")
    return complete(found, manifest)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
