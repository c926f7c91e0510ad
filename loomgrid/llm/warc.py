"""WARC archives with a per-archive Zstandard dictionary.

An archive is a byte string after the ``.warc.zst`` convention: first a skippable frame (magic 0x184D2A5D) whose
content is the dictionary, then one Zstandard frame a record, each compressed alone with that dictionary.  The
dictionary is trained on pieces spread evenly over all of the archive's own records; where nothing can be trained
(very little text, or nothing in common), the pieces themselves are the dictionary, as raw content.

Records have the fields that WARC/1.1 asks for.  A response's block is an HTTP response with the page as its body; a
revisit has no block and names the response's address and payload digest.  The tables hold no time of capture, so
WARC-Date is a parameter; the tables' own numbers are in X- fields, as is an address that a header can't hold.

Edge cases: a null body is an empty payload; an empty table gives no archive; a null id or url has no field and is
read back as null; a record larger than ``archive_bytes`` gets an archive of its own; rows that repeat an id and a
payload are all written, with record ids of their own (all but the first id's rows are revisits, rows of that first
id are responses); of rows that share the first id, the least url is what revisits name; extra columns, of any name,
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

SKIPPABLE_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
DICT_SAMPLE_BYTES, PIECE = 2 << 20, 16 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the WARC and HTTP formats.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None, place: str = "", date: str = DATE) -> bytes:
    """One WARC record; ``place`` tells apart records of equal pages."""
    revisit, digest = refers_to is not None, digest32(payload)
    block = b"" if revisit else (HTTP_HEAD % len(payload)).encode() + payload
    name = uuid.UUID(bytes=hashlib.blake2b(f"{page_id} {digest} {place}".encode(), digest_size=16).digest(), version=4)
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
        if _line(url) != url:
            head.append(f"X-Target-URI-Base64: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_line(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first + b"\r\n" != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from pieces spread evenly over the records, of DICT_SAMPLE_BYTES in all."""
    total = sum(map(len, records))
    size = min(PIECE, max(64, total // 16))
    step = max(1, -(-total // DICT_SAMPLE_BYTES))
    pieces = ((x, a) for x in records for a in range(0, len(x), size))
    samples = [x[a : a + size] for at, (x, a) in enumerate(pieces) if at % step == 0]
    most = min(DICT_BYTES, max(1024, total // 8))
    try:
        return zstd.train_dictionary(most, samples, k=512, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:most]


def pack(records: list[bytes]) -> bytes:
    """The archive of these records."""
    raw = build_dictionary(records)
    coder = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(raw), write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(raw)), raw, *map(coder.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, by the dictionary in its leading skippable frame."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no leading dictionary frame")
    raw = archive[8 : 8 + size]
    decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
    view = memoryview(archive)[8 + size :]
    while len(view):
        one = decoder.decompressobj()
        yield one.decompress(view)
        view = view[len(view) - len(one.unused_data) :]


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = n = 0
    task = TaskContext.get().partitionId() if TaskContext.get() else 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n_records": pa.array([len(held)], pa.int64()), "content": pa.array([pack(held)], pa.large_binary()).cast(pa.binary())})

    for batch in slices(batches, "payload"):
        cols = [batch.column(k) for k in ("page_id", "url", "payload", "refers_to", "refers_url")]
        for at in range(batch.num_rows):
            record = build_record(*(c[at].as_py() for c in cols), place=f"{task}-{n}")
            n += 1
            if held and size + len(record) > ARCHIVE_BYTES:
                yield flush()
                held, size = [], 0
            held.append(record)
            size += len(record)
    if held:
        yield flush()


def write_archives(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Rows (n_records, content): one archive of at most ARCHIVE_BYTES of records a row.

    Of equal payloads the smallest id is the response.  Only (id, digest) pairs are grouped.  Which rows are revisits is
    written first, so that its size is known when bodies meet their decision: few are broadcast, and bodies stay
    where they are; more are joined by id, which is even however many copies a payload has.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.cast("binary").alias("payload"), F.sha1(body.cast("binary")).alias("digest"))
    slim = rows.select("page_id", "digest", "url")
    first = slim.where("page_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = slim.select("page_id", "digest").join(first, "digest").where("page_id > r.page_id").select("page_id", "digest", F.col("r.page_id").alias("refers_to"), F.col("r.url").alias("refers_url")).distinct()
    made = rows.join(scratch.save(again), ["page_id", "digest"], "left")
    return made.select("page_id", "url", "payload", "refers_to", "refers_url").mapInArrow(_write, "n_records long, content binary")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out: list[tuple] = []
            for record in unpack(content.as_py()):
                fields, payload = parse_record(record)
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if fields["WARC-Type"] == "response" and (digest32(payload) != digest or len(payload) != size):
                    raise ValueError("a payload differs from its digest")
                raw, number = fields.get("X-Target-URI-Base64"), lambda k, f=fields: int(f[k]) if k in f else None
                url = fields.get("WARC-Target-URI") if raw is None else base64.b64decode(raw).decode("utf-8", "surrogatepass")
                out.append((number("X-Page-ID"), url, size, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID")))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in READ_SCHEMA.split(", ")])


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record of the archives' ``content`` (also of Spark's binaryFile source); every response's digest is checked."""
    return archives.select("content").mapInArrow(_read, READ_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archives = scratch.save(write_archives(table(spark, sf_dir, "pages"), scratch), codec="uncompressed")
    return read_archives(archives).drop("url")
