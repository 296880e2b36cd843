"""WARC archives: a writer that stores each payload once, and a reader that salvages damaged files.

Writing.  Pages with equal payloads of at least min_bytes have one ``response``
record, that of the largest page_id; the others are ``revisit`` records, which
name it and carry HTTP headers but no payload.  Smaller payloads are responses
all.  Copies of a payload are merged in each task before rows move, so a payload
that a third of all pages share is shuffled once a task.  Each task writes files
of about SEGMENT bytes, one gzip member a record, under a name of its own that
is changed to the final one when a file is whole: a repeated task writes the
same files again and a lost one leaves none behind that the reader takes.

Reading.  Spark lists and reads the files.  A record must pass all checks: gzip
checksum, version line, lengths, closing lines, digests of block and payload.
Where one fails, the reader searches for the next gzip member, or version line
in a file that is not compressed, from which a valid record can be read; the
bytes in between are logged as a gap with the first check that failed.  Records
in a member beside a bad one are kept.

Defined results: null html is the empty payload; a null page_id is smallest and
a record without one reads back as null; of equal page_ids the one with the
greatest url (null least) is the response, of equal rows any one; a null url is
left out; a revisit whose response is lost has no refers_to; an empty table
gives no file and no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import shared_dir, staged, table
from cuelake.llm.components import spread_join

SEGMENT = 8_000_000
MIN_BYTES = 0
PIECE = 16_384
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_DATE = "1970-01-01T00:00:00Z"  # pages carry no date

RECORD = (
    "path string, begin bigint, end bigint, gap string, record_type string, record_id string, page_id bigint, uri string, refers_to_record string, "
    "payload_bytes bigint, payload_digest string, payload binary"
)
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_KINDS = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in RECORD.split(", ")]


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record; fields without a value are left out."""
    head = [VERSION, *(f"{name}: {value}".encode() for name, value in fields if value is not None)]
    head += [b"WARC-Block-Digest: sha1:" + digest(block).encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(kind: str, name: str, page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: str | None = None) -> bytes:
    """The record of a page; payload is empty for revisits, size and sha1 are of the full one."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", _DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Page-ID", None if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Refers-To", refers_to and f"<{refers_to}>"), ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return record(fields, block)


def member(data: bytes) -> bytes:
    """A gzip member that depends on data alone."""
    tool = zlib.compressobj(6, zlib.DEFLATED, 31)
    return tool.compress(data) + tool.flush()


class Bad(ValueError):
    """A check that failed."""


def parse(data: bytes, begin: int = 0) -> tuple[int, dict[str, str], bytes]:
    """(end, fields, block) of the record that begins there; Bad if a check fails."""
    version = _VERSION_LINE.match(data, begin)
    if not version:
        raise Bad("no version line")
    close = data.find(b"\r\n\r\n", version.end() - 2)
    if close < 0:
        raise Bad("headers have no end")
    fields: dict[str, str] = {}
    last = None
    for line in data[version.end() : close].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif line:
            last, colon, value = line.partition(":")
            last = last.strip().lower()
            if not colon:
                raise Bad("header without a colon")
            fields[last] = value.strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Bad("no length")
    start, end = close + 4, close + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("record does not end where its length says")
    block = data[start:end]
    _same(fields.get("warc-block-digest"), block, "block digest")
    if fields.get("warc-type") == "response":
        _same(fields.get("warc-payload-digest"), payload_of(block), "payload digest")
    return end + 4, fields, block


def _same(said: str | None, data: bytes, what: str) -> None:
    if said and said.lower().startswith("sha1:") and said[5:].upper() != digest(data):
        raise Bad(what)


def payload_of(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block


def inflated(data: bytes, begin: int) -> tuple[int, bytes]:
    """(end, content) of the gzip member that begins there; Bad if it is broken or cut off."""
    if data[begin : begin + 3] != MAGIC:
        raise Bad("no gzip member")
    tool, out, at = zlib.decompressobj(31), [], begin
    try:
        # Pieces, as each leaves its bytes after the member's end to be copied.
        while not tool.eof and at < len(data):
            out.append(tool.decompress(data[at : at + PIECE]))
            at += PIECE
    except zlib.error:
        raise Bad("gzip member is broken") from None
    if not tool.eof:
        raise Bad("gzip member is cut off")
    return min(at, len(data)) - len(tool.unused_data), b"".join(out)


#: What a salvaging reader yields: (begin, end, fields, block), or (begin, end, reason, None) for a gap.
Found = tuple[int, int, dict[str, str] | str, bytes | None]


def _salvaged(data: bytes, mark: re.Pattern, read) -> Iterator[Found]:
    """What read(data, begin) gives from the start on; where it fails, from the next mark at which it does not."""
    at = 0
    while at < len(data):
        try:
            end, found = read(data, at)
        except Bad as reason:
            for hit in mark.finditer(data, at + 1):
                try:
                    read(data, hit.start())
                except Bad:
                    continue
                yield at, hit.start(), str(reason), None
                at = hit.start()
                break
            else:
                yield at, len(data), str(reason), None
                return
        else:
            yield from found
            at = end


def _plain_record(data: bytes, begin: int) -> tuple[int, list[Found]]:
    end, fields, block = parse(data, begin)
    return end, [(begin, end, fields, block)]


def _gzip_record(data: bytes, begin: int) -> tuple[int, list[Found]]:
    """All records of a member; bad ones beside good ones are gaps of the member's bytes."""
    end, content = inflated(data, begin)
    inner = list(_salvaged(content, _VERSION_LINE, _plain_record))
    if not any(block is not None for *_, block in inner):
        raise Bad(inner[0][2] if inner else "empty gzip member")
    return end, [(begin, end, what if block is not None else f"{what} (bytes {a} to {b} of the member's content)", block) for a, b, what, block in inner]


def salvaged(data: bytes, compressed: bool) -> Iterator[Found]:
    return _salvaged(data, re.compile(re.escape(MAGIC)), _gzip_record) if compressed else _salvaged(data, _VERSION_LINE, _plain_record)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """RECORD rows of all ``*.warc`` and ``*.warc.gz`` files of a folder.

    Rows with ``gap``, the check that failed, stand for the bytes from begin to
    end that are lost; all others are records.  payload=False leaves that column
    null.  One file at a time is held, so files are best of moderate size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, data in zip(batch.column("path"), batch.column("content")):
                    path, data = path.as_py(), data.as_py()
                    for begin, end, found, block in salvaged(data, path.endswith(".gz")):
                        if block is None:
                            yield (path, begin, end, found, *[None] * 8)
                        else:
                            yield (path, begin, end, None, *_columns(found, block, payload))

        held: list[tuple] = []
        size = 0
        for row in rows():
            held.append(row)
            size += 200 + len(row[-1] or b"")
            if size > 4_000_000:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return files.mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _columns(fields: dict[str, str], block: bytes, payload: bool) -> tuple:
    body = payload_of(block)
    stated = re.search(rb"(?i)\r\ncontent-length: *([0-9]{1,18})\r\n", block[: len(block) - len(body)])
    size = int(stated[1]) if fields.get("warc-type") == "revisit" and stated else len(body)
    page_id, sha1 = fields.get("warc-page-id", ""), fields.get("warc-payload-digest", "")
    refers = fields.get("warc-refers-to")
    return (
        fields.get("warc-type"), fields.get("warc-record-id", "").strip("<>"), int(page_id) if re.fullmatch(r"-?[0-9]{1,19}", page_id) else None,
        fields.get("warc-target-uri"), refers and refers.strip("<>"), size, sha1[5:] if sha1.startswith("sha1:") else None, body if payload else None,
    )


def _name(payload_hash: str, page_id: int | None, url: str | None, copy: int) -> str:
    """The id of the record of a page, or of one more row equal to it."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((payload_hash, page_id, url, copy)))}"


def records_of(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row for each record to write: (h, page_id, url, copy, size, payload, sha1, first_id, first_url).

    Responses have payload; revisits have sha1, the payload's in hex, and first_id and first_url of the response that they name.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    read = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    read = read.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("h", F.sha2("payload", 256))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("sha1", "string"), ("first_id", "bigint"), ("first_url", "string"))]
    small = read.filter(F.col("size") < min_bytes).select("h", "page_id", "url", F.monotonically_increasing_id().alias("copy"), "size", "payload", *none)
    large = read.filter(F.col("size") >= min_bytes)
    # A null is smaller than any value of a struct.
    first = large.groupBy("h").agg(F.max(F.struct("page_id", "url")).alias("first"), F.max("payload").alias("payload"))
    responses = first.select("h", "first.*", F.lit(0).cast("bigint").alias("copy"), F.octet_length("payload").cast("bigint").alias("size"), "payload", *none)
    rows = large.groupBy("h", "page_id", "url").agg(F.count("*").alias("rows"), F.max("size").alias("size"), F.max(F.sha1("payload")).alias("sha1"))
    named = large.groupBy("h").agg(F.max(F.struct("page_id", "url")).alias("first"))
    met = spread_join(rows, named, "h")
    mine = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    copies = F.explode(F.sequence(mine.cast("bigint"), F.col("rows") - 1))
    revisits = met.filter((F.col("rows") > 1) | ~mine).select(
        "h", "page_id", "url", copies.alias("copy"), "size", F.lit(None).cast("binary").alias("payload"), "sha1",
        F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"),
    )
    return responses.unionByName(small).unionByName(revisits).sortWithinPartitions("h", "page_id", "url", "copy")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, segment: int = SEGMENT) -> DataFrame:
    """Write a record for each (page_id, url, html) row; gives (path, records, bytes) of the files, once they are written.

    folder is a URI or absolute path that all executors share.
    """
    store, top = pafs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, top = pafs.FileSystem.from_uri(folder)
        out, path, temporary, n_records, n_bytes, done = None, "", "", 0, 0, []

        def close():
            out.close()
            store.move(temporary, path)
            done.append((path, n_records, n_bytes))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "page_id", "url", "copy", "size", "sha1", "first_id", "first_url")]
            for h, page_id, url, copy, size, sha1, first_id, first_url, payload in zip(*columns, batch.column("payload")):
                name = _name(h, page_id, url, copy)
                if payload.is_valid:
                    data = payload.as_py()
                    made = page_record("response", name, page_id, url, data, size, digest(data))
                else:
                    sha1 = base64.b32encode(bytes.fromhex(sha1)).decode()
                    made = page_record("revisit", name, page_id, url, b"", size, sha1, _name(h, first_id, first_url, 0))
                if out is None:
                    path = f"{top}/part-{task.partitionId():06d}-{len(done):05d}.warc.gz"
                    temporary = f"{path}.{task.taskAttemptId()}.tmp"
                    out, n_records, n_bytes = store.open_output_stream(temporary), 0, 0
                made = member(made)
                out.write(made)
                n_records, n_bytes = n_records + 1, n_bytes + len(made)
                if n_bytes >= segment:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return staged(records_of(pages, min_bytes).mapInArrow(write, "path string, records bigint, bytes bigint"))


def resolved(records: DataFrame) -> DataFrame:
    """Records with refers_to, the page_id of the response that a revisit names, if that was read and has its digest."""
    plain = records.filter(F.col("gap").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_record")
    responses = plain.filter(F.col("record_type") == "response")
    named = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max(F.struct("page_id", "payload_digest")).alias("named"))
    met = spread_join(plain.filter(F.col("record_type") == "revisit"), named, "refers_to_record", "left")
    same = F.col("named.payload_digest") == F.col("payload_digest")
    out = ("page_id", "payload_bytes", "payload_digest", "record_type")
    return responses.select(*out, F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        met.select(*out, F.when(same, F.col("named.page_id")).alias("refers_to"))
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return resolved(staged(read_archives(spark, folder, payload=False)))


OP12_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         row_number() OVER same AS place, first_value(page_id) OVER same AS first_id
  FROM pages WINDOW same AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first_id END AS refers_to
FROM p
"""
