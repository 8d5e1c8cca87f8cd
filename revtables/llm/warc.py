"""Web archives (WARC 1.1) in Zstandard: one frame a record, a shared dictionary in front.

An archive begins with a skippable frame that holds the dictionary of its records (plain or
itself compressed); every record is a frame of its own. Pages with equal payloads have one
response record, the others are revisit records that name it. Archives are rows (archive,
content), so that Spark's own readers and writers move them: ``read_archives`` takes the
rows of a table as well as files through the ``binaryFile`` source.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the two formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"
#: An archive is closed when its records have so many compressed bytes.
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on the first records of an archive, so many bytes of each and in all.
SAMPLE_BYTES, SAMPLES_BYTES, DICTIONARY_BYTES = 8 << 10, 1 << 20, 16 << 10
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
READ = (
    "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, "
    "payload binary, problem string"
)


class BadRecord(ValueError):
    """A frame or record that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: bytes, known: str, first: int | None) -> bytes:
    """A response record with the page, or a revisit record that names page ``first``."""
    payload = html if first is None else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(html)).encode() + CRLF + CRLF + payload
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{known}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if first is not None:
        headers += [
            ("WARC-Refers-To", f"<urn:page:{first}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    head = CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers)])
    return head + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> dict:
    """The fields of one record; its headers, lengths and digests must agree."""
    head, gap, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadRecord("a header line without a name")
        fields[name.strip().decode().lower()] = value.strip().decode("utf-8")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadRecord(f"no {name}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != CRLF + CRLF:
        raise BadRecord("the record is not as long as its Content-Length says")
    block = rest[:-4]
    if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", digest(block)):
        raise BadRecord("the block is not what its digest says")
    kind, payload = fields["warc-type"], None
    size = None
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, body = block.partition(CRLF + CRLF)
        if not gap or not http.startswith(b"HTTP/"):
            raise BadRecord("no HTTP header")
        sizes = [x.partition(b":")[2].strip() for x in http.split(CRLF)[1:] if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else None
        if kind == "response":
            payload = body
            if size not in (None, len(body)):
                raise BadRecord("the payload is not as long as its HTTP header says")
            size = len(body)
            if fields.get("warc-payload-digest", "").removeprefix("sha1:") not in ("", digest(body)):
                raise BadRecord("the payload is not what its digest says")
    if kind == "revisit" and "warc-refers-to" not in fields:
        raise BadRecord("a revisit record that names no other")
    return {
        "record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": fields.get("warc-refers-to"),
        "payload": payload, "problem": None,
    }


def _dictionary(records: list[bytes]):
    """A trained dictionary, or none where there is too little to train on."""
    import zstandard

    samples, held = [], 0
    for r in records:
        samples.append(r[:SAMPLE_BYTES])
        held += len(samples[-1])
        if held >= SAMPLES_BYTES:
            break
    if len(samples) < 16 or held < 16 * DICTIONARY_BYTES:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:1024], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:1024], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    import zstandard

    words = _dictionary(records)
    writer = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True, write_checksum=True)
    body = zstandard.ZstdCompressor(level=3).compress(words.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body + b"".join(writer.compress(r) for r in records)


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one after another; other skippable frames are skipped."""
    import zstandard

    words, at, view = None, 0, memoryview(content)
    while at < len(content):
        magic = struct.unpack_from("<I", content, at)[0] if at + 8 <= len(content) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", content, at + 4)[0]
            if at + 8 + size > len(content):
                raise BadRecord("a skippable frame goes on beyond the archive")
            if at == 0 and magic == DICTIONARY_MAGIC:
                body = content[8 : 8 + size]
                if body[:4] == FRAME_MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body)
                trained = body[:4] == b"\x37\xa4\x30\xec"
                words = zstandard.ZstdCompressionDict(
                    body, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
                )
            at += 8 + size
            continue
        reader = zstandard.ZstdDecompressor(**({"dict_data": words} if words else {})).decompressobj()
        try:
            parts, step = [], at
            while not reader.eof and step < len(content):
                parts.append(reader.decompress(view[step : step + 65536]))
                step += 65536
        except zstandard.ZstdError as error:
            raise BadRecord(f"no frame: {error}") from None
        if not reader.eof:
            raise BadRecord("the last frame is cut off")
        at = min(step, len(content)) - len(reader.unused_data)
        yield b"".join(parts)


def with_first(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (bytes), digest and the first page of an equal payload, null if it is this one.

    A null html is an empty payload. Rows without a page_id never stand for others, and are
    revisits if another row has their payload. Rows that repeat the smallest page_id are
    responses all.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))

    def digests(batches):
        for batch in batches:
            known = [digest(memoryview(x.as_buffer())) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known, pa.string())], [*batch.schema.names, "digest"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.mapInArrow(digests, "page_id long, url string, html binary, digest string")
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"))
    joined = rows.join(first, F.col("digest") == F.col("_digest"))
    revisit = (F.length("html") >= least_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull()
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("first"))


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content) of the rows of ``with_first``; an archive holds rows of one task."""

    def run(batches):
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            name = f"part-{task:05d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive(held)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page_id, url, html, known, first in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, html, known, first))
                size += len(held[-1]) // 3
                if size >= archive_bytes:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return rows.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (archive, content), with what is wrong with them as ``problem``.

    A record that breaks the format is a row with its problem; a frame that can't be decoded
    ends its archive with such a row. Null contents have no record.
    """
    fields = [f.split()[0] for f in READ.split(", ")]
    kinds = [pa.int64() if " long" in f else pa.binary() if " binary" in f else pa.string() for f in READ.split(", ")]

    def rows_of(content: bytes):
        try:
            for frame in frames(content):
                try:
                    yield parse(frame)
                except (BadRecord, UnicodeDecodeError) as error:
                    yield {"problem": str(error)}
        except BadRecord as error:
            yield {"problem": str(error)}

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for row in rows_of(content.as_py() or b""):
                    held.append(row)
                    size += row.get("payload_bytes") or 0
                    if size > (8 << 20):
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in held], k) for f, k in zip(fields, kinds)], fields)

    return archives.select("content").mapInArrow(run, READ)


def page_of(record_id):
    """The page_id in a record id, null if it has none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
