"""WARC archives: a writer with revisit records, and a reader that salvages.

The writer makes one gzip member for each record and rolls files by size. The reader
checks each record (member, version line, length, block and payload digests); after a
failed check it searches for the next place where a valid member or version line starts,
goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir

#: A file is closed once it has so many bytes; readers hold one file at a time.
ROLL_BYTES = 16 << 20
#: Equal payloads of at least so many bytes are written once.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a member that are unpacked at a time; a record that has come whole is not held on to.
PIECE_BYTES = 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_path string, gap_start long, gap_end long, gap_reason string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, wbits=31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record for every row of pages to `folder`; gives the manifest (path, n_records, n_bytes).

    Of equal payloads of min_revisit_bytes or more, the row with the largest page_id is
    the response; rows with its page_id are too. Tasks write under names of their own, and
    only the files of tasks that ended well are in the manifest, so a task that runs again
    leaves nothing that is read.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/tessera-warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    sized = rows.where(F.octet_length("html") >= min_revisit_bytes)
    # Only payloads that are found twice; partial sums go before the shuffle.
    keepers = materialize(sized.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1 AND keeper IS NOT NULL").drop("n"), "keepers")
    planned = rows.join(keepers, "sha", "left").select("page_id", "url", F.when(F.col("keeper").isNull() | F.col("keeper").eqNullSafe(F.col("page_id")) | (F.octet_length("html") < min_revisit_bytes), None).otherwise(F.col("keeper")).alias("refers_to"), "html")
    where = folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        out, done, n, size = None, [], 0, 0
        for b in batches:
            for page, url, refers, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "html")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = _member(make_record(page, url, html.encode(), refers, refers is not None))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((f"{where}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{where}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    return materialize(planned.mapInArrow(write, MANIFEST), "manifest")


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at `at` and where it ends; ValueError says which check failed."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("no end of header")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        name = k.strip().lower().decode("latin-1")
        if name in head and name != "warc-concurrent-to":
            raise ValueError("repeated header")
        head[name] = v.strip().decode("utf-8", "replace")
    try:
        n = int(head["content-length"])
    except (KeyError, ValueError):
        raise ValueError("bad length") from None
    start = end + 4
    block = data[start : start + n]
    if n < 0 or len(block) < n or data[start + n : start + n + 4] != b"\r\n\r\n":
        raise ValueError("length differs")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    revisit = head.get("warc-type") == "revisit"
    http, _, payload = block.partition(b"\r\n\r\n")
    if not revisit and "warc-payload-digest" in head and head["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise ValueError("payload digest differs")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    page = lambda k: int(x) if (x := head.get(k, "").removeprefix("<urn:x-page:").rstrip(">")).lstrip("-").isdigit() else None
    return {
        "page_id": page("warc-record-id"), "record_type": head.get("warc-type"), "refers_to": page("warc-refers-to"), "payload": None if revisit else payload,
        "payload_bytes": int(length[1]) if revisit and length else len(payload), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(payload),
    }, start + n + 4


def _inflate(data: bytes, at: int) -> Iterator[bytes | tuple[int, str]]:
    """What the member that starts at `at` unpacks to, in pieces, up to where it is damaged; last, where it ends and what is wrong with it, if anything."""
    z, x, left = zlib.decompressobj(31), at, b""
    view = memoryview(data)
    try:
        while not z.eof and (left or x < len(data)):
            if not left:
                left, x = bytes(view[x : x + PIECE_BYTES]), x + PIECE_BYTES
            piece = z.decompress(left, 16 * PIECE_BYTES)
            left = z.unconsumed_tail
            if piece:
                yield piece
    except zlib.error as e:
        yield at, f"bad member: {e}"
        return
    yield min(x, len(data)) - len(z.unused_data), "" if z.eof else "member cut short"


def _whole(text: bytes) -> bool:
    """Whether text holds all of the record that it starts with, as far as its header says."""
    end = text.find(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", text[: end + 2]) if end >= 0 else None
    return length is not None and len(text) >= end + 8 + int(length[1])


def _member_records(data: bytes, at: int) -> Iterator[dict | tuple[int, str]]:
    """Records of the member at `at`, as they unpack; last, where it ends and what is wrong in it, if anything."""
    held, end, wrong = b"", at, ""
    broken = False  # what follows a bad record is looked through at the end
    for piece in _inflate(data, at):
        if isinstance(piece, tuple):
            end, wrong = piece
            break
        held += piece
        while not broken and _whole(held):
            try:
                record, used = parse_record(held)
            except ValueError:
                broken = True
                break
            yield record
            held = held[used:]
    for r in _records(held):
        if isinstance(r, dict):
            yield r
        else:
            wrong = wrong or r[2]
    yield end, wrong


def _records(text: bytes) -> Iterator[dict | tuple[int, int, str]]:
    """Records of plain WARC bytes; gaps as (start, end, reason)."""
    at = 0
    while at < len(text):
        try:
            record, at = parse_record(text, at)
            yield record
        except ValueError as e:
            start, at = at, len(text)
            for m in _VERSION.finditer(text, start + 1):
                try:
                    parse_record(text, m.start())
                except ValueError:
                    continue
                at = m.start()
                break
            yield start, at, str(e)


def salvage(data: bytes) -> Iterator[dict | tuple[int, int, str]]:
    """Every record of an archive, gzip by member or plain, and a gap for all bytes that are in none.

    The records before the damage in a member are given too; its gap is the whole member, up
    to the next one.
    """
    if not data.startswith(_MAGIC) and (_VERSION.search(data) or _MAGIC not in data):
        yield from _records(data)
        return
    at = 0
    while at < len(data):
        for r in _member_records(data, at):
            if isinstance(r, dict):
                yield r
            else:
                end, wrong = r
        if end == at:  # damaged: on to the next member that starts with a record
            end, x = len(data), data.find(_MAGIC, at + 1)
            while x >= 0:
                first = next(_inflate(data, x))
                if isinstance(first, bytes) and _VERSION.match(first):
                    end = x
                    break
                x = data.find(_MAGIC, x + 1)
        if wrong:
            yield at, end, wrong
        at = end


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record and for each gap (gap_path and what follows it) of the files in the manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for r in salvage(data):
                    if isinstance(r, tuple):
                        rows.append({"gap_path": path, "gap_start": r[0], "gap_end": r[1], "gap_reason": r[2]})
                    else:
                        rows.append(r if with_payload else r | {"payload": None})
                        held += len(r["payload"] or b"") if with_payload else 0
                    if len(rows) >= 5000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = max(manifest.sparkSession.sparkContext.defaultParallelism, 1)
    return manifest.select("path").repartition(4 * files).mapInArrow(read, RECORD)


_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap_path", pa.string()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string())])


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives written and read back.

    Null html counts as empty, and empty payloads are equal payloads. Null or odd urls
    are kept out of, or escaped in, the header. A null page_id comes back null. Repeated
    rows each have a record. An empty table gives none. Columns other than page_id, url
    and html are not read.
    """
    return read_archives(write_archives(pages, folder)).where("gap_path IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
