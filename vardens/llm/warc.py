"""WARC archives: a writer, and a salvage reader that survives damage.

Writing: one gzip member per record, made in Arrow batches and saved with Spark's own
text writer, a zero byte after each member (gzip readers skip zero padding).  Payloads
that occur more than once are written once, as a ``response``; the others ``revisit`` it.
First occurrences come from a ``groupBy`` on the payload's SHA-256 that moves digests and
ids only.  The list of shared digests is then joined to the pages: pages stay where they are
when Spark broadcasts it, and are shuffled by digest when it is too long for that.

Reading: each archive file is walked member by member.  A member is taken only when it
inflates, its CRC holds, its header block parses, ``Content-Length`` fits and the block
digest agrees.  After any failed check the reader looks for the next gzip magic or
``WARC/`` version line, resumes there, recovers every later record and logs the bytes in
between as a quarantined gap.  Members of several records are searched inside: one bad
record loses itself alone, and of a member that breaks off, the records before the break
are kept if their own digests agree.  Plain (uncompressed) records are read as well.  A file is
one row, so a task holds one file; ``write_archives`` bounds their size by ``file_rows``.

Defined cases: a null payload is empty; payloads shorter than ``MIN_SHARED`` bytes are
always responses; of equal payloads the rows of the smallest id are responses (each row
of a repeated id is a record); a null id never is the smallest; an empty table gives an
empty archive and no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import arrow_map, bounded_map

MIN_SHARED = 100
FILE_ROWS = 2000
VERSION = b"WARC/1.1"
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")
PADDING = "\u0000"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id, url: str | None, kind: str, refers_to, digest: str, size: int, payload: bytes) -> bytes:
    """One uncompressed WARC record, its closing blank lines included."""
    body = payload if kind == "response" else b""
    uri = re.sub(r"[\r\n]+", " ", url or "")
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += [
            f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines = "\r\n".join([*head, f"Content-Length: {len(body)}"])
    return VERSION + b"\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def new_archive(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    level: int = 1, file_rows: int = FILE_ROWS,
) -> str:
    """Write one member per row of ``pages`` under ``path`` and return ``path``.

    Only rows of shared payloads travel to learn that they revisit another: the digests
    of those payloads are a semi-join away from the pages, which keep their partitions
    when Spark can broadcast them and are shuffled by digest otherwise.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    first = (
        rows.filter(F.octet_length("payload") >= MIN_SHARED).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("payload_digest", "first_id")
    )
    rows = rows.join(first, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", "first_id")

    def members(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for pid, url, body, digest, first_id in zip(*(c.to_pylist() for c in b.columns)):
            again = first_id is not None and pid != first_id
            out.append(gzip_member(record_bytes(pid, url, "revisit" if again else "response", first_id, digest, len(body), body), level))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    made = arrow_map(rows, members, "member binary").select(F.col("member").cast("string").alias("value"))
    made.write.option("lineSep", PADDING).option("maxRecordsPerFile", file_rows).text(path)
    return path


def _parse(block: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, payload and end of the record at ``at``; ValueError names the failed check."""
    line = VERSION_LINE.match(block, at)
    if not line:
        raise ValueError("version line")
    end = block.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise ValueError("header block")
    head = {}
    for raw in block[line.end() : end].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if raw and not colon:
            raise ValueError("header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdecimal():
        raise ValueError("content length")
    start, stop = end + 4, end + 4 + int(length)
    if block[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    body = block[start:stop]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha256:") and hashlib.sha256(body).hexdigest() != said[7:]:
        raise ValueError("block digest")
    return head, body, stop + 4


def _inflate(data: bytes, at: int, step: int = 1 << 15) -> tuple[bytes, int, str]:
    """The inflated gzip member at ``at``, its end, and what failed (empty: nothing), fed
    in steps so that the rest of the file is never copied.

    Of a member that fails, all bytes that inflate before the damage are returned: the
    step that fails is fed again byte by byte.
    """
    z, parts, end = zlib.decompressobj(31), [], at
    while not z.eof:
        piece = data[end : end + step]
        if not piece:
            return b"".join(parts), end, "truncated member"
        before = z.copy() if end > at else zlib.decompressobj(31)
        try:
            parts.append(z.decompress(piece))
        except zlib.error as e:
            try:
                for k in range(len(piece)):
                    parts.append(before.decompress(piece[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(parts), end, str(e)
        end += len(piece)
    return b"".join(parts), end - len(z.unused_data), ""


def _records(block: bytes, damaged: bool):
    """``(headers, payload)`` of the records of an inflated member that pass, and
    ``(None, (start, length, reason))`` for the stretches between them.

    After a failed check the search goes on at the next version line.  In a damaged
    member no sum vouches for the bytes, so there a record needs a digest that agrees.
    """
    inner, lost, why = 0, None, ""
    while inner < len(block):
        try:
            head, body, end = _parse(block, inner)
            if damaged and not head.get("warc-block-digest", "").startswith("sha256:"):
                raise ValueError("no digest in a damaged member")
        except ValueError as e:
            if lost is None:
                lost, why = inner, str(e)
            ahead = VERSION_LINE.search(block, inner + 1)
            inner = ahead.start() if ahead else len(block)
            continue
        if lost is not None:
            yield None, (lost, inner - lost, why)
            lost = None
        yield head, body
        inner = end
    if lost is not None:
        yield None, (lost, len(block) - lost, why)


def salvage(data: bytes):
    """Walk one archive: ``("record", offset, length, headers, payload)`` for every record
    that passes all checks, ``("gap", offset, length, reason, None)`` for every stretch
    of bytes that belongs to none.

    A stretch lost inside a member has the member's offset and its length and start in
    inflated bytes; a member that does not inflate to its end is a gap up to the next
    start, its records that pass (each by its own digest) come before that gap.
    """
    at, gap, why = 0, None, ""
    n = len(data)
    while at < n:
        if data[at] == 0 and gap is None:  # padding between members
            at += 1
            continue
        failed, found = "", []
        if data.startswith(GZIP_MAGIC, at):
            block, end, failed = _inflate(data, at)
            found = list(_records(block, bool(failed)))
            if not failed and all(head is None for head, _ in found):  # sound, but no record
                failed = found[0][1][2] if found else "empty member"
        else:
            try:
                head, body, end = _parse(data, at)
                found = [(head, body)]
            except ValueError as e:
                failed = str(e)
        good = [f for f in found if f[0] is not None]
        if gap is not None and (good or not failed):
            yield "gap", gap, at - gap, why, None
            gap = None
        ahead = at
        if failed:
            ahead = m.start() if (m := NEXT.search(data, at + 1)) else n
        for head, body in found if good else []:
            if head is not None:
                yield "record", at, (ahead if failed else end) - at, head, body
            elif not failed:
                start, length, reason = body
                yield "gap", at, length, f"{reason}, from inflated byte {start}", None
        if failed:
            if gap is None:
                gap, why = at, f"{failed}, {len(good)} records kept" if good else failed
            at = ahead
        else:
            at = end
    if gap is not None:
        yield "gap", gap, n - gap, why, None


RECORDS = (
    "file string, offset long, length long, reason string, page_id long, url string, record_type string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (``reason`` null) and quarantined gaps (``reason`` set) of all files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = pa.schema([
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def number(s: str | None):
        return int(s) if s and s.lstrip("-").isdecimal() else None

    def read(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows, size = [], 0
                for kind, at, length, head, body in salvage(content.as_buffer().to_pybytes()):
                    if kind == "gap":
                        rows.append((name.as_py(), at, length, head, None, None, None, None, None, None, None))
                        continue
                    rows.append((
                        name.as_py(), at, length, None, number(head.get("x-page-id")), head.get("warc-target-uri"),
                        head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha256:"),
                        number(head.get("x-payload-length")), number(head.get("x-refers-to-page")), body if payloads else None,
                    ))
                    size += len(body)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return bounded_map(files, read, RECORDS)
