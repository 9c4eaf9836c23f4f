"""WARC archives: writing with revisit records, and a salvage reader.

Each record is a gzip member of its own.  The reader checks every record (gzip
CRC, version line, length, payload digest); where a check fails it searches for
the next member or version line from which a whole record can be read, goes on
from there, and logs the bytes it passed over as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._common import arrow_batches, bit_words, drop_path, filter_words, make_folder, may_hold, new_path, numbered, releasing, spare_name, written

ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 1000
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str, compress: bool = True) -> bytes:
    """One record: a response carries the payload, a revisit only the HTTP header and the digest."""
    body = HTTP + (payload if kind == "response" else b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url or ""),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + body + b"\r\n\r\n"
    if not compress:
        return raw
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


class Damaged(Exception):
    pass


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parse(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at raw[at:], checked, and where it ends.  Raises Damaged."""
    if not VERSION.match(raw, at):
        raise Damaged("no version line")
    split = raw.find(b"\r\n\r\n", at)
    if split < 0:
        raise Damaged("no end of header")
    lines = [x.split(": ", 1) for x in raw[at:split].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x]
    fields = dict(lines)
    if len(fields) < len(lines) or VERSION.search(raw, at + 8, split):
        raise Damaged("another record begins within the header")
    size = fields.get("Content-Length", "")
    if not size.isdigit():
        raise Damaged("no length")
    start, end = split + 4, split + 4 + int(size)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not end the record")
    body = raw[start:end]
    if fields.get("WARC-Block-Digest") != "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode():
        raise Damaged("block digest differs")
    head = body.find(b"\r\n\r\n")
    payload = body[head + 4 :] if head >= 0 else b""
    try:
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        length = int(fields["X-Payload-Length"])
    except (KeyError, ValueError) as e:
        raise Damaged("no payload digest or length") from e
    kind = fields.get("WARC-Type")
    if kind == "response" and (digest != hashlib.sha1(payload).hexdigest() or length != len(payload)):
        raise Damaged("payload digest differs")
    return {"page_id": _number(fields.get("WARC-Record-ID")), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": _number(fields.get("WARC-Refers-To"))}, end + 4


def _inside(raw: bytes) -> Iterator[tuple[dict | None, int, int, str]]:
    """(record, start, end, "") of each whole record of a member's bytes, and (None, start, end, reason) of what lies between: after a failed check the next version line is looked for."""
    at, gap, why = 0, 0, ""
    while at < len(raw):
        try:
            found, end = parse(raw, at)
        except Damaged as e:
            why = why or str(e)
            m = VERSION.search(raw, at + 1)
            at = m.start() if m else len(raw)
            continue
        if gap < at:
            yield None, gap, at, why
        yield found, at, end, ""
        at, gap, why = end, end, ""
    if gap < len(raw):
        yield None, gap, len(raw), why


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(bytes, where the member at data[at:] ends, ""), or what came before the damage, -1 and the reason."""
    # A member is fed window by window, so that unused_data stays short.
    tool, k, out, step = zlib.decompressobj(31), at, [], 65536
    while not tool.eof and k < len(data):
        before = tool.copy() if step > 1 else None
        try:
            out.append(tool.decompress(data[k : k + step]))
        except zlib.error as e:
            if before is None:
                return b"".join(out), -1, str(e)
            tool, step = before, step // 16  # what comes before the damage is read in smaller steps
            continue
        k += step
    if not tool.eof:
        return b"".join(out), -1, "member ends early"
    return b"".join(out), min(k, len(data)) - len(tool.unused_data), ""


def salvage(data: bytes) -> Iterator[tuple[dict | None, int, int, str]]:
    """(record, start, end, "") of each record that passes its checks, and (None, start, end, reason) of each gap between them.

    Places are those in data; a record of a member has the member's, and a gap
    within one says in its reason which of the member's bytes it is.  Of a
    member that breaks off, the records before the damage are kept, at its
    start; the gap then lies between that and the next member or version line
    that holds a record.
    """
    at, gap, why = 0, 0, ""
    size = len(data)
    magic = version = -1  # the next of each, searched for once
    while at < size:
        found: list[tuple] = []
        try:
            if data.startswith(MAGIC, at):
                raw, end, broken = _inflated(data, at)
                found = list(_inside(raw))
                if broken:
                    yield from ((r, at, at, "") for r, *_ in found if r)
                    raise Damaged(broken)
                if found and not any(r for r, *_ in found):
                    raise Damaged(found[0][3])
                found = [(r, at, end, "" if r else f"{reason} (bytes {lo} to {hi} of the member)") for r, lo, hi, reason in found]
            else:
                record, end = parse(data, at)
                found = [(record, at, end, "")]
        except Damaged as e:
            why = why or str(e)
            at += 1
            if magic < at:
                magic = data.find(MAGIC, at)
                magic = size if magic < 0 else magic
            if version < at:
                version = m.start() if (m := VERSION.search(data, at)) else size
            at = min(magic, version)
            continue
        if gap < at:
            yield None, gap, at, why
        yield from found
        at = gap = end
        why = ""
    if gap < size:
        yield None, gap, size, why or "no record"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes records (page_id, url, payload, record_type, refers_to, payload_digest) as .warc.gz files under path, a shared folder.

    An archive is closed at archive_bytes.  Each is written under a name of its
    own and then renamed to one of its task alone: a task run again replaces
    its own archives, which hold the same records.
    """
    arrow_batches(records.sparkSession)
    make_folder(records.sparkSession, path)  # also where there are no records

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        held, size, n = [], 0, 0

        def close() -> int:
            name = f"{root}/part-{part:05d}-{number:05d}.warc.gz"
            draft = f"{root}/_draft-{uuid.uuid4().hex}"
            with fs.open_output_stream(draft, compression=None) as out:
                out.write(b"".join(held))
            fs.move(draft, name)
            return number + 1

        for b in batches:
            for row in zip(*(b.column(k) for k in range(6)), strict=True):
                page, url, payload, kind, refers, digest = (x.as_py() for x in row)
                held.append(record(page, url, payload, kind, refers, digest))
                size += len(held[-1])
                n += 1
                if size >= archive_bytes:
                    number = close()
                    held, size = [], 0
        if held:
            number = close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n], pa.int64())], names=["archives", "records"])

    own = records.select("page_id", "url", "payload", "record_type", "refers_to", "payload_digest")
    own.mapInArrow(releasing(write), "archives long, records long").agg(F.sum("records")).collect()


READ = "archive string, start long, end long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, gap string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record that passes its checks, and per quarantined gap (gap: the reason; record columns null; start and end: its bytes).

    Archives of the writer's size are read whole, one at a time.  A folder
    without archives gives no rows.
    """
    arrow_batches(spark)
    schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("gap", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows, size = [], 0
                for r, start, end, why in salvage(content.as_py()):
                    row = {"archive": name.as_py(), "start": start, "end": end, "gap": None if r else why} | (r or {})
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if size > 8 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInArrow(releasing(read), READ)


def assign_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to.

    Of equal payloads (SHA-256) of REVISIT_BYTES or more, the row of the largest
    page_id is the response, the last of equal ids; the others revisit it.
    Null html is an empty payload; rows of a null id come before all others.
    Copies are combined before the shuffle; the join back is one that adaptive
    execution can split.
    """
    own = numbered(pages, row := spare_name(pages, "row_no")).select(F.col(row).alias("row_id"), F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    marked = own.withColumn("payload_digest", F.sha1("payload")).withColumn("mark", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.unhex(F.sha2("payload", 256))).otherwise(F.col("row_id").cast("string").cast("binary")))
    marks, _ = written(marked.groupBy("mark").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), F.col("page_id").alias("id"), F.col("row_id").alias("row"))).alias("keep"), F.count("*").alias("n")).where("n > 1"), "payloads")
    # Only payloads whose mark may come twice move; all others are written where they are read.
    words = filter_words(marks.count())
    bits, _ = written(bit_words(marks, "mark", words), "filter")
    flagged = may_hold(marked, "mark", bits, words, "maybe")
    sole = flagged.where("not maybe").withColumn("keep", F.lit(None).cast(marks.schema["keep"].dataType))
    shared = flagged.where("maybe").join(marks.select("mark", "keep"), "mark", "left")
    out = sole.unionByName(shared)
    revisit = F.col("keep").isNotNull() & (F.col("keep.row") != F.col("row_id"))
    return out.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep.id")).alias("refers_to"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record per row of pages, reads the archives back, and returns page_id, payload_bytes, payload_digest, record_type, refers_to of what was read."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(assign_types(pages), path)
    out, _ = written(read_archives(spark, path, payloads=False).where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-rows")
    drop_path(spark, path)
    return out
