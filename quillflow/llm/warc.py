"""Operator 10: WARC archives, written with revisit records and read back by a salvage reader.

Writing: one gzip member per record.  A task writes files of FILE_BYTES at most
into the given folder, by the file system that its address names.  Every attempt
of a task has names of its own; the table of written files, which Spark commits,
has those of the attempts that counted, and the reader takes no others.

Reading: every member is checked (gzip check sum, version line, header fields,
length, block and payload digest).  After a failed check the reader looks for the
next valid member, or in uncompressed archives the next version line, goes on
there and logs the gap it leaves: (file, start, end, reason).

Defined cases: a null page is the empty payload; a null page_id is written as an
empty name, and any id counts as larger; rows equal in page_id and payload are all
responses if they are the group's largest; an empty table gives an archive folder
without files and an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import materialize, small, text_batches, tidy

FILE_BYTES = 16 << 20
MIN_PAYLOAD = 0
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
FIELDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _name(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def build_record(page_id, url, payload: bytes, refers_to=None, date: str = "2024-01-01T00:00:00Z", digest: bytes | None = None) -> bytes:
    """A response record (HTTP head and payload), or a revisit (HTTP head alone) if refers_to names the response."""
    revisit = refers_to is not None
    digest = digest or hashlib.sha1(payload).digest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha1:{b32(digest)}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at a position, and where it ends; ValueError if a check fails."""
    m = VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end())
    if end < 0:
        raise ValueError("header without end")
    head = {}
    for line in data[m.end() : end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        head[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record of another length")
    block = data[start:stop]
    if (want := head.get("warc-block-digest")) and want != "sha1:" + b32(hashlib.sha1(block).digest()):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    length = re.search(rb"(?i)content-length: *(\d+)", http)
    if kind == "response" and digest and digest != b32(hashlib.sha1(payload).digest()):
        raise ValueError("payload digest differs")

    def number(field: str):
        found = re.search(r"urn:page:(-?\d+)", head.get(field, ""))
        return int(found[1]) if found else None

    return {
        "page_id": number("warc-record-id"), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"), "payload_digest": digest,
        "payload_bytes": len(payload) if kind == "response" or not length else int(length[1]), "payload": payload,
    }, stop + 4


def _member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str | None]:
    """What the gzip member that begins at a position holds, as far as it can be read, where it ends, and why it can't be read on; without a known end that is the position itself."""
    z, out, begin = zlib.decompressobj(31), [], at
    while not z.eof and at < len(data):
        for piece in (step, 64):  # after an error, once more in small pieces, so that what precedes the damage is kept
            before = z.copy()
            try:
                for i in range(at, min(at + step, len(data)), piece):
                    out.append(z.decompress(data[i : min(i + piece, at + step)]))
                break
            except zlib.error as e:
                reason = f"gzip: {e}"
                if piece == 64:
                    return b"".join(out), begin, reason
                z = before
        at += step
    return (b"".join(out), min(at, len(data)) - len(z.unused_data), None) if z.eof else (b"".join(out), begin, "gzip member without end")


def _records(content: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of uncompressed content, and the gaps between them."""
    found, gaps, at, bad = [], [], 0, None
    while at < len(content):
        try:
            record, end = parse_record(content, at)
        except ValueError as e:
            bad = bad or (at, str(e))
            line = VERSION.search(content, at + 1)
            at = line.start() if line else len(content)
            continue
        if bad:
            gaps.append((bad[0], at, bad[1]))
            bad = None
        found.append(record)
        at = end
    return found, gaps + ([(bad[0], len(content), bad[1])] if bad else [])


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """All valid records of an archive, compressed by member or not, and the quarantined gaps (start, end, reason).

    A member that holds several records, or breaks off, gives the valid records
    among what can be read of it; its gap is the whole member, in bytes of the
    archive, or what follows its begin up to the next member or version line.
    """
    records, gaps, at, bad = [], [], 0, None
    while at < len(data):
        if data.startswith(MAGIC, at):
            content, end, why = _member(data, at)
            found, lost = _records(content)
            records += found
            if why is None and found:
                if bad:
                    gaps.append((bad[0], at, bad[1]))
                    bad = None
                if lost:
                    gaps.append((at, end, lost[0][2]))
                at = end
                continue
            bad = bad or (at, why or (lost[0][2] if lost else "empty member"))
        else:
            line = VERSION.match(data, at)
            try:
                if not line:
                    raise ValueError("no version line")
                record, end = parse_record(data, at)
                if bad:
                    gaps.append((bad[0], at, bad[1]))
                    bad = None
                records.append(record)
                at = end
                continue
            except ValueError as e:
                bad = bad or (at, str(e))
        line, member = VERSION.search(data, at + 1), data.find(MAGIC, at + 1)
        at = min(([line.start()] if line else []) + ([member] if member >= 0 else []), default=len(data))
    if bad:
        gaps.append((bad[0], len(data), bad[1]))
    return records, gaps


def plan_records(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, payload, sha, refers_to): refers_to is null for responses; of equal payloads that with the largest page_id is the response."""
    text_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("sha", F.unhex(F.sha1("payload")))
    twice = src.where(F.length("payload") >= min_payload).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    rows = src.join(small(materialize(twice, "copies")), "sha", "left")
    return rows.select("page_id", "url", "payload", "sha", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records (page_id, url, payload, sha, refers_to) as *.warc.gz files below folder; (file, n_records, n_bytes) of each."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        part, attempt, k = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        held, size, rows = [], 0, []

        def flush():
            nonlocal k
            name = f"{root}/pages-{part:06d}-{k:04d}-{attempt}.warc.gz"
            with fs.open_output_stream(f"{root}/_{attempt}-{k}.tmp", compression=None) as f:
                f.write(b"".join(held))
            fs.move(f"{root}/_{attempt}-{k}.tmp", name)
            rows.append((name, len(held), size))
            k += 1

        for b in batches:
            for page, url, payload, sha, to in zip(*[b.column(c) for c in ("page_id", "url", "payload", "sha", "refers_to")]):
                member = gzip_member(build_record(page.as_py(), url.as_py(), payload.as_py(), to.as_py(), digest=sha.as_py()))
                held.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows]) for j in range(3)], ["file", "n_records", "n_bytes"])

    jvm = records.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(records.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)  # an empty table leaves an empty folder
    return materialize(records.mapInArrow(tidy(run), "file string, n_records bigint, n_bytes bigint"), "archives", scan=True)


def scan_archives(spark: SparkSession, folder: str, written: DataFrame | None = None) -> DataFrame:
    """Records (FIELDS and file) and quarantined gaps (file, start, end, reason; reason is null for records) of the archives below folder, read once; with the table that write_archives gave, of the files that it lists."""

    def run(batches):
        names = [x.split()[0] for x in FIELDS.split(", ")]
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content")):
                found, lost = salvage(data.as_py())
                rows = [*found, *({"start": s, "end": e, "reason": r} for s, e, r in lost)]
                cols = [pa.array([r.get(n) for r in rows], t) for n, t in zip([*names, "start", "end", "reason"], (*types, pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([file] * len(rows), pa.string())], [*names, "start", "end", "reason", "file"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    if written is not None:
        base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
        files = files.join(small(written.select(base("file").alias("_name"))), base("path") == F.col("_name"), "left_semi")
    return materialize(files.mapInArrow(tidy(run), FIELDS + ", start bigint, end bigint, reason string, file string"), "scanned", scan=True)


def read_archives(spark: SparkSession, folder: str, gaps: bool = False, written: DataFrame | None = None) -> DataFrame:
    """The records (FIELDS and file) of the archives below folder, or with gaps the quarantined gaps (file, start, end, reason); see scan_archives for both at once."""
    rows = scan_archives(spark, folder, written)
    if gaps:
        return rows.where("reason IS NOT NULL").select("file", "start", "end", "reason")
    return rows.where("reason IS NULL").drop("start", "end", "reason")
