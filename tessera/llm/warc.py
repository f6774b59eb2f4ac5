"""WARC archives: a writer that stores repeats as revisits, and a splittable reader.

Archives are files of one gzip member a record, as the format asks. The reader deals out
byte ranges: a task scans its range for the gzip magic, validates each candidate by
decoding the header, owns the records that start in its range and reads the last of them
past its end. Files are opened by ``pyarrow.fs``, so any store that it knows will do.

A payload may hold an archive of its own, whose records look like true ones where deflate
has stored it as it was. A stored block is at most 65,535 bytes long and its neighbours
are parted by a block header, so what begins inside a payload can't run on soundly for
longer: a first record in a range counts once it and what follows it without a gap span
more than that, or reach the end of the file. At the start of a file there is no doubt.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ceil_div, shared_dir, small_batches, splittable

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
SPLIT_BYTES = 16 << 20
#: How much of a file is read at once.
CHUNK = 1 << 20
#: How much of a record's headers is inflated first; longer ones take further steps.
HEADER_STEP = 1 << 16
#: The longest stored block of a deflate stream: fixed by the format.
STORED = 65_535
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(value: str) -> str:
    """A header value on one line; other characters stay."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}:{digest}')}>"


def record(url: str | None, payload: bytes, digest: str, key: int | None, original: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if key is not None:
        head.append(f"X-Page-ID: {key}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}", f"X-Refers-To-Page-ID: {original}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_head(raw: bytes) -> dict[str, str] | None:
    """Headers of a record, by lower-case name; None if these bytes don't begin one."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    out = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out if "warc-type" in out and out.get("content-length", "").isdigit() else None


def _begins_record(raw: bytes) -> bool | None:
    """Whether a gzip member of a WARC record begins here; None if more bytes are needed.

    Headers may be of any length: as long as what there is reads as header lines, more is asked for.
    """
    z, out, read, limit = zlib.decompressobj(31), b"", 0, HEADER_STEP
    while True:
        try:
            out += z.decompress(raw, limit)
        except zlib.error:
            return False
        if b"\r\n\r\n" in out:
            return parse_head(out) is not None
        if not out.startswith(VERSION[:7]) and not VERSION[:7].startswith(out):
            return False
        end = out.rfind(b"\r\n")
        if end > read:
            lines = out[read:end].split(b"\r\n")
            if not all(b":" in x for x in (lines if read else lines[1:])):
                return False
            read = end + 2
        raw, limit = z.unconsumed_tail, 2 * limit
        if z.eof or not raw:
            return False if z.eof else None


class _Window:
    """A file read forward in chunks; what has been passed is let go a chunk at a time."""

    def __init__(self, file, at: int):
        self.file, self.size = file, file.size()
        self.begin, self.held, self.skip = at, b"", 0

    @property
    def at(self) -> int:
        return self.begin + self.skip

    @property
    def left(self) -> int:
        """Bytes held from here on."""
        return len(self.held) - self.skip

    def grow(self) -> bool:
        end = self.begin + len(self.held)
        if end >= self.size:
            return False
        self.file.seek(end)
        more = self.file.read(CHUNK)
        self.held, self.begin, self.skip = self.held[self.skip :] + more, self.at, 0
        return bool(more)

    def view(self, at: int = 0) -> memoryview:
        return memoryview(self.held)[self.skip + at :]

    def pass_(self, n: int) -> None:
        self.skip += n


def _member(w: _Window, at: int) -> tuple[int, bytes] | None:
    """Length and content of the gzip member of a record ``at`` bytes on; None if there is none."""
    while w.left < at + len(MAGIC) and w.grow():
        pass
    ok = _begins_record(bytes(w.view(at)[:HEADER_STEP]))
    step = HEADER_STEP
    while ok is None:
        if w.left <= at + step and not w.grow():
            return None
        step *= 2
        ok = _begins_record(bytes(w.view(at)[:step]))
    if not ok:
        return None
    z, out, used = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if used == w.left and not w.grow():
                return None
            part = w.view(used)
            out.append(z.decompress(part))
            used = w.left - len(z.unused_data)
    except zlib.error:
        return None
    return used - at, b"".join(out)


def _sure(w: _Window, size: int) -> bool:
    """Whether the member here, of ``size`` bytes, and those after it go on as no payload's could."""
    at = size
    while at <= STORED:
        if w.at + at >= w.size:
            return True
        found = _member(w, at)
        if found is None:
            return False
        at += found[0]
    return True


def read_split(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose member starts in [start, end): (offset, headers, block).

    What lies between records is passed over, but a record in the 64 KiB before a gap counts
    only if a record of its own range went before it.
    """
    w = _Window(file, start)
    sure = start == 0  # at the start of a file and right after a record there is no doubt
    while w.at < end:
        if w.left < len(MAGIC) and not w.grow() and not w.left:
            return
        if not sure:
            at = w.held.find(MAGIC, w.skip)
            if at < 0:
                w.pass_(max(0, w.left - len(MAGIC) + 1))
                if not w.grow():
                    return
                continue
            w.pass_(at - w.skip)
            if w.at >= end:
                return
        found = _member(w, 0)
        head = parse_head(found[1]) if found else None
        if head is None or not (sure or _sure(w, found[0])):
            if not sure:
                w.pass_(1)
            sure = False
            continue
        size, raw = found
        body = raw.find(b"\r\n\r\n") + 4
        yield w.at, head, raw[body : body + int(head["content-length"])]
        w.pass_(size)
        sure = True


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row to ``folder``; returns (file, bytes, records).

    Of payloads that are equal and at least ``least`` bytes long, the smallest key's is
    the response and the others revisit it. Null payloads count as empty, null keys sort
    last. A file is written under a name of its own and then renamed, so a task that runs
    twice leaves one file.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    own = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    )
    # Lengths and digests alone decide who revisits whom; only the join below moves payloads.
    facts = own.select("key", F.sha2("html", 256).alias("digest")).where(F.octet_length("html") >= least)
    groups = facts.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    own = own.withColumn("digest", F.sha2("html", 256)).join(splittable(groups), "digest", "left")
    own = own.select(
        "key", "url", "html", "digest", F.when(F.octet_length("html") >= least, F.col("first")).alias("first")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        context = TaskContext.get()
        name = f"{at}/part-{context.partitionId():06d}.warc.gz"
        tried = f"{name}.{context.taskAttemptId()}.tmp"
        size = n = 0
        with fs.open_output_stream(tried, compression=None) as out:
            for b in batches:
                for k, u, h, d, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    raw = record(u, h.encode(), d, k, first, first is not None and first != k, date)
                    out.write(raw)
                    size += len(raw)
                    n += 1
        fs.move(tried, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})

    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)
    return own.mapInArrow(each, "file string, bytes long, records long")


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a folder's .warc.gz files, read in byte ranges.

    Columns: file, offset, record_type, page_id, url, payload_bytes, payload_digest,
    refers_to and payload (null for revisits). Anything between records that isn't a
    record is passed over; an empty folder gives no rows.
    """
    fs, at = open_fs(folder)
    files = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".warc.gz")]
    splits = [(p, i * split_bytes, min(size, (i + 1) * split_bytes)) for p, size in files for i in range(ceil_div(size, split_bytes))]
    schema = "file string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()], strict=True)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        fs, _ = open_fs(folder)
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for offset, head, block in read_split(file, start, end):
                        kind, payload = head["warc-type"], None
                        digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        size = int(x) if (x := head.get("x-payload-length", "")).isdigit() else None
                        if kind != "revisit":
                            payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        number = lambda x: int(x) if x.lstrip("-").isdigit() else None
                        refers = number(head.get("x-refers-to-page-id", ""))
                        rows.append((path, offset, kind, number(head.get("x-page-id", "")), head.get("warc-target-uri"), size, digest, refers, payload))
                        held += len(payload or b"")
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)

    ranges = spark.createDataFrame(splits, "path string, start long, end long")
    return ranges.repartition(max(1, len(splits))).mapInArrow(each, schema)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, and read those back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, **columns).collect()  # a row per file
    return read_archives(spark, folder)
