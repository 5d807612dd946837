"""Deterministic, sharded WARC files: written in page order, committed by manifest, read back.

1. Payload digests are grouped to find, for each repeated payload, the smallest page_id that
   holds it; the other pages' markers (page_id, digest, refers_to) are written as a table. Only
   digests and ids are shuffled for that.
2. ``bounds`` cuts the order of (page_id, digest) into ranges of equal bytes, exactly, from the sum of the bytes
   before each page. Ranges hold a 512th of the bytes, RANGE_LEAST at least and RANGE_MOST at most, so they
   depend on the pages alone, not on the session or on how the pages are stored.
3. Pages and markers are sent to their range and sorted, a marker just before
   its page, so one shuffle brings each payload to its place. Each task streams its range into gzip members, one a
   record, and begins a new file when one has reached ROLL compressed bytes. Headers, record ids, lengths and digests are
   made anew from the payload; ids and dates depend on nothing but the input.
4. Files are written under a name that holds the task attempt and moved to their final names when
   the task has written them all. Final names depend on the range alone, and a file that is there already has
   the same bytes and stays. The manifest, a table written last, lists the files and
   the places in them where reading may begin; a file that it doesn't list isn't part of the archive.
5. ``read`` takes a slice of a file a task and checks each payload against its digest.

Null html is an empty payload; null url leaves out the target. A null page_id comes first in the
files; it is a response only if no page with an id has the payload, and refers_to is then null for its copies.
Rows that repeat page_id and payload are one response (or revisit) and revisits of that page. A URL that a header can't
hold as it is goes into a header of its own besides, in base 64, and comes back unchanged. Ids are integers; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import math
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, map_arrow

ROLL = 256 << 20
SLICE = 4 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
RANGE_LEAST = 8 << 20
RANGE_MOST = 1 << 30
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}:{repeat}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, repeat: int) -> bytes:
    """One record with headers made from the payload."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, repeat)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = quote(url, safe=""":/?#[]@!$&'()*+,;=%~""")
        lines.append(f"WARC-Target-URI: {safe}")
        if safe != url:
            lines.append(f"Page-URL-Base64: {base64.b64encode(url.encode()).decode()}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"Refers-To-Page-ID: {refers_to}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def markers(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a smaller page_id has."""
    light = pages.select(F.col("page_id").cast("long"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    other = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return light.join(firsts.hint("merge"), "digest").where(other).select("page_id", "digest", "refers_to").distinct()


_MANIFEST = "file string, at long, length long, records long, first_page long, last_page long"


class _Files:
    """A task's files: temporary names first, final names by ``commit``."""

    def __init__(self, out: str, roll: int):
        self.fs, self.root = pa.fs.FileSystem.from_uri(out)
        c = TaskContext.get()
        self.part, self.roll = c.partitionId(), roll
        self.temporary = f"{self.root}/_temporary/{c.partitionId()}-{c.taskAttemptId()}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        self.stream, self.size = None, 0

    def write(self, data: bytes) -> tuple[str, int]:
        if self.stream is None or self.size >= self.roll:
            self.close()
            if not self.names:
                self.fs.create_dir(self.temporary, recursive=True)
            self.names.append(f"part-{self.part:06d}-{len(self.names):05d}.warc.gz")
            self.stream, self.size = self.fs.open_output_stream(f"{self.temporary}/{self.names[-1]}", compression=None), 0
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return self.names[-1], at

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None

    def commit(self) -> None:
        self.close()
        for name in self.names:
            final = f"{self.root}/{name}"
            if self.fs.get_file_info(final).type == pa.fs.FileType.NotFound:
                self.fs.move(f"{self.temporary}/{name}", final)
        if self.names:
            self.fs.delete_dir(self.temporary)


def _writer(out: str, roll: int, slice_bytes: int, level: int):
    def run(batches):
        files = _Files(out, roll)
        slices: list[list] = []
        key, refers_to, marked, repeat = object(), None, False, 0
        for b in batches:
            for page_id, digest, kind, refers, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (page_id, digest) != key:
                    key, marked, repeat = (page_id, digest), False, 0
                if kind == 0:
                    refers_to, marked = refers, True
                    continue
                again = marked or repeat > 0
                name, at = files.write(member(record(page_id, url, html or b"", refers_to if marked else page_id, again, repeat), level))
                repeat += 1
                if not slices or slices[-1][0] != name or at - slices[-1][1] >= slice_bytes:
                    slices.append([name, at, 0, 0, page_id, page_id])
                slices[-1][2] = files.size - slices[-1][1]
                slices[-1][3] += 1
                slices[-1][5] = page_id
        files.commit()
        columns = list(zip(*slices, strict=True)) if slices else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], [x.split()[0] for x in _MANIFEST.split(", ")])

    return run


def bounds(light: DataFrame, ws: Workspace, *, least: int = RANGE_LEAST, most: int = RANGE_MOST) -> list[tuple]:
    """The first (page_id, digest) of each range but the first, from rows (page_id, digest, size)."""
    order = ["page_id", "digest"]
    rows = light.repartitionByRange(*order).withColumn("run", F.spark_partition_id())
    rows = ws.write(rows, "sizes")
    runs = {r.run: r.size for r in rows.groupBy("run").agg(F.sum("size").alias("size")).collect()}
    before = dict(zip(sorted(runs), itertools.accumulate([0, *(runs[k] for k in sorted(runs))]), strict=False))
    range_bytes = min(most, max(least, -(-sum(runs.values()) // 512)))
    # Equal keys lie in one run and count from their first.
    keys = rows.groupBy("run", *order).agg(F.sum("size").alias("size"))
    at = F.sum("size").over(Window.partitionBy("run").orderBy(*order)) - F.col("size")
    starts = ws.spark.createDataFrame(list(before.items()), "run int, before long")
    placed = keys.withColumn("at", at).join(F.broadcast(starts), "run").withColumn("range", F.expr(f"(at + before) div {range_bytes}"))  # a row a run
    found = placed.groupBy("range").agg(F.min(F.struct(*order)).alias("key")).orderBy("range").collect()
    ws.drop("sizes")
    return [(r.key.page_id, r.key.digest) for r in found][1:]


def _range(cuts: list[tuple]) -> Column:
    """The number of cuts at or below (page_id, digest), in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    shape = "struct<page_id: bigint, digest: string>"
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    key = F.struct("page_id", "digest")
    entry = lambda c: {"page_id": c[0], "digest": c[1]}
    group = F.size(F.filter(literal([entry(g[0]) for g in groups], f"array<{shape}>"), lambda c: c <= key))
    inner = F.element_at(literal([[entry(c) for c in g] for g in groups], f"array<array<{shape}>>"), F.greatest(group, F.lit(1)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + F.size(F.filter(inner, lambda c: c <= key)))


def write(pages: DataFrame, ws: Workspace, *, roll: int = ROLL, slice_bytes: int = SLICE, level: int = LEVEL, least: int = RANGE_LEAST) -> tuple[str, DataFrame]:
    """Write the archive; returns its folder and its manifest."""
    marks = ws.write(markers(pages), "markers")
    body = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long"), F.sha1(body).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), F.col("url").cast("string").alias("url"), body.alias("html"))
    cuts = bounds(full.select("page_id", "digest", (F.octet_length("html").cast("long") + 1).alias("size")), ws, least=least)
    marked = marks.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    rows = full.union(marked).withColumn("range", _range(cuts)).repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("page_id", "digest", "kind", "url").drop("range")
    out = f"{ws.path}/archive"
    return out, ws.write(map_arrow(rows, _writer(out, roll, slice_bytes, level), _MANIFEST), "manifest")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with names in lower case, and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def members(data: bytes):
    """The contents of concatenated gzip members."""
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data) + z.flush()
        data = z.unused_data


def _entry(data: bytes) -> tuple:
    headers, block = parse(data)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if f"sha1:{base32_sha1(block)}" != headers["warc-block-digest"]:
        raise ValueError("a block doesn't match its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if headers["warc-type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError("a payload doesn't match its digest")
    number = lambda k: int(headers[k]) if k in headers else None
    raw = headers.get("page-url-base64")
    url = base64.b64decode(raw).decode() if raw is not None else headers.get("warc-target-uri")
    return number("page-id"), n, digest, headers["warc-type"], number("refers-to-page-id"), url, payload


def read(spark, out: str, manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, and with ``payloads`` the payload (empty in revisits)."""

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(out)
        for b in batches:
            for name, at, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(at)
                    data = f.read(length)
                rows = [_entry(x) for x in members(data)]
                for i in range(0, len(rows), 200):
                    c = list(zip(*rows[i : i + 200], strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 6 + payloads]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=False)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *(["payload"] if payloads else [])]
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if payloads else "")
    tasks = max(1, -(-manifest.count() // 4))  # a few slices each
    return manifest.select("file", "at", "length").repartition(tasks, "file", "at").mapInArrow(run, shape)
