"""Line deduplication: keys that many documents share stay in one document only.

A line's key is the line stripped of ASCII white space, with A-Z in lower case. Keys of at
least MIN_CHARS code points that occur in at least MIN_DOCS documents lose all their lines but
those of the largest doc_id that holds them.

1. ``line_hashes``: each document becomes rows (hash, doc_id, version, position), no text.
2. The rows are range-partitioned and sorted by hash, then document (largest first), then
   position. The range key holds the document and position too, so a line found in a third of
   the corpus spreads over many tasks.
3. Each sorted run is streamed once to note how its first and last key enter and leave it
   (two rows a run), then once more to give the positions to drop. The state is one key.
4. Positions are gathered per document into a compressed bitmap of the lines that stay.

Null or empty text is one empty line. Rows with equal doc_id and text are one document and get
the same bitmap; rows with equal doc_id and unequal text count as one document when documents
are counted. A null doc_id is one document, smaller than all others. Ids are integers. Other columns are carried in a
struct and may have any name.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Workspace, map_arrow, range_count, text_bytes

MIN_CHARS = 20
MIN_DOCS = 3
#: Rows of a sorted run, at least and at most.
RUN_ROWS = 100_000, 10_000_000
_TRAILS = bytes(range(0x80, 0xC0))
_HASHES = "h1 long, h2 long, doc_id long, version long, pos int"
_SIGNED = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGNED else x


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, version, pos) of every line whose key is long enough; h1 and h2 are 128 bits of the key's hash."""

    def run(batches):
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, version, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip().lower()
                    if len(key) >= min_chars and len(key.translate(None, _TRAILS)) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(key)
                        for column, x in zip(rows, (_signed(h >> 64), _signed(h & (1 << 64) - 1), doc_id, version, pos), strict=True):
                            column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["h1", "h2", "doc_id", "version", "pos"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), text_bytes()), run, _HASHES)


class _Run:
    """Streams one sorted run; numbers the documents of each key from the largest doc_id on."""

    def __init__(self, key=None, doc=None, count: int = 0):
        self.key, self.doc, self.count = key, doc, count

    def number(self, h1, h2, doc, null):
        """For each row: whether it begins a key, and its document's number within the key."""
        n = len(h1)
        first = np.ones(n, bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh = first.copy()
        fresh[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
        key0, doc0 = (int(h1[0]), int(h2[0])), (int(doc[0]), bool(null[0]))
        begin = 0
        if key0 == self.key:
            first[0], begin = False, self.count
            fresh[0] = doc0 != self.doc
        total = np.cumsum(fresh) + begin
        start = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        number = total - np.where(start >= 0, total[np.maximum(start, 0)] - 1, 0)
        self.key, self.doc, self.count = (int(h1[-1]), int(h2[-1])), (int(doc[-1]), bool(null[-1])), int(number[-1])
        return first, number


def _arrays(b: pa.RecordBatch):
    h1, h2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    doc = b.column(2)
    null = doc.is_null().to_numpy(zero_copy_only=False)
    return h1, h2, doc.fill_null(0).to_numpy(zero_copy_only=False), null


_EDGES = "run int, head1 long, head2 long, head_doc long, head_null boolean, head_count long, whole boolean, tail1 long, tail2 long, tail_doc long, tail_null boolean, tail_count long"


def _edges(batches):
    """One row: the run's first key with its number of documents, and its last."""
    state, head, head_count, whole = _Run(), None, 0, True
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, null = _arrays(b)
        if head is None:
            head = (int(h1[0]), int(h2[0]), int(doc[0]), bool(null[0]))
        _, number = state.number(h1, h2, doc, null)
        if whole:
            same = (h1 == head[0]) & (h2 == head[1])
            head_count = max(head_count, int(number[same].max()) if same.any() else 0)
            whole = bool(same.all())
    if head is not None:
        row = [TaskContext.get().partitionId(), *head, head_count, whole, *state.key, *state.doc, state.count]
        yield pa.RecordBatch.from_pylist([dict(zip((x.split()[0] for x in _EDGES.split(", ")), row, strict=True))], schema=_edge_schema())


def _edge_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _EDGES.split(", "))])


def _carry(edges: list) -> dict[int, tuple]:
    """run -> (key, document and count that enter it; documents of that key after it and of its last key after it)."""
    edges = sorted(edges, key=lambda e: e.run)
    enter: list[tuple] = []
    key, doc, count = None, None, 0
    for e in edges:
        enter.append((key, doc, count))
        head, first = (e.head1, e.head2), (e.head_doc, e.head_null)
        if e.whole:
            more = e.head_count - (key == head and doc == first)
            count = count + more if key == head else e.head_count
        else:
            count = e.tail_count
        key, doc = (e.tail1, e.tail2), (e.tail_doc, e.tail_null)
    found: dict[int, tuple] = {}
    after_key, after = None, 0  # documents of the first key of what follows, in all runs that follow
    for i in range(len(edges) - 1, -1, -1):
        e = edges[i]
        tail = (e.tail1, e.tail2)
        follows = after if after_key == tail else 0
        if follows and (edges[i + 1].head_doc, edges[i + 1].head_null) == (e.tail_doc, e.tail_null):
            follows -= 1  # the document that both runs hold
        found[e.run] = (*enter[i], follows)
        after_key, after = (e.head1, e.head2), e.head_count + (follows if e.whole else 0)
    return found


_DROPS = "doc_id long, version long, pos int"


def _drops(carry: dict[int, tuple], min_docs: int):
    def run(batches):
        key, doc, count, follows = carry.get(TaskContext.get().partitionId(), (None, None, 0, 0))
        state = _Run(key, doc, count)
        held: list[pa.RecordBatch] = []  # rows of the open key's second to last documents while they are too few to tell

        def out(parts):
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, doc, null = _arrays(b)
            was = state.key
            first, number = state.number(h1, h2, doc, null)
            starts = np.flatnonzero(first)
            bounds = np.concatenate(([0], starts, [len(h1)])) if not len(starts) or starts[0] else np.concatenate((starts, [len(h1)]))
            last = np.repeat(number[bounds[1:] - 1], np.diff(bounds))
            opened = np.arange(len(h1)) >= bounds[-2]
            rows = b.select([2, 3, 4])
            if held:
                continues = (int(h1[0]), int(h2[0])) == was
                if continues and last[0] >= min_docs:
                    yield from out(held)
                    held = []
                elif not (continues and bounds[-2] == 0):  # the key ended with too few documents
                    held = []
            sure = (number > 1) & (last >= min_docs)
            yield rows.filter(pa.array(sure))
            wait = opened & (number > 1) & (last < min_docs)
            if wait.any():
                held.append(rows.filter(pa.array(wait)))
        if held and state.count + follows >= min_docs:
            yield from out(held)

    return run


def dropped_lines(docs: DataFrame, ws: Workspace, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, runs: int | None = None) -> DataFrame:
    """(doc_id, version, pos) of every line that goes; ``runs`` is the number of sorted runs."""
    hashes = ws.write(line_hashes(docs, min_chars), "hashes")
    runs = runs or range_count(hashes.count(), *RUN_ROWS)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("version"), F.col("pos")]
    # A checkpoint keeps the partitions and their order, so both passes see the same sorted runs.
    runs_at = ws.checkpoint(hashes.repartitionByRange(runs, *order).sortWithinPartitions(*order))
    ws.drop("hashes")
    edges = runs_at.mapInArrow(_edges, _EDGES).collect()  # one row a run
    return runs_at.mapInArrow(_drops(_carry(edges), min_docs), _DROPS)


def keep_bitmaps(docs: DataFrame, ws: Workspace, **rules) -> DataFrame:
    """(doc_id, version, bitmap) of each document that loses lines.

    Bit i of the zlib-compressed bitmap is set if line i stays; lines past its end stay too.
    """
    gone = dropped_lines(docs, ws, **rules).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone"))

    def run(batches):
        for b in batches:
            maps = []
            for gone in b.column(2).to_pylist():
                keep = np.ones(gone[-1] // 8 * 8 + 8, bool)
                keep[gone] = False
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], ["doc_id", "version", "bitmap"])

    return gone.mapInArrow(run, "doc_id long, version long, bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, list[bytes]]:
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return len(lines), [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]


def _with_bitmaps(docs: DataFrame, ws: Workspace, others: list[str], rules: dict) -> DataFrame:
    """(id, body, bitmap, row) of each document, row with the columns of ``others``."""
    maps = ws.write(keep_bitmaps(docs, ws, **rules), "bitmaps")
    ws.drop_checkpoints()
    row = F.struct(*(docs[c] for c in others)) if others else F.lit(None).cast("int")
    rows = docs.select(F.col("doc_id").alias("id"), text_bytes().alias("body"), F.xxhash64("text").alias("own"), row.alias("row"))
    met = F.col("id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("version"))
    # Both sides grow with the corpus, so neither is ever broadcast.
    return rows.join(maps.hint("merge"), met, "left").select("id", "body", "bitmap", "row")


def digest(docs: DataFrame, ws: Workspace, **rules) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and the SHA-256 of the lines that stay, joined by newlines."""

    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for text, bitmap in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                total, stay = kept_lines(text, bitmap)
                n.append(total)
                gone.append(total - len(stay))
                sha.append(hashlib.sha256(b"\n".join(stay)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = _with_bitmaps(docs, ws, [], rules)
    return map_arrow(joined, run, f"doc_id {joined.schema['id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def dedup(docs: DataFrame, ws: Workspace, **rules) -> DataFrame:
    """The documents with only the lines that stay, n_chars to match, in the columns of ``docs``."""
    joined = _with_bitmaps(docs, ws, [c for c in docs.columns if c != "text"], rules)
    shape = StructType([joined.schema["row"], StructField("text", BinaryType())])

    def run(batches):
        for b in batches:
            stay = [b"\n".join(kept_lines(t, m)[1]) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(stay, pa.binary())], ["row", "text"])

    done = map_arrow(joined, run, shape)
    text = F.col("text").cast("string")
    made = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return done.select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns))
