"""Shared helpers: the shared work folder, byte classes and Arrow plumbing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, the separators of words: space and U+0009 to U+000D.
#: ``bytes.split()`` and ``bytes.strip()`` without arguments use exactly these.
SPACE = " \t\n\x0b\x0c\r"

#: Near-duplicate operators work on this many words per shingle.
SHINGLE = 5

#: Texts are handled in Python in batches of at most this many rows, and sent there in batches of
#: at most SENT_ROWS, so that what lies in Arrow's buffers on both sides stays small.
BATCH_ROWS, SENT_ROWS = 1000, 4000
_SENT = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session names none, as in tests on one machine, a new local folder is set; on a cluster that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakeforge-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lakeforge-")  # code only; Spark copies it to the executors
    atexit.register(shutil.rmtree, folder, True)
    at = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))


class Workspace:
    """Tables that cut a plan's lineage, written below the shared folder.

    A written table outlives the executors that made it. ``drop`` frees a table that no
    later step reads, ``close`` all of them; what is left goes when the Python process ends.
    """

    #: Those not closed yet.
    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lakeforge-{label}-{uuid.uuid4().hex}"
        self.others: list[str] = []
        self.opened.append(self)
        atexit.register(self.close)

    def checkpoint(self, df: DataFrame) -> DataFrame:
        """``df.checkpoint()``, which keeps partitions and their order; its files go with this workspace, or by ``drop_checkpoints``."""
        shared_dir(self.spark)
        out = df.checkpoint()
        at = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if at.isDefined():
            self.others.append(at.get())
        return out

    def drop_checkpoints(self) -> None:
        while self.others:
            _delete(self.spark, self.others.pop())

    def write(self, df: DataFrame, name: str, by: str | None = None, free: bool = False) -> DataFrame:
        """The table, written and read again; ``by`` makes a folder for each value of that column.

        ``free``: the files of its shuffles go as soon as it is written, not when the driver happens to collect its garbage.
        """
        at = f"{self.path}/{name}"
        out = df.write.mode("overwrite").option("compression", "zstd")
        before = self.spark.conf.get(_FREED)
        self.spark.conf.set(_FREED, "true" if free else before)
        try:
            (out.partitionBy(by) if by else out).parquet(at)
        finally:
            self.spark.conf.set(_FREED, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        try:
            if self in self.opened:
                self.opened.remove(self)
                if self.spark.sparkContext._jsc is not None:
                    self.drop_checkpoints()
                    _delete(self.spark, self.path)
        except Exception:  # the session has ended, and with it the right to its files
            pass


def range_count(total: int, least: int, most: int, want: int = 4096) -> int:
    """Ranges for that many rows or bytes: ``want`` of them, each of ``least`` at least and ``most`` at most; the session's settings play no part."""
    each = min(most, max(least, -(-total // want)))
    return max(2, -(-total // each))


def text_bytes(name: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


#: What a Python worker keeps between tasks, by owner and name.
_KEPT: dict[tuple[str, str], object] = {}


def keep(owner: str, name: str, make: Callable[[], object]):
    """``make``'s result, kept in this worker for the owner's later tasks; an owner keeps one thing at a time."""
    if (owner, name) not in _KEPT:
        _KEPT.clear()
        _KEPT[owner, name] = make()
    return _KEPT[owner, name]


def release_others(owner: str) -> None:
    """Let go of what other owners' tasks kept in this worker."""
    for key in [k for k in _KEPT if k[0] != owner]:
        del _KEPT[key]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = BATCH_ROWS, owner: str = "") -> DataFrame:
    """mapInArrow whose function sees batches of at most ``rows`` rows; workers keep only what ``owner`` keeps."""

    spark = df.sparkSession
    ship(spark)
    if not 0 < int(spark.conf.get(_SENT, "10000")) <= SENT_ROWS:
        spark.conf.set(_SENT, SENT_ROWS)

    def sliced(batches):
        release_others(owner)
        for b in batches:
            for at in range(0, max(b.num_rows, 1), rows):
                yield b.slice(at, rows)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(lambda batches: f(sliced(batches)), schema)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and the offsets of its values in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a string column in the order of the texts.

    Returns each word's place in the list of the batch's distinct words, the texts' offsets in
    the words, and that list. Work that depends on the word alone is then done once a word and batch.
    """
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()))
    flat = lists.flatten().dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    place = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    blank = pc.index(flat.dictionary, "").as_py()  # white space at a text's ends, or an empty text
    if blank >= 0:
        full = place != blank
        counts = np.concatenate(([0], np.cumsum(full)))
        place, ends = place[full], counts[ends]
    return place, ends, flat.dictionary


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each [offsets[i], offsets[i+1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_set(chars: str) -> np.ndarray:
    """A table of 256 flags, set for the given ASCII characters."""
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80


def text_string(name: str = "text") -> Column:
    """The whole text; null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("string")


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
