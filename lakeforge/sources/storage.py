"""Versioned Parquet folders and small text files, through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables below ``root``: each write makes a new folder, and readers keep the one they began with."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.stats: dict[str, dict] = {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Written under a temporary name, then put in place by a rename that replaces, so readers see the old text or the new one."""
        temporary = f"{path}.{uuid.uuid4().hex}"
        fs, p = self._fs(temporary)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(p, self._fs(path)[1], how)

    def folders(self, path: str) -> list[str]:
        """The names of the folders in a folder."""
        fs, p = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []

    def join(self, parts: list[str], head: str, to: str) -> None:
        """One file of a line and the parts, one after another; bytes pass the driver without being held."""
        temporary = f"{to}.{uuid.uuid4().hex}"
        fs, p = self._fs(temporary)
        out = fs.create(p, True)
        out.write(bytearray(head.encode()))
        for part in parts:
            other, q = self._fs(part)
            stream = other.open(q)
            self.spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
        out.close()
        fs.rename(p, self._fs(to)[1])

    def write_table(self, df: DataFrame, name: str, order: list[str] | None = None) -> str:
        """A new folder of rows of the table; they are sorted within files so that row groups can be skipped.

        Counts, minima and maxima are taken as the rows pass, and kept in ``stats``.
        """
        at = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        seen = Observation()
        columns = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
        marks = [x for k, c in enumerate(columns) for x in (F.count(c).alias(f"n{k}"), F.min(c).cast("string").alias(f"a{k}"), F.max(c).cast("string").alias(f"b{k}"))]
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *marks)
        if order:
            df = df.sortWithinPartitions(*order)
        df.write.option("compression", "zstd").parquet(at)
        found = seen.get
        self.stats[at] = {"rows": found["rows"], "columns": {c: [found[f"n{k}"], found[f"a{k}"], found[f"b{k}"]] for k, c in enumerate(df.columns)}}
        return at

    def files(self, path: str) -> list[tuple[str, int]]:
        fs, p = self._fs(path)
        found, it = [], fs.listFiles(p, True)
        while it.hasNext():
            f = it.next()
            found.append((f.getPath().toString(), f.getLen()))
        return sorted(found)

    def copy(self, source: str, to: str) -> None:
        fs, p = self._fs(source)
        other, q = self._fs(to)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, self.spark._jsc.hadoopConfiguration())

    def checksum(self, path: str) -> str:
        """SHA-256 over the folder's data files, computed on the executors a file at a time."""
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).selectExpr("sha2(content, 256) as h").collect()
        return hashlib.sha256("".join(sorted(r.h for r in rows)).encode()).hexdigest()


def dump(value) -> str:
    return json.dumps(value, indent=1, sort_keys=True)
