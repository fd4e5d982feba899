"""Files below a folder: listings as DataFrames, small text files, deletes of whole folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few file-system calls the engine makes from the driver (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names directly below a folder, without hidden ones."""
        if not self.exists(path):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
        return sorted(n for n in found if not n.startswith(("_", ".")))

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Create a small file; False when the name is taken. The text is written under a hidden name first and
        then renamed, which fails if the name exists: a crash in between leaves no file by that name, and a
        reader never sees half of one."""
        target = self._path(path)
        if self._fs.exists(target):
            return False
        hidden = self._path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex[:12]}")
        stream = self._fs.create(hidden, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            self._rename(hidden, target)
        except Exception:
            self._fs.delete(hidden, False)
            if self._fs.exists(target):
                return False
            raise
        return True

    def _rename(self, source, target) -> None:
        """A rename that never replaces a file."""
        self._context.rename(source, target, self._no_options)

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def usage(self, path: str) -> tuple[int, int]:
        """(data files, bytes) below a folder."""
        if not self.exists(path):
            return 0, 0
        count = size = 0
        walk = self._fs.listFiles(self._path(path), True)
        while walk.hasNext():
            status = walk.next()
            if not status.getPath().getName().startswith(("_", ".")):
                count += 1
                size += status.getLen()
        return count, size


def listing(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Every file below some folders: file_path, last_modified, bytes (contents are not read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(F.col("path").alias("file_path"),
                    F.col("modificationTime").alias("last_modified"),
                    F.col("length").alias("bytes")))


def footprint(files: DataFrame, root: str, metadata_folder: str = "commits") -> DataFrame:
    """Objects and bytes per table, split into data and metadata by the path below the root."""
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.split(F.substring_index(F.col("file_path"), base + "/", -1), "/")
    inner = F.slice(relative, 2, F.greatest(F.size(relative) - 2, F.lit(0)))
    kind = F.when(F.array_contains(inner, metadata_folder), "metadata").otherwise("data")
    return (files.where(F.size(relative) >= 2)
            .groupBy(relative[0].alias("table_name"), kind.alias("kind"))
            .agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes")))


def file_metadata(df: DataFrame) -> DataFrame:
    """Rows per data file of a file-backed frame, from the scan's own metadata column."""
    return (df.select(F.col("_metadata.file_path").alias("file_path"),
                      F.col("_metadata.file_size").alias("file_size_in_bytes"))
            .groupBy("file_path", "file_size_in_bytes")
            .agg(F.count(F.lit(1)).alias("record_count")))
