"""Stored tables: a commit over several of them shows whole or not at all, and rewrites only the buckets it touches.

A table is Parquet in folders by bucket, a hash of its key. A commit writes new folders beside the old ones; a head, a
small numbered file, then names the folder of every bucket of every table. It is created last, and only if no other
commit has taken its number, so a reader of the newest head sees all of a commit or none, and of two writers one fails.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another commit was published since this one began."""


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, none if it isn't there; names that start with a dot or underscore are left out."""
    at, fs = _at(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(n for s in fs.listStatus(at) if (n := s.getPath().getName())[0] not in "._")


def content(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with ``text``, whole; False if it is there. Of several that try at once one succeeds."""
    at, fs = _at(spark, path)
    fs.mkdirs(at.getParent())
    part = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    if fs.getScheme() == "file":  # a link is made or not, whereas a local rename replaces what is there
        own, end = (x.toUri().getPath() for x in (part, at))
        with open(own, "w") as f:
            f.write(text)
        try:
            os.link(own, end)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    stream = fs.create(part)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs_ = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(fs_, "Options$Rename"), 0)
    try:
        fs_.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, none)
    except CapturedException:
        fs.delete(part, False)
        if fs.exists(at):
            return False
        raise
    return True


class Versions:
    """The tables under ``root``, each in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root, buckets

    def head(self) -> tuple[int, dict]:
        """The number of the newest commit, 0 before the first, and where its tables lie."""
        heads = names(self.spark, f"{self.root}/heads")
        return (int(heads[-1]), json.loads(content(self.spark, f"{self.root}/heads/{heads[-1]}"))) if heads else (0, {})

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of the newest commit, or of the ``number``-th."""
        tables = self.head()[1] if number is None else json.loads(content(self.spark, f"{self.root}/heads/{number:010d}"))
        return self._read(tables[name])

    def _read(self, table: dict, only: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{self.root}/{at}" for bucket, at in table["buckets"].items() if only is None or bucket in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Commit:
        return Commit(self)


class Commit:
    """Writes of one commit. Nothing shows before ``publish``; what it leaves undone is never read."""

    def __init__(self, versions: Versions):
        self.versions, self.spark = versions, versions.spark
        self.number, self.tables = versions.head()
        self.name = uuid.uuid4().hex
        self.touched: dict[str, list[str]] = {}
        self.written = 0

    def read(self, name: str) -> DataFrame:
        """A table as this commit has it so far."""
        return self.versions._read(self.tables[name])

    def _bucket(self, key: tuple[str, ...]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.versions.buckets))

    def _written(self, name: str, rows: DataFrame, key: tuple[str, ...]) -> dict[str, str]:
        """Write ``rows`` by bucket; the folder of each bucket that has any.

        Each task writes a file for each of its buckets: the rows are not shuffled once more to have fewer, larger ones.
        """
        self.written += 1
        folder = f"{name}/{self.name}-{self.written}"
        rows.withColumn("bucket_", self._bucket(key)).write.partitionBy("bucket_").parquet(f"{self.versions.root}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in names(self.spark, f"{self.versions.root}/{folder}")}

    def replace(self, name: str, rows: DataFrame, key: tuple[str, ...]) -> None:
        """Put ``rows`` for the whole table."""
        written = self._written(name, rows, key)
        self.tables = self.tables | {name: {"key": list(key), "schema": json.loads(rows.schema.json()), "buckets": written}}
        self.touched[name] = sorted(written)

    def merge(self, name: str, batch: DataFrame, key: tuple[str, ...], combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Rewrite the buckets that ``batch`` has keys of with ``combine(stored, batch)``; a new table is ``combine(no rows, batch)``.

        The batch is written by bucket first, so its lineage ends there and its buckets are known without counting.
        ``combine`` keeps the columns of the batch, and each row's key.
        """
        staged = self._written(name, batch, key)
        table = self.tables.get(name) or {"key": list(key), "schema": json.loads(batch.schema.json()), "buckets": {}}
        own = {"schema": json.loads(batch.schema.json()), "buckets": staged}
        rows = combine(self.versions._read(table, list(staged)), self.versions._read(own))
        written = self._written(name, rows, key)
        kept = {b: at for b, at in table["buckets"].items() if b not in staged}
        self.tables = self.tables | {name: table | {"buckets": kept | written}}
        self.touched[name] = sorted(staged)

    def revise(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the buckets in which ``change`` alters a row, row by row; the others keep their folders.

        ``change`` gives all rows that it is given, with the table's columns, keys as they were, and ``moved_``: whether
        the row is altered. It looks at one row at a time, so no rows are shuffled and no batch is written first: one
        pass tells the buckets, another writes them.
        """
        table = self.tables[name]
        key = tuple(table["key"])
        moved = change(self.read(name)).where("moved_").select(self._bucket(key).cast("string").alias("bucket_")).distinct()
        touched = sorted(r.bucket_ for r in moved.collect())  # no more than there are buckets
        if touched:
            written = self._written(name, change(self.versions._read(table, touched)).drop("moved_"), key)
            self.tables = self.tables | {name: table | {"buckets": {b: at for b, at in table["buckets"].items() if b not in touched} | written}}
        self.touched[name] = touched

    def publish(self) -> int:
        """Show the commit; raises ``Conflict`` if another one took its place."""
        if not claim(self.spark, f"{self.versions.root}/heads/{self.number + 1:010d}", json.dumps(self.tables)):
            raise Conflict(f"commit {self.number + 1} is taken")
        return self.number + 1
