"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    On a single machine without that setting it is a temporary one; a cluster without it is an error, since no
    folder of one host can be read by the others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"{master} needs a shared folder in spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="ravelin-checkpoints-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate data that nothing reads any more, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def light_batches(spark: SparkSession, most: str = "8m") -> None:
    """Have Arrow batches end at ``most`` bytes, unless the session states a size of its own.

    By default a batch holds up to 64 MB of texts, which both the executor and its Python worker keep, per task. A
    longer text is a batch of its own; how rows are cut into batches changes no row that an operator returns for them, but for the order in which models see rows.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, which ends its lineage and survives lost executors."""
    shared = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names an operator is about to write."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


def extended(df: DataFrame, **fields: T.DataType) -> T.StructType:
    """The schema of ``df`` with further nullable fields at its end."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in fields.items())])


def slices(batch: pa.RecordBatch, at: int, most: int = 1 << 19, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``most`` bytes of text in column ``at``, and ``rows`` rows; a longer text is alone."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    lo = 0
    while lo < batch.num_rows:
        hi = min(max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + most, side="right")) - 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, text: str = "text") -> DataFrame:
    """The documents of at most ``max_rows`` ids that ``labels`` covers, chosen by a hash of the id, with a 0/1 column ``target_``.

    Labels with a null id or value are left out; several labels of one id count as their mean, and a mean of
    exactly one half as no label. The chosen ids are bounded by ``max_rows``, hence the broadcast; their rows are not,
    where ids repeat: ``bounded`` ends that once their features are known. ``row_`` is a hash of id and text.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("t"))
        .where("doc_id IS NOT NULL AND t IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("t").alias("t"))
        .where("t <> 0.5")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .select("doc_id", (F.col("t") > 0.5).cast("double").alias("target_"))
    )
    return without(docs, "target_", "row_").join(F.broadcast(chosen), "doc_id").withColumn("row_", F.xxhash64("doc_id", text))


def bounded(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows, those with the least ``row_``, of which each counts once."""
    return rows.dropDuplicates(["row_"]).orderBy("row_").limit(max_rows)
