"""Closed windows once, and late rows kept: two branches over one landing folder.

A run takes all that has landed since the one before. By then the watermark stands ``late`` before the newest row of all
earlier runs: windows that end by it are closed and have been written; rows of theirs that land now are late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ravelin.sources.versions import names
from ravelin.streaming.cycles import cycle_counts


def closed_windows(rows: DataFrame, out: str, checkpoint: str, cycle: str = "6 hours", late: str = "1 day") -> StreamingQuery:
    """Append the windows that have closed (see ``cycle_counts``); each leaves once, and its state goes."""
    return cycle_counts(rows, cycle, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(rows: DataFrame, out: str, checkpoint: str, cycle: str = "6 hours", late: str = "1 day") -> StreamingQuery:
    """Write the rows that ``closed_windows`` leaves out as late; ``newest`` of each run is kept beside them.

    A run writes folders of its own number, so one that runs again overwrites itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [f"{out}-newest/{n}" for n in names(spark, f"{out}-newest") if int(n.split("=")[1]) < number]
        batch = batch.withColumn("ts_", F.col("ts").cast("timestamp")).persist()
        batch.agg(F.max("ts_").alias("newest")).write.mode("overwrite").parquet(f"{out}-newest/batch={number}")
        end = F.window("ts_", cycle)["end"]
        newest = spark.read.parquet(*before).agg(F.max("newest").alias("newest_")) if before else spark.range(1).select(F.lit(None).cast("timestamp").alias("newest_"))
        gone = batch.withColumn("end_", end).crossJoin(newest).where(F.col("end_") <= F.col("newest_") - F.expr(f"INTERVAL {late}"))  # one row
        gone.drop("ts_", "end_", "newest_").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing(spark: SparkSession, schema, path: str) -> DataFrame:
    """Rows of Parquet files in a folder, as they land."""
    return spark.readStream.schema(schema).parquet(path)
