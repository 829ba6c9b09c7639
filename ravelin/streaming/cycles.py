"""Import cycles as streams: windows over signals, and a cycle barrier for landed envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cycle_counts(signals: DataFrame, cycle: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Reports per six-hour cycle and event type; as a stream, closed cycles only, as its watermark tells."""
    own = signals.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark wants an instant
    own = own.withWatermark("ts", late) if signals.isStreaming else own
    out = own.groupBy(F.window("ts", cycle).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("cycle_start"), "event_type", "n", "most")


def finished(envelopes: DataFrame) -> DataFrame:
    """Items of cycles whose finish has landed; the others wait."""
    key = ["cluster", "kind", "import_id"]
    marks = envelopes.where("phase = 'finish'").groupBy(*key).agg(F.max("observed_count").alias("observed"))
    return envelopes.where("phase = 'item'").join(marks, key)


def counters(envelopes: DataFrame) -> DataFrame:
    """Of each cycle and kind: state, items landed, items announced."""
    done = F.max(F.when(F.col("phase") == "finish", F.lit(True)))
    rows = envelopes.groupBy("cluster", "kind", "import_id").agg(F.count_if(F.col("phase") == "item").alias("items"), F.max("observed_count").alias("announced"), done.alias("done"))
    return rows.select("cluster", "kind", "import_id", F.when(F.col("done"), "draining").otherwise("open").alias("state"), "items", "announced")


def ingest(stream: DataFrame, waiting: str, out: str, rejects: str, checkpoint: str, valid):
    """Run all that has landed: each micro-batch joins what waited, releases finished cycles, keeps the rest.

    ``valid`` maps envelopes to a boolean column; items that fail it go to ``rejects``. Items that land after their cycle
    was released pass at once, with those of the batch. Batches write folders of their own number, so a batch that runs
    again overwrites itself. What waits, and the keys of released cycles (in ``waiting``-released), is in the folder of
    the batch before, so memory holds no state.
    """
    key = ["cluster", "kind", "import_id"]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, done = batch, batch.where("phase = 'finish'").select(*key)
        if number:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{waiting}/batch={number - 1}"))
            done = done.unionByName(spark.read.schema(done.schema).parquet(f"{waiting}-released/batch={number - 1}"))
        done.distinct().write.mode("overwrite").parquet(f"{waiting}-released/batch={number}")
        ready = spark.read.schema(done.schema).parquet(f"{waiting}-released/batch={number}")
        items = rows.where("phase = 'item'").join(ready, key, "left_semi").persist()
        items.where(valid(items)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        items.where(~F.coalesce(valid(items), F.lit(False))).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        items.unpersist()
        rows.where("phase = 'item'").join(ready, key, "left_anti").write.mode("overwrite").parquet(f"{waiting}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
