"""The barrier of an import cycle as a stateful stream: items wait until their cycle is finished.

State is kept by cluster, kind and import, in Spark's state store: when the cycle was last opened and last finished, and
the items that wait. A timer in event time ends a cycle of which nothing has come for long, so state does not grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("cluster", "kind", "import_id")
#: Of an item: released or expired. Of a cycle: open, draining or expired, with what it announced.
OUT = "cluster string, kind string, import_id string, what string, outcome string, payload string, created_at timestamp, observed_count long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(starts: int | None, finish: int | None) -> bool:
    """Whether a cycle that was last opened and last finished at these times is finished: a finish needs a start before it, and a later start opens anew."""
    return starts is not None and finish is not None and starts <= finish


class Barrier(StatefulProcessor):
    """Opens, finishes and ends cycles. Times are microseconds; a cycle ends ``idle`` of them after its last event.

    Whatever order its events come in, a cycle ends up as its latest start and finish say. Repeated starts and finishes
    change nothing, unless later ones: a later start opens the cycle anew, and items wait again. Items that have passed
    stay passed. An expired cycle gives back what waited; what comes for it after that starts from nothing.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "start long, finish long, observed long, last long")
        self.waiting = handle.getListState("waiting", "payload string, at long")

    def _rows(self, key: tuple, what: str, outcome: str, items: list[tuple], observed: int | None) -> pd.DataFrame:
        rows = [(*key, what, outcome, payload, pd.Timestamp(at, unit="us"), observed) for payload, at in items]
        frame = pd.DataFrame(rows, columns=[*KEY, "what", "outcome", "payload", "created_at", "observed_count"])
        return frame.astype({"observed_count": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, finish, observed, last = self.mark.get() if self.mark.exists() else (None, None, None, None)
        before = settled(start, finish), observed, start
        fresh = []
        for frame in rows:
            for phase, payload, at, count in zip(frame["phase"], frame["payload"], frame["at"], frame["observed_count"], strict=True):
                last = at if last is None else max(last, at)
                if phase == "start":
                    start = at if start is None else max(start, at)
                elif phase == "finish":
                    count = None if pd.isna(count) else int(count)
                    if finish is None or (at, -1 if count is None else count) > (finish, -1 if observed is None else observed):
                        finish, observed = at, count
                elif phase == "item":
                    fresh.append((payload, at))
        if last is None:
            return
        self.mark.update((start, finish, observed, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle) // 1000)
        done = settled(start, finish)
        if start is not None and before != (done, observed, start):
            yield self._rows(key, "cycle", "draining" if done else "open", [(None, finish if done else start)], observed if done else None)
        if not done:
            if fresh:
                self.waiting.appendList(fresh)
            return
        if self.waiting.exists():
            fresh = [tuple(x) for x in self.waiting.get()] + fresh
            self.waiting.clear()
        if fresh:
            yield self._rows(key, "item", "released", fresh, observed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, finish, observed, last = self.mark.get()
        if (last + self.idle) // 1000 > timerValues.getCurrentWatermarkInMs():
            return
        if not settled(start, finish):
            yield self._rows(key, "cycle", "expired", [(None, last)], None)
            if self.waiting.exists():
                yield self._rows(key, "item", "expired", [tuple(x) for x in self.waiting.get()], None)
        self.waiting.clear()
        self.mark.clear()

    def close(self) -> None:
        pass


def barrier(envelopes: DataFrame, late: str = "1 day", idle_days: int = 7) -> DataFrame:
    """A stream of envelopes (cluster, kind, import_id, phase, payload, created_at, observed_count) to OUT.

    A cycle's items come out when it has started and finished, in whatever order these and they come; ``idle_days``
    after its last event by the watermark, which lags by ``late``, an unfinished one comes out as expired and the state
    of any goes. Envelopes without a key or time are no part of a cycle and are left out: ``valid`` tells of them.
    """
    session(envelopes.sparkSession)
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*KEY, "created_at"))
    rows = envelopes.where(known).withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    rows = rows.select(*KEY, "phase", "payload", "created_at", F.unix_micros("created_at").alias("at"), F.col("observed_count").cast("long"))
    return rows.groupBy(*KEY).transformWithStateInPandas(Barrier(idle_days * 86_400_000_000), OUT, "Append", "EventTime")


def session(spark: SparkSession) -> None:
    """State of this kind needs the provider that keeps it on disk; a session that names another keeps its own, and Spark refuses."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(name, PROVIDER)


def ingest(envelopes: DataFrame, out: str, rejects: str, checkpoint: str, valid: Callable[[DataFrame], Column], **how):
    """Run all that has landed through the barrier: released items that are ``valid`` to ``out``, others to ``rejects``.

    Rejects carry why: ``invalid``, or ``expired`` where their cycle never finished. A batch writes folders of its own
    number, so one that runs again overwrites itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.where("what = 'item'").persist()
        good = (F.col("outcome") == "released") & F.coalesce(valid(rows), F.lit(False))
        rows.where(good).drop("what", "outcome").write.mode("overwrite").parquet(f"{out}/batch={number}")
        why = F.when(F.col("outcome") == "released", "invalid").otherwise(F.col("outcome"))
        rows.where(~good).select(*KEY, "payload", "created_at", why.alias("reason")).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        rows.unpersist()

    return barrier(envelopes, **how).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
