"""What a finished import cycle changes: sweeps, refreshes, streaks. Pure functions of old state and batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sweep(rows: DataFrame, seen: str, started: Column, complete: Column | None = None) -> DataFrame:
    """``rows`` with deployed: seen since the cycle began (never seen is not). A partial cycle leaves the flag as it was."""
    now = F.coalesce(F.col(seen) >= started, F.lit(False))
    return rows.withColumn("deployed", now if complete is None else F.when(complete, now).otherwise(F.col("deployed")))


def retained(rows: DataFrame, seen: str, as_of: Column, days: int = 30) -> DataFrame:
    """Drop what was last seen more than ``days`` days ago; rows never seen stay."""
    return rows.where(~F.coalesce(F.col(seen) < as_of - F.make_dt_interval(F.lit(days)), F.lit(False)))


def deactivate(signals: DataFrame, scope: list[str], started: Column, observed: Column | None = None) -> DataFrame:
    """Turn off active signals in scope that the cycle did not report. A cycle that observed nothing turns off nothing."""
    stale = F.col("active") & F.col("signal_id").isin(*scope) & F.coalesce(F.col("last_seen") < started, F.lit(False))
    if observed is not None:
        stale = stale & (F.coalesce(observed, F.lit(0)) > 0)
    return signals.withColumn("active", F.col("active") & ~stale)


def gone(known: DataFrame, seen: DataFrame, *key: str) -> DataFrame:
    """What is known but was not seen, to be removed on a complete cycle."""
    return known.join(seen.select(*key).distinct(), list(key), "left_anti")


def replaced(old: DataFrame, feed: DataFrame) -> DataFrame:
    """The feed takes the place of the old rows; an empty feed changes nothing. Both in one plan, without an action."""
    some = feed.limit(1).select(F.lit(1).alias("some_"))
    kept = old.join(some, F.lit(True), "left_anti")
    return feed.unionByName(kept.select(*feed.columns))


def scope_gate(marks: DataFrame, held: DataFrame, *key: str) -> DataFrame:
    """``marks`` with reap: false where a cycle observed nothing although its scope still holds rows."""
    some = held.select(*key).distinct().withColumn("some_", F.lit(True))
    out = marks.join(some, list(key), "left")
    return out.withColumn("reap", ~((F.coalesce("observed_count", F.lit(0)) == 0) & F.coalesce("some_", F.lit(False)))).drop("some_")


def latest_marks(marks: DataFrame) -> DataFrame:
    return marks.where("state = 'reaped'").groupBy("source").agg(F.max("started_at").alias("started_at"))


def fresh(findings: DataFrame, marks: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Findings seen since their source's latest successful cycle; a known source without one keeps all, others none."""
    own = findings.where(F.col("source").isin(*known)).join(F.broadcast(latest_marks(marks)), "source", "left")
    return own.where(F.col("started_at").isNull() | (F.col("last_seen") >= F.col("started_at"))).drop("started_at")


def streaks(rows: DataFrame, key: list[str], cycle: str, hit: str) -> DataFrame:
    """``rows`` with streak: how many cycles up to this one ``hit`` holds without a break, 0 where it does not."""
    w = W.partitionBy(*key).orderBy(cycle)
    breaks = F.sum(F.when(F.col(hit), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("run_", breaks)
    return out.withColumn("streak", F.sum(F.when(F.col(hit), 1).otherwise(0)).over(W.partitionBy(*key, "run_").orderBy(cycle))).drop("run_")


def with_manual(rows: DataFrame, manual: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` as a person set it, else as found."""
    own = manual.select(key, F.col(column).alias("manual_"))
    return rows.join(own, key, "left").withColumn(column, F.coalesce("manual_", column)).drop("manual_")


def merged_images(old: DataFrame, inventory: DataFrame, scans: DataFrame) -> DataFrame:
    """digest and ref: the inventory's reference wins, else the longest among scans and what was known."""
    told = inventory.groupBy("digest").agg(F.max("ref").alias("told_"))
    long = old.select("digest", "ref").unionByName(scans.select("digest", "ref")).groupBy("digest").agg(F.max_by("ref", F.struct(F.length("ref"), "ref")).alias("long_"))
    return long.join(told, "digest", "full").select("digest", F.coalesce("told_", "long_").alias("ref"))


def inventory_reap(workloads: DataFrame, observations: DataFrame, started: Column, days: int = 30) -> DataFrame:
    """The counters of a complete inventory cycle, one row: workloads and observed (workload, image) pairs that it leaves
    in use or not, and among the latter those that go, as they were last seen ``days`` days before it began."""
    pairs = observations.groupBy("wl_id", "image_id").agg(F.max("seen_at").alias("last_at"))
    old = F.col("last_at") < started - F.make_dt_interval(F.lit(days))
    counted = sweep(pairs, "last_at", started).agg(F.count_if("deployed").alias("obs_deployed"), F.count_if(~F.col("deployed")).alias("obs_undeployed"), F.count_if(~F.col("deployed") & old).alias("obs_swept"))
    seen = observations.groupBy("wl_id").agg(F.max("seen_at").alias("last_at"))
    swept = sweep(workloads.join(seen, "wl_id", "left"), "last_at", started).agg(F.count_if("deployed").alias("deployed"), F.count_if(~F.col("deployed")).alias("undeployed"))
    return swept.crossJoin(counted)  # one row each


def scan_reap(signals: DataFrame, marks: DataFrame, held: DataFrame, scope: list[str], started: Column) -> DataFrame:
    """The counters of a scan cycle (``marks``: its row with observed_count), one row. A cycle that observed nothing although its scope holds rows clears nothing."""
    gate = scope_gate(marks, held, "source").agg(F.bool_and("reap").alias("reaped"))
    after = deactivate(signals.withColumn("before_", F.col("active")), scope, started).agg(F.count_if("before_").alias("active_before"), F.count_if(F.col("before_") & ~F.col("active")).alias("n_"))
    return after.crossJoin(gate).select("active_before", F.when(F.col("reaped"), F.col("n_")).otherwise(0).alias("signals_cleared"), "reaped")  # one row each


def outages(in_use: DataFrame, scanned: DataFrame, key: list[str], cycle: str) -> DataFrame:
    """What was in use in a cycle but not scanned, with the number of such cycles in a row. Uses and scans are told apart by a flag in one aggregate."""
    both = in_use.select(*key, cycle, F.lit(False).alias("scan_")).unionByName(scanned.select(*key, cycle, F.lit(True).alias("scan_")))
    rows = both.groupBy(*key, cycle).agg((~F.bool_or("scan_")).alias("gap_"), F.bool_or(~F.col("scan_")).alias("use_")).where("use_")
    return streaks(rows, key, cycle, "gap_").where("gap_").select(*key, cycle, F.col("streak").cast("long").alias("streak"))


def active_namespaces(namespaces: DataFrame, seen: DataFrame, cycles: DataFrame) -> DataFrame:
    """``namespaces`` with active: a complete snapshot of a cluster puts those that it does not name out of use.

    ``seen`` (cluster_id, ns_name) are namespaces with an item of their own or a workload; ``cycles`` (cluster_id,
    complete). Without a complete snapshot what was active stays so; what is seen is active.
    """
    here = seen.select("cluster_id", "ns_name").distinct().withColumn("seen_", F.lit(True))
    whole = cycles.groupBy("cluster_id").agg(F.bool_or("complete").alias("whole_"))
    out = namespaces.join(here, ["cluster_id", "ns_name"], "left").join(whole, "cluster_id", "left")
    still = F.coalesce("seen_", F.lit(False)) | (F.col("active") & ~F.coalesce("whole_", F.lit(False)))
    return out.withColumn("active", still).drop("seen_", "whole_")
