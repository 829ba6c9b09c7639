"""What an import cycle does to stored tables: upserts, the reap of its inventory, and the rescoring of what moved.

Functions of stored rows and a batch give the new rows; ``run`` applies them to tables in buckets and publishes one
commit. A cycle rewrites the buckets of the findings that it saw or that moved, and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ravelin.operators.findings import KEY, enrich, score
from ravelin.operators.lifecycle import deactivate
from ravelin.sources.versions import Versions

#: What a finding's band depends on beside itself, by workload.
CONTEXT = ("is_exposed", "escalation", "env", "sensitive")
KEEP = ("severity", "fixed_version", "order_id", "line")
PAIR = ("wl_id", "image_id")


@dataclass
class Cycle:
    """One import: its marks by cluster (cluster_id, complete), and what it saw."""

    number: int
    started: Column
    scan_started: Column
    marks: DataFrame
    items: DataFrame  # wl_id, image_id, seen_at: containers of the inventory
    findings: DataFrame  # folded
    signals: DataFrame  # wl_id, signal_id, seen_at
    exposed: DataFrame  # wl_id, exposed


def latest(stored: DataFrame, batch: DataFrame, key: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """The upsert: ``keep`` of the batch wins, first_seen and last_seen widen. Both have a row a key at most."""
    columns = [*key, *keep, "first_seen", "last_seen"]
    both = stored.select(*columns, F.lit(0).alias("new_")).unionByName(batch.select(*columns, F.lit(1).alias("new_")))
    out = both.groupBy(*key).agg(F.max_by(F.struct(*keep), "new_").alias("r_"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.select(*key, *[F.col(f"r_.{c}").alias(c) for c in keep], "first_seen", "last_seen")


def merged_findings(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Findings after a batch of scored ones: its attributes and band win."""
    return latest(stored, batch, KEY, (*KEEP, "rule", "band"))


def merged_signals(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Signals after a batch of reports: what is reported is active, whatever it was, and others stay as they were."""
    both = stored.select("*", F.lit(False).alias("new_")).unionByName(batch.select("*", F.lit(True).alias("new_")))
    return both.groupBy("wl_id", "signal_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.bool_or(F.col("new_") | F.col("active")).alias("active"))


def merged_pairs(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Containers seen: a pair's times widen; ``deployed`` of a new pair is what the batch says."""
    return latest(stored, batch, PAIR, ("deployed",))


def merged_images(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Images after a batch with ``told`` (true: from the inventory): digest, ref, os_family, os_version, base_eosl.

    The inventory's reference wins, the greatest where it has several; else the longest of those scanned and stored,
    and of equally long ones the stored one, then the greatest. Operating-system data comes whole from the scan that
    names a family, the greatest of several, and stays otherwise. Rows without a digest name no image.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    system = F.when(empty("os_family") != "", F.struct("os_family", empty("os_version").alias("os_version"), F.coalesce("base_eosl", F.lit(False)).alias("base_eosl")))
    both = stored.select("*", F.lit(False).alias("told"), F.lit(0).alias("new_")).unionByName(batch.select("*", F.lit(1).alias("new_")))
    both = both.where(empty("digest") != "").select("digest", empty("ref").alias("ref"), "told", "new_", system.alias("s_"))
    out = both.groupBy("digest").agg(
        F.max(F.when(F.col("told") & (F.col("ref") != ""), F.col("ref"))).alias("told_"),
        F.max(F.struct(F.length("ref").alias("n"), (1 - F.col("new_")).alias("old"), F.col("ref").alias("ref"))).alias("long_"),
        F.max(F.when(F.col("s_").isNotNull(), F.struct("new_", "s_"))).alias("s_"),
    )
    own = [F.col(f"s_.s_.{c}") for c in ("os_family", "os_version", "base_eosl")]
    return out.select("digest", F.coalesce("told_", "long_.ref").alias("ref"), empty(own[0]).alias("os_family"), empty(own[1]).alias("os_version"), F.coalesce(own[2], F.lit(False)).alias("base_eosl"))


def reaped_clusters(clusters: DataFrame, marks: DataFrame, started: Column) -> DataFrame:
    """A complete cycle sets last_complete and ends the count of incomplete ones in a row; three of these are an alarm."""
    out = clusters.join(marks.select("cluster_id", F.col("complete").alias("whole_")), "cluster_id", "left")
    whole, torn = F.coalesce(F.col("whole_"), F.lit(False)), F.coalesce(~F.col("whole_"), F.lit(False))
    count = F.when(whole, 0).when(torn, F.col("incomplete") + 1).otherwise(F.col("incomplete"))
    out = out.withColumns({"last_complete": F.when(whole, started).otherwise(F.col("last_complete")), "incomplete": count.cast("int")})
    return out.withColumn("alarm", F.col("incomplete") >= 3).drop("whole_")


def reaped(rows: DataFrame, clusters: DataFrame, started: Column, days: int | None = None) -> DataFrame:
    """``rows`` (deployed, last_seen, cluster_id) after the reap of the clusters whose cycle was complete.

    Those seen since it began are deployed, the others are not; with ``days``, what is not and was last seen so long
    before the cycle goes. Rows of other clusters stay as they were.
    """
    whole = clusters.where(F.col("last_complete") == started).select("cluster_id").withColumn("whole_", F.lit(True))
    out = rows.join(whole, "cluster_id", "left")
    now = F.coalesce(F.col("last_seen") >= started, F.lit(False))
    if days is not None:
        old = F.coalesce(F.col("last_seen") < started - F.make_dt_interval(F.lit(days)), F.lit(False))
        out = out.where(~(F.coalesce("whole_", F.lit(False)) & ~now & old))
    return out.withColumn("deployed", F.when(F.col("whole_"), now).otherwise(F.col("deployed"))).drop("whole_")


def context(workloads: DataFrame, namespaces: DataFrame, clusters: DataFrame, signals: DataFrame, escalating: tuple[str, ...]) -> DataFrame:
    """wl_id and CONTEXT: a workload is exposed itself or by a deployed one of its namespace."""
    shown = workloads.groupBy("ns_id").agg(F.bool_or(F.col("exposed") & F.col("deployed")).alias("ns_exposed"))
    grave = signals.where(F.col("active") & F.col("signal_id").isin(*escalating)).select("wl_id").distinct().withColumn("escalation", F.lit(True))
    out = workloads.join(namespaces.select("ns_id", "sensitive"), "ns_id").join(shown, "ns_id").join(clusters.select("cluster_id", "env"), "cluster_id").join(grave, "wl_id", "left")
    return out.select("wl_id", (F.col("exposed") | F.col("ns_exposed")).alias("is_exposed"), F.coalesce("escalation", F.lit(False)).alias("escalation"), "env", "sensitive")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of ``after`` that ``before`` does not have: workloads whose context changed, or that are new."""
    return after.exceptAll(before)


def rescored(findings: DataFrame, around: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """``findings`` with rule and band of the context ``around`` their workloads."""
    rows = enrich(findings, epss, kev).join(around, "wl_id", "left")
    return score(rows).select(*KEY, *KEEP, "rule", "band", "first_seen", "last_seen")


def _counted(observation: Observation, name: str) -> int:
    """What a finished write observed; 0 where the optimizer left the rows out, as there were none."""
    try:
        return observation.get[name]
    except Py4JJavaError:
        return 0


def run(store: Versions, cycle: Cycle, workloads: DataFrame, namespaces: DataFrame, environments: DataFrame, epss: DataFrame, kev: DataFrame, escalating: tuple[str, ...], scope: list[str], days: int = 30) -> int:
    """Apply one cycle to the stored tables and publish it as one commit; its number.

    ``workloads`` (wl_id, ns_id, cluster_id), ``namespaces`` (ns_id, sensitive) and ``environments`` (cluster_id, env,
    as found or as a person set it) are given anew each time. Signals in ``scope`` that the cycle does not report go
    out of use, unless it reports none at all. Findings of this cycle are scored and merged; of the stored ones only
    those are scored again whose workload's context moved. ``counters`` gets a row per cycle, counted by the writes.
    """
    commit, spark = store.begin(), store.spark
    never = F.lit(None).cast("timestamp_ntz").alias
    if not commit.number:
        commit.replace("clusters", environments.select("cluster_id", "env", never("last_complete"), F.lit(0).alias("incomplete"), F.lit(False).alias("alarm")), ("cluster_id",))
        commit.replace("workloads", workloads.select("wl_id", "ns_id", "cluster_id", F.lit(False).alias("exposed"), F.lit(False).alias("deployed"), never("last_seen")), ("wl_id",))
        commit.replace("pairs", cycle.items.limit(0).select(*PAIR, F.lit(True).alias("deployed"), F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen")), PAIR)
        commit.replace("signals", cycle.signals.limit(0).select("wl_id", "signal_id", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), F.lit(True).alias("active")), ("wl_id", "signal_id"))
        commit.replace("context", workloads.limit(0).select("wl_id", *[F.lit(True).alias(c) for c in CONTEXT[:2]], F.lit("").alias("env"), F.lit(True).alias("sensitive")), ("wl_id",))
        commit.replace("findings", cycle.findings.limit(0).select(*KEY, *KEEP, F.lit(0).alias("rule"), F.lit("").alias("band"), "first_seen", "last_seen"), KEY)

    clusters = commit.read("clusters").drop("env").join(environments.select("cluster_id", "env"), "cluster_id").select("cluster_id", "env", "last_complete", "incomplete", "alarm")
    commit.replace("clusters", reaped_clusters(clusters, cycle.marks, cycle.started), ("cluster_id",))
    clusters = commit.read("clusters")

    seen = cycle.items.groupBy("wl_id").agg(F.max("seen_at").alias("seen_"))
    own = commit.read("workloads").join(seen, "wl_id", "left").join(cycle.exposed.select("wl_id", F.col("exposed").alias("shown_")), "wl_id", "left")
    here = F.col("seen_").isNotNull()
    own = own.select("wl_id", "ns_id", "cluster_id", F.coalesce(F.when(here, F.col("shown_")), "exposed").alias("exposed"), (F.col("deployed") | here).alias("deployed"), F.greatest("last_seen", "seen_").alias("last_seen"))
    commit.replace("workloads", reaped(own, clusters, cycle.started).select(*own.columns), ("wl_id",))

    batch = cycle.items.groupBy(*PAIR).agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")).withColumn("deployed", F.lit(True))
    before, after = Observation(), Observation()
    pairs = merged_pairs(commit.read("pairs"), batch).observe(before, F.count("*").alias("n"))
    kept = reaped(pairs.join(workloads.select("wl_id", "cluster_id"), "wl_id"), clusters, cycle.started, days).select(*commit.read("pairs").columns)
    commit.replace("pairs", kept.observe(after, F.count_if("deployed").alias("up"), F.count_if(~F.col("deployed")).alias("down")), PAIR)

    reports = cycle.signals.join(workloads.select("wl_id"), "wl_id", "left_semi").groupBy("wl_id", "signal_id").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    commit.merge("signals", reports.withColumn("active", F.lit(True)), ("wl_id", "signal_id"), merged_signals)
    cleared = Observation()
    known = commit.read("signals").withColumn("was_", F.col("active"))
    now = deactivate(known, scope, cycle.scan_started, F.lit(len(commit.touched["signals"])))
    commit.replace("signals", now.observe(cleared, F.count_if(F.col("was_") & ~F.col("active")).alias("n")).drop("was_"), ("wl_id", "signal_id"))

    old = commit.read("context")
    commit.replace("context", context(commit.read("workloads"), namespaces, clusters, commit.read("signals"), escalating), ("wl_id",))
    around = commit.read("context")
    turned = moved(old, around).select("wl_id")
    again = commit.read("findings").join(turned, "wl_id", "left_semi").join(cycle.findings.select(*KEY), list(KEY), "left_anti")
    both = cycle.findings.select(*KEY, *KEEP, "first_seen", "last_seen", F.lit(False).alias("again_")).unionByName(again.select(*KEY, *KEEP, "first_seen", "last_seen", F.lit(True).alias("again_")))
    counted, total = Observation(), Observation()
    both = both.observe(counted, F.count_if("again_").alias("rescored"), F.count_if(~F.col("again_")).alias("reported"))
    commit.merge("findings", rescored(both, around, epss, kev), KEY, lambda stored, new: merged_findings(stored.observe(total, F.count("*").alias("n")), new))

    up, down = _counted(after, "up"), _counted(after, "down")
    row = (cycle.number, up, down, _counted(before, "n") - up - down, _counted(cleared, "n"), _counted(counted, "reported"), _counted(counted, "rescored"), _counted(total, "n"))
    counters = spark.createDataFrame([row], "cycle int, obs_deployed long, obs_undeployed long, obs_swept long, signals_cleared long, reported long, rescored long, read long")
    commit.merge("counters", counters, ("cycle",), lambda stored, new: stored.unionByName(new))
    return commit.publish()
