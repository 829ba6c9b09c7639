"""Trend snapshots: rollups by scope, and how a workload's set of images changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDS = ("cluster_id", "ns_id", "wl_id")


def scopes(clusters: DataFrame, namespaces: DataFrame, workloads: DataFrame) -> DataFrame:
    """(level, cluster_id, ns_id, wl_id): the whole, and every row of the tables given; ids outside a scope are -1.

    The level has a bit for each id summed over: 7 the whole, 3 cluster, 1 namespace, 0 workload.
    """
    one = lambda df, level, *ids: df.select(F.lit(level).alias("level"), *[F.col(i).cast("long").alias(i) if i in ids else F.lit(-1).cast("long").alias(i) for i in IDS])
    whole = clusters.sparkSession.range(1)
    return one(whole, 7).unionByName(one(clusters, 3, IDS[0])).unionByName(one(namespaces, 1, *IDS[:2])).unionByName(one(workloads, 0, *IDS))


def heartbeat(findings: DataFrame, scopes: DataFrame, measures: dict[str, tuple[str, ...]]) -> DataFrame:
    """Counts of the values of each measure, and in all, for each of ``scopes``; empty ones have zeros.

    Findings without a workload count for their cluster, those without a cluster for the whole. Findings are counted by
    workload first; the grouping sets then add up these few rows, which are joined to the scopes.
    """
    names = [v for values in measures.values() for v in values] + ["total"]
    counts = [F.count_if(F.col(m) == v).alias(v) for m, values in measures.items() for v in values] + [F.count("*").alias("total")]
    own = findings.groupBy(*IDS).agg(*counts)
    summed = own.groupingSets([[], [IDS[0]], list(IDS[:2]), list(IDS)], *IDS).agg(*[F.sum(n).alias(n) for n in names], F.grouping_id().alias("level"))
    # an id that is null within a scope stays so and meets none; one that is summed over is -1
    ids = [F.when(F.expr(f"(level >> {2 - k}) & 1 = 1"), -1).otherwise(F.col(i)).cast("long").alias(i) for k, i in enumerate(IDS)]
    out = scopes.join(summed.select("level", *ids, *names), ["level", *IDS], "left")
    scope = F.expr("CASE level WHEN 7 THEN 'global' WHEN 3 THEN 'cluster' WHEN 1 THEN 'namespace' ELSE 'workload' END")
    return out.select(scope.alias("scope"), *IDS, *[F.coalesce(v, F.lit(0)).alias(v) for v in names])


def image_sets(observations: DataFrame, cycle: Column) -> DataFrame:
    """The sorted distinct images of each workload and cycle."""
    return observations.groupBy("wl_id", cycle.alias("cycle")).agg(F.array_sort(F.collect_set("image_id")).alias("images"))


def with_previous(sets: DataFrame) -> DataFrame:
    """``sets`` with previous: the last non-empty set before this one."""
    w = W.partitionBy("wl_id").orderBy("cycle").rowsBetween(W.unboundedPreceding, -1)
    return sets.withColumn("previous", F.last(F.when(F.size("images") > 0, F.col("images")), ignorenulls=True).over(w))


def classified(sets: DataFrame) -> DataFrame:
    """How each set differs from the last non-empty one: change_kind, n_added, n_removed, changed."""
    out = with_previous(sets)
    before = F.coalesce("previous", F.array().cast(sets.schema["images"].dataType))
    out = out.withColumns({"added": F.array_except("images", before), "removed": F.array_except(before, F.col("images"))})
    a, r = F.size("added"), F.size("removed")
    kind = (
        F.when(F.col("previous").isNull(), "first_seen")
        .when((a == 0) & (r == 0), "none")
        .when(r == 0, "added")
        .when(a == 0, "removed")
        .when((a == 1) & (r == 1), "replaced")
        .otherwise("mixed")
    )
    return out.withColumns({"change_kind": kind, "changed": F.col("previous").isNotNull() & ((a > 0) | (r > 0)), "n_added": a.cast("long"), "n_removed": r.cast("long")})


def series(snapshots: DataFrame, as_of: Column, days: int, keep_days: int = 365, changes_only: bool = False) -> DataFrame:
    """Snapshots of the last ``days`` days (1 to ``keep_days``), by time."""
    span = F.make_dt_interval(F.lit(max(1, min(days, keep_days))))
    out = snapshots.where(F.col("captured_at") >= as_of - span)
    return (out.where("change_kind <> 'none'") if changes_only else out).orderBy("captured_at")


def series_arrays(long: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """One row per key with its values in the order of time, ready for a chart."""
    return long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, value))).alias("s_")).select(key, F.col(f"s_.{at}").alias("at"), F.col(f"s_.{value}").alias("values"))


def aligned(rows: DataFrame, scope: list[str], key: str, keys: tuple[str, ...], at: str, value: str, since: Column, until: Column, step: str) -> DataFrame:
    """Of each scope and key in ``keys`` the sums of ``value`` at every point of time from ``since`` to ``until``, zeros included.

    Long form (scope, key, at, value). Scopes are those that ``rows`` names at all, whatever the time; rows of other keys
    or times add nothing. All series of a scope have the same points, so ``series_arrays`` gives arrays of one length.
    """
    grid = F.explode(F.sequence(since, until, F.expr(f"INTERVAL {step}"))).alias(at)
    spine = rows.select(*scope).distinct().select("*", grid).select("*", F.explode(F.array(*[F.lit(k) for k in keys])).alias(key))
    sums = rows.groupBy(*scope, key, at).agg(F.sum(value).alias(value))
    return spine.join(sums, [*scope, key, at], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def in_scope(rows: DataFrame, cluster: str | None = None, namespace: str | None = None, workload: int | None = None) -> DataFrame:
    """Rows of one scope; a namespace needs its cluster, as its name alone is not unique."""
    if namespace is not None and cluster is None:
        raise ValueError("a namespace is named within a cluster")
    for name, wanted in (("cluster_name", cluster), ("ns_name", namespace), ("wl_id", workload)):
        rows = rows if wanted is None else rows.where(F.col(name) == wanted)
    return rows


def window_days(asked: int | None, keep_days: int = 365, usual: int = 90) -> int:
    """How many days a series reaches back: as asked, at least one and at most what is kept."""
    return max(1, min(asked or usual, keep_days))
