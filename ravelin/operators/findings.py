"""Findings: fold repeated observations, enrich, score, hide, count and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.scalars import BANDS, SEVERITIES, exposed, ranked
from ravelin.functions.signals import ESCALATION_IDS

KEY = ("category", "vuln_id", "wl_id", "image_id")


def fold(observations: DataFrame, key: tuple[str, ...] = KEY, keep: tuple[str, ...] = ("severity", "fixed_version", "order_id", "line")) -> DataFrame:
    """One finding per key: attributes of the latest observation, first_seen and last_seen.

    A plain aggregate with a partial step before the shuffle, so a hot key costs one row per task. Ties in time
    go to the larger order, line and price, then to the lesser severity and version as texts, so the result has one value.
    """
    # the least of what falls: of negative times and numbers, then of the texts themselves
    micros = lambda c: F.negative(F.unix_micros(F.col(c).cast("timestamp")))
    falling = ("order_id", "line", "price")
    order = F.struct(micros("seen_at").alias("a"), *[F.negative(F.col(c)).alias(c) for c in falling], "severity", "fixed_version")
    # what the order holds already is taken from it and does not travel twice
    more = [c for c in keep if c not in (*falling, "severity", "fixed_version")]
    least = F.min_by(F.struct(order.alias("o"), *more), order) if more else F.struct(F.min(order).alias("o"))
    out = observations.groupBy(*key).agg(least.alias("r_"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    kept = lambda c: F.col(f"r_.{c}") if c in more else F.negative(F.col(f"r_.o.{c}")) if c in falling else F.col(f"r_.o.{c}")
    return out.select(*key, *[kept(c).alias(c) for c in keep], "first_seen", "last_seen")


def merged(stored: DataFrame, batch: DataFrame, key: tuple[str, ...] = KEY, keep: tuple[str, ...] = ("severity", "fixed_version", "order_id", "line")) -> DataFrame:
    """Stored findings after a batch of folded ones: its attributes win, first_seen and last_seen widen; ``what`` says created, updated or kept."""
    both = stored.select("*", F.lit(0).alias("new_")).unionByName(batch.select("*", F.lit(1).alias("new_")))
    out = both.groupBy(*key).agg(F.max_by(F.struct(*keep), "new_").alias("r_"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("new_").alias("a_"), F.max("new_").alias("b_"))
    what = F.when(F.col("a_") == 1, "created").when(F.col("b_") == 1, "updated").otherwise("kept")
    return out.select(*key, *[F.col(f"r_.{c}").alias(c) for c in keep], "first_seen", "last_seen", what.alias("what"))


def enrich(findings: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """Exploit probability and known exploitation; only ids that start with CVE- are looked up."""
    key = F.when(F.col("vuln_id").startswith("CVE-"), F.col("vuln_id"))
    e = epss.select(F.col("vuln_id").alias("e_"), F.col("percentile").alias("epss_percentile"))
    k = kev.select(F.col("vuln_id").alias("k_")).distinct()
    out = findings.join(e, key == F.col("e_"), "left").join(k, key == F.col("k_"), "left")
    return out.withColumn("kev_listed", F.col("k_").isNotNull() & (F.col("category") == "vulnerability")).drop("e_", "k_")


def fold_signals(raw: DataFrame, workloads: DataFrame, cycle_start: Column) -> DataFrame:
    """One row per workload and signal: first and last report, active if reported in the cycle. Unresolved reports drop."""
    out = raw.join(workloads.select("wl_id"), "wl_id", "left_semi").groupBy("wl_id", "signal_id").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return out.withColumn("active", F.coalesce(F.col("last_seen") >= cycle_start, F.lit(False)))


def dimensions(workloads: DataFrame, namespaces: DataFrame, clusters: DataFrame, signals: DataFrame) -> DataFrame:
    """A row per workload with its namespace, its cluster and whether a signal escalates it."""
    escalated = signals.where(F.col("active") & F.col("signal_id").isin(*ESCALATION_IDS)).select("wl_id").distinct().withColumn("escalation", F.lit(True))
    return workloads.join(namespaces, "ns_id").join(clusters, "cluster_id").join(escalated, "wl_id", "left")


def within(findings: DataFrame, dims: DataFrame) -> DataFrame:
    """Join ``dimensions``; findings without a workload keep their row with nulls (left join)."""
    out = findings.join(dims, "wl_id", "left")
    return out.withColumns({"is_exposed": exposed(F.col("exposed"), F.col("ns_exposed")), "escalation": F.coalesce("escalation", F.lit(False))}).drop("exposed", "ns_exposed")


def widen(findings: DataFrame, workloads: DataFrame, namespaces: DataFrame, clusters: DataFrame, signals: DataFrame) -> DataFrame:
    """``within`` of the dimensions, joined in the same plan."""
    return within(findings, dimensions(workloads, namespaces, clusters, signals))


def rules() -> list[tuple[int, Column, str]]:
    """The urgency rules in order: number, condition, band. The first that holds decides."""
    sev, e = F.col("severity"), F.coalesce("epss_percentile", F.lit(0.0))
    fix = F.coalesce(F.col("fixed_version"), F.lit("")) != ""
    prod = F.coalesce(F.nullif(F.col("env"), F.lit("")), F.lit("dev")) == "prod"
    out, esc, alone = F.col("is_exposed"), F.col("escalation"), F.col("wl_id").isNull()
    sensitive = F.coalesce("sensitive", F.lit(False))
    grave = sev.isin("critical", "high")
    return [
        (1, F.coalesce("kev_listed", F.lit(False)), "immediate"),
        (2, alone & (sev == "critical"), "out_of_cycle"),
        (3, alone & (sev == "high") & prod, "out_of_cycle"),
        (4, alone, "scheduled"),
        (5, grave & (e >= 0.9) & out & prod, "immediate"),
        (6, (sev == "critical") & out & prod, "immediate"),
        (7, grave & prod & esc, "out_of_cycle"),
        (8, (e >= 0.9) & prod, "out_of_cycle"),
        (9, (sev == "critical") & prod, "out_of_cycle"),
        (10, (sev == "high") & out & prod, "out_of_cycle"),
        (11, sev.isin("high", "medium") & ~fix & sensitive, "scheduled"),
        (12, ~fix & ~out & ~esc, "defer"),
        (13, ~fix & grave & (out | esc), "scheduled"),
        (14, (sev == "critical") & ~prod, "scheduled"),
        (15, (sev == "high") & prod, "scheduled"),
        (16, (sev == "medium") & prod & esc, "scheduled"),
    ]


def score(wide: DataFrame) -> DataFrame:
    """``wide`` with rule and band."""
    rule, band = F.lit(17), F.lit("defer")
    for number, condition, name in reversed(rules()):
        rule, band = F.when(condition, F.lit(number)).otherwise(rule), F.when(condition, F.lit(name)).otherwise(band)
    return wide.select("*", rule.alias("rule"), band.alias("band"))


def changed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose band differs from the stored one, the only ones that a rescoring has to write."""
    old = before.select(*key, F.col("band").alias("old_"))
    return after.join(old, key, "left").where(~F.col("band").eqNullSafe(F.col("old_"))).drop("old_")


def moved(scored: DataFrame, stored: str) -> DataFrame:
    """``changed`` where the stored band is a column of the same rows: no join."""
    return scored.where(~F.col("band").eqNullSafe(F.col(stored)))


def relevant(scored: DataFrame) -> DataFrame:
    """Deployed or without a workload, and seen since the cluster's last complete inventory, if it had one."""
    return scored.where((F.coalesce("deployed", F.lit(False)) | F.col("wl_id").isNull()) & (F.col("last_complete").isNull() | (F.col("last_seen") >= F.col("last_complete"))))


def muting(actions: DataFrame, as_of: Column) -> DataFrame:
    return actions.where(F.col("action").isin("accept", "false_positive") & ~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def unmuted(findings: DataFrame, actions: DataFrame, as_of: Column, key: str = "order_id") -> DataFrame:
    return findings.join(muting(actions, as_of).select(key), key, "left_anti")


def band_counts(findings: DataFrame, *key: str) -> DataFrame:
    return findings.groupBy(*key).agg(*[F.count_if(F.col("band") == b).alias(b) for b in BANDS])


def work_list(workloads: DataFrame, namespaces: DataFrame, clusters: DataFrame, findings: DataFrame, deployed_only: bool = True) -> DataFrame:
    """Workloads with their band counts, zeros included."""
    own = workloads.where("deployed") if deployed_only else workloads
    counts = band_counts(findings, "wl_id")
    out = own.join(namespaces, "ns_id").join(clusters, "cluster_id").join(counts, "wl_id", "left")
    return out.select("wl_id", "wl_name", "kind", "deployed", "ns_name", "cluster_name", *[F.coalesce(b, F.lit(0)).cast("long").alias(b) for b in BANDS])


def ranked_list(listed: DataFrame, key: str | None = None, descending: bool = True) -> DataFrame:
    """By bands, then name; or by one of the columns, whose direction also turns the name. Unknown keys mean the former."""
    if key in ("wl_name", "kind", "ns_name", "cluster_name", *BANDS[:3]):
        turn = F.desc if descending else F.asc
        return listed.orderBy(turn(key), turn(F.lower("wl_name")), "wl_id")
    return listed.orderBy(F.desc("immediate"), F.desc("out_of_cycle"), F.desc("scheduled"), F.lower("wl_name"), "wl_id")


def urgency_order(findings: DataFrame) -> list[Column]:
    """Band, severity, exploit probability, then the latest seen; unknown names come last."""
    return [ranked(F.col("band"), BANDS), ranked(F.col("severity"), SEVERITIES), F.desc(F.coalesce("epss_percentile", F.lit(0.0))), F.desc("last_seen")]
