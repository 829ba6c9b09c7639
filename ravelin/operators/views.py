"""Read views over the domain: images in use, counts by scope, searches and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions.scalars import BANDS, contains_folded
from ravelin.operators.findings import band_counts


def currently_deployed(images: DataFrame, in_use: DataFrame) -> DataFrame:
    """``images`` with currently_deployed: some deployed observation names the image. ``in_use`` is scoped beforehand."""
    used = in_use.select(F.col("image_id").alias("used_")).distinct()
    return images.join(used, F.col("image_id") == F.col("used_"), "left").withColumn("currently_deployed", F.col("used_").isNotNull()).drop("used_")


def running_only(findings: DataFrame, in_use: DataFrame, running: bool = True) -> DataFrame:
    """Findings whose image runs, or those whose image does not; a finding without an image is among the latter."""
    return findings.join(in_use.select("image_id").distinct(), "image_id", "left_semi" if running else "left_anti")


def image_rows(in_use: DataFrame, findings: DataFrame) -> DataFrame:
    """Each (workload, image) in use with its band counts and their total, zeros included.

    Uses and findings are told apart by a flag and counted in one aggregate, which needs no join of their keys.
    """
    key = ("wl_id", "image_id")
    both = in_use.select(*key, F.lit(None).cast("string").alias("band"), F.lit(1).alias("use_")).unionByName(findings.select(*key, "band", F.lit(0).alias("use_")))
    found = [F.count_if(F.col("band") == b).alias(b) for b in BANDS]
    return both.groupBy(*key).agg(*found, F.count_if(F.col("use_") == 0).alias("total"), F.max("use_").alias("use_")).where("use_ = 1").drop("use_")


def image_order() -> list[Column]:
    return [F.desc("deployed"), *[F.desc(b) for b in BANDS], F.asc_nulls_last("cluster_name")]


def shown_image(rows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Of each workload's image rows the one that ``wanted`` picks, else the first in ``image_order``."""
    first = [F.desc(F.coalesce(wanted, F.lit(False)))] if wanted is not None else []
    place = F.row_number().over(W.partitionBy("wl_id").orderBy(*first, *image_order(), "image_id"))
    return rows.withColumn("place_", place).where("place_ = 1").drop("place_")


def namespace_order() -> list[Column]:
    return [F.desc("active"), F.asc("ns_name")]


def namespace_counts(namespaces: DataFrame, workloads: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each cluster: its namespaces, those with a deployed workload, and the exposed ones among these."""
    live = workloads.where("deployed").select("ns_id").distinct().withColumn("live", F.lit(True))
    own = clusters.join(namespaces.join(live, "ns_id", "left"), "cluster_id", "left")
    return own.groupBy("cluster_name").agg(
        F.count_distinct("ns_id").alias("namespaces"),
        F.count_distinct(F.when(F.col("live"), F.col("ns_id"))).alias("active"),
        F.count_distinct(F.when(F.col("live") & F.col("ns_exposed"), F.col("ns_id"))).alias("exposed"),
    )


def namespace_findings(namespaces: DataFrame, findings: DataFrame) -> DataFrame:
    counts = findings.where("deployed").groupBy("ns_id").agg(F.count("*").alias("n_findings"))
    return namespaces.join(counts, "ns_id", "left").select("ns_id", "ns_name", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def exposure_rollup(namespaces: DataFrame, workloads: DataFrame, manual: Column) -> DataFrame:
    """A namespace is exposed if a workload in it is; where a person set the flag it stays."""
    shown = workloads.groupBy("ns_id").agg(F.bool_or("exposed").alias("any_"))
    return namespaces.join(shown, "ns_id", "left").withColumn("ns_exposed", F.when(manual, F.col("ns_exposed")).otherwise(F.coalesce("any_", F.lit(False)))).drop("any_")


def selector_names(namespaces: DataFrame, workloads: DataFrame) -> DataFrame:
    return namespaces.join(workloads.where("deployed"), "ns_id", "left_semi").select("ns_name").distinct()


def searched(rows: DataFrame, equal: dict | None = None, like: dict | None = None) -> DataFrame:
    """Rows whose columns equal, or contain whatever the case, what is asked for; parameters that are None ask nothing."""
    for name, value in (equal or {}).items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    for name, value in (like or {}).items():
        rows = rows if value is None else rows.where(contains_folded(F.col(name), value))
    return rows


def listed(rows: DataFrame, exact: dict | None = None, member: dict | None = None, part: dict | None = None) -> DataFrame:
    """Rows whose columns equal a text, hold it in a list with commas, or contain it whatever the case; empty texts ask nothing."""
    for name, value in (exact or {}).items():
        rows = rows.where(F.col(name) == value) if value else rows
    for name, value in (member or {}).items():
        rows = rows.where(F.array_contains(F.split(name, ","), value)) if value else rows
    for name, value in (part or {}).items():
        rows = rows.where(contains_folded(F.col(name), value)) if value else rows
    return rows


def scoped(rows: DataFrame, cluster: str | None = None, namespace: str | None = None, kind: str | None = None, name: str | None = None) -> DataFrame:
    """What lies within a cluster, a namespace, a kind of workload or one workload; what is None does not narrow."""
    return searched(rows, {"cluster_name": cluster, "ns_name": namespace, "kind": kind, "wl_name": name})


def finding_details(findings: DataFrame, images: DataFrame) -> DataFrame:
    """Findings with the names that their keys stand for; a finding whose image is not known keeps a null there."""
    columns = ("category", "vuln_id", "severity", "band", "fixed_version", "kev_listed", "wl_id", "wl_name", "kind", "ns_name", "cluster_name", "env")
    return findings.join(images.select("image_id", "image_ref"), "image_id", "left").select(*columns, "image_id", "image_ref")


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 25) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def detail_extras(details: Column, promoted: tuple[str, ...]) -> Column:
    """The details of a finding that no column of its own shows."""
    return F.map_filter(details, lambda k, v: ~k.isin(*promoted))
