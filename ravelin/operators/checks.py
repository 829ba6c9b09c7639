"""Assertions on the state after a cycle, evaluated over named tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind to table and verdict: how many rows that fit ``filter`` there have to be.
KINDS = {
    "cluster_exists": ("clusters", "some"), "namespace_count": ("namespaces", "count"), "namespace_attributes": ("namespaces", "attributes"),
    "workload_count": ("workloads", "count"), "workload_exists": ("workloads", "some"), "workload_absent": ("workloads", "none"), "workload_alias_count": ("aliases", "count"),
    "image_count": ("images", "count"), "image_exists": ("images", "some"), "observation_count": ("observations", "count"),
    "finding_count": ("findings", "count"), "finding_exists": ("findings", "some"), "finding_priority": ("findings", "first"),
    "signal_present": ("signals", "active"), "signal_absent": ("signals", "inactive"),
    "import_mark": ("marks", "attributes"), "import_mark_count": ("marks", "count"), "ingest_queue_count": ("queue", "count"),
    "snapshot_count": ("snapshots", "stated"), "snapshot_delta": ("snapshots", "latest"), "snapshot_absent_since": ("snapshots", "absent_since"),
    "scan_inconsistency": ("inconsistencies", "exactly"), "scan_inconsistency_count": ("inconsistencies", "stated"), "enrichment": ("feed", "attributes"),
    "workload_last_inventory_advanced": ("workloads", "advanced"), "workload_last_inventory_unchanged": ("workloads", "unchanged"),
    "log_event_count": (None, "stub"), "log_event_exists": (None, "stub"), "scan_health_widget": (None, "stub"),
}


def evaluate(spark: SparkSession, tables: Mapping[str, DataFrame], assertions: list[dict]) -> DataFrame:
    """index, kind, pass and found of each assertion: {kind, filter: {column: value}, expect | min | attributes | since}.

    An unknown kind, table or column fails. ``latest`` judges the row with the last captured_at, ``first`` the least row
    by its columns as text, ``exactly`` wants ``expect`` rows (1 by default), and ``stated`` fails unless ``expect`` or
    ``min`` is given. All assertions on a table are one aggregate, which reads it once; all are one plan.
    """
    by_table: dict[int, tuple[DataFrame, list]] = {}
    plain = []
    for k, a in enumerate(assertions):
        table, verdict = KINDS.get(a.get("kind"), (None, None))
        if verdict == "stub":
            plain.append((k, a.get("kind"), True, 0))
        elif table not in tables or not {*a.get("filter", {}), *a.get("attributes", {})} <= {*tables[table].columns}:
            plain.append((k, a.get("kind"), False, 0))
        else:
            by_table.setdefault(id(tables[table]), (tables[table], []))[1].append((k, a, verdict))
    out = spark.createDataFrame(plain, "index int, kind string, pass boolean, found long")
    for rows, asked in by_table.values():
        judged = [_judged(rows.columns, verdict, a) for _, a, verdict in asked]
        rows = rows.agg(*[c.alias(f"{name}{i}") for i, pair in enumerate(judged) for name, c in zip(("pass_", "found_"), pair)])
        told = [F.struct(F.lit(k).alias("index"), F.lit(a["kind"]).alias("kind"), F.col(f"pass_{i}").alias("pass"), F.col(f"found_{i}").alias("found")) for i, (k, a, _) in enumerate(asked)]
        out = out.unionByName(rows.select(F.inline(F.array(*told))))
    return out


def _judged(columns: list[str], verdict: str, a: dict) -> tuple[Column, Column]:
    """Whether an assertion passes and how many rows fit it, as aggregates over its whole table."""
    own = F.lit(True)
    for name, value in a.get("filter", {}).items():
        own = own & (F.col(name).isNull() if value is None else F.col(name).isin(*value) if isinstance(value, list) else F.col(name) == value)
    if verdict in ("active", "inactive"):
        own = own & F.col("active")
    if verdict == "absent_since":
        own = own & (F.col("captured_at") >= F.lit(a["since"]).cast("timestamp_ntz"))
    if verdict in ("advanced", "unchanged"):
        moved = F.col("last_inventory_at") > F.lit(a["since"]).cast("timestamp_ntz") + F.expr("INTERVAL 1 SECOND")
        own = own & (moved if verdict == "advanced" else ~F.coalesce(moved, F.lit(False)))
    own = F.coalesce(own, F.lit(False))
    fits = F.lit(True)
    for name, value in a.get("attributes", {}).items():
        fits = fits & F.col(name).eqNullSafe(F.lit(value))
    n = F.count_if(own)
    least = lambda order: F.coalesce(F.min_by(fits, F.when(own, order)), F.lit(False))
    passed = {
        "latest": least(F.struct(F.negative(F.unix_micros(F.col("captured_at").cast("timestamp"))))) if verdict == "latest" else None,
        "first": least(F.struct(*[F.col(c).cast("string") for c in sorted(columns)])) if verdict == "first" else None,
        "exactly": n == a.get("expect", 1),
        "stated": (n >= a["min"]) if "min" in a else (n == a["expect"]) if "expect" in a else F.lit(False),
        "count": (n >= a["min"]) if "min" in a else (n == a.get("expect", 0)),
        "attributes": (n > 0) & (F.count_if(own & ~fits) == 0),
        "none": n == 0, "inactive": n == 0, "absent_since": n == 0,
    }.get(verdict, n > 0)
    return passed, n
