"""The registry of posture signals, a static dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category to matchers, as the scanners name them.
SCANNER_CHECKS = {
    "host_escape": ["KSV-0017", "KSV-0023", "KSV-0008", "KSV-0009", "KSV-0010"],
    "rbac_elevation": ["KSV-0051", "KSV-0053", "KSV-0044", "KSV-0041"],
    "priv_escalation": ["KSV-0001", "KSV-0005"],
    "supply_chain": ["KSV-0013"],
    "hardening_gap": ["KSV-0012", "KSV-0014"],
}
POLICIES = {
    "host_escape": ["disallow-privileged-containers", "disallow-host-path", "disallow-host-namespaces"],
    "priv_escalation": ["disallow-privilege-escalation", "disallow-capabilities"],
    "supply_chain": ["disallow-latest-tag"],
    "hardening_gap": ["require-run-as-nonroot", "require-ro-rootfs"],
}
OWN = {
    "exposed-secret-in-image": ("trivy", "secret_leak"),
    "has-external-ingress": ("derived", "network_exposure"),
    "has-external-lb": ("derived", "network_exposure"),
    "has-nodeport-service": ("derived", "network_exposure"),
    "missing-networkpolicy": ("kyverno", "network_exposure"),
}
#: Only these raise a finding's urgency.
ESCALATING = ("host_escape", "rbac_elevation", "priv_escalation")

ROWS = (
    [(f"ksv:{m}", "trivy", c, m) for c, ms in SCANNER_CHECKS.items() for m in ms]
    + [(f"kyverno:{m}", "kyverno", c, m) for c, ms in POLICIES.items() for m in ms]
    + [(f"kp:{m}", source, c, m) for m, (source, c) in OWN.items()]
)
ESCALATION_IDS = sorted(r[0] for r in ROWS if r[2] in ESCALATING)
VALUES_SQL = ", ".join(str(r) for r in ROWS)


def registry(spark: SparkSession) -> DataFrame:
    """signal_id, source, category, matcher: 27 rows, so small enough to broadcast anywhere."""
    return spark.sql(f"SELECT * FROM VALUES {VALUES_SQL} AS t(signal_id, source, category, matcher)")


def reap_scope(kind: str) -> list[str]:
    """The signals that a finished cycle of this scan kind may clear."""
    by_source = {s: sorted(r[0] for r in ROWS if r[1] == s) for s in ("trivy", "kyverno")}
    if kind.startswith("kyverno."):
        return by_source["kyverno"]
    return {
        "trivy.ConfigAuditReport": by_source["trivy"],
        "trivy.RbacAssessmentReport": [i for i in by_source["trivy"] if i.startswith("ksv:KSV-005")],
        "trivy.ClusterRbacAssessmentReport": [i for i in by_source["trivy"] if i.startswith("ksv:KSV-005")],
        "trivy.ExposedSecretReport": ["kp:exposed-secret-in-image"],
    }.get(kind, [])


def canonical_check(check_id: Column) -> Column:
    """KSV51, KSV-0051 or AVD-KSV-0051 as the registry spells it; other ids without their AVD- prefix."""
    bare = F.regexp_replace(check_id, "^AVD-", "")
    number = F.regexp_extract(bare, r"^KSV(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("KSV-"), _padded(number))).otherwise(bare)


def _padded(number: Column) -> Column:
    short = F.regexp_replace(number, "^0+(?=.)", "")
    return F.when(F.length(short) >= 4, short).otherwise(F.lpad(short, 4, "0"))


def lookup(rows: DataFrame, check_id: str, source: str = "trivy") -> DataFrame:
    """``rows`` with signal_id: the registered signal of a check or policy, null if none."""
    own = registry(rows.sparkSession).where(F.col("source") == source).select("signal_id", F.col("matcher").alias("key_"))
    key = canonical_check(F.col(check_id)) if source == "trivy" else F.col(check_id)
    return rows.withColumn("key_", key).join(F.broadcast(own), "key_", "left").drop("key_")
