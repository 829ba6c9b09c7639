"""A refresh of exploit intelligence: the feeds take the place of what is stored, and findings follow where they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.findings import score
from ravelin.sources.versions import Versions


def followed(findings: DataFrame, epss: DataFrame | None, kev: DataFrame | None) -> DataFrame:
    """All findings after a refresh; those that it changes, ``moved_``, have their new values and are scored anew.

    What a feed does not name any more is cleared. A feed of None leaves what was known; ids that do not start with CVE-
    have no values. ``findings`` hold what rules look at: severity, fixed_version, env, is_exposed, escalation, sensitive.
    """
    named = F.col("vuln_id").startswith("CVE-")
    out = findings.withColumns({"p_": F.col("epss_percentile"), "k_": F.col("kev_listed")})
    if epss is not None:
        own = F.col("p_").cast(findings.schema["epss_percentile"].dataType)
        out = out.drop("p_").join(epss.groupBy("vuln_id").agg(F.max("percentile").alias("p_")), "vuln_id", "left").withColumn("p_", F.when(named, own))
    if kev is not None:
        listed = kev.select("vuln_id").distinct().withColumn("k_", F.lit(True))
        out = out.drop("k_").join(listed, "vuln_id", "left").withColumn("k_", named & F.coalesce("k_", F.lit(False)) & (F.col("category") == "vulnerability"))
    moved = ~F.col("p_").eqNullSafe(F.col("epss_percentile")) | ~F.col("k_").eqNullSafe(F.col("kev_listed"))
    rows = out.withColumns({"moved_": moved, "was_": F.struct("rule", "band"), "epss_percentile": F.col("p_"), "kev_listed": F.col("k_")}).drop("p_", "k_", "rule", "band")
    kept = {c: F.when(F.col("moved_"), F.col(c)).otherwise(F.col(f"was_.{c}")) for c in ("rule", "band")}
    return score(rows).withColumns(kept).select(*findings.columns, "moved_")


def refresh(store: Versions, epss: DataFrame | None = None, kev: DataFrame | None = None) -> int:
    """Replace the stored feeds and let the stored findings follow, as one commit; its number, 0 if nothing was to do.

    An empty feed changes nothing, as it tells of a failed download rather than of a world without exploits. Only the
    buckets of findings whose values differ are written, and each where it is read: stored findings are not shuffled.
    """
    epss, kev = (None if feed is None or feed.isEmpty() else feed for feed in (epss, kev))
    if epss is None and kev is None:
        return 0
    commit = store.begin()
    for name, feed in (("epss", epss), ("kev", kev)):
        if feed is not None:
            commit.replace(name, feed.dropDuplicates(["vuln_id"]), ("vuln_id",))
    commit.revise("findings", lambda rows: followed(rows, epss, kev))
    return commit.publish()
