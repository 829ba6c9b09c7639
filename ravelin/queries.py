"""The registered queries over the lens, each beside the SQL that another engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import scalars as S
from ravelin.functions import signals as G
from ravelin.operators import checks, findings, lifecycle, resolve, snapshots, views
from ravelin.plans import lens, payloads
from ravelin.sources import feeds
from ravelin.streaming import cycles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None, on_lens: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (lens.SQL if on_lens else "") + sql
        return f

    return add


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _folded(spark, d):
    return findings.fold(lens.observations(spark, d))


def _enriched(spark, d):
    return findings.enrich(_folded(spark, d), lens.epss(spark, d), lens.kev(spark, d))


def _signals(spark, d):
    return findings.fold_signals(lens.signals(spark, d), lens.workloads(spark, d), _at(lens.CYCLE_START))


def _wide(spark, d):
    return findings.widen(_enriched(spark, d), lens.workloads(spark, d), lens.namespaces(spark, d), lens.clusters(spark, d), _signals(spark, d))


def _banded(spark, d):
    return findings.score(_wide(spark, d))


def _relevant(spark, d):
    return findings.relevant(_banded(spark, d))


def _visible(spark, d):
    """As ``relevant`` without muted orders; what cannot be visible goes before the fold and before the dimensions join."""
    deployed = lens.workloads(spark, d).where("deployed").select("wl_id")
    folded = findings.fold(lens.observations(spark, d).join(deployed, "wl_id", "left_semi"))
    open_ = findings.unmuted(folded, lens.actions(spark, d), _at(lens.AS_OF))
    rows = findings.enrich(open_, lens.epss(spark, d), lens.kev(spark, d))
    rows = findings.widen(rows, lens.workloads(spark, d), lens.namespaces(spark, d), lens.clusters(spark, d), _signals(spark, d))
    return findings.relevant(findings.score(rows))


def _listed(spark, d, **more):
    return findings.work_list(lens.workloads(spark, d), lens.namespaces(spark, d), lens.clusters(spark, d), _visible(spark, d), **more)


KEY = ["category", "vuln_id", "wl_id", "image_id"]


@register("SELECT * FROM listed")
def ranked_workloads(spark, d):
    return findings.ranked_list(_listed(spark, d))


@register("SELECT * FROM finding")
def finding_dedup_fold(spark, d):
    return _folded(spark, d)


@register("""SELECT category, vuln_id, wl_id, image_id,
    sha256(concat_ws('|', 'trivy', category, vuln_id, CAST(wl_id AS VARCHAR), 'sha256:' || sha256(CAST(image_id AS VARCHAR)), 'pkg', fixed_version)) AS hash_code FROM finding""")
def finding_hash(spark, d):
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("image_id").cast("string"), 256))
    code = S.dedup_hash(F.lit("trivy"), F.col("category"), F.col("vuln_id"), F.col("wl_id"), F.lit(""), digest, F.lit("pkg"), F.col("fixed_version"))
    return _folded(spark, d).select(*KEY, code.alias("hash_code"))


@register("SELECT category, vuln_id, wl_id, image_id, epss_percentile, kev_listed FROM enriched")
def finding_enriched(spark, d):
    return _enriched(spark, d).select(*KEY, "epss_percentile", "kev_listed")


@register("SELECT category, vuln_id, wl_id, image_id, rule, band FROM banded")
def finding_scored(spark, d):
    return _banded(spark, d).select(*KEY, "rule", "band")


@register("SELECT rule, band, count(*) AS n FROM banded GROUP BY rule, band")
def band_reason_counts(spark, d):
    return _banded(spark, d).groupBy("rule", "band").agg(F.count("*").alias("n"))


@register("""SELECT c.cluster_name, x.vuln_id, x.severity, CASE
    WHEN k.vuln_id IS NOT NULL THEN 1 WHEN x.severity = 'critical' THEN 2 WHEN x.severity = 'high' AND c.env = 'prod' THEN 3 ELSE 4 END AS rule, count(*) AS n
    FROM (SELECT *, wl_id % 5 AS cluster_id FROM observation) x JOIN cluster c USING (cluster_id)
    LEFT JOIN kev k ON k.vuln_id = x.vuln_id AND x.category = 'vulnerability' GROUP BY ALL""")
def cluster_scoped_scored(spark, d):
    rows = lens.observations(spark, d).withColumn("cluster_id", F.col("wl_id") % 5)
    rows = findings.enrich(rows.withColumns({"wl_id": F.lit(None).cast("long")}), lens.epss(spark, d), lens.kev(spark, d)).join(lens.clusters(spark, d), "cluster_id")
    rows = rows.withColumns({"is_exposed": F.lit(False), "escalation": F.lit(False), "sensitive": F.lit(False)})
    return findings.score(rows).groupBy("cluster_name", "vuln_id", "severity", "rule").agg(F.count("*").alias("n"))


@register("SELECT category, vuln_id, wl_id, image_id, band FROM visible")
def visible_findings(spark, d):
    return _visible(spark, d).select(*KEY, "band")


@register("SELECT category, vuln_id, wl_id, image_id FROM relevant WHERE order_id IN (SELECT order_id FROM muted)")
def muted_findings(spark, d):
    return _relevant(spark, d).join(findings.muting(lens.actions(spark, d), _at(lens.AS_OF)).select("order_id"), "order_id", "left_semi").select(*KEY)


@register("""SELECT u.wl_id, u.image_id, count(*) FILTER (WHERE band = 'immediate') AS immediate, count(*) FILTER (WHERE band = 'out_of_cycle') AS out_of_cycle,
    count(*) FILTER (WHERE band = 'scheduled') AS scheduled, count(*) FILTER (WHERE band = 'defer') AS defer, count(v.wl_id) AS total
    FROM (SELECT DISTINCT wl_id, image_id FROM observation JOIN workload USING (wl_id) WHERE deployed) u LEFT JOIN visible v ON v.wl_id = u.wl_id AND v.image_id = u.image_id GROUP BY u.wl_id, u.image_id""")
def workload_image_bands(spark, d):
    deployed = lens.workloads(spark, d).where("deployed").select("wl_id")
    use = lens.observations(spark, d).join(deployed, "wl_id", "left_semi").select("wl_id", "image_id")
    return views.image_rows(use, _visible(spark, d))


@register("""SELECT category, vuln_id, wl_id, image_id, CAST(row_number() OVER (PARTITION BY wl_id ORDER BY
    CASE band WHEN 'immediate' THEN 0 WHEN 'out_of_cycle' THEN 1 WHEN 'scheduled' THEN 2 ELSE 3 END,
    CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END,
    epss_percentile DESC, last_seen DESC, category, vuln_id, image_id) AS BIGINT) AS place FROM visible""")
def findings_urgency_order(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("wl_id").orderBy(*findings.urgency_order(None), "category", "vuln_id", "image_id")
    return _visible(spark, d).select(*KEY, F.row_number().over(w).cast("long").alias("place"))


@register("SELECT wl_name, ns_name, scheduled FROM listed ORDER BY scheduled DESC, lower(wl_name) DESC LIMIT 50")
def workloads_sorted_by_key(spark, d):
    return findings.ranked_list(_listed(spark, d), "scheduled").select("wl_name", "ns_name", "scheduled").limit(50)


@register("SELECT wl_id, immediate FROM listed WHERE immediate > 0 AND cluster_name IN ('ASIA', 'AFRICA')")
def having_immediate(spark, d):
    return _listed(spark, d).where("immediate > 0 AND cluster_name IN ('ASIA', 'AFRICA')").select("wl_id", "immediate")


@register("SELECT p_partkey AS image_id, EXISTS (SELECT 1 FROM observation o JOIN workload w USING (wl_id) WHERE o.image_id = p_partkey AND w.deployed) AS currently_deployed FROM part")
def image_currently_deployed(spark, d):
    images = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("image_id"))
    use = lens.observations(spark, d).join(lens.workloads(spark, d).where("deployed"), "wl_id", "left_semi")
    return views.currently_deployed(images, use)


@register("""SELECT category, vuln_id, wl_id, image_id FROM finding WHERE image_id NOT IN (SELECT o.image_id FROM observation o JOIN workload w USING (wl_id) JOIN namespace n USING (ns_id) JOIN cluster c USING (cluster_id) WHERE w.deployed AND c.cluster_name = 'ASIA')""")
def findings_not_running_image(spark, d):
    """Findings whose image nothing deployed runs in one cluster."""
    homes = lens.workloads(spark, d).where("deployed").join(lens.namespaces(spark, d), "ns_id").join(lens.clusters(spark, d).where("cluster_name = 'ASIA'"), "cluster_id")
    use = lens.observations(spark, d).join(homes.select("wl_id"), "wl_id", "left_semi")
    return views.running_only(_folded(spark, d), use, running=False).select(*KEY)


@register("""SELECT c.cluster_name, count(DISTINCT n.ns_id) AS namespaces, count(DISTINCT n.ns_id) FILTER (WHERE l.ns_id IS NOT NULL) AS active,
    count(DISTINCT n.ns_id) FILTER (WHERE l.ns_id IS NOT NULL AND n.ns_exposed) AS exposed
    FROM cluster c LEFT JOIN namespace n USING (cluster_id) LEFT JOIN (SELECT DISTINCT ns_id FROM workload WHERE deployed) l ON l.ns_id = n.ns_id GROUP BY c.cluster_name""")
def cluster_namespace_counts(spark, d):
    return views.namespace_counts(lens.namespaces(spark, d), lens.workloads(spark, d), lens.clusters(spark, d))


@register("SELECT n.ns_id, n.ns_name, count(w.wl_id) FILTER (WHERE w.deployed) AS n_findings FROM namespace n LEFT JOIN wide w USING (ns_id) GROUP BY n.ns_id, n.ns_name")
def namespace_finding_counts(spark, d):
    return views.namespace_findings(lens.namespaces(spark, d), _wide(spark, d))


@register("SELECT n.ns_id, CASE WHEN n.ns_id % 7 = 0 THEN n.ns_exposed ELSE coalesce((SELECT bool_or(exposed AND deployed) FROM workload w WHERE w.ns_id = n.ns_id), false) END AS ns_exposed FROM namespace n")
def namespace_exposure_rollup(spark, d):
    own = lens.workloads(spark, d).withColumn("exposed", F.col("exposed") & F.col("deployed"))
    return views.exposure_rollup(lens.namespaces(spark, d), own, F.col("ns_id") % 7 == 0).select("ns_id", "ns_exposed")


@register("SELECT DISTINCT ns_name FROM namespace WHERE ns_id IN (SELECT ns_id FROM workload WHERE deployed)")
def namespace_selector(spark, d):
    return views.selector_names(lens.namespaces(spark, d), lens.workloads(spark, d))


@register("SELECT severity, count(*) AS n FROM finding GROUP BY severity")
def severity_counts(spark, d):
    return _folded(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@register("SELECT wl_id, band, count(*) AS n FROM banded GROUP BY wl_id, band")
def priority_counts(spark, d):
    return _banded(spark, d).groupBy("wl_id", "band").agg(F.count("*").alias("n"))


_N = ", ".join(f"count(f.wl_id) FILTER (WHERE f.{m} = '{v}') AS {v}" for m, values in (("severity", S.SEVERITIES), ("band", S.BANDS)) for v in values)


@register(f""", loose AS (SELECT wl_id % 5 AS cluster_id, severity FROM observation WHERE category = 'config' AND line = 1), counted AS (
      SELECT cluster_id, ns_id, wl_id, severity, band FROM banded UNION ALL SELECT cluster_id, NULL, NULL, severity, 'scheduled' FROM loose)
    SELECT s.scope, s.cluster_id, s.ns_id, s.wl_id, {_N.replace("count(f.wl_id)", "count(f.severity)")}, count(f.severity) AS total FROM (
      SELECT 'global' AS scope, -1::BIGINT AS cluster_id, -1::BIGINT AS ns_id, -1::BIGINT AS wl_id UNION ALL
      SELECT 'cluster', cluster_id, -1, -1 FROM cluster UNION ALL
      SELECT 'namespace', cluster_id, ns_id, -1 FROM namespace WHERE ns_id % 4 <> 0 UNION ALL
      SELECT 'workload', cluster_id, ns_id, wl_id FROM workload JOIN namespace USING (ns_id) WHERE deployed) s
    LEFT JOIN counted f ON (s.cluster_id = -1 OR s.cluster_id = f.cluster_id) AND (s.ns_id = -1 OR s.ns_id = f.ns_id) AND (s.wl_id = -1 OR s.wl_id = f.wl_id)
    GROUP BY s.scope, s.cluster_id, s.ns_id, s.wl_id""")
def heartbeat_rollup(spark, d):
    """Findings of workloads and of clusters themselves, counted for the whole, every cluster, active namespaces and deployed workloads."""
    spaces = lens.namespaces(spark, d)
    scopes = snapshots.scopes(lens.clusters(spark, d), spaces.where("ns_id % 4 <> 0"), lens.workloads(spark, d).where("deployed").join(spaces.select("ns_id", "cluster_id"), "ns_id"))
    loose = lens.observations(spark, d).where("category = 'config' AND line = 1").select((F.col("wl_id") % 5).alias("cluster_id"), "severity", F.lit("scheduled").alias("band"))
    rows = _banded(spark, d).select("cluster_id", "ns_id", "wl_id", "severity", "band").unionByName(loose, allowMissingColumns=True)
    return snapshots.heartbeat(rows, scopes, {"severity": S.SEVERITIES, "band": S.BANDS})


_SETS = """, item AS (SELECT DISTINCT wl_id, CAST(date_trunc('month', seen_at) AS TIMESTAMP) AS cycle, image_id FROM observation),
  step AS (SELECT wl_id, cycle, lag(cycle) OVER (PARTITION BY wl_id ORDER BY cycle) AS previous FROM (SELECT DISTINCT wl_id, cycle FROM item)),
  diff AS (SELECT s.wl_id, s.cycle, s.previous,
    (SELECT count(*) FROM item a WHERE a.wl_id = s.wl_id AND a.cycle = s.cycle AND NOT EXISTS (SELECT 1 FROM item b WHERE b.wl_id = s.wl_id AND b.cycle = s.previous AND b.image_id = a.image_id)) AS n_added,
    (SELECT count(*) FROM item b WHERE b.wl_id = s.wl_id AND b.cycle = s.previous AND NOT EXISTS (SELECT 1 FROM item a WHERE a.wl_id = s.wl_id AND a.cycle = s.cycle AND a.image_id = b.image_id)) AS n_removed FROM step s) """


def _sets(spark, d):
    return snapshots.image_sets(lens.observations(spark, d), F.date_trunc("month", "seen_at").cast("timestamp_ntz"))


@register(_SETS + """SELECT wl_id, cycle, n_added, n_removed, previous IS NOT NULL AND n_added + n_removed > 0 AS changed, CASE WHEN previous IS NULL THEN 'first_seen' WHEN n_added + n_removed = 0 THEN 'none'
    WHEN n_removed = 0 THEN 'added' WHEN n_added = 0 THEN 'removed' WHEN n_added = 1 AND n_removed = 1 THEN 'replaced' ELSE 'mixed' END AS change_kind FROM diff""")
def image_set_changes(spark, d):
    return snapshots.classified(_sets(spark, d)).select("wl_id", "cycle", "n_added", "n_removed", "changed", "change_kind")


@register(_SETS + """SELECT s.wl_id, s.cycle, 'added' AS what, a.image_id FROM step s JOIN item a ON a.wl_id = s.wl_id AND a.cycle = s.cycle
    WHERE NOT EXISTS (SELECT 1 FROM item b WHERE b.wl_id = s.wl_id AND b.cycle = s.previous AND b.image_id = a.image_id)
    UNION ALL SELECT s.wl_id, s.cycle, 'removed', b.image_id FROM step s JOIN item b ON b.wl_id = s.wl_id AND b.cycle = s.previous
    WHERE NOT EXISTS (SELECT 1 FROM item a WHERE a.wl_id = s.wl_id AND a.cycle = s.cycle AND a.image_id = b.image_id)""")
def image_set_diff_events(spark, d):
    rows = snapshots.classified(_sets(spark, d))
    one = lambda what: rows.select("wl_id", "cycle", F.lit(what).alias("what"), F.explode(what).alias("image_id"))
    return one("added").unionByName(one("removed"))


@register("""SELECT severity, CAST(date_trunc('month', last_seen) AS TIMESTAMP) AS at, count(*) AS n FROM finding WHERE last_seen >= TIMESTAMP '1997-01-01' - INTERVAL 365 DAY GROUP BY ALL""")
def snapshot_series(spark, d):
    rows = _folded(spark, d).withColumn("captured_at", F.col("last_seen"))
    return snapshots.series(rows, _at(lens.AS_OF), 1000).groupBy("severity", F.date_trunc("month", "captured_at").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"))


@register("SELECT wl_id, max(seen_at) AS last_at, coalesce(max(seen_at) >= TIMESTAMP '1998-10-01', false) AS deployed FROM workload LEFT JOIN observation USING (wl_id) GROUP BY wl_id")
def deployed_sweep(spark, d):
    seen = lens.observations(spark, d).groupBy("wl_id").agg(F.max("seen_at").alias("last_at"))
    return lifecycle.sweep(lens.workloads(spark, d).select("wl_id").join(seen, "wl_id", "left"), "last_at", _at("1998-10-01"))


@register("SELECT category, vuln_id, wl_id, image_id FROM finding WHERE last_seen >= TIMESTAMP '1997-01-01' - INTERVAL 30 DAY")
def observation_retention(spark, d):
    """What was observed within thirty days: all findings, as of the moment at which all views are taken."""
    return lifecycle.retained(_folded(spark, d), "last_seen", _at(lens.AS_OF)).select(*KEY)


@register("SELECT wl_id, image_id, max(seen_at) AS last_seen FROM observation GROUP BY wl_id, image_id HAVING max(seen_at) >= TIMESTAMP '2001-01-01' - INTERVAL 30 DAY")
def container_retention(spark, d):
    """Containers that were seen within thirty days."""
    pairs = lens.observations(spark, d).groupBy("wl_id", "image_id").agg(F.max("seen_at").alias("last_seen"))
    return lifecycle.retained(pairs, "last_seen", _at("2001-01-01"))


@register("SELECT wl_id, signal_id, active AND NOT (signal_id LIKE 'k%:KSV-%' AND last_seen < TIMESTAMP '2024-01-20') AS active FROM signal")
def signal_deactivation(spark, d):
    return lifecycle.deactivate(_signals(spark, d), G.reap_scope("trivy.ConfigAuditReport"), _at("2024-01-20"), F.lit(1)).select("wl_id", "signal_id", "active")


@register("SELECT * FROM signal")
def signal_fold(spark, d):
    return _signals(spark, d)


@register("""SELECT cluster_id, n AS observed_count, NOT (n = 0 AND cluster_id IN (SELECT cluster_id FROM wide)) AS reap
    FROM (SELECT cluster_id, (SELECT count(*) FROM action) * (cluster_id % 2) AS n FROM cluster)""")
def zero_input_gate(spark, d):
    n = lens.actions(spark, d).agg(F.count("*").alias("n"))
    marks = lens.clusters(spark, d).join(F.broadcast(n)).select("cluster_id", (F.col("n") * (F.col("cluster_id") % 2)).alias("observed_count"))
    return lifecycle.scope_gate(marks, _wide(spark, d), "cluster_id")


_MARKS = """, mark AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'vulnerability' WHEN '2-HIGH' THEN 'config' ELSE 'other' END AS source,
    CASE o_orderstatus WHEN 'F' THEN 'reaped' ELSE 'open' END AS state, o_orderdate AS started_at FROM orders) """


def _marks(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'vulnerability' WHEN '2-HIGH' THEN 'config' ELSE 'other' END").alias("source"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'reaped' ELSE 'open' END").alias("state"),
        F.col("o_orderdate").alias("started_at"),
    )


@register(_MARKS + "SELECT source, max(started_at) AS started_at FROM mark WHERE state = 'reaped' GROUP BY source")
def latest_mark_per_source(spark, d):
    return lifecycle.latest_marks(_marks(spark, d))


def _fresh(spark, d, marks):
    marks = marks.withColumn("started_at", F.col("started_at") - F.make_dt_interval(F.lit(300)))
    rows = _folded(spark, d).withColumn("source", F.col("category"))
    return lifecycle.fresh(rows, marks, ("vulnerability", "config", "exposed-secret")).select(*KEY)


@register(_MARKS + """SELECT f.category, f.vuln_id, f.wl_id, f.image_id FROM finding f LEFT JOIN (SELECT source, max(started_at) - INTERVAL 300 DAY AS at FROM mark WHERE state = 'reaped' GROUP BY source) m ON m.source = f.category
    WHERE f.category IN ('vulnerability', 'config', 'exposed-secret') AND (m.at IS NULL OR f.last_seen >= m.at)""")
def source_freshness(spark, d):
    return _fresh(spark, d, _marks(spark, d))


def _streaks(observations):
    rows = observations.groupBy("wl_id", F.date_trunc("month", "seen_at").cast("timestamp_ntz").alias("cycle")).agg(F.bool_or(F.col("severity") == "critical").alias("hit"))
    return lifecycle.streaks(rows, ["wl_id"], "cycle", "hit")


@register(""", month AS (SELECT wl_id, CAST(date_trunc('month', seen_at) AS TIMESTAMP) AS cycle, bool_or(severity = 'critical') AS hit FROM observation GROUP BY ALL),
    run AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY wl_id ORDER BY cycle) AS r FROM month)
    SELECT wl_id, cycle, hit, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY wl_id, r ORDER BY cycle) AS BIGINT) AS streak FROM run""")
def coverage_gap_streaks(spark, d):
    return _streaks(lens.observations(spark, d))


@register("""SELECT DISTINCT 'CVE-' || (l_partkey % 900) AS vuln_id FROM lineitem WHERE 'CVE-' || (l_partkey % 900) NOT IN (SELECT 'CVE-' || (p_partkey % 700) FROM part WHERE p_partkey % 10 NOT IN (7, 8))""", on_lens=False)
def epss_refresh_antijoin(spark, d):
    """What the stored exploit probabilities have and a new feed does not: they go."""
    stored = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("concat('CVE-', l_partkey % 900) AS vuln_id").distinct()
    return lifecycle.gone(stored, feeds.epss_rows(payloads.epss_lines(spark, d)), "vuln_id")


@register("SELECT vuln_id, 'feed' AS origin FROM kev WHERE vuln_id IN (SELECT vuln_id FROM observation)")
def kev_refresh(spark, d):
    feed = lens.kev(spark, d).join(lens.observations(spark, d), "vuln_id", "left_semi").withColumn("origin", F.lit("feed"))
    return lifecycle.replaced(lens.kev(spark, d).withColumn("origin", F.lit("old")), feed)


_NAMES = "element_at(array('prod-%s', '%s-production', 'x_stage_%s', '%s-qa', 'product-%s', 'dev', 'Prod-%s'), cast({k} % 7 + 1 AS int))"


@register("""SELECT s_suppkey AS id, name, CASE WHEN regexp_matches(name, '(^|[-_])prod([-_]|$)') THEN 'prod' WHEN regexp_matches(name, '(^|[-_])production([-_]|$)') THEN 'prod'
    WHEN regexp_matches(name, '(^|[-_])stag(e|ing)?([-_]|$)') THEN 'staging' ELSE 'dev' END AS env FROM (
    SELECT s_suppkey, replace(CASE s_suppkey % 7 WHEN 0 THEN 'prod-%s' WHEN 1 THEN '%s-production' WHEN 2 THEN 'x_stage_%s' WHEN 3 THEN '%s-qa' WHEN 4 THEN 'product-%s' WHEN 5 THEN 'dev' ELSE 'Prod-%s' END, '%s', CAST(s_suppkey AS VARCHAR)) AS name FROM supplier)""", on_lens=False)
def env_from_name(spark, d):
    name = F.replace(F.expr(_NAMES.format(k="s_suppkey")), F.lit("%s"), F.col("s_suppkey").cast("string"))
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), name.alias("name")).withColumn("env", S.environment(F.col("name")))


@register("""SELECT raw, CASE WHEN lower(raw) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(raw) ELSE 'unknown' END AS scanner,
    CASE WHEN lower(raw) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(raw) ELSE 'medium' END AS policy, count(*) AS n
    FROM (SELECT CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'LOW' WHEN 4 THEN 'info' WHEN 5 THEN 'None' ELSE '' END AS raw FROM lineitem) GROUP BY raw""", on_lens=False)
def severity_normalise(spark, d):
    raw = F.expr("CASE cast(l_quantity AS int) % 7 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'LOW' WHEN 4 THEN 'info' WHEN 5 THEN 'None' ELSE '' END")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return rows.select("raw", S.scanner_severity(F.col("raw")).alias("scanner"), S.policy_severity(F.col("raw")).alias("policy"), "n")


_CHECK_SQL = """(SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'KSV' || lpad(CAST(p_partkey % 60 AS VARCHAR), 3, '0') WHEN 1 THEN 'KSV-' || lpad(CAST(p_partkey % 60 AS VARCHAR), 4, '0')
    WHEN 2 THEN 'AVD-KSV-' || lpad(CAST(p_partkey % 60 AS VARCHAR), 4, '0') WHEN 3 THEN 'KSVabc' WHEN 4 THEN '' ELSE 'DS' || CAST(p_partkey % 60 AS VARCHAR) END AS check_id FROM part)"""


def _check_ids(spark, d):
    made = F.expr("""CASE p_partkey % 6 WHEN 0 THEN concat('KSV', lpad(cast(p_partkey % 60 AS string), 3, '0')) WHEN 1 THEN concat('KSV-', lpad(cast(p_partkey % 60 AS string), 4, '0'))
        WHEN 2 THEN concat('AVD-KSV-', lpad(cast(p_partkey % 60 AS string), 4, '0')) WHEN 3 THEN 'KSVabc' WHEN 4 THEN '' ELSE concat('DS', cast(p_partkey % 60 AS string)) END""")
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), made.alias("check_id"))


@register("SELECT id, check_id, CASE WHEN check_id LIKE 'AVD-%' THEN check_id WHEN regexp_matches(check_id, '^KSV-*[0-9]+$') THEN 'AVD-KSV-' || lpad(CAST(CAST(regexp_extract(check_id, '([0-9]+)$', 1) AS INT) AS VARCHAR), 4, '0') WHEN check_id LIKE 'KSV%' THEN 'AVD-' || check_id ELSE check_id END AS avd_id FROM " + _CHECK_SQL, on_lens=False)
def avd_normalise(spark, d):
    return _check_ids(spark, d).withColumn("avd_id", S.avd_id(F.col("check_id")))


@register(f"""SELECT c.id, r.signal_id FROM {_CHECK_SQL} c LEFT JOIN (SELECT * FROM (VALUES {G.VALUES_SQL}) t(signal_id, source, category, matcher) WHERE source = 'trivy') r
    ON r.matcher = 'KSV-' || lpad(CAST(TRY_CAST(regexp_extract(c.check_id, 'KSV-?([0-9]+)$', 1) AS INT) AS VARCHAR), 4, '0')""", on_lens=False)
def signal_lookup(spark, d):
    return G.lookup(_check_ids(spark, d), "check_id").select("id", "signal_id")


_REF = "CASE p_partkey % 6 WHEN 0 THEN 'r' || p_size || '.example.io/team/app' || p_partkey || ':1.' || p_size WHEN 1 THEN 'nginx:' || p_size WHEN 2 THEN 'lib/app@sha256:' || sha256(CAST(p_partkey AS VARCHAR)) WHEN 3 THEN 'host:5000/app' || p_partkey WHEN 4 THEN 'app@md5:1' ELSE 'q.io/a/b:2@sha256:ab' || p_partkey END"


def _refs(spark, d):
    made = F.expr(_REF.replace("sha256(CAST(p_partkey AS VARCHAR))", "sha2(cast(p_partkey AS string), 256)"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), made.alias("ref"))


@register(f"SELECT p_partkey AS id, CASE WHEN regexp_matches({_REF}, '^[^@]*@sha256:') THEN regexp_extract({_REF}, '^[^@]*@(sha256:.*)$', 1) ELSE '' END AS digest FROM part", on_lens=False)
def digest_parse(spark, d):
    return _refs(spark, d).select("id", S.ref_digest(F.col("ref")).alias("digest"))


@register(f"""SELECT id, CASE WHEN has THEN head ELSE '' END AS registry, CASE WHEN has THEN substr(path, strpos(path, '/') + 1) ELSE path END AS repository FROM (
    SELECT *, strpos(path, '/') > 0 AND (strpos(head, '.') > 0 OR strpos(head, ':') > 0) AS has FROM (SELECT *, split_part(path, '/', 1) AS head FROM (
    SELECT p_partkey AS id, regexp_replace(split_part({_REF}, '@', 1), ':[^:]*$', '') AS path FROM part)))""", on_lens=False)
def registry_repo_split(spark, d):
    return _refs(spark, d).select("id", S.registry_of(F.col("ref")).alias("registry"), S.repository_of(F.col("ref")).alias("repository"))


@register("""SELECT p_partkey AS id, CASE WHEN reg = '' OR starts_with(repo, reg || '/') THEN repo ELSE reg || '/' || repo END || CASE WHEN tag = '' THEN '' ELSE ':' || tag END AS ref FROM (SELECT p_partkey,
    CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'r.io' END AS reg, CASE p_partkey % 2 WHEN 0 THEN 'r.io/' ELSE '' END || 'app' || p_partkey AS repo, CASE p_partkey % 5 WHEN 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS tag FROM part)""", on_lens=False)
def image_ref_build(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("id"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN NULL ELSE 'r.io' END").alias("reg"),
        F.expr("concat(CASE p_partkey % 2 WHEN 0 THEN 'r.io/' ELSE '' END, 'app', p_partkey)").alias("repo"),
        F.expr("CASE p_partkey % 5 WHEN 0 THEN '' ELSE cast(p_size AS string) END").alias("tag"),
    )
    return parts.select("id", S.image_ref(F.col("reg"), F.col("repo"), F.col("tag")).alias("ref"))


@register("SELECT l_partkey % 300 AS v, CASE WHEN l_partkey % 300 % 7 = 0 THEN 'none' WHEN (l_partkey % 300) / 300.0 >= 0.5 THEN 'red' WHEN (l_partkey % 300) / 300.0 >= 0.1 THEN 'orange' WHEN (l_partkey % 300) / 300.0 >= 0.01 THEN 'yellow' ELSE 'grey' END AS bucket, count(*) AS n FROM lineitem GROUP BY ALL", on_lens=False)
def epss_bucket(spark, d):
    v = F.col("l_partkey") % 300
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    return rows.select("v", S.epss_bucket(F.when(F.col("v") % 7 != 0, F.col("v") / 300.0)).alias("bucket"), "n")


def _labelled(spark, d):
    return lens.workloads(spark, d).select("wl_id", "ns_id", F.expr("map('app', concat('a', wl_id % 10), 'tier', concat('t', wl_id % 3))").alias("labels"))


def _services(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_custkey").alias("svc_id"),
        F.col("c_nationkey").cast("long").alias("ns_id"),
        F.concat(F.lit("svc"), F.col("c_custkey") % 20).alias("svc_name"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN map('app', concat('a', c_custkey % 10)) WHEN 1 THEN map('app', concat('a', c_custkey % 10), 'tier', concat('t', c_custkey % 4)) ELSE cast(map() AS map<string,string>) END").alias("selector"),
    )


_MATCH = """, matched AS (SELECT c_custkey AS svc_id, wl_id, ns_id, 'svc' || (c_custkey % 20) AS svc_name FROM customer JOIN workload ON ns_id = c_nationkey
    WHERE c_custkey % 3 < 2 AND wl_id % 10 = c_custkey % 10 AND (c_custkey % 3 = 0 OR wl_id % 3 = c_custkey % 4)) """


@register(_MATCH + "SELECT svc_id, wl_id FROM matched")
def selector_match(spark, d):
    return resolve.match_selectors(_services(spark, d), _labelled(spark, d))


@register(_MATCH + """SELECT DISTINCT o_orderkey AS ing_id, wl_id FROM orders JOIN matched ON ns_id = o_custkey % 25 AND svc_name IN ('svc' || (o_orderkey % 20), 'svc' || (o_custkey % 20))""")
def ingress_backends(spark, d):
    ing = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ing_id"), (F.col("o_custkey") % 25).alias("ns_id"), F.expr("array(concat('svc', o_orderkey % 20), concat('svc', o_custkey % 20))").alias("backends"))
    return resolve.ingress_selected(ing, _services(spark, d), _labelled(spark, d))


@register("""WITH RECURSIVE chain AS (SELECT p_partkey AS node, p_partkey // 4 AS owner, 1 AS hops FROM part WHERE p_partkey > 9
    UNION ALL SELECT node, owner // 4, hops + 1 FROM chain WHERE owner > 9) SELECT node, owner, hops FROM chain WHERE owner <= 9 AND owner > 0""", on_lens=False)
def alias_chain(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("child")).where("child > 9")
    known = spark.range(1, 10).withColumnRenamed("id", "node")
    return resolve.owners(parts.withColumn("parent", F.expr("child div 4")), known)


@register("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS cycle_start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL", on_lens=False)
def cycle_windows(spark, d):
    return cycles.cycle_counts(spark.read.parquet(f"{d}/events.parquet"))


@register("SELECT cluster_name, category, max(last_seen) AS last_at, CASE WHEN max(last_seen) < TIMESTAMP '1998-11-01' THEN 'STALE' ELSE 'ok' END AS health FROM wide GROUP BY ALL")
def scan_health(spark, d):
    rows = _wide(spark, d).groupBy("cluster_name", "category").agg(F.max("last_seen").alias("last_at"))
    return rows.withColumn("health", F.when(F.col("last_at") < _at("1998-11-01"), "STALE").otherwise("ok"))


@register("SELECT vuln_id, max(epss_percentile) AS percentile, count(*) AS n FROM enriched GROUP BY vuln_id ORDER BY percentile DESC, vuln_id LIMIT 20")
def top_epss(spark, d):
    rows = _enriched(spark, d).groupBy("vuln_id").agg(F.max("epss_percentile").alias("percentile"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("percentile"), "vuln_id").limit(20)


@register("SELECT cluster_name, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium FROM wide GROUP BY cluster_name")
def severity_cluster_pivot(spark, d):
    return _wide(spark, d).groupBy("cluster_name").pivot("severity", ["critical", "high", "medium"]).agg(F.count("vuln_id")).fillna(0)


@register("""SELECT image_id, count(DISTINCT wl_id) AS workloads, count(*) FILTER (WHERE band = 'immediate') AS immediate, count(*) FILTER (WHERE kev_listed) AS kev, count(*) FILTER (WHERE epss_percentile >= 0.9) AS high_epss,
    count(*) FILTER (WHERE fixed_version <> '') AS fixable, count(*) AS total FROM visible GROUP BY image_id""")
def image_rollup(spark, d):
    n = lambda c, name: F.count_if(c).alias(name)
    return _visible(spark, d).groupBy("image_id").agg(F.count_distinct("wl_id").alias("workloads"), n(F.col("band") == "immediate", "immediate"), n(F.col("kev_listed"), "kev"), n(F.col("epss_percentile") >= 0.9, "high_epss"), n(F.col("fixed_version") != "", "fixable"), F.count("*").alias("total"))


@register("SELECT count(*) AS total, count(*) FILTER (WHERE kev_listed) AS kev, count(*) FILTER (WHERE band = 'immediate') AS immediate, count(*) FILTER (WHERE last_seen >= TIMESTAMP '1997-01-01' - INTERVAL 7 DAY AND first_seen < TIMESTAMP '1997-01-01') AS this_week FROM visible")
def kpi_cards(spark, d):
    week = (F.col("last_seen") >= _at(lens.AS_OF) - F.make_dt_interval(F.lit(7))) & (F.col("first_seen") < _at(lens.AS_OF))
    return _visible(spark, d).agg(F.count("*").alias("total"), F.count_if("kev_listed").alias("kev"), F.count_if(F.col("band") == "immediate").alias("immediate"), F.count_if(week).alias("this_week"))


@register("SELECT order_id, action, expires_at FROM action WHERE action = 'accept' AND NOT revoked AND expires_at > TIMESTAMP '1997-01-01' AND expires_at <= TIMESTAMP '1997-01-31'")
def expiring_acceptances(spark, d):
    rows = findings.muting(lens.actions(spark, d), _at(lens.AS_OF)).where("action = 'accept'")
    return rows.where(F.col("expires_at") <= _at(lens.AS_OF) + F.make_dt_interval(F.lit(30))).select("order_id", "action", "expires_at")


@register("SELECT wl_id, wl_name, kind FROM workload WHERE deployed AND lower(wl_name) LIKE '%er#0%' ORDER BY lower(wl_name) LIMIT 25 OFFSET 25")
def workload_search_page(spark, d):
    rows = views.searched(lens.workloads(spark, d), {"deployed": True, "kind": None}, {"wl_name": "ER#0"})
    return views.page(rows, [F.lower("wl_name")], number=2).select("wl_id", "wl_name", "kind")


@register("SELECT b.category, b.vuln_id, b.wl_id, b.image_id, b.band FROM banded b WHERE b.band <> CASE WHEN b.severity = 'critical' THEN 'immediate' ELSE 'defer' END")
def rescored_changes(spark, d):
    stored = F.when(F.col("severity") == "critical", "immediate").otherwise("defer")
    return findings.moved(_banded(spark, d).withColumn("stored_band", stored), "stored_band").select(*KEY, "band")


@register("SELECT cluster_id, CASE WHEN cluster_id = 2 THEN 'prod' ELSE env END AS env FROM cluster")
def manual_environment(spark, d):
    manual = spark.range(2, 3).select(F.col("id").alias("cluster_id"), F.lit("prod").alias("env"))
    return lifecycle.with_manual(lens.clusters(spark, d), manual, "cluster_id", "env").select("cluster_id", "env")


@register("""SELECT * FROM (VALUES
    (0, 'cluster_exists', (SELECT count(*) FROM cluster WHERE cluster_name = 'ASIA') > 0, (SELECT count(*) FROM cluster WHERE cluster_name = 'ASIA')),
    (1, 'workload_count', (SELECT count(*) FROM workload WHERE deployed) >= 1, (SELECT count(*) FROM workload WHERE deployed)),
    (2, 'finding_priority', (SELECT count(*) FROM banded WHERE rule = 1) > 0, (SELECT count(*) FROM banded WHERE rule = 1)),
    (3, 'signal_present', (SELECT count(*) FROM signal WHERE active AND signal_id = 'ksv:KSV-0051') > 0, (SELECT count(*) FROM signal WHERE active AND signal_id = 'ksv:KSV-0051')),
    (4, 'no_such_kind', false, 0),
    (5, 'namespace_count', (SELECT count(*) FROM namespace) = 25, (SELECT count(*) FROM namespace)),
    (6, 'workload_absent', (SELECT count(*) FROM workload WHERE wl_name = 'nobody') = 0, (SELECT count(*) FROM workload WHERE wl_name = 'nobody')),
    (7, 'finding_exists', (SELECT count(*) FROM banded WHERE severity IN ('critical', 'high')) > 0, (SELECT count(*) FROM banded WHERE severity IN ('critical', 'high'))),
    (8, 'signal_absent', (SELECT count(*) FROM signal WHERE active AND signal_id = 'kp:none') = 0, (SELECT count(*) FROM signal WHERE active AND signal_id = 'kp:none')),
    (9, 'import_mark', (SELECT bool_and(source IN ('vulnerability', 'config', 'other')) FROM mark), (SELECT count(*) FROM mark)),
    (10, 'snapshot_count', false, (SELECT count(*) FROM finding)),
    (11, 'snapshot_count', (SELECT count(*) FROM finding) >= 3, (SELECT count(*) FROM finding)),
    (12, 'enrichment', (SELECT coalesce(bool_and(percentile = 0.05), false) FROM epss WHERE vuln_id = 'CVE-0005'), (SELECT count(*) FROM epss WHERE vuln_id = 'CVE-0005')),
    (13, 'snapshot_absent_since', (SELECT count(*) FROM finding WHERE last_seen >= TIMESTAMP '1999-06-01') = 0, (SELECT count(*) FROM finding WHERE last_seen >= TIMESTAMP '1999-06-01')),
    (14, 'scan_health_widget', true, 0),
    (15, 'observation_count', false, 0)) t("index", kind, pass, found)""".replace("SELECT * FROM (VALUES", ", mark AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'vulnerability' WHEN '2-HIGH' THEN 'config' ELSE 'other' END AS source FROM orders) SELECT * FROM (VALUES", 1))
def assertion_batch(spark, d):
    captured = _folded(spark, d).withColumn("captured_at", F.col("last_seen"))
    tables = {"clusters": lens.clusters(spark, d), "workloads": lens.workloads(spark, d), "namespaces": lens.namespaces(spark, d), "findings": _banded(spark, d), "signals": _signals(spark, d), "marks": _marks(spark, d), "snapshots": captured, "feed": lens.epss(spark, d)}
    asked = [
        {"kind": "cluster_exists", "filter": {"cluster_name": "ASIA"}},
        {"kind": "workload_count", "filter": {"deployed": True}, "min": 1},
        {"kind": "finding_priority", "filter": {"rule": 1}, "attributes": {"band": "immediate"}},
        {"kind": "signal_present", "filter": {"signal_id": "ksv:KSV-0051"}},
        {"kind": "no_such_kind"},
        {"kind": "namespace_count", "expect": 25},
        {"kind": "workload_absent", "filter": {"wl_name": "nobody"}},
        {"kind": "finding_exists", "filter": {"severity": ["critical", "high"]}},
        {"kind": "signal_absent", "filter": {"signal_id": "kp:none"}},
        {"kind": "import_mark"},
        {"kind": "snapshot_count"},
        {"kind": "snapshot_count", "min": 3},
        {"kind": "enrichment", "filter": {"vuln_id": "CVE-0005"}, "attributes": {"percentile": 0.05}},
        {"kind": "snapshot_absent_since", "since": "1999-06-01"},
        {"kind": "scan_health_widget"},
        {"kind": "observation_count", "min": 1},
    ]
    return checks.evaluate(spark, tables, asked).select(F.col("index").cast("int").alias("index"), "kind", "pass", "found")


@register("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS cycle_start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL", on_lens=False)
def stream_cycle_replay(spark, d):
    """The batch table replayed as a stream into the shared folder; without late rows it gives what the batch gives."""
    import uuid

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"cycles_{uuid.uuid4().hex}"
    at, out = (f"{feeds.shared_folder(spark)}/{name}-{what}" for what in ("state", "out"))

    def write(batch: DataFrame, number: int) -> None:  # complete mode: each batch holds the whole result
        batch.write.mode("overwrite").parquet(out)

    run = cycles.cycle_counts(rows).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)
