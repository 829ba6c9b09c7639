"""Registered queries over what lands: reports, manifests and feeds as JSON, parsed to rows; and what a cycle makes of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import signals as G
from ravelin.operators import findings, lifecycle
from ravelin.plans import lens, payloads
from ravelin.queries import KEY, _at, _folded, _signals, register
from ravelin.sources import feeds, reports

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_CHECK = "CASE WHEN l_partkey % 4 = 0 THEN 'AVD-KSV-' || lpad(CAST(l_partkey % 60 AS VARCHAR), 4, '0') ELSE 'KSV' || lpad(CAST(l_partkey % 60 AS VARCHAR), 3, '0') END"
_CHECKS = f"""SELECT {{who}}, CASE WHEN l_linenumber % 2 = 0 THEN left(repeat('t' || l_partkey, 200), 512) ELSE {_CHECK} END AS title, {payloads.SEVERITY_SQL} AS severity, {{vuln}} AS vuln_id, s.signal_id, '{{category}}' AS category
    FROM {_LINES} LEFT JOIN (SELECT * FROM (VALUES {G.VALUES_SQL}) t(signal_id, source, category, matcher) WHERE source = 'trivy') s ON s.matcher = 'KSV-' || lpad(CAST(l_partkey % 60 AS VARCHAR), 4, '0')
    WHERE l_linenumber % 3 <> 0 OR l_linestatus <> 'F'"""
_AVD = "'AVD-KSV-' || lpad(CAST(l_partkey % 60 AS VARCHAR), 4, '0')"
_NOBODY = "'' AS namespace, '' AS kind, '' AS name, '' AS container"


@register(f"""SELECT {payloads.WHO_SQL}, CASE WHEN o_orderkey % 3 <> 0 THEN 'r.io/' ELSE '' END || 'team/app' || (o_custkey % 20) || ':1.' || (o_orderkey % 4) AS image_ref, CASE WHEN o_orderkey % 4 <> 0 THEN 'sha256:' || o_orderkey ELSE '' END AS image_digest,
    'alpine' AS os_family, CASE WHEN o_orderkey % 2 = 0 THEN '3.19' ELSE '' END AS os_version, o_orderkey % 7 = 0 AS base_eosl, 'CVE-' || (l_partkey % 300) AS vuln_id, 'pkg' || (l_suppkey % 10) AS pkg_name, '1.' || l_linenumber AS installed_version,
    CASE WHEN l_linestatus = 'F' THEN '2.0' ELSE '' END AS fixed_version, CASE WHEN l_linenumber % 2 = 0 THEN 'T' || l_partkey ELSE 'CVE-' || (l_partkey % 300) END AS title, {payloads.SEVERITY_SQL} AS severity,
    CASE WHEN l_linenumber > 2 THEN l_linenumber / 2.0::DOUBLE WHEN l_linenumber = 1 THEN 4.5 END AS cvss_score, CASE WHEN l_linenumber = 1 THEN 'AV:N' ELSE '' END AS cvss_vector FROM {_LINES}""", on_lens=False)
def parse_vulnerability_reports(spark, d):
    return reports.vulnerability_rows(payloads.vulnerabilities(spark, d))


@register(_CHECKS.format(who=payloads.WHO_SQL, vuln=_AVD, category="config"), on_lens=False)
def parse_config_audits(spark, d):
    return reports.check_rows(payloads.checks(spark, d), "config")


@register(_CHECKS.format(who=payloads.WHO_SQL, vuln=_AVD, category="rbac"), on_lens=False)
def parse_rbac_assessments(spark, d):
    return reports.check_rows(payloads.checks(spark, d), "rbac")


@register(_CHECKS.format(who=_NOBODY, vuln=_AVD, category="rbac"), on_lens=False)
def parse_cluster_rbac(spark, d):
    """Findings of the cluster itself: no workload."""
    return reports.check_rows(payloads.checks(spark, d, whole_cluster=True), "rbac")


@register(_CHECKS.format(who=payloads.WHO_SQL, vuln=_CHECK, category="compliance"), on_lens=False)
def parse_compliance_reports(spark, d):
    return reports.check_rows(payloads.checks(spark, d), "compliance")


@register(f"""SELECT {payloads.WHO_SQL}, 'rule-' || (l_partkey % 9) AS vuln_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Key ' || l_suppkey ELSE 'rule-' || (l_partkey % 9) END AS title, {payloads.SEVERITY_SQL} AS severity, 'kp:exposed-secret-in-image' AS signal_id FROM {_LINES}""", on_lens=False)
def parse_secret_reports(spark, d):
    return reports.secret_rows(payloads.secrets(spark, d))


@register(f"""SELECT coalesce(w.own, CASE WHEN w.scoped THEN 'scoped' ELSE 'ns' || (o_custkey % 25) END) AS namespace, w.kind, w.name, p.policy, p.policy || CASE WHEN l_linenumber % 2 = 0 THEN '/rule1' ELSE '' END AS title,
    CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'medium' END AS severity, s.signal_id
    FROM {_LINES}, LATERAL (SELECT CASE l_partkey % 3 WHEN 0 THEN 'disallow-privileged-containers' WHEN 1 THEN 'disallow-host-path' ELSE 'own-policy' END AS policy) p,
    LATERAL (SELECT 'Deployment' AS kind, 's' || l_suppkey AS name, CASE WHEN l_suppkey % 2 = 0 THEN 'n' || (l_suppkey % 5) END AS own, false AS scoped WHERE l_linenumber % 3 = 0
      UNION ALL SELECT 'Deployment', x || l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'n' || (l_suppkey % 5) END, false FROM (VALUES ('a'), ('b')) v(x) WHERE l_linenumber % 3 = 1
      UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Pod' ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN 'pod' || o_orderkey ELSE '' END, NULL, o_orderkey % 2 = 0 WHERE l_linenumber % 3 = 2) w
    LEFT JOIN (SELECT * FROM (VALUES {G.VALUES_SQL}) t(signal_id, source, category, matcher) WHERE source = 'kyverno') s ON s.matcher = p.policy WHERE l_returnflag <> 'R'""", on_lens=False)
def parse_policy_reports(spark, d):
    return reports.policy_rows(payloads.policies(spark, d))


_FAILED = f"""SELECT {payloads.SEVERITY_SQL} AS severity, CASE WHEN l_linenumber % 2 = 0 THEN left(repeat('t' || l_partkey, 200), 512) ELSE {_CHECK} END AS title FROM lineitem WHERE l_linenumber % 3 <> 0 OR l_linestatus <> 'F'"""
_CHECK_KINDS = {"trivy.ConfigAuditReport": "config", "trivy.RbacAssessmentReport": "rbac", "trivy.ClusterRbacAssessmentReport": "rbac", "trivy.InfraAssessmentReport": "compliance", "trivy.ClusterComplianceReport": "compliance"}


@register(f"""WITH failed AS ({_FAILED}), policy AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'medium' END AS severity, CASE l_partkey % 3 WHEN 0 THEN 'disallow-privileged-containers' WHEN 1 THEN 'disallow-host-path' ELSE 'own-policy' END || CASE WHEN l_linenumber % 2 = 0 THEN '/rule1' ELSE '' END AS title
      FROM lineitem, (VALUES (1), (2)) twice(k) WHERE l_returnflag <> 'R' AND (k = 1 OR l_linenumber % 3 = 1))
    SELECT scan_kind, category, severity, count(*) AS n, count(DISTINCT title) AS titles FROM (
    SELECT 'trivy.VulnerabilityReport' AS scan_kind, 'vulnerability' AS category, {payloads.SEVERITY_SQL} AS severity, CASE WHEN l_linenumber % 2 = 0 THEN 'T' || l_partkey ELSE 'CVE-' || (l_partkey % 300) END AS title FROM lineitem
    UNION ALL SELECT kind, category, severity, title FROM failed, (VALUES {", ".join(str(x) for x in _CHECK_KINDS.items())}) v(kind, category)
    UNION ALL SELECT kind, 'policy', severity, title FROM policy, (VALUES ('kyverno.PolicyReport'), ('kyverno.ClusterPolicyReport')) v(kind)
    UNION ALL SELECT 'trivy.ExposedSecretReport', 'exposed-secret', {payloads.SEVERITY_SQL}, CASE WHEN l_linenumber % 2 = 0 THEN 'Key ' || l_suppkey ELSE 'rule-' || (l_partkey % 9) END FROM lineitem) GROUP BY ALL""", on_lens=False)
def scan_kinds_union(spark, d):
    """All nine kinds of scans as one table, counted."""
    checks, policies = payloads.checks(spark, d), payloads.policies(spark, d)
    by_kind = {k: checks for k in _CHECK_KINDS} | {"trivy.VulnerabilityReport": payloads.vulnerabilities(spark, d), "trivy.ExposedSecretReport": payloads.secrets(spark, d)}
    by_kind |= {k: policies for k in ("kyverno.PolicyReport", "kyverno.ClusterPolicyReport")} | {"trivy.ClusterRbacAssessmentReport": payloads.checks(spark, d, whole_cluster=True)}
    return reports.scan_counts(by_kind)


def _inventory(spark, d):
    return reports.Inventory(payloads.manifests(spark, d))


_KIND = "CASE s_suppkey % 3 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'StatefulSet' ELSE 'DaemonSet' END"


@register(f"""SELECT 'ns' || s_nationkey AS namespace, kind, name, CASE WHEN s_suppkey % 2 = 0 THEN 'runner' ELSE 'default' END AS service_account, coalesce(replicas, -1) AS replicas, 'a' || (s_suppkey % 10) AS app FROM (
    SELECT *, {_KIND} AS kind, 'wl' || s_suppkey AS name, CAST(s_suppkey % 6 AS INT) AS replicas FROM supplier UNION ALL SELECT *, 'CronJob', 'cron' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 6 = 5)""", on_lens=False)
def inventory_workloads(spark, d):
    return _inventory(spark, d).workloads().select("namespace", "kind", "name", "service_account", F.coalesce("replicas", F.lit(-1)).alias("replicas"), F.col("labels")["app"].alias("app"))


@register("""SELECT 'ns' || s_nationkey AS namespace, kind, name || s_suppkey AS name, target_kind, target || s_suppkey AS target_name FROM supplier, (VALUES ('ReplicaSet', 'rs', 'Deployment', 'wl'), ('Pod', 'pod', 'ReplicaSet', 'rs')) v(kind, name, target_kind, target) WHERE s_suppkey % 3 = 0""", on_lens=False)
def inventory_aliases(spark, d):
    return _inventory(spark, d).aliases()


@register(f"""SELECT 'ns' || s_nationkey AS namespace, kind, name, container, container = 'setup' AS init_container, 'r.io/team/app' || (s_suppkey % 20) || tail AS ref, digest, 'r.io' AS registry, 'team/app' || (s_suppkey % 20) AS repository FROM (
    SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN '@sha256:' || s_suppkey ELSE ':1' END AS tail, CASE WHEN s_suppkey % 3 = 0 THEN 'sha256:' || s_suppkey ELSE '' END AS digest FROM (
      SELECT *, {_KIND} AS kind, 'wl' || s_suppkey AS name FROM supplier UNION ALL SELECT *, 'CronJob', 'cron' || s_suppkey FROM supplier WHERE s_suppkey % 6 = 5), (VALUES ('main'), ('setup')) v(container)
    UNION ALL SELECT *, ':v' || s_suppkey, CASE WHEN container = 'main' THEN 'sha256:run' || s_suppkey ELSE '' END FROM (SELECT *, 'ReplicaSet' AS kind, 'rs' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 = 0), (VALUES ('main'), ('setup')) v(container))
    WHERE container = 'main' OR s_suppkey % 4 = 0""", on_lens=False)
def inventory_observations(spark, d):
    return _inventory(spark, d).observations()


@register(f"""SELECT 'ns' || s_nationkey AS namespace, kind, name, signal_id FROM (
    SELECT *, {_KIND} AS kind, 'wl' || s_suppkey AS name FROM supplier UNION ALL SELECT *, 'CronJob', 'cron' || s_suppkey FROM supplier WHERE s_suppkey % 6 = 5 UNION ALL SELECT *, 'ReplicaSet', 'rs' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0),
    (VALUES ('kyverno:disallow-host-namespaces', 7), ('kyverno:disallow-privileged-containers', 5), ('kyverno:require-run-as-nonroot', 4)) v(signal_id, k) WHERE s_suppkey % k = 0""", on_lens=False)
def inventory_signals(spark, d):
    return _inventory(spark, d).signals()


@register("SELECT 'ns' || c_nationkey AS namespace, 'svc' || c_custkey AS svc_name, CASE WHEN c_custkey % 2 = 0 THEN 'LoadBalancer' ELSE '' END AS type, 'a' || (c_custkey % 10) AS app FROM customer WHERE c_custkey % 3 <> 0", on_lens=False)
def inventory_services(spark, d):
    return _inventory(spark, d).services().select("namespace", "svc_name", "type", F.col("selector")["app"].alias("app"))


@register("""SELECT 'ns' || (o_custkey % 25) AS namespace, 'in' || o_orderkey AS ing_name, 'nginx' AS class_name, CASE WHEN o_orderkey % 2 = 0 THEN 'fallback,' ELSE '' END || 'svc' || o_custkey AS backends FROM orders""", on_lens=False)
def inventory_ingresses(spark, d):
    return _inventory(spark, d).ingresses().select("namespace", "ing_name", "class_name", F.array_join("backends", ",").alias("backends"))


@register("SELECT DISTINCT 'ns' || s_nationkey AS namespace FROM supplier WHERE s_nationkey % 3 <> 0", on_lens=False)
def inventory_bare_namespaces(spark, d):
    return _inventory(spark, d).bare_namespaces()


@register("""SELECT 'ns' || n_nationkey AS name, true AS declared, n_name AS team FROM nation WHERE n_nationkey % 6 <> 5
    UNION ALL SELECT DISTINCT 'ns' || s_nationkey, false, NULL FROM supplier WHERE s_nationkey % 6 = 5""", on_lens=False)
def inventory_namespaces(spark, d):
    """Namespace items, and the namespaces that workloads imply."""
    return _inventory(spark, d).all_namespaces().select("name", "declared", F.col("labels")["team"].alias("team"))


@register("SELECT count(*) AS n FROM customer WHERE c_custkey % 9 < 3", on_lens=False)
def inventory_unknown_items(spark, d):
    """Items without a kind or of one not known here, as far as they look like manifests at all."""
    return _inventory(spark, d).unknown()


@register("""SELECT vuln_id, score, percentile FROM (SELECT *, row_number() OVER (PARTITION BY vuln_id ORDER BY score DESC, percentile DESC) AS k FROM (
    SELECT 'CVE-' || (p_partkey % 700) AS vuln_id, p_size / 100.0::DOUBLE AS score, (p_partkey % 100) / 100.0::DOUBLE AS percentile FROM part WHERE p_partkey % 10 NOT IN (7, 8))) WHERE k = 1""", on_lens=False)
def feed_epss(spark, d):
    return feeds.epss_rows(payloads.epss_lines(spark, d))


@register("""SELECT vuln_id, coalesce(CAST(added_at AS VARCHAR), '') AS added_at, '' AS due_date, short_description, '' AS required_action FROM (SELECT *, row_number() OVER (PARTITION BY vuln_id ORDER BY added_at DESC NULLS LAST, short_description DESC) AS k FROM (
    SELECT 'CVE-' || (p_partkey % 500) AS vuln_id, CASE WHEN p_size <= 40 THEN CAST('2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS DATE) END AS added_at, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS short_description FROM part WHERE p_partkey % 11 <> 0)) WHERE k = 1""", on_lens=False)
def feed_kev(spark, d):
    rows = feeds.kev_rows(payloads.kev_documents(spark, d))
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("added_at", "due_date")})


_SPLIT = "TIMESTAMP '1996-06-01'"


@register(f"""SELECT category, count(*) FILTER (WHERE first_seen >= {_SPLIT}) AS created, count(*) FILTER (WHERE first_seen < {_SPLIT} AND last_seen >= {_SPLIT}) AS updated, count(*) FILTER (WHERE last_seen < {_SPLIT}) AS kept, count(*) AS n,
    count(*) FILTER (WHERE severity = 'critical') AS critical FROM finding GROUP BY category""")
def finding_merge_counts(spark, d):
    """Stored findings merged with a batch: what was created, updated and left as it was; the merged rows are those of one fold over all."""
    rows = lens.observations(spark, d)
    stored, batch = findings.fold(rows.where(F.col("seen_at") < _at("1996-06-01"))), findings.fold(rows.where(F.col("seen_at") >= _at("1996-06-01")))
    merged = findings.merged(stored, batch)
    n = lambda what: F.count_if(F.col("what") == what).alias(what)
    return merged.groupBy("category").agg(n("created"), n("updated"), n("kept"), F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))


@register(""", pair AS (SELECT wl_id, image_id, max(seen_at) AS l FROM observation GROUP BY ALL)
    SELECT (SELECT count(DISTINCT wl_id) FROM observation WHERE seen_at >= TIMESTAMP '2000-10-01') AS deployed,
    (SELECT count(*) FROM workload WHERE wl_id NOT IN (SELECT wl_id FROM observation WHERE seen_at >= TIMESTAMP '2000-10-01')) AS undeployed,
    count(*) FILTER (WHERE l >= TIMESTAMP '2000-10-01') AS obs_deployed, count(*) FILTER (WHERE l < TIMESTAMP '2000-10-01') AS obs_undeployed, count(*) FILTER (WHERE l < TIMESTAMP '2000-10-01' - INTERVAL 30 DAY) AS obs_swept FROM pair""")
def inventory_reap(spark, d):
    """What the end of a complete inventory cycle changes, counted."""
    return lifecycle.inventory_reap(lens.workloads(spark, d).select("wl_id"), lens.observations(spark, d), _at("2000-10-01"))


@register("""SELECT (SELECT count(*) FROM signal WHERE active) AS active_before, (SELECT count(*) FROM signal WHERE active AND signal_id LIKE 'k%:KSV-%' AND last_seen < TIMESTAMP '2024-01-20') AS signals_cleared, true AS reaped""")
def scan_reap(spark, d):
    """What the end of a scan cycle changes: stale signals of its kind go out, unless it observed nothing although the scope holds rows."""
    marks = spark.range(1).select(F.lit("trivy.ConfigAuditReport").alias("source"), F.lit(5).alias("observed_count"))
    held = _folded(spark, d).select(F.lit("trivy.ConfigAuditReport").alias("source")).limit(1)
    return lifecycle.scan_reap(_signals(spark, d), marks, held, G.reap_scope("trivy.ConfigAuditReport"), _at("2024-01-20"))


@register(""", month AS (SELECT wl_id, image_id, CAST(date_trunc('year', seen_at) AS TIMESTAMP) AS cycle, NOT bool_or(category = 'vulnerability') AS gap FROM observation GROUP BY ALL),
    run AS (SELECT *, sum(CASE WHEN gap THEN 0 ELSE 1 END) OVER (PARTITION BY wl_id, image_id ORDER BY cycle) AS r FROM month)
    SELECT wl_id, image_id, cycle, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY wl_id, image_id, r ORDER BY cycle) AS BIGINT) AS streak FROM run QUALIFY gap""")
def scan_outages(spark, d):
    """Images in use that a cycle did not scan, and for how many cycles in a row."""
    rows = lens.observations(spark, d).withColumn("cycle", F.date_trunc("year", "seen_at").cast("timestamp_ntz"))
    return lifecycle.outages(rows.select("wl_id", "image_id", "cycle"), rows.where("category = 'vulnerability'").select("wl_id", "image_id", "cycle"), ["wl_id", "image_id"], "cycle")


@register("SELECT category, vuln_id, wl_id, image_id FROM finding WHERE image_id IN (SELECT image_id FROM observation JOIN workload USING (wl_id) WHERE deployed)")
def findings_running_image(spark, d):
    from ravelin.operators import views

    use = lens.observations(spark, d).join(lens.workloads(spark, d).where("deployed"), "wl_id", "left_semi")
    return views.running_only(_folded(spark, d), use).select(*KEY)
