"""Registered queries behind the panels: marks and queue, scopes and filters, default picks, compliance, licences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import scalars as S
from ravelin.operators import compliance, lifecycle, marks, views
from ravelin.plans import lens
from ravelin.queries import _banded, _relevant, _visible, register

_CYCLES = """WITH cluster AS (SELECT CAST(r_regionkey AS BIGINT) AS cluster_id, 'c' || r_regionkey AS cluster_name FROM region),
queue AS (SELECT o_orderkey AS item_id, 'c' || (o_custkey % 6) AS cluster_name, CASE o_orderpriority WHEN '1-URGENT' THEN 'inventory' WHEN '2-HIGH' THEN 'config' ELSE 'vulnerability' END AS kind,
    'i' || o_custkey AS import_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'done' END AS status, o_orderkey % 5 = 0 AS complete_snapshot FROM orders),
mark AS (SELECT DISTINCT CAST(o_custkey % 6 AS BIGINT) AS cluster_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'inventory' WHEN '2-HIGH' THEN 'config' ELSE 'vulnerability' END AS kind, 'i' || o_custkey AS import_id,
    CASE o_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'reaped' ELSE 'draining' END AS state FROM orders) """


def _queue(spark, d):
    kind = "CASE o_orderpriority WHEN '1-URGENT' THEN 'inventory' WHEN '2-HIGH' THEN 'config' ELSE 'vulnerability' END AS kind"
    orders = spark.read.parquet(f"{d}/orders.parquet")
    queue = orders.selectExpr("o_orderkey AS item_id", "concat('c', o_custkey % 6) AS cluster_name", kind, "concat('i', o_custkey) AS import_id", "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'done' END AS status", "o_orderkey % 5 = 0 AS complete_snapshot")
    own = orders.selectExpr("cast(o_custkey % 6 AS long) AS cluster_id", kind, "concat('i', o_custkey) AS import_id", "CASE o_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'reaped' ELSE 'draining' END AS state").distinct()
    clusters = spark.read.parquet(f"{d}/region.parquet").selectExpr("cast(r_regionkey AS long) AS cluster_id", "concat('c', r_regionkey) AS cluster_name")
    return queue, own, clusters


@register(_CYCLES + "SELECT q.item_id, m.cluster_id, q.kind, q.import_id FROM queue q JOIN cluster c USING (cluster_name) JOIN mark m ON m.cluster_id = c.cluster_id AND m.kind = q.kind AND m.import_id = q.import_id WHERE q.status = 'pending' AND m.state = 'draining'", on_lens=False)
def queue_claimable(spark, d):
    queue, own, clusters = _queue(spark, d)
    return marks.claimable(queue, own, clusters).select("item_id", "cluster_id", "kind", "import_id")


@register(_CYCLES + "SELECT m.* FROM mark m WHERE m.state = 'draining' AND NOT EXISTS (SELECT 1 FROM queue q JOIN cluster c USING (cluster_name) WHERE c.cluster_id = m.cluster_id AND q.kind = m.kind AND q.import_id = m.import_id AND q.status IN ('pending', 'processing'))", on_lens=False)
def marks_drained(spark, d):
    """The marks that the safety net works out again."""
    queue, own, clusters = _queue(spark, d)
    return marks.drained(own, queue, clusters)


@register(_CYCLES + "SELECT m.*, m.import_id IN (SELECT import_id FROM queue WHERE complete_snapshot) AS complete FROM mark m", on_lens=False)
def marks_complete(spark, d):
    queue, own, _ = _queue(spark, d)
    return marks.with_complete(own, queue)


_WEIGHT = "CASE {} {} ELSE -1 END"


@register(f"""SELECT severity, band, {_WEIGHT.format('severity', ' '.join(f"WHEN '{s}' THEN {5 - k}" for k, s in enumerate(S.SEVERITIES)))} AS severity_weight, {_WEIGHT.format('band', ' '.join(f"WHEN '{b}' THEN {3 - k}" for k, b in enumerate(S.BANDS)))} AS band_weight, count(*) AS n FROM banded GROUP BY ALL""")
def urgency_weights(spark, d):
    rows = _banded(spark, d).groupBy("severity", "band").agg(F.count("*").alias("n"))
    return rows.withColumns({"severity_weight": S.weight(F.col("severity"), S.SEVERITIES), "band_weight": S.weight(F.col("band"), S.BANDS)})


_TOLD = "CASE p_size % 5 WHEN 0 THEN ' Immediate' WHEN 1 THEN 'OutOfCycle' WHEN 2 THEN 'OUT_OF_CYCLE ' WHEN 3 THEN p_brand END"
_REF = "CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '/', p_name, '/x') ELSE p_name END"


@register(f"""SELECT p_partkey, CASE lower(trim(told)) WHEN 'immediate' THEN 'immediate' WHEN 'outofcycle' THEN 'out_of_cycle' WHEN 'out_of_cycle' THEN 'out_of_cycle' ELSE told END AS band,
    CASE WHEN contains(ref, '/') THEN split_part(ref, '/', 1) END AS ns, CASE WHEN contains(ref, '/') THEN substr(ref, strpos(ref, '/') + 1) ELSE ref END AS name FROM (SELECT p_partkey, {_TOLD} AS told, {_REF} AS ref FROM part)""", on_lens=False)
def label_normalise(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", f"{_TOLD} AS told", f"{_REF} AS ref")
    ns, name = S.split_ref(F.col("ref"))
    return rows.select("p_partkey", S.label(F.col("told"), S.BANDS).alias("band"), ns.alias("ns"), name.alias("name"))


@register("SELECT true AS with_muted, ns_name, category, count(*) AS n FROM relevant WHERE cluster_name = 'ASIA' GROUP BY ALL UNION ALL SELECT false, ns_name, category, count(*) FROM visible WHERE cluster_name = 'ASIA' GROUP BY ALL")
def scoped_findings(spark, d):
    """The findings of one cluster, with those that are muted and without."""
    count = lambda rows, muted: views.scoped(rows, cluster="ASIA").groupBy("ns_name", "category").agg(F.count("*").alias("n")).withColumn("with_muted", F.lit(muted))
    return count(_relevant(spark, d), True).unionByName(count(_visible(spark, d), False))


@register("SELECT wl_id, wl_name, ns_name, cluster_name FROM workload JOIN namespace USING (ns_id) JOIN cluster USING (cluster_id) WHERE kind = 'Job' AND cluster_name = 'ASIA'")
def workload_scope(spark, d):
    rows = lens.workloads(spark, d).join(lens.namespaces(spark, d), "ns_id").join(lens.clusters(spark, d), "cluster_id")
    return views.scoped(rows, cluster="ASIA", kind="Job").select("wl_id", "wl_name", "ns_name", "cluster_name")


@register("""SELECT image_id, string_agg(DISTINCT cluster_name, ',' ORDER BY cluster_name) AS clusters FROM observation JOIN workload USING (wl_id) JOIN namespace USING (ns_id) JOIN cluster USING (cluster_id)
    GROUP BY image_id HAVING bool_or(cluster_name = 'ASIA') AND string_agg(DISTINCT cluster_name, ',' ORDER BY cluster_name) LIKE '%AMERICA%'""")
def images_by_cluster_list(spark, d):
    """Images whose list of clusters has one as a member and another's name somewhere in it."""
    where = lens.workloads(spark, d).join(lens.namespaces(spark, d), "ns_id").join(lens.clusters(spark, d), "cluster_id").select("wl_id", "cluster_name")
    rows = lens.observations(spark, d).select("wl_id", "image_id").distinct().join(where, "wl_id")
    rows = rows.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("cluster_name")), ",").alias("clusters"))
    return views.listed(rows, member={"clusters": "ASIA"}, part={"clusters": "america"})


_BANDS = ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS {b}" for b in S.BANDS)


@register(f""", own AS (SELECT wl_id, image_id, cluster_name, deployed, {_BANDS} FROM banded GROUP BY ALL)
    SELECT wl_id, image_id, cluster_name, deployed, {', '.join(S.BANDS)} FROM (SELECT *, row_number() OVER (PARTITION BY wl_id ORDER BY image_id % 100 = 7 DESC, deployed DESC, {', '.join(f'{b} DESC' for b in S.BANDS)}, cluster_name, image_id) AS k FROM own) WHERE k = 1""")
def workload_shown_image(spark, d):
    """The image that the page of each workload opens with: the one asked for, else the most urgent."""
    rows = _banded(spark, d).groupBy("wl_id", "image_id", "cluster_name", "deployed").agg(*[F.count_if(F.col("band") == b).alias(b) for b in S.BANDS])
    return views.shown_image(rows, F.col("image_id") % 100 == 7)


@register("""SELECT n.ns_id, n.ns_name, n.cluster_id, n.ns_id IN (SELECT ns_id FROM workload WHERE deployed AND exposed) OR (n.ns_id % 4 <> 0 AND n.cluster_id % 2 <> 0) AS active FROM namespace n ORDER BY active DESC, ns_name""")
def namespace_deactivation(spark, d):
    """What a cycle leaves active: of clusters with a complete snapshot, only namespaces that it names or that a workload implies."""
    before = lens.namespaces(spark, d).select("ns_id", "ns_name", "cluster_id", (F.col("ns_id") % 4 != 0).alias("active"))
    seen = before.join(lens.workloads(spark, d).where("deployed AND exposed"), "ns_id", "left_semi")
    cycles = lens.clusters(spark, d).select("cluster_id", (F.col("cluster_id") % 2 == 0).alias("complete"))
    return lifecycle.active_namespaces(before, seen, cycles).select("ns_id", "ns_name", "cluster_id", "active").orderBy(*views.namespace_order())


@register("""SELECT category, vuln_id, severity, band, fixed_version, kev_listed, wl_id, wl_name, kind, ns_name, cluster_name, env, image_id, p_brand || ':' || p_size AS image_ref
    FROM visible LEFT JOIN part ON p_partkey = image_id""")
def finding_details(spark, d):
    images = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS image_id", "concat(p_brand, ':', p_size) AS image_ref")
    return views.finding_details(_visible(spark, d), images)


_VERDICTS = """, verdict AS (SELECT vuln_id AS control, cluster_name, CASE WHEN bool_or(severity = 'critical') THEN 'FAIL' WHEN bool_or(severity = 'high') THEN 'WARN' ELSE 'PASS' END AS verdict
    FROM wide WHERE category = 'config' GROUP BY ALL) """
CLUSTERS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _verdicts(spark, d):
    from ravelin.queries import _wide

    checks = _wide(spark, d).where("category = 'config'")
    return compliance.judged(checks.select(F.col("vuln_id").alias("control"), "cluster_name", F.expr("CASE severity WHEN 'critical' THEN 'FAIL' WHEN 'high' THEN 'WARN' ELSE 'PASS' END AS status")))


@register(_VERDICTS + "SELECT control, " + ", ".join(f"max(verdict) FILTER (WHERE cluster_name = '{c}') AS \"{c}\"" for c in CLUSTERS) + " FROM verdict GROUP BY control")
def compliance_matrix(spark, d):
    return compliance.matrix(_verdicts(spark, d), CLUSTERS)


@register(_VERDICTS + """SELECT cluster_name, count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE verdict = 'FAIL') AS n_fail, count(*) FILTER (WHERE verdict = 'WARN') AS n_warn,
    100 * count(*) FILTER (WHERE verdict = 'PASS') // nullif(count(*) FILTER (WHERE verdict <> 'WARN'), 0) AS pass_rate FROM verdict GROUP BY cluster_name""")
def compliance_pass_rates(spark, d):
    return compliance.pass_rates(_verdicts(spark, d))


@register("""WITH own AS (SELECT p_name AS component, p_brand AS version, p_size AS instances, unnest(list_distinct(string_split(p_type || ' ' || p_name, ' '))) AS licence FROM part)
    SELECT licence, count(DISTINCT component) AS components, count(DISTINCT component || '|' || version) AS versions, CAST(sum(instances) AS BIGINT) AS instances, licence IN ('ECONOMY', 'PROMO') AS restrictive FROM own GROUP BY licence""", on_lens=False)
def component_licences(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("component"), F.col("p_brand").alias("version"), F.col("p_size").cast("long").alias("instances"), F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("licences"))
    return compliance.licence_counts(rows, ("ECONOMY", "PROMO"))
