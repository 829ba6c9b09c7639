"""Registered queries over lists and details: pages of the five resources, owners over two cycles, licence expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import compliance, listing, resolve
from ravelin.plans import lens
from ravelin.queries import _banded, register
from ravelin.sources import captures
from ravelin.sources.feeds import shared_folder


def _second(rows: DataFrame, resource: str, params: dict[str, str], size: int = 25) -> DataFrame:
    """The second page: what comes after the last row of the first."""
    return listing.page(rows, resource, params, size, listing.last_of(listing.page(rows, resource, params, size), resource, params))


@register("SELECT cluster_id, cluster_name, env FROM cluster WHERE lower(cluster_name) LIKE '%a%' ORDER BY env DESC, cluster_id LIMIT 2 OFFSET 2")
def list_clusters(spark, d):
    """The second page of two clusters whose name holds an a, by environment."""
    return _second(lens.clusters(spark, d), "cluster", {"name": "A", "ordering": "-environment"}, 2).select("cluster_id", "cluster_name", "env")


@register("SELECT ns_id, ns_name, cluster_name, sensitive, ns_exposed FROM namespace JOIN cluster USING (cluster_id) WHERE NOT sensitive ORDER BY cluster_name, ns_name LIMIT 6 OFFSET 6")
def list_namespaces(spark, d):
    rows = lens.namespaces(spark, d).join(lens.clusters(spark, d), "cluster_id")
    return _second(rows, "namespace", {"contains_sensitive_data": "no", "name": ""}, 6).select("ns_id", "ns_name", "cluster_name", "sensitive", "ns_exposed")


@register("""SELECT wl_id, wl_name, kind, ns_name, cluster_name, deployed, exposed FROM workload JOIN namespace USING (ns_id) JOIN cluster USING (cluster_id)
    WHERE deployed AND lower(wl_name) LIKE '%supplier%' ORDER BY cluster_name, ns_name, kind, wl_name, wl_id LIMIT 3 OFFSET 3""")
def list_workloads(spark, d):
    rows = lens.workloads(spark, d).join(lens.namespaces(spark, d), "ns_id").join(lens.clusters(spark, d), "cluster_id")
    return _second(rows, "workload", {"deployed": "YES", "name": "Supplier"}, 3).select("wl_id", "wl_name", "kind", "ns_name", "cluster_name", "deployed", "exposed")


@register("""SELECT finding_id, severity, band, last_seen, wl_name FROM (SELECT *, 'f' || category || '/' || vuln_id || '/' || wl_id || '/' || image_id AS finding_id FROM banded)
    WHERE band = 'scheduled' AND lower(vuln_id) LIKE '%cve-01%' AND NOT kev_listed ORDER BY last_seen DESC, finding_id LIMIT 25 OFFSET 25""")
def list_findings(spark, d):
    """The second page of the scheduled findings of some vulnerabilities, newest first."""
    name = F.concat(F.lit("f"), F.concat_ws("/", "category", "vuln_id", F.col("wl_id").cast("string"), F.col("image_id").cast("string")))
    rows = _banded(spark, d).withColumn("finding_id", name)
    return _second(rows, "finding", {"effective_priority": "scheduled", "vuln_id": "cve-01", "kev_listed": "false"}).select("finding_id", "severity", "band", "last_seen", "wl_name")


@register("""SELECT image_id, ref, registry, currently_deployed FROM (SELECT p_partkey AS image_id, lower(p_brand) || '/' || p_type || ':' || p_size AS ref, lower(p_brand) AS registry,
      p_partkey IN (SELECT o.image_id FROM observation o JOIN workload w USING (wl_id) JOIN namespace n USING (ns_id) JOIN cluster c USING (cluster_id) WHERE w.deployed AND c.cluster_name = 'ASIA') AS currently_deployed FROM part)
    WHERE currently_deployed AND lower(ref) LIKE '%:1%' ORDER BY ref DESC, image_id LIMIT 10 OFFSET 10""")
def list_images(spark, d):
    """The second page of images that something deployed runs in one cluster."""
    images = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS image_id", "concat(lower(p_brand), '/', p_type, ':', p_size) AS ref", "lower(p_brand) AS registry")
    homes = lens.workloads(spark, d).where("deployed").join(lens.namespaces(spark, d), "ns_id").join(lens.clusters(spark, d), "cluster_id").select("wl_id", "cluster_name")
    rows = listing.with_deployed(images, lens.observations(spark, d).join(homes, "wl_id"), "ASIA")
    return _second(rows, "image", {"currently_deployed": "1", "ref": ":1", "ordering": "-ref,nonsense"}, 10).select("image_id", "ref", "registry", "currently_deployed")


def _node(space: str, kind: str, name: str):
    return F.expr(f"concat_ws('/', {space}, '{kind}', {name})")


@register("""WITH pod AS (SELECT p_partkey AS p, p_partkey // 2 AS r, 'ns' || ((p_partkey // 2) % 25) AS namespace FROM part)
    SELECT namespace, 'pod' || p AS name, CASE WHEN r % 7 <> 0 AND r % 40 < 30 THEN namespace || '/Deployment/wl' || (r % 40) END AS owner, CASE WHEN r % 7 = 0 OR r % 40 >= 30 THEN 'rejected' ELSE 'resolved' END AS outcome FROM pod""", on_lens=False)
def owners_two_cycles(spark, d):
    """Reports on pods, given to the workload at the end of their chain of owners.

    Nodes are named by namespace, kind and name. Of every fifth pod only the cycle before knew the owner; of others its
    word no longer counts. Some chains go in a circle, some end at nothing that is known; their reports are rejected.
    """
    part = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS p", "p_partkey div 2 AS r", "concat('ns', (p_partkey div 2) % 25) AS namespace")
    sets = part.select("r", "namespace").distinct()
    edge = lambda rows, child, parent: rows.select(child.alias("child"), parent.alias("parent"))
    pod, rs, job = _node("namespace", "Pod", "concat('pod', p)"), _node("namespace", "ReplicaSet", "concat('rs', r)"), _node("namespace", "Job", "concat('job', r)")
    deployment = _node("namespace", "Deployment", "concat('wl', r % 40)")
    now = edge(part.where("p % 5 <> 0"), pod, rs).unionByName(edge(sets.where("r % 7 <> 0"), rs, deployment))
    now = now.unionByName(edge(sets.where("r % 7 = 0"), rs, job)).unionByName(edge(sets.where("r % 7 = 0"), job, rs))
    before = edge(part.where("p % 5 = 0"), pod, rs).unionByName(edge(part.where("p % 5 = 1"), pod, _node("namespace", "ReplicaSet", "'gone'")))
    known = spark.read.parquet(f"{d}/nation.parquet").selectExpr("concat('ns', n_nationkey) AS namespace").select("namespace", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("r"))
    workloads = known.select(deployment.alias("node")).withColumn("wl_id", F.col("node"))
    chains = resolve.owners(now, workloads, before)
    found, rejected = resolve.attach(part.select("namespace", F.expr("concat('pod', p)").alias("name"), pod.alias("target")), workloads, chains)
    out = found.select("namespace", "name", F.col("wl_id").alias("owner"), F.lit("resolved").alias("outcome"))
    return out.unionByName(rejected.select("namespace", "name", F.lit(None).cast("string").alias("owner"), F.lit("rejected").alias("outcome")))


#: Expressions with what they come to, where GPL-3.0 and AGPL-3.0 bind, but not with the linking exception.
LICENCES = (
    ("MIT", False),
    ("GPL-3.0 OR MIT", False),
    ("(MIT AND GPL-3.0+) or agpl-3.0", True),
    ("GPL-3.0 WITH Classpath-exception-2.0", False),
    ("MIT OR (GPL-3.0 AND (AGPL-3.0 OR BSD-3-Clause))", False),
    ("MIT AND GPL-3.0 OR AGPL-3.0 AND MIT", True),
    ("(GPL-3.0 OR MIT", None),
    ("GPL-3.0 WITH Bison-exception-2.2 AND MIT", True),
    ("Apache-2.0 MIT", None),
)
NAMES, EXCEPTED = ("GPL-3.0", "AGPL-3.0"), ("Classpath-exception-2.0",)


def _licences(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(e) for e, _ in LICENCES]), (F.col("p_partkey") % len(LICENCES) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("component"), F.col("p_brand").alias("version"), F.col("p_size").cast("long").alias("instances"), text.alias("expression"))


_CASES = " ".join(f"WHEN {k} THEN {str(v).lower() if v is not None else 'NULL'}" for k, (_, v) in enumerate(LICENCES))


@register(f"SELECT p_brand AS version, CASE p_partkey % {len(LICENCES)} {_CASES} END AS restrictive, count(DISTINCT p_name) AS components, CAST(sum(p_size) AS BIGINT) AS instances FROM part GROUP BY ALL", on_lens=False)
def licence_verdicts(spark, d):
    """Components and instances of each version by whether their licence expression is restrictive."""
    rows = _licences(spark, d).withColumn("restrictive", compliance.restrictive(F.col("expression"), NAMES, EXCEPTED))
    return rows.groupBy("version", "restrictive").agg(F.count_distinct("component").alias("components"), F.sum("instances").alias("instances"))


_NODE = """to_json(named_struct('metadata', named_struct('name', concat('node', s_suppkey), 'labels', map_filter(map('eks.amazonaws.com/group', CASE WHEN s_suppkey % 8 = 0 THEN 'g' END, 'topology.kubernetes.io/region', CASE WHEN s_suppkey % 3 = 0 THEN concat('r', s_suppkey) END,
    'failure-domain.beta.kubernetes.io/region', concat('old', s_suppkey)), (k, v) -> v IS NOT NULL)), 'spec', named_struct('providerID', CASE s_suppkey % 4 WHEN 0 THEN 'AWS://x' WHEN 1 THEN 'gce://x' WHEN 2 THEN 'azure://x' END)))"""
_POD = """CASE c_custkey % 7 WHEN 0 THEN '"no object"' WHEN 1 THEN '{}' WHEN 2 THEN concat('{"kind":"Custom","metadata":{"name":"p', c_custkey, '"}}') ELSE concat('{"metadata":{"name":"p', c_custkey, '"}}') END"""


@register("""WITH node AS (SELECT s_nationkey AS n, min(s_suppkey) AS s FROM supplier GROUP BY s_nationkey),
    pod AS (SELECT c_nationkey AS n, count(*) FILTER (WHERE c_custkey % 7 <> 0) AS pods, count(*) FILTER (WHERE c_custkey % 7 NOT IN (0, 2)) AS stamped, count(*) FILTER (WHERE c_custkey % 7 > 1) AS named FROM customer GROUP BY c_nationkey)
    SELECT 'n' || n_nationkey AS cluster, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'v1.' || n_nationkey END AS k8s_version, CASE WHEN s IS NULL OR s % 4 = 3 THEN 'onprem' WHEN s % 8 = 0 THEN 'eks' WHEN s % 4 = 0 THEN 'aws' WHEN s % 4 = 1 THEN 'gcp' ELSE 'azure' END AS provider,
      CASE WHEN s IS NULL THEN '' WHEN s % 3 = 0 THEN 'r' || s ELSE 'old' || s END AS region, coalesce(pods, 0) AS pods, coalesce(stamped, 0) AS stamped, coalesce(named, 0) AS named
    FROM nation LEFT JOIN node ON node.n = n_nationkey LEFT JOIN pod ON pod.n = n_nationkey""", on_lens=False)
def captured_clusters(spark, d):
    """Clusters as captured, one folder a nation: what their first node says, and their pods, of which most lack a kind."""
    at = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    nodes = spark.read.parquet(f"{d}/supplier.parquet").select("s_nationkey", "s_suppkey", F.expr(_NODE).alias("raw")).groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "raw"))).alias("r"))
    pods = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", F.expr(_POD).alias("raw")).groupBy("c_nationkey").agg(F.collect_list("raw").alias("r"))
    nations = spark.read.parquet(f"{d}/nation.parquet")
    name = lambda key: F.concat(F.lit("n"), F.col(key)).alias("cluster")
    files = nodes.select(name("s_nationkey"), F.lit("nodes.json").alias("file"), F.concat(F.lit('{"kind":"List","items":['), F.array_join("r.raw", ","), F.lit("]}")).alias("value"))
    files = files.unionByName(pods.select(name("c_nationkey"), F.lit("pods.json").alias("file"), F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")).alias("value")))
    version = F.when(F.col("n_nationkey") % 5 == 0, "{}").otherwise(F.concat(F.lit('{"gitVersion":"v1.'), "n_nationkey", F.lit('"}')))
    files = files.unionByName(nations.select(name("n_nationkey"), F.lit("version.json").alias("file"), version.alias("value")))
    files.withColumn("group", F.lit("kubeapi")).write.partitionBy("cluster", "group", "file").text(at)
    found = captures.items(spark, at).where("kind = 'Pod'").withColumn("own", F.get_json_object("raw", "$.kind"))
    counts = found.groupBy("cluster").agg(F.count("*").alias("pods"), F.count_if(F.col("own") == "Pod").alias("stamped"), F.count(F.get_json_object("raw", "$.metadata.name")).alias("named"))
    return captures.cluster_facts(spark, at).join(counts, "cluster", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pods", "stamped", "named")})
