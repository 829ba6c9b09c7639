"""Scanner reports, manifests and feeds as they land, made from the TPC-H-like tables: one JSON document a row (raw: string)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.plans.lens import sized

#: Who a report is about: the workload of its order, by labels or else by the report's own namespace.
_META = """named_struct('name', concat('r', o_orderkey), 'namespace', 'scan', 'labels', map_filter(map('trivy-operator.resource.namespace', CASE WHEN o_orderkey % 5 <> 0 THEN concat('ns', o_custkey % 25) END,
    'trivy-operator.resource.kind', 'Deployment', 'trivy-operator.resource.name', concat('wl', o_custkey % 40), 'trivy-operator.container.name', CASE WHEN o_orderkey % 2 = 0 THEN 'main' END), (k, v) -> v IS NOT NULL)) AS metadata"""
WHO_SQL = """CASE WHEN o_orderkey % 5 <> 0 THEN 'ns' || (o_custkey % 25) ELSE 'scan' END AS namespace, 'Deployment' AS kind, 'wl' || (o_custkey % 40) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE '' END AS container"""
_SEVERITY = "CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'R' THEN 'High' ELSE 'odd' END"
SEVERITY_SQL = "CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'R' THEN 'high' ELSE 'unknown' END"


def _ordered(spark: SparkSession, d: str, items: str, name: str = "items") -> DataFrame:
    """Orders with a list of ``items``, one per line.

    The lines travel as they were read, the same columns for every kind of report, and become items where they arrive:
    a plan that makes several kinds shuffles them once, and no long text.
    """
    sized(spark, d)
    line = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    orders = spark.read.parquet(f"{d}/orders.parquet").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.withColumn(name, F.expr(f"transform(lines, l -> {re.sub(r'\bl_', 'l.l_', items)})"))


def _reports(spark: SparkSession, d: str, items: str, body: str, meta: str = _META) -> DataFrame:
    """One report per order, with an item per line."""
    return _ordered(spark, d, items).select(F.to_json(F.struct(*[F.expr(x) for x in (meta, body)])).alias("raw"))


def vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    items = f"""named_struct('vulnerabilityID', concat('CVE-', l_partkey % 300), 'resource', concat('pkg', l_suppkey % 10), 'installedVersion', concat('1.', l_linenumber), 'fixedVersion', CASE WHEN l_linestatus = 'F' THEN '2.0' END,
        'severity', {_SEVERITY}, 'score', CASE WHEN l_linenumber > 2 THEN l_linenumber / 2 END, 'title', CASE WHEN l_linenumber % 2 = 0 THEN concat('T', l_partkey) ELSE '' END,
        'cvss', CASE WHEN l_linenumber = 1 THEN map('redhat', named_struct('V3Score', CAST(NULL AS double), 'V2Score', 4.5D, 'V3Vector', 'AV:N')) END)"""
    return _reports(spark, d, items, """named_struct('artifact', named_struct('registry', CASE WHEN o_orderkey % 3 <> 0 THEN 'r.io' END, 'repository', concat('team/app', o_custkey % 20), 'tag', concat('1.', o_orderkey % 4), 'digest', CASE WHEN o_orderkey % 4 <> 0 THEN concat('sha256:', o_orderkey) END),
        'os', named_struct('family', 'alpine', 'name', CASE WHEN o_orderkey % 2 = 0 THEN '3.19' END, 'eosl', o_orderkey % 7 = 0), 'vulnerabilities', items) AS report""")


def checks(spark: SparkSession, d: str, whole_cluster: bool = False) -> DataFrame:
    items = f"named_struct('checkID', CASE WHEN l_partkey % 4 = 0 THEN concat('AVD-KSV-', lpad(cast(l_partkey % 60 AS string), 4, '0')) ELSE concat('KSV', lpad(cast(l_partkey % 60 AS string), 3, '0')) END, 'severity', {_SEVERITY}, 'success', CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus = 'F' END, 'title', CASE WHEN l_linenumber % 2 = 0 THEN repeat(concat('t', l_partkey), 200) END)"
    meta = "named_struct('name', concat('r', o_orderkey)) AS metadata" if whole_cluster else _META
    return _reports(spark, d, items, "named_struct('checks', items) AS report", meta)


def secrets(spark: SparkSession, d: str) -> DataFrame:
    items = f"named_struct('ruleID', concat('rule-', l_partkey % 9), 'severity', {_SEVERITY}, 'title', CASE WHEN l_linenumber % 2 = 0 THEN concat('Key ', l_suppkey) END, 'target', '/etc/key')"
    return _reports(spark, d, items, "named_struct('secrets', items) AS report")


def policies(spark: SparkSession, d: str) -> DataFrame:
    who = "named_struct('kind', 'Deployment', 'name', concat('{}', l_suppkey), 'namespace', CASE WHEN l_suppkey % 2 = 0 THEN concat('n', l_suppkey % 5) END)"
    items = f"""named_struct('policy', CASE l_partkey % 3 WHEN 0 THEN 'disallow-privileged-containers' WHEN 1 THEN 'disallow-host-path' ELSE 'own-policy' END, 'rule', CASE WHEN l_linenumber % 2 = 0 THEN 'rule1' END,
        'result', CASE l_returnflag WHEN 'A' THEN 'fail' WHEN 'R' THEN 'pass' ELSE 'WARN' END, 'severity', CASE WHEN l_linestatus = 'F' THEN 'High' END,
        'subjects', CASE WHEN l_linenumber % 3 = 0 THEN array({who.format('s')}) END, 'resources', CASE WHEN l_linenumber % 3 = 1 THEN array({who.format('a')}, {who.format('b')}) END)"""
    orders = _ordered(spark, d, items, "results")
    meta = F.expr("named_struct('name', concat('p', o_orderkey), 'namespace', concat('ns', o_custkey % 25)) AS metadata")
    scope = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN named_struct('kind', 'Pod', 'name', concat('pod', o_orderkey), 'namespace', 'scoped') END AS scope")
    return orders.select(F.to_json(F.struct(meta, scope, "results")).alias("raw"))


_CONTAINER = "named_struct('name', '{name}', 'image', concat('r.io/team/app', s_suppkey % 20, CASE WHEN s_suppkey % 3 = 0 THEN concat('@sha256:', s_suppkey) ELSE ':1' END), 'securityContext', named_struct('privileged', s_suppkey % 5 = 0, 'runAsNonRoot', CASE WHEN s_suppkey % 4 = 0 THEN false END))"
_POD = f"named_struct('serviceAccountName', CASE WHEN s_suppkey % 2 = 0 THEN 'runner' END, 'hostNetwork', CASE WHEN s_suppkey % 7 = 0 THEN true END, 'containers', array({_CONTAINER.format(name='main')}), 'initContainers', CASE WHEN s_suppkey % 4 = 0 THEN array({_CONTAINER.format(name='setup')}) END)"
_NAMED = "named_struct('name', concat('{name}', s_suppkey), 'namespace', concat('ns', s_nationkey){more}) AS metadata"


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier a controller and, of deployments, a replica set and its pod; services, ingresses, namespaces and policies beside them."""
    parts = sized(spark, d)
    owned = ", 'ownerReferences', array(named_struct('kind', '{kind}', 'name', concat('{name}', s_suppkey), 'controller', true))"
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    one = lambda df, *columns: df.select(F.to_json(F.struct(*[F.expr(c) for c in columns])).alias("raw"))
    template = f"named_struct('metadata', named_struct('labels', map('app', concat('a', s_suppkey % 10))), 'spec', {_POD})"
    kinds = "CASE s_suppkey % 3 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'StatefulSet' ELSE 'DaemonSet' END AS kind"
    out = one(rows, kinds, _NAMED.format(name="wl", more=""), f"named_struct('replicas', cast(s_suppkey % 6 AS int), 'template', {template}) AS spec")
    out = out.unionByName(one(rows.where("s_suppkey % 6 = 5"), "'CronJob' AS kind", _NAMED.format(name="cron", more=""), f"named_struct('jobTemplate', named_struct('spec', named_struct('template', {template}))) AS spec"))
    mine = rows.where("s_suppkey % 3 = 0")
    out = out.unionByName(one(mine, "'ReplicaSet' AS kind", _NAMED.format(name="rs", more=owned.format(kind="Deployment", name="wl"))))
    status = "named_struct('containerStatuses', array(named_struct('name', 'main', 'imageID', concat('docker-pullable://r.io/team/app@sha256:run', s_suppkey)))) AS status"
    out = out.unionByName(one(mine, "'Pod' AS kind", _NAMED.format(name="pod", more=owned.format(kind="ReplicaSet", name="rs")), f"{_POD.replace('@sha256:', ':v')} AS spec", status))
    customers, orders, nations = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders", "nation"))
    out = out.unionByName(one(customers, "'Service' AS kind", "named_struct('name', concat('svc', c_custkey), 'namespace', concat('ns', c_nationkey), 'annotations', CASE WHEN c_custkey % 5 = 0 THEN map('service.beta.kubernetes.io/aws-load-balancer-internal', 'true') END) AS metadata", "named_struct('type', CASE WHEN c_custkey % 2 = 0 THEN 'LoadBalancer' END, 'selector', CASE WHEN c_custkey % 3 <> 0 THEN map('app', concat('a', c_custkey % 10)) END) AS spec"))
    orders = orders.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")  # packed, many lie in one piece of a file; to write their documents takes longer than to read them
    path = "named_struct('backend', named_struct('service', named_struct('name', concat('svc', o_custkey))))"
    out = out.unionByName(one(orders, "'Ingress' AS kind", "named_struct('name', concat('in', o_orderkey), 'namespace', concat('ns', o_custkey % 25), 'annotations', CASE WHEN o_orderkey % 4 <> 0 THEN map('alb.ingress.kubernetes.io/scheme', 'internal') END) AS metadata", f"named_struct('ingressClassName', 'nginx', 'defaultBackend', CASE WHEN o_orderkey % 2 = 0 THEN named_struct('service', named_struct('name', 'fallback')) END, 'rules', array(named_struct('http', named_struct('paths', array({path}, {path}))))) AS spec"))
    # of some namespaces there is no item; some items are of no known kind, and some are no manifests
    odd = customers.where("c_custkey % 9 < 3")
    out = out.unionByName(one(odd, "CASE c_custkey % 3 WHEN 0 THEN 'ConfigMap' WHEN 1 THEN 'Secret' END AS kind", "named_struct('name', concat('odd', c_custkey)) AS metadata"))
    out = out.unionByName(customers.where("c_custkey % 9 = 3").selectExpr("CASE c_custkey % 2 WHEN 0 THEN '{}' ELSE '{\"x\":\"y\"}' END AS raw"))
    out = out.unionByName(one(nations.where("n_nationkey % 6 <> 5"), "'Namespace' AS kind", "named_struct('name', concat('ns', n_nationkey), 'labels', map('team', n_name)) AS metadata"))
    return out.unionByName(one(nations.where("n_nationkey % 3 = 0"), "'NetworkPolicy' AS kind", "named_struct('name', 'deny', 'namespace', concat('ns', n_nationkey)) AS metadata"))


def epss_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an exploit-probability feed: a preamble, a header, rows, of which some are short or not numeric."""
    parts = spark.read.parquet(f"{d}/part.parquet")
    made = F.expr("CASE p_partkey % 10 WHEN 7 THEN concat('CVE-', p_partkey) WHEN 8 THEN concat('CVE-', p_partkey, ',high,0.5') ELSE concat(' CVE-', p_partkey % 700, ',', p_size / 100, ',', p_partkey % 100 / 100) END")
    return spark.createDataFrame([("#model_version:v1",), ("cve,epss,percentile",)], "value string").unionByName(parts.select(made.alias("value")))


def kev_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a feed of known exploited vulnerabilities, one per brand, and one that cannot be read."""
    item = F.expr("named_struct('cveID', CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('CVE-', p_partkey % 500) END, 'dateAdded', CASE WHEN p_size > 40 THEN 'soon' ELSE concat('2024-01-', lpad(cast(p_size % 28 + 1 AS string), 2, '0')) END, 'shortDescription', CASE WHEN p_size % 2 = 0 THEN p_brand END)")
    rows = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.collect_list(item).alias("vulnerabilities")).select(F.to_json(F.struct("vulnerabilities")).alias("value"))
    return rows.unionByName(spark.createDataFrame([("{not json",)], "value string"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of import cycles, one per order: phase and value, of which some lack what they need or cannot be read."""
    cluster = """CASE o_orderkey % 17 WHEN 2 THEN '' WHEN 3 THEN '"cluster":5,' ELSE concat('"cluster":" c', o_custkey % 5, '",') END"""
    kind = """CASE o_orderkey % 17 WHEN 4 THEN '"kind":"  ",' ELSE '"kind":"inventory",' END"""
    number = """CASE o_orderkey % 17 WHEN 5 THEN '"import_id":null,' ELSE concat('"import_id":"i', o_custkey % 50, '",') END"""
    payload = """CASE o_orderkey % 17 WHEN 6 THEN '' WHEN 7 THEN '"payload":null,' WHEN 9 THEN '"payload":[1],"complete_snapshot":true,' WHEN 10 THEN '"payload":{"complete_snapshot":true},' WHEN 11 THEN '"payload":{"a":[]},"complete_snapshot":1,' ELSE '"payload":{"complete_snapshot":0},' END"""
    count = """CASE o_orderkey % 17 WHEN 8 THEN '"more":1' WHEN 12 THEN '"observed_count":"x"' WHEN 14 THEN '"observed_count":"7"' ELSE concat('"observed_count":', o_orderkey % 9) END"""
    value = f"CASE o_orderkey % 17 WHEN 0 THEN '{{not json' WHEN 1 THEN '[1]' WHEN 13 THEN NULL ELSE concat('{{', {cluster}, {kind}, {number}, {payload}, {count}, '}}') END"
    phase = "CASE o_orderkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'item' ELSE 'finish' END"
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(phase).alias("phase"), F.expr(value).alias("value"))
