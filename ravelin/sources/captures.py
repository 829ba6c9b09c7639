"""Captured clusters: a folder per cluster with a file per kind, as command-line dumps leave them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.scalars import blank, provider, region

#: The kinds that a capture holds, by the folder in which their files lie.
KINDS = {
    "kubeapi": ("Namespace", "Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job", "ReplicaSet", "Pod", "Service", "Ingress", "NetworkPolicy", "Node"),
    "trivy": ("VulnerabilityReport", "ConfigAuditReport", "ExposedSecretReport", "RbacAssessmentReport", "ClusterRbacAssessmentReport", "InfraAssessmentReport", "ClusterComplianceReport"),
    "kyverno": ("PolicyReport", "ClusterPolicyReport"),
}
#: cluster / group / kinds.json, a file or a folder of parts, named plainly or as Spark names partitions.
_PATH = r"/(?:cluster=)?([^/]+)/(?:group=)?([a-z]+)/(?:file=)?([a-z]+)\.json(?:/[^/]*)?$"


def file_of(kind: str) -> str:
    """The plural of a kind in small letters, without its ending."""
    name = kind.lower()
    return name[:-1] + "ies" if name.endswith("y") else name + ("es" if name.endswith("s") else "s")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return files.select(*[F.regexp_extract(at, _PATH, k).alias(n) for k, n in ((1, "cluster"), (2, "group"), (3, "file"))], "value")


def items(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, kind, position, raw) of each object below ``path``; a file holds a list wrapper, a bare list or one object.

    Objects without a kind get that of their file, also within ``raw``. kind is the file's, as it decides who parses
    them. Files of other names, unreadable ones and list members that are no objects are left out.
    """
    known = [(g, file_of(k), k) for g, kinds in KINDS.items() for k in kinds]
    kinds = spark.createDataFrame(known, "group string, file string, kind string")  # 21 rows
    doc = F.try_parse_json("value")
    object_ = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    listed = F.coalesce(F.when(object_(doc), F.coalesce(F.try_variant_get(doc, "$.items", "array<variant>"), F.array(doc))), F.try_variant_get(doc, "$", "array<variant>"))
    rows = _documents(spark, path).join(F.broadcast(kinds), ["group", "file"]).select("cluster", "kind", F.posexplode(listed).alias("position", "item")).where(object_(F.col("item")))
    raw = F.to_json("item")
    stamped = F.concat(F.expr("substring(to_json(struct(kind)), 1, length(to_json(struct(kind))) - 1)"), F.when(raw == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.expr("substring(to_json(item), 2)"))))
    return rows.select("cluster", "kind", "position", F.when(F.try_variant_get("item", "$.kind", "variant").isNull(), stamped).otherwise(raw).alias("raw"))


def cluster_facts(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, k8s_version, provider, region): of each captured cluster what its version file and its first node say.

    Without a node a cluster is on premises and in no region.
    """
    docs = _documents(spark, path)
    versions = docs.where("group = 'kubeapi' AND file = 'version'").select("cluster", blank(F.get_json_object("value", "$.gitVersion")).alias("k8s_version"))
    node = "struct<metadata:struct<labels:map<string,string>>,spec:struct<providerID:string>>"
    nodes = items(spark, path).where("kind = 'Node'").groupBy("cluster").agg(F.min_by("raw", "position").alias("raw")).select("cluster", F.from_json("raw", node).alias("n"))
    labels: Column = F.coalesce(F.col("n.metadata.labels"), F.create_map().cast("map<string,string>"))
    told = nodes.select("cluster", provider(F.col("n.spec.providerID"), labels).alias("provider"), region(labels).alias("region"))
    out = docs.where("cluster <> ''").select("cluster").distinct().join(versions, "cluster", "left").join(told, "cluster", "left")
    return out.select("cluster", blank(F.col("k8s_version")).alias("k8s_version"), F.coalesce("provider", F.lit("onprem")).alias("provider"), blank(F.col("region")).alias("region"))
