"""Scanner reports and inventory manifests: JSON documents to typed rows."""

from __future__ import annotations

import uuid
from copy import copy
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.scalars import avd_id, blank, filled, image_ref, policy_severity, ref_digest, registry_of, repository_of, scanner_severity, status_digest
from ravelin.functions.signals import lookup
from ravelin.sources.feeds import shared_folder

_META = "struct<name:string,namespace:string,labels:map<string,string>,annotations:map<string,string>,ownerReferences:array<struct<kind:string,name:string,controller:boolean>>>"
_CVSS = "struct<V3Score:double,V2Score:double,V3Vector:string,V2Vector:string>"
_CONTAINER = "struct<name:string,image:string,securityContext:struct<privileged:boolean,allowPrivilegeEscalation:boolean,runAsNonRoot:boolean,readOnlyRootFilesystem:boolean>>"
_POD = f"struct<serviceAccountName:string,hostNetwork:boolean,hostPID:boolean,hostIPC:boolean,containers:array<{_CONTAINER}>,initContainers:array<{_CONTAINER}>,volumes:array<struct<name:string,hostPath:struct<path:string>>>>"
_TEMPLATE = f"struct<metadata:struct<labels:map<string,string>>,spec:{_POD}>"
_SERVICE = "struct<service:struct<name:string>>"
REPORT = f"""struct<kind:string,metadata:{_META},report:struct<
    artifact:struct<registry:string,repository:string,tag:string,digest:string>, os:struct<family:string,name:string,eosl:boolean>,
    vulnerabilities:array<struct<vulnerabilityID:string,resource:string,installedVersion:string,fixedVersion:string,severity:string,score:double,title:string,cvss:map<string,{_CVSS}>>>,
    checks:array<struct<checkID:string,severity:string,success:boolean,title:string,description:string>>,
    secrets:array<struct<ruleID:string,severity:string,title:string,category:string,match:string,target:string>>>>"""
POLICY_REPORT = f"""struct<kind:string,metadata:{_META},scope:struct<kind:string,name:string,namespace:string>,results:array<struct<policy:string,rule:string,result:string,
    severity:string,message:string,category:string,subjects:array<struct<kind:string,name:string,namespace:string>>,resources:array<struct<kind:string,name:string,namespace:string>>>>>"""
ITEM = f"""struct<apiVersion:string,kind:string,metadata:{_META},
    spec:struct<replicas:int,serviceAccountName:string,hostNetwork:boolean,hostPID:boolean,hostIPC:boolean,containers:array<{_CONTAINER}>,initContainers:array<{_CONTAINER}>,
      volumes:array<struct<name:string,hostPath:struct<path:string>>>,template:{_TEMPLATE},jobTemplate:struct<spec:struct<template:{_TEMPLATE}>>,
      type:string,selector:string,ingressClassName:string,defaultBackend:{_SERVICE},rules:array<struct<http:struct<paths:array<struct<backend:{_SERVICE}>>>>>>,
    status:struct<containerStatuses:array<struct<name:string,imageID:string>>,initContainerStatuses:array<struct<name:string,imageID:string>>>>"""
CONTROLLERS = ("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job")
#: What a pod specification may fire, and when.
SELF_SIGNALS = {
    "kyverno:disallow-host-namespaces": lambda s: F.greatest(*[F.coalesce(s[k], F.lit(False)) for k in ("hostNetwork", "hostPID", "hostIPC")]),
    "kyverno:disallow-privileged-containers": lambda s: _any(s, "privileged", True),
    "kyverno:disallow-privilege-escalation": lambda s: _any(s, "allowPrivilegeEscalation", True),
    "kyverno:require-run-as-nonroot": lambda s: _any(s, "runAsNonRoot", False),
    "kyverno:require-ro-rootfs": lambda s: _any(s, "readOnlyRootFilesystem", False),
    "kyverno:disallow-host-path": lambda s: F.coalesce(F.exists(s["volumes"], lambda v: v["hostPath"].isNotNull()), F.lit(False)),
}


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of each JSON item below ``path``: files hold a list wrapper, a bare array or one object."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    doc = F.try_parse_json(F.col("value"))
    listed = F.coalesce(F.try_variant_get(doc, "$.items", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"), F.array(doc))
    return files.select(F.input_file_name().alias("path"), F.explode(listed).alias("item")).select("path", F.to_json("item").alias("raw"))


def _any(spec: Column, field: str, value: bool) -> Column:
    """Some container says so; unset says nothing."""
    return F.coalesce(F.exists(_containers(spec), lambda c: c["securityContext"][field].eqNullSafe(F.lit(value))), F.lit(False))


def _containers(spec: Column) -> Column:
    none = F.array().cast(f"array<{_CONTAINER}>")
    return F.concat(F.coalesce(spec["containers"], none), F.coalesce(spec["initContainers"], none))


def _flagged(init: bool):
    return lambda x: F.struct(x.alias("c"), F.lit(init).alias("init"))


def _identity(md: Column) -> list[Column]:
    label = lambda k: blank(F.try_element_at(md["labels"], F.lit(f"trivy-operator.{k}")))
    return [
        filled(label("resource.namespace"), md["namespace"]).alias("namespace"),
        label("resource.kind").alias("kind"),
        label("resource.name").alias("name"),
        label("container.name").alias("container"),
    ]


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select(F.from_json("raw", schema).alias("o"))


def vulnerability_rows(raw: DataFrame) -> DataFrame:
    """One row per vulnerability of a report, with its image."""
    v, a = F.col("v"), F.col("o.report.artifact")
    scores = [v["score"], *[v["cvss"][vendor][k] for vendor in ("nvd", "redhat") for k in ("V3Score", "V2Score")]]
    vectors = [v["cvss"][vendor][k] for vendor in ("nvd", "redhat") for k in ("V3Vector", "V2Vector")]
    rows = _parsed(raw, REPORT).select("o", F.explode("o.report.vulnerabilities").alias("v"))
    return rows.select(
        *_identity(F.col("o.metadata")),
        image_ref(a["registry"], a["repository"], a["tag"]).alias("image_ref"),
        blank(a["digest"]).alias("image_digest"),
        blank(F.col("o.report.os.family")).alias("os_family"),
        blank(F.col("o.report.os.name")).alias("os_version"),
        F.coalesce("o.report.os.eosl", F.lit(False)).alias("base_eosl"),
        blank(v["vulnerabilityID"]).alias("vuln_id"),
        blank(v["resource"]).alias("pkg_name"),
        blank(v["installedVersion"]).alias("installed_version"),
        blank(v["fixedVersion"]).alias("fixed_version"),
        F.substring(filled(v["title"], v["vulnerabilityID"]), 1, 512).alias("title"),
        scanner_severity(v["severity"]).alias("severity"),
        F.coalesce(*scores).alias("cvss_score"),
        filled(*vectors).alias("cvss_vector"),
    )


def _failed_checks(raw: DataFrame) -> DataFrame:
    c = F.col("c")
    rows = _parsed(raw, REPORT).select("o", F.explode("o.report.checks").alias("c")).where(~F.coalesce(c["success"], F.lit(False)))
    return rows.select(*_identity(F.col("o.metadata")), blank(c["checkID"]).alias("check_id"), F.substring(filled(c["title"], c["checkID"]), 1, 512).alias("title"), scanner_severity(c["severity"]).alias("severity"))


def check_rows(raw: DataFrame, category: str) -> DataFrame:
    """One row per failed check: of audits and RBAC the AVD id and the signal; compliance keeps its own ids."""
    return _as_checks(_failed_checks(raw), category)


def _as_checks(rows: DataFrame, category: str) -> DataFrame:
    rows = rows.withColumn("vuln_id", F.col("check_id") if category == "compliance" else avd_id(F.col("check_id")))
    return lookup(rows, "check_id").withColumn("category", F.lit(category)).drop("check_id")


def secret_rows(raw: DataFrame) -> DataFrame:
    s = F.col("s")
    rows = _parsed(raw, REPORT).select("o", F.explode("o.report.secrets").alias("s"))
    return rows.select(
        *_identity(F.col("o.metadata")),
        blank(s["ruleID"]).alias("vuln_id"),
        F.substring(filled(s["title"], s["ruleID"]), 1, 512).alias("title"),
        scanner_severity(s["severity"]).alias("severity"),
        F.lit("kp:exposed-secret-in-image").alias("signal_id"),
    )


def policy_rows(raw: DataFrame) -> DataFrame:
    """One row per subject of each failed, erroneous or warning result; subjects, else resources, else the report's scope."""
    r, subject = F.col("r"), F.col("s")
    none = F.array().cast("array<struct<kind:string,name:string,namespace:string>>")
    some = lambda c: F.when(F.size(c) > 0, c)
    scope = F.when((blank(F.col("o.scope.kind")) != "") & (blank(F.col("o.scope.name")) != ""), F.array("o.scope"))
    rows = _parsed(raw, POLICY_REPORT).select("o", F.explode("o.results").alias("r")).where(F.lower(blank(r["result"])).isin("fail", "error", "warn"))
    rows = rows.select("o", "r", F.explode_outer(F.coalesce(some(r["subjects"]), some(r["resources"]), scope, none)).alias("s"))
    rows = rows.select(
        filled(subject["namespace"], F.col("o.metadata.namespace")).alias("namespace"),
        blank(subject["kind"]).alias("kind"),
        blank(subject["name"]).alias("name"),
        blank(r["policy"]).alias("policy"),
        F.when(blank(r["rule"]) != "", F.concat_ws("/", blank(r["policy"]), r["rule"])).otherwise(blank(r["policy"])).alias("title"),
        policy_severity(r["severity"]).alias("severity"),
    )
    return lookup(rows, "policy", "kyverno")


def _of(category: str):
    return lambda rows: rows.withColumn("category", F.lit(category))


def _checked(category: str):
    return lambda rows: _as_checks(rows, category)


#: Of each kind of scan what reads its documents, its category, and what makes its rows of what was read.
SCANS = {
    "trivy.VulnerabilityReport": (vulnerability_rows, "vulnerability", _of("vulnerability")),
    "trivy.ConfigAuditReport": (_failed_checks, "config", _checked("config")),
    "trivy.ExposedSecretReport": (secret_rows, "exposed-secret", _of("exposed-secret")),
    "trivy.RbacAssessmentReport": (_failed_checks, "rbac", _checked("rbac")),
    "trivy.ClusterRbacAssessmentReport": (_failed_checks, "rbac", _checked("rbac")),
    "trivy.InfraAssessmentReport": (_failed_checks, "compliance", _checked("compliance")),
    "trivy.ClusterComplianceReport": (_failed_checks, "compliance", _checked("compliance")),
    "kyverno.PolicyReport": (policy_rows, "policy", _of("policy")),
    "kyverno.ClusterPolicyReport": (policy_rows, "policy", _of("policy")),
}


def scan_facts(by_kind: dict[str, DataFrame]) -> DataFrame:
    """The rows of scans (raw), by kind, as one table with scan_kind; what a kind does not know is null. Unknown kinds give none."""
    tables = [SCANS[kind][2](SCANS[kind][0](raw)).withColumn("scan_kind", F.lit(kind)) for kind, raw in by_kind.items() if kind in SCANS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def scan_counts(by_kind: dict[str, DataFrame]) -> DataFrame:
    """scan_kind, category, severity of ``scan_facts`` with the number of rows (n) and of their titles.

    Kinds that are given the same documents and read them in the same way have the same rows, so these are read, and
    their titles told apart, once; the counts then go to each of the kinds.
    """
    shared: dict[tuple, list[str]] = {}
    for kind in by_kind:
        if kind in SCANS:
            shared.setdefault((id(by_kind[kind]), SCANS[kind][0]), []).append(kind)
    tables = [read(by_kind[kinds[0]]).select(F.lit(k).alias("read_"), "severity", "title") for k, ((_, read), kinds) in enumerate(shared.items(), 1)]
    rows = reduce(lambda a, b: a.unionByName(b), tables)
    counts = rows.groupBy("read_", "severity").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))
    named = F.array(*[F.array(*[F.struct(F.lit(kind).alias("scan_kind"), F.lit(SCANS[kind][1]).alias("category")) for kind in kinds]) for kinds in shared.values()])
    return counts.select(F.inline(F.element_at(named, F.col("read_"))), "severity", "n", "titles")


class Inventory:
    """The tables of an inventory envelope's items, (raw: one manifest each)."""

    def __init__(self, raw: DataFrame):
        o = F.col("o")
        spec = F.coalesce(
            F.when(o["kind"] == "Pod", F.struct(*[o["spec"][f].alias(f) for f in ("serviceAccountName", "hostNetwork", "hostPID", "hostIPC", "containers", "initContainers", "volumes")])),
            F.when(o["kind"] == "CronJob", o["spec"]["jobTemplate"]["spec"]["template"]["spec"]),
            o["spec"]["template"]["spec"],
        )
        owner = F.try_element_at(F.filter(o["metadata"]["ownerReferences"], lambda x: F.coalesce(x["controller"], F.lit(False))), F.lit(1))
        self.raw, self.stored = raw, False
        self.items = _parsed(raw, ITEM).select("o", blank(o["kind"]).alias("kind"), blank(o["metadata"]["namespace"]).alias("namespace"), blank(o["metadata"]["name"]).alias("name"), spec.alias("pod"), owner.alias("owner"))

    def where(self, condition: Column) -> Inventory:
        """The inventory of the items (kind, namespace, name) for which ``condition`` holds."""
        out = copy(self)
        out.items = self.items.where(condition)
        return out

    def store(self) -> Inventory:
        """Write the items, unless they are, to the shared folder as Parquet: what follows parses nothing and reads the kinds and fields that it needs."""
        if not self.stored:
            path = f"{shared_folder(self.items.sparkSession)}/items-{uuid.uuid4().hex}"
            self.items.write.parquet(path)
            self.items, self.stored = self.items.sparkSession.read.schema(self.items.schema).parquet(path), True
        return self

    def unknown(self) -> DataFrame:
        """Items of no kind known here that look like manifests, counted."""
        known = (*CONTROLLERS, "Pod", "ReplicaSet", "Namespace", "Service", "Ingress", "NetworkPolicy")
        odd = (F.col("kind") == "") & (F.col("o.metadata").isNotNull() | F.col("o.spec").isNotNull() | F.col("o.apiVersion").isNotNull())
        return self.items.agg(F.count_if(odd | ((F.col("kind") != "") & ~F.col("kind").isin(*known))).alias("n"))

    def namespaces(self) -> DataFrame:
        return self.items.where("kind = 'Namespace'").select("name", F.col("o.metadata.labels").alias("labels"), F.col("o.metadata.annotations").alias("annotations"))

    def all_namespaces(self) -> DataFrame:
        """Namespace items, and those that workloads name without an item (declared: false)."""
        own = self.namespaces().withColumn("declared", F.lit(True))
        implied = self.workloads().select(F.col("namespace").alias("name")).distinct().join(own.select("name"), "name", "left_anti")
        return own.unionByName(implied.withColumn("declared", F.lit(False)), allowMissingColumns=True)

    def _owned(self) -> Column:
        return F.col("owner").isNotNull()

    def workloads(self) -> DataFrame:
        """Controllers, and jobs and pods that nobody controls."""
        kind = F.col("kind")
        rows = self.items.where("name <> '' AND namespace <> ''").where(kind.isin("Deployment", "StatefulSet", "DaemonSet", "CronJob") | (kind.isin("Job", "Pod") & ~self._owned()))
        labels = F.when(kind == "Pod", F.col("o.metadata.labels")).when(kind == "CronJob", F.col("o.spec.jobTemplate.spec.template.metadata.labels")).otherwise(F.col("o.spec.template.metadata.labels"))
        return rows.select("namespace", "kind", "name", filled(F.col("pod.serviceAccountName"), F.lit("default")).alias("service_account"), F.when(kind != "Pod", F.col("o.spec.replicas")).alias("replicas"), F.coalesce(labels, F.create_map().cast("map<string,string>")).alias("labels"))

    def aliases(self) -> DataFrame:
        """Owner edges of replica sets, jobs and pods."""
        rows = self.items.where("name <> '' AND namespace <> ''").where(F.col("kind").isin("ReplicaSet", "Job", "Pod") & self._owned())
        return rows.select("namespace", "kind", "name", blank(F.col("owner.kind")).alias("target_kind"), blank(F.col("owner.name")).alias("target_name")).where("target_kind <> '' AND target_name <> ''")

    def observations(self) -> DataFrame:
        """Images of containers, declared or running, under the item or, for owned pods, under its owner."""
        kind, c = F.col("kind"), F.col("c.c")
        rows = self.items.where(kind.isin("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Pod") | ((kind == "Job") & ~self._owned()))
        none = F.array().cast(f"array<{_CONTAINER}>")
        both = F.concat(*[F.transform(F.coalesce(F.col(f"pod.{f}"), none), _flagged(init)) for f, init in (("containers", False), ("initContainers", True))])
        rows = rows.select("*", F.explode(both).alias("c")).where((blank(c["name"]) != "") & (blank(c["image"]) != ""))
        status = F.concat(*[F.coalesce(F.col(f"o.status.{f}"), F.array().cast("array<struct<name:string,imageID:string>>")) for f in ("containerStatuses", "initContainerStatuses")])
        running = F.try_element_at(F.filter(status, lambda s: s["name"] == c["name"]), F.lit(1))["imageID"]
        digest = filled(ref_digest(c["image"]), F.when(kind == "Pod", status_digest(running)))
        up = self._owned() & (kind == "Pod")
        return rows.select("namespace", F.when(up, F.col("owner.kind")).otherwise(kind).alias("kind"), F.when(up, F.col("owner.name")).otherwise(F.col("name")).alias("name"), c["name"].alias("container"), F.col("c.init").alias("init_container"), c["image"].alias("ref"), digest.alias("digest"), registry_of(c["image"]).alias("registry"), repository_of(c["image"]).alias("repository"))

    def signals(self) -> DataFrame:
        """What pod specifications fire, under the item or, for owned pods, under its owner."""
        kind = F.col("kind")
        rows = self.items.where(kind.isin("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Pod") | ((kind == "Job") & ~self._owned())).where("pod IS NOT NULL")
        fired = F.array_compact(F.array(*[F.when(test(F.col("pod")), F.lit(name)) for name, test in SELF_SIGNALS.items()]))
        up = self._owned() & (kind == "Pod")
        return rows.select("namespace", F.when(up, F.col("owner.kind")).otherwise(kind).alias("kind"), F.when(up, F.col("owner.name")).otherwise(F.col("name")).alias("name"), F.explode(fired).alias("signal_id")).distinct()

    def services(self) -> DataFrame:
        """Services with a selector."""
        selector = F.from_json(F.col("o.spec.selector"), "map<string,string>")
        rows = self.items.where("kind = 'Service'").select("namespace", F.col("name").alias("svc_name"), blank(F.col("o.spec.type")).alias("type"), selector.alias("selector"), F.col("o.metadata.annotations").alias("annotations"))
        return rows.where(F.size("selector") > 0)

    def ingresses(self) -> DataFrame:
        paths = F.flatten(F.transform(F.coalesce(F.col("o.spec.rules"), F.array()), lambda r: F.coalesce(F.transform(r["http"]["paths"], lambda p: p["backend"]["service"]["name"]), F.array().cast("array<string>"))))
        named = F.array_distinct(F.filter(F.concat(F.array("o.spec.defaultBackend.service.name"), paths), lambda x: F.coalesce(x, F.lit("")) != ""))
        return self.items.where("kind = 'Ingress'").select("namespace", F.col("name").alias("ing_name"), F.col("o.spec.ingressClassName").alias("class_name"), F.col("o.metadata.annotations").alias("annotations"), named.alias("backends"))

    def bare_namespaces(self) -> DataFrame:
        """Namespaces of workloads without any network policy."""
        return self.workloads().select("namespace").distinct().join(self.items.where("kind = 'NetworkPolicy'").select("namespace"), "namespace", "left_anti")
