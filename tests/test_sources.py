"""Reports, manifests, feeds and streams."""

import json

from pyspark.sql import functions as F

from ravelin import intake
from ravelin.operators import resolve
from ravelin.sources import feeds, reports
from ravelin.streaming import cycles


def raw(spark, *docs):
    return spark.createDataFrame([(json.dumps(d) if isinstance(d, dict) else d,) for d in docs], "raw string")


def meta(name, ns="ns", **more):
    return {"metadata": {"name": name, "namespace": ns, **more}}


LABELS = {f"trivy-operator.{k}": v for k, v in (("resource.namespace", "shop"), ("resource.kind", "ReplicaSet"), ("resource.name", "api-1"), ("container.name", "main"))}


def test_vulnerability_report(spark):
    doc = {"kind": "VulnerabilityReport", "metadata": {"labels": LABELS}, "report": {"artifact": {"registry": "r.io", "repository": "app", "tag": "1", "digest": "sha256:a"}, "os": {"family": "alpine", "name": "3"},
           "vulnerabilities": [{"vulnerabilityID": "CVE-1", "resource": "ssl", "installedVersion": "1", "severity": "CRITICAL", "cvss": {"nvd": {"V2Score": 5.0, "V3Vector": ""}, "redhat": {"V3Score": 9.0, "V3Vector": "v"}}},
                               {"vulnerabilityID": "CVE-2", "severity": "odd", "score": 7, "title": "t", "fixedVersion": "2"}]}}
    a, b = reports.vulnerability_rows(raw(spark, doc, "not json", {})).orderBy("vuln_id").collect()
    assert (a.namespace, a.kind, a.name, a.container, a.image_ref, a.image_digest) == ("shop", "ReplicaSet", "api-1", "main", "r.io/app:1", "sha256:a")
    assert (a.severity, a.cvss_score, a.cvss_vector, a.title, a.fixed_version) == ("critical", 5.0, "v", "CVE-1", "")
    assert (b.severity, b.cvss_score, b.title, b.fixed_version, b.base_eosl) == ("unknown", 7.0, "t", "2", False)


def test_checks_and_secrets(spark):
    doc = {"metadata": {"namespace": "meta", "labels": {}}, "report": {"checks": [{"checkID": "KSV017", "severity": "HIGH", "success": False}, {"checkID": "KSV001", "success": True}, {"checkID": "X1"}], "secrets": [{"ruleID": "key", "severity": "LOW"}]}}
    rows = {r.vuln_id: r for r in reports.check_rows(raw(spark, doc), "config").collect()}
    assert set(rows) == {"AVD-KSV-0017", "X1"} and rows["AVD-KSV-0017"].signal_id == "ksv:KSV-0017" and rows["X1"].signal_id is None
    assert rows["X1"].namespace == "meta" and rows["X1"].title == "X1"
    assert {r.vuln_id for r in reports.check_rows(raw(spark, doc), "compliance").collect()} == {"KSV017", "X1"}
    s = reports.secret_rows(raw(spark, doc)).first()
    assert (s.vuln_id, s.severity, s.signal_id) == ("key", "low", "kp:exposed-secret-in-image")


def test_policy_report(spark):
    result = lambda **k: {"policy": "disallow-host-path", "rule": "r", "result": "fail", **k}
    doc = {"metadata": {"namespace": "a"}, "scope": {"kind": "Pod", "name": "p"}, "results": [result(subjects=[{"kind": "Pod", "name": "s1"}, {"kind": "Pod", "name": "s2", "namespace": "b"}]), result(resources=[{"kind": "Job", "name": "j"}], severity="Low"), result(rule=""), result(result="pass")]}
    rows = reports.policy_rows(raw(spark, doc)).collect()
    assert {(r.namespace, r.kind, r.name, r.severity, r.title) for r in rows} == {("a", "Pod", "s1", "medium", "disallow-host-path/r"), ("b", "Pod", "s2", "medium", "disallow-host-path/r"), ("a", "Job", "j", "low", "disallow-host-path/r"), ("a", "Pod", "p", "medium", "disallow-host-path")}
    assert {r.signal_id for r in rows} == {"kyverno:disallow-host-path"}
    bare = reports.policy_rows(raw(spark, {"results": [result(policy="none")]})).collect()
    assert [(r.kind, r.name, r.signal_id) for r in bare] == [("", "", None)]


def owner(kind, name, controller=True):
    return {"ownerReferences": [{"kind": "Other", "name": "o"}, {"kind": kind, "name": name, "controller": controller}]}


def items():
    spec = {"containers": [{"name": "c", "image": "r.io/app:1", "securityContext": {"privileged": True, "runAsNonRoot": False}}], "initContainers": [{"name": "i", "image": "init@sha256:aa"}], "hostPID": True, "volumes": [{"name": "v", "hostPath": {"path": "/"}}]}
    template = {"metadata": {"labels": {"app": "x"}}, "spec": spec}
    status = {"containerStatuses": [{"name": "c", "imageID": "docker://app@sha256:run"}]}
    return [
        {"kind": "Namespace", **meta("ns", labels={"a": "b"})},
        {"kind": "Deployment", **meta("dep"), "spec": {"replicas": 2, "template": template}},
        {"kind": "CronJob", **meta("cron"), "spec": {"jobTemplate": {"spec": {"template": template}}}},
        {"kind": "Job", **meta("owned", **owner("CronJob", "cron")), "spec": {"template": template}},
        {"kind": "Job", **meta("free", **owner("CronJob", "cron", False)), "spec": {"template": {"spec": {"containers": []}}}},
        {"kind": "ReplicaSet", **meta("rs", **owner("Deployment", "dep"))},
        {"kind": "Pod", **meta("pod", **owner("ReplicaSet", "rs")), "spec": spec, "status": status},
        {"kind": "Pod", **meta("alone", labels={"l": "1"}), "spec": {"containers": [{"name": "c", "image": "app"}], "serviceAccountName": "sa"}, "status": {"containerStatuses": [{"name": "c", "imageID": "sha256:bare"}]}},
        {"kind": "Service", **meta("svc"), "spec": {"selector": {"app": "x"}, "type": "NodePort"}},
        {"kind": "Service", **meta("none"), "spec": {}},
        {"kind": "Ingress", **meta("ing"), "spec": {"defaultBackend": {"service": {"name": "svc"}}, "rules": [{"http": {"paths": [{"backend": {"service": {"name": "other"}}}, {"backend": {"service": {"name": "svc"}}}]}}, {}]}},
        {"kind": "ConfigMap", **meta("cm")},
        {"metadata": {"name": "no kind"}},
        {},
        {"x": "y"},
    ]


def test_inventory(spark):
    inv = reports.Inventory(raw(spark, *items()))
    assert inv.unknown().first().n == 2
    w = {(r.kind, r.name): r for r in inv.workloads().collect()}
    assert set(w) == {("Deployment", "dep"), ("CronJob", "cron"), ("Job", "free"), ("Pod", "alone")}
    assert w["Deployment", "dep"].replicas == 2 and w["CronJob", "cron"].labels == {"app": "x"} and w["Pod", "alone"].service_account == "sa" and w["Job", "free"].service_account == "default"
    assert {(r.kind, r.name, r.target_kind, r.target_name) for r in inv.aliases().collect()} == {("Job", "owned", "CronJob", "cron"), ("ReplicaSet", "rs", "Deployment", "dep"), ("Pod", "pod", "ReplicaSet", "rs")}
    obs = {(r.kind, r.name, r.container): r for r in inv.observations().collect()}
    assert obs["ReplicaSet", "rs", "c"].digest == "sha256:run" and obs["Deployment", "dep", "c"].digest == "" and obs["Deployment", "dep", "i"].init_container
    assert obs["Deployment", "dep", "i"].digest == "sha256:aa" and obs["Pod", "alone", "c"].digest == "sha256:bare" and obs["Deployment", "dep", "c"].registry == "r.io"
    fired = {r.signal_id for r in inv.signals().where("name = 'dep'").collect()}
    assert fired == {"kyverno:disallow-host-namespaces", "kyverno:disallow-privileged-containers", "kyverno:require-run-as-nonroot", "kyverno:disallow-host-path"}
    assert inv.signals().where("name = 'alone'").count() == 0 and inv.signals().where("name = 'rs'").count() == 4
    assert [(r.svc_name, r.selector) for r in inv.services().collect()] == [("svc", {"app": "x"})]
    assert inv.ingresses().first().backends == ["svc", "other"]
    assert [r.namespace for r in inv.bare_namespaces().collect()] == ["ns"]
    assert inv.namespaces().first().labels == {"a": "b"}


def test_selectors_meet_labels(spark):
    inv = reports.Inventory(raw(spark, *items()))
    services = inv.services().select(F.col("svc_name").alias("svc_id"), F.col("namespace").alias("ns_id"), "svc_name", "selector")
    workloads = inv.workloads().select(F.col("name").alias("wl_id"), F.col("namespace").alias("ns_id"), "labels")
    matches = resolve.match_selectors(services, workloads)
    assert {r.wl_id for r in matches.collect()} == {"dep", "cron"}
    ing = inv.ingresses().select(F.col("ing_name").alias("ing_id"), F.col("namespace").alias("ns_id"), "backends")
    assert {(r.ing_id, r.wl_id) for r in resolve.ingress_workloads(ing, services, matches).collect()} == {("ing", "dep"), ("ing", "cron")}


def test_ingresses_go_to_workloads_not_by_service(spark):
    """A hundred services of one name and selector are one step between ingress and workload; pairs are not made twice."""
    services = spark.range(100).selectExpr("concat('s', id) AS svc_id", "'ns' AS ns_id", "'web' AS svc_name", "map('app', 'x') AS selector")
    workloads = spark.createDataFrame([("w1", "ns", {"app": "x"}), ("w2", "ns", {"app": "x", "t": "1"}), ("w3", "ns", {"app": "y"}), ("w1", "other", {"app": "x"})], "wl_id string, ns_id string, labels map<string,string>")
    ing = spark.createDataFrame([("a", "ns", ["web", "web", None]), ("b", "ns", ["web", "none"]), ("a", "ns", ["web"]), ("a", "other", ["web"]), ("c", "ns", [])], "ing_id string, ns_id string, backends array<string>")
    found = resolve.ingress_selected(ing, services, workloads)
    expected = [("a", "w1"), ("a", "w2"), ("b", "w1"), ("b", "w2")]
    assert sorted(tuple(r) for r in found.collect()) == expected
    matches = resolve.match_selectors(services, workloads)
    over = resolve.ingress_workloads(ing, services, matches)
    assert sorted(tuple(r) for r in over.collect()) == expected
    # no aggregate or exchange follows the join that makes the pairs
    plan = over._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[: plan.index("Aggregate")]


def test_pairs_are_laid_out_from_packs_of_like_workloads(spark, monkeypatch):
    """Ten workloads of equal labels are one step behind a set of backends; told twice, in two places, in small packs, each pair is there once."""
    monkeypatch.setattr(resolve, "PACK", 3)
    services = spark.createDataFrame([(1, "ns", "web", {"app": "x"}), (2, "ns", "all", {"app": "x"}), (3, "far", "web", {"t": "1"})], "svc_id long, ns_id string, svc_name string, selector map<string,string>")
    workloads = spark.range(10).selectExpr("id AS wl_id", "'ns' AS ns_id", "map('t', '1', 'app', 'x') AS labels")
    workloads = workloads.unionByName(workloads).unionByName(spark.range(2).selectExpr("id AS wl_id", "'far' AS ns_id", "map('t', '1') AS labels"))
    ing = spark.createDataFrame([("a", "ns", ["web", "all"]), ("a", "far", ["web"]), ("a", "far", ["web"]), ("b", "far", ["web"])], "ing_id string, ns_id string, backends array<string>")
    found = resolve.ingress_selected(ing, services, workloads)
    assert sorted(tuple(r) for r in found.collect()) == [("a", k) for k in range(10)] + [("b", 0), ("b", 1)]
    # what joins the ingresses are packs, not workloads
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(wls_" in plan[: plan.index("Join")]


def test_documents_of_several_kinds_are_read_once(spark):
    """Counts by kind are those of the rows of ``scan_facts``, and the documents that kinds share are parsed for all of them together."""
    checks = raw(spark, {"report": {"checks": [{"checkID": "KSV1", "severity": "HIGH", "success": False, "title": "t"}, {"checkID": "KSV2", "severity": "HIGH"}, {"checkID": "KSV3", "success": True}]}}, {"report": {"checks": [{"checkID": "KSV2", "severity": "HIGH", "title": ""}]}})
    others = raw(spark, {"report": {"checks": [{"checkID": "KSV9", "severity": "odd"}]}})
    none = raw(spark, {"report": {}})
    by_kind = {"trivy.ConfigAuditReport": checks, "trivy.InfraAssessmentReport": checks, "trivy.RbacAssessmentReport": others, "trivy.ExposedSecretReport": none, "trivy.VulnerabilityReport": none, "other": checks}
    found = reports.scan_counts(by_kind)
    expected = reports.scan_facts(by_kind).groupBy("scan_kind", "category", "severity").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))
    assert sorted(found.collect()) == sorted(expected.collect())
    assert sorted(tuple(r) for r in found.collect()) == [("trivy.ConfigAuditReport", "config", "high", 3, 2), ("trivy.InfraAssessmentReport", "compliance", "high", 3, 2), ("trivy.RbacAssessmentReport", "rbac", "unknown", 1, 1)]
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert plan(found).count("from_json(") == 4
    assert plan(intake.scan_kinds_union(spark, "/root/testdata/sf0.001")).count("from_json(") == 5


def test_folder_of_items(spark, tmp_path):
    (tmp_path / "kubeapi").mkdir()
    (tmp_path / "kubeapi/a.json").write_text(json.dumps({"items": [{"kind": "A"}, {"kind": "B"}]}))
    (tmp_path / "kubeapi/b.json").write_text(json.dumps([{"kind": "C"}]))
    (tmp_path / "kubeapi/c.json").write_text(json.dumps({"kind": "D"}))
    (tmp_path / "kubeapi/d.txt").write_text("{}")
    rows = reports.folder(spark, str(tmp_path)).collect()
    assert sorted(json.loads(r.raw)["kind"] for r in rows) == ["A", "B", "C", "D"]


def test_feeds(spark, tmp_path):
    (tmp_path / "epss.csv").write_text("#model:v1\ncve,epss,percentile\nCVE-1,0.1,0.9\nCVE-2,x,0.1\nCVE-3\n")
    assert [(r.vuln_id, r.score, r.percentile) for r in feeds.epss(spark, str(tmp_path / "epss.csv")).collect()] == [("CVE-1", 0.1, 0.9)]
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-01-02T00:00", "dueDate": "soon"}, {"dateAdded": "2024-01-01"}]}, indent=1))
    r = feeds.kev(spark, str(tmp_path / "kev.json")).collect()
    assert [(x.vuln_id, str(x.added_at), x.due_date) for x in r] == [("CVE-1", "2024-01-02", None)]
    for bad in ("", "oops", '{"vulnerabilities": []}'):
        (tmp_path / "bad.json").write_text(bad)
        assert feeds.kev(spark, str(tmp_path / "bad.json")).count() == 0
    assert len(feeds.cycle_id()) == 26 and feeds.cycle_id(1.0, "0" * 16) < feeds.cycle_id(2.0, "0" * 16)


def test_stream_releases_finished_cycles(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    lines = feeds.cycle_lines("c", "id1", {"inventory": [{"a": 1}], "trivy.X": [{"b": 1}, {}], "kyverno.Y": []}, "2024-01-01T00:00:00")
    assert json.loads(lines[0])["kind"] == "inventory" and sum('"finish"' in x for x in lines) == 3
    (landing / "1.json").write_text("\n".join(x for x in lines if '"finish"' not in x))
    paths = [str(tmp_path / p) for p in ("waiting", "out", "rejects", "checkpoint")]
    run = lambda: cycles.ingest(feeds.landed(spark, str(landing), stream=True), *paths, lambda df: F.get_json_object("payload", "$.a").isNotNull() | F.get_json_object("payload", "$.b").isNotNull()).awaitTermination()
    run()
    assert spark.read.parquet(paths[1]).count() == 0 and spark.read.parquet(f"{paths[0]}/batch=0").count() == 3
    (landing / "2.json").write_text("\n".join(x for x in lines if '"finish"' in x))
    run()
    assert spark.read.parquet(paths[1]).count() == 2 and spark.read.parquet(paths[2]).count() == 1
    batch = feeds.landed(spark, str(landing))
    assert cycles.finished(batch).count() == 3
    assert {(r.kind, r.state, r.items, r.announced) for r in cycles.counters(batch).collect()} == {("inventory", "draining", 1, 1), ("trivy.X", "draining", 2, 2), ("kyverno.Y", "draining", 0, 0)}
