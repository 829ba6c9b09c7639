"""Stored tables, and what import cycles do to them."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from ravelin import replay
from ravelin.operators import cycle, enrichment, findings, inventory
from ravelin.sources import reports
from ravelin.sources.versions import Commit, Conflict, Versions, claim, names

D = "/root/testdata/sf0.001"
PAIRS = "k long, v string"


def newer(stored, batch):
    both = stored.select("*", F.lit(0).alias("n_")).unionByName(batch.select("*", F.lit(1).alias("n_")))
    return both.groupBy("k").agg(F.max_by("v", "n_").alias("v"))


@pytest.fixture
def store(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/store", buckets=8)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def test_a_merge_leaves_untouched_buckets_alone(spark, store, tmp_path):
    first = store.begin()
    first.replace("t", spark.createDataFrame([(k, "a") for k in range(100)], PAIRS), ("k",))
    assert first.publish() == 1
    before = store.head()[1]["t"]["buckets"]
    written = files(tmp_path / "store" / "t")
    second = store.begin()
    second.merge("t", spark.createDataFrame([(3, "b"), (1000, "b")], PAIRS), ("k",), newer)
    assert rows(store.read("t")) == [(k, "a") for k in range(100)]  # nothing shows yet
    assert second.publish() == 2
    after, touched = store.head()[1]["t"]["buckets"], set(second.touched["t"])
    assert 1 <= len(touched) <= 2 and all((before[b] == after[b]) == (b not in touched) for b in before)
    assert set(written) <= set(files(tmp_path / "store" / "t"))  # old files are as they were
    assert rows(store.read("t")) == sorted([(k, "b" if k == 3 else "a") for k in range(100)] + [(1000, "b")])
    assert rows(store.read("t", 1)) == [(k, "a") for k in range(100)]


def test_a_failure_between_two_tables_shows_nothing(spark, store):
    first = store.begin()
    first.replace("a", spark.createDataFrame([(1, "old")], PAIRS), ("k",))
    first.replace("b", spark.createDataFrame([(1, "old")], PAIRS), ("k",))
    first.publish()
    broken = store.begin()
    broken.replace("a", spark.createDataFrame([(1, "new")], PAIRS), ("k",))
    with pytest.raises(Exception, match="(?i)divi"):
        broken.merge("b", spark.range(1).select(F.col("id").alias("k"), F.expr("cast(1 / id AS string)").alias("v")), ("k",), newer)
    assert rows(store.read("a")) == rows(store.read("b")) == [(1, "old")]
    again = store.begin()  # the cycle runs again, in folders of its own
    again.replace("a", spark.createDataFrame([(1, "new")], PAIRS), ("k",))
    again.merge("b", spark.createDataFrame([(1, "new")], PAIRS), ("k",), newer)
    assert again.publish() == 2 and rows(store.read("a")) == rows(store.read("b")) == [(1, "new")]


def test_of_two_commits_one_is_refused(spark, store):
    one, two = store.begin(), store.begin()
    for c, v in ((one, "one"), (two, "two")):
        c.replace("t", spark.createDataFrame([(1, v)], PAIRS), ("k",))
    two.publish()
    with pytest.raises(Conflict):
        one.publish()
    assert rows(store.read("t")) == [(1, "two")]


def test_empty_tables_and_batches(spark, store):
    none = spark.createDataFrame([], PAIRS)
    first = store.begin()
    first.replace("t", none, ("k",))
    first.merge("t", none, ("k",), newer)
    first.publish()
    assert store.read("t").columns == ["k", "v"] and rows(store.read("t")) == []
    second = store.begin()
    second.merge("t", spark.createDataFrame([(None, "null key"), (2, None)], PAIRS), ("k",), newer)
    second.publish()
    assert set(store.read("t").collect()) == {(None, "null key"), (2, None)}


def test_one_of_many_claims_a_name(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((claim(spark, f"file://{tmp_path}/ledger/x", str(k)), k))) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [k for ok, k in won if ok]
    assert len(winners) == 1 and (tmp_path / "ledger" / "x").read_text() == str(winners[0])
    assert names(spark, f"file://{tmp_path}/ledger") == ["x"] and names(spark, f"file://{tmp_path}/none") == []


def brute_images(batches):
    """One row after the other, as they come: told by an inventory, or scanned."""
    out = {}
    for batch, told in batches:
        for digest, ref, family, version, eosl in sorted(batch, key=lambda r: [x or "" for x in r[:2]]):
            if not digest:
                continue
            own = out.setdefault(digest, {"ref": "", "os": ("", "", False)})
            if told:
                own["ref"] = ref or own["ref"]
            elif len(ref or "") > len(own["ref"]):
                own["ref"] = ref
            if family:
                own["os"] = (family, version or "", bool(eosl))
    return {(k, v["ref"], *v["os"]) for k, v in out.items()}


def test_images_are_merged_by_source(spark):
    kind = "digest string, ref string, os_family string, os_version string, base_eosl boolean"
    batches = [
        ([("d1", "app:1", "alpine", "3.1", True), ("d2", "r.io/app:2", None, None, None), (None, "x", None, None, None), ("", "y", "z", "", True)], False),
        ([("d1", "r.io/team/app@sha256:d1", None, None, None), ("d3", "a", None, None, None), ("d2", "", None, None, None)], True),
        ([("d1", "short", "debian", None, None), ("d3", "longer than a", "", "9", True), ("d4", None, "wolfi", "1", False)], False),
    ]
    stored = spark.createDataFrame([], kind)
    for batch, told in batches:
        stored = cycle.merged_images(stored, spark.createDataFrame(batch, kind).withColumn("told", F.lit(told)))
    assert {tuple(r) for r in stored.collect()} == brute_images(batches)


def test_signals_come_back_into_use(spark):
    kind = "wl_id long, signal_id string, first_seen int, last_seen int, active boolean"
    stored = spark.createDataFrame([(1, "a", 1, 2, False), (1, "b", 1, 2, False), (2, "a", 1, 1, True)], kind)
    batch = spark.createDataFrame([(1, "a", 5, 6, True), (3, "c", 5, 5, True)], kind)
    assert rows(cycle.merged_signals(stored, batch)) == [(1, "a", 1, 6, True), (1, "b", 1, 2, False), (2, "a", 1, 1, True), (3, "c", 5, 5, True)]


def test_incomplete_cycles_are_counted_and_change_nothing(spark):
    clusters = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "cluster_id long, incomplete int").selectExpr("cluster_id", "timestamp_ntz'2024-01-01' AS last_complete", "incomplete", "false AS alarm")
    marks = spark.createDataFrame([(1, False), (2, True)], "cluster_id long, complete boolean")
    started = F.lit("2024-02-01").cast("timestamp_ntz")
    after = cycle.reaped_clusters(clusters, marks, started)
    assert [(r.cluster_id, r.incomplete, r.alarm, r.last_complete.month) for r in after.orderBy("cluster_id").collect()] == [(1, 3, True, 1), (2, 0, False, 2), (3, 1, False, 1)]
    pairs = spark.createDataFrame([(c, t, True) for c in (1, 2) for t in ("2023-12-01", "2024-01-31", "2024-02-01", None)], "cluster_id long, t string, deployed boolean").selectExpr("cluster_id", "deployed", "cast(t AS timestamp_ntz) AS last_seen")
    kept = cycle.reaped(pairs, after, started, 30).orderBy("cluster_id", "last_seen").collect()
    assert [(r.cluster_id, r.last_seen and r.last_seen.month, r.deployed) for r in kept] == [(1, None, True), (1, 12, True), (1, 1, True), (1, 2, True), (2, None, False), (2, 1, False), (2, 2, True)]


def test_a_cycle_scores_again_only_what_moved(spark):
    store = replay._state(spark, D)
    counters = {r.cycle: r for r in store.read("counters").collect()}
    assert counters[1].rescored == 0 and 0 < counters[3].rescored < counters[3].read
    before, after = store.read("context", 2), store.read("context", 3)
    turned = {r.wl_id for r in cycle.moved(before, after).collect()}
    seen = {tuple(r) for r in replay._cycle(spark, D, 3).findings.select(*findings.KEY).collect()}
    old = [r for r in store.read("findings", 2).collect() if r.wl_id in turned and tuple(r[k] for k in findings.KEY) not in seen]
    assert counters[3].rescored == len(old)


def test_a_cycle_without_anything(spark, tmp_path):
    store, d = Versions(spark, f"file://{tmp_path}/empty", buckets=2), D
    nothing = replay._cycle(spark, d, 1)
    for part in ("marks", "items", "findings", "signals", "exposed"):
        setattr(nothing, part, getattr(nothing, part).limit(0))
    spaces = replay.lens.namespaces(spark, d).select("ns_id", "cluster_id", "sensitive")
    workloads = replay.lens.workloads(spark, d).join(spaces, "ns_id").select("wl_id", "ns_id", "cluster_id")
    cycle.run(store, nothing, workloads, spaces, replay.lens.clusters(spark, d).select("cluster_id", "env"), replay.lens.epss(spark, d), replay.lens.kev(spark, d), (), [])
    assert store.read("findings").isEmpty() and store.read("clusters").count() == 5
    assert store.read("counters").first().asDict() == {"cycle": 1, "obs_deployed": 0, "obs_undeployed": 0, "obs_swept": 0, "signals_cleared": 0, "reported": 0, "rescored": 0, "read": 0}


# ── inventories as one commit ─────────────────────────────────────


def item(kind, name, space=None, spec=None, owner=None, labels=None, **more):
    meta = {"name": name} | ({"namespace": space} if space else {}) | ({"labels": labels} if labels else {})
    meta |= {"ownerReferences": [{"kind": owner[0], "name": owner[1], "controller": True}]} if owner else {}
    return json.dumps({"kind": kind, "metadata": meta | more.pop("meta", {}), **({"spec": spec} if spec else {}), **more})


def pod(image, privileged=False):
    return {"containers": [{"name": "main", "image": image, "securityContext": {"privileged": privileged}}]}


def deployment(name, space, image="r.io/a@sha256:1", app="x", privileged=False):
    return item("Deployment", name, space, {"replicas": 2, "template": {"metadata": {"labels": {"app": app}}, "spec": pod(image, privileged)}})


def service(name, space, kind="LoadBalancer", app="x", **meta):
    return item("Service", name, space, {"type": kind, "selector": {"app": app}}, meta=meta)


def ingress(name, space, backend, **spec):
    return item("Ingress", name, space, {"rules": [{"http": {"paths": [{"backend": {"service": {"name": backend}}}]}}], **spec})


@pytest.fixture
def persist(spark, store):
    def run(cluster, items, day, complete=True):
        raw = spark.createDataFrame([(x,) for x in items], "raw string")
        return inventory.persist(store, cluster, reports.Inventory(raw), F.lit(f"2024-01-0{day}").cast("timestamp_ntz"), complete)

    return run


def test_inventories_of_clusters_stand_beside_each_other(spark, store, persist):
    persist("one", [deployment("w", "a"), item("Namespace", "a", labels={inventory.SENSITIVE: "True"})], 1)
    persist("two", [deployment("w", "a", privileged=True), service("s", "a"), item("NetworkPolicy", "deny", "a")], 1)
    assert rows(store.read("workloads").select("cluster", "name", "exposed")) == [("one", "w", False), ("two", "w", True)]
    assert rows(store.read("namespaces")) == [("one", "a", True, True, False), ("two", "a", True, False, True)]
    assert rows(store.read("signals").select("cluster", "signal_id", "active")) == [("one", inventory.BARE, True), ("two", inventory.BALANCER, True), ("two", "kyverno:disallow-privileged-containers", True)]
    persist("two", [deployment("v", "b")], 2)  # complete: namespace a of cluster two is out of use, and of it alone
    assert rows(store.read("namespaces").select("cluster", "name", "active")) == [("one", "a", True), ("two", "a", False), ("two", "b", True)]
    assert rows(store.read("workloads").select("cluster", "name", F.dayofmonth("last_inventory"))) == [("one", "w", 1), ("two", "v", 2), ("two", "w", 1)]


def test_partial_inventories_put_nothing_out_of_use(spark, store, persist):
    owned = [item("ReplicaSet", "r", "a", owner=("Deployment", "w")), item("Pod", "p", "a", pod("r.io/b:1"), owner=("ReplicaSet", "r"), status={"containerStatuses": [{"name": "main", "imageID": "x@sha256:2"}]})]
    persist("c", [item("Namespace", "a"), deployment("w", "a"), *owned], 1)
    assert rows(store.read("containers").select("kind", "name", "digest")) == [("Deployment", "w", "sha256:1"), ("Deployment", "w", "sha256:2")]
    persist("c", [deployment("w", "a"), owned[1]], 2, complete=False)  # the replica set has gone, its pod has not
    assert rows(store.read("namespaces").select("name", "active")) == [("a", True)] and rows(store.read("aliases").select("kind", "name", "target_name")) == [("ReplicaSet", "r", "w")]
    assert rows(store.read("containers").select("digest", F.dayofmonth("last_seen"))) == [("sha256:1", 2), ("sha256:2", 2)]
    persist("c", [deployment("w", "a"), owned[1]], 3)
    assert store.read("aliases").isEmpty() and rows(store.read("namespaces").select("name", "active")) == [("a", False)]
    persist("c", [deployment("w", "a"), owned[1]], 4)  # nobody knows the pod's owner any more
    assert rows(store.read("containers").select("digest", F.dayofmonth("last_seen"))) == [("sha256:1", 4), ("sha256:2", 3)]


def test_what_leads_to_a_workload_from_outside(spark, store, persist):
    internal = {"annotations": {"service.beta.kubernetes.io/aws-load-balancer-internal": "true"}}
    items = [deployment(n, "a", app=n) for n in ("lb", "inner", "port", "web", "back", "none")]
    items += [service("s1", "a", app="lb"), service("s2", "a", app="inner", **internal), service("s3", "a", "NodePort", "port"), service("s4", "a", "ClusterIP", "web"), service("s5", "a", "ClusterIP", "back"), service("s6", "b", app="none")]
    items += [ingress("i1", "a", "s4"), ingress("i2", "a", "s5", ingressClassName="nginx-internal"), ingress("i3", "b", "s5")]
    persist("c", items, 1)
    assert rows(store.read("workloads").where("exposed").select("name")) == [("lb",), ("web",)]
    assert rows(store.read("signals").where(f"signal_id <> '{inventory.BARE}'").select("name", "signal_id")) == [("lb", inventory.BALANCER), ("port", inventory.NODE_PORT), ("web", inventory.INGRESS)]


def test_a_policy_that_comes_clears_its_signal(spark, store, persist):
    for day, more in ((1, []), (2, [item("NetworkPolicy", "deny", "a")]), (3, [])):
        persist("c", [deployment("w", "a"), *more], day)
        assert rows(store.read("signals").select("signal_id", "active")) == [(inventory.BARE, day != 2)]


def test_an_inventory_that_breaks_leaves_all_tables(spark, store, persist, monkeypatch):
    persist("c", [deployment("w", "a")], 1)
    before = {t: rows(store.read(t)) for t in ("namespaces", "aliases", "images", "containers", "signals")}
    monkeypatch.setattr(inventory, "registry_of", lambda c: F.raise_error(F.lit("broken off")))
    with pytest.raises(Exception, match="broken off"):
        persist("c", [deployment("v", "b")], 2)
    assert {t: rows(store.read(t)) for t in before} == before and store.head()[0] == 1


def test_inventories_of_nothing_and_of_oddities(spark, store, persist):
    persist("c", [], 1)
    persist("c", ["{}", "not json", json.dumps({"kind": "Deployment"}), deployment("w", "a"), deployment("w", "a"), item("Deployment", "no spec", "a"), item("Service", "s", "a")], 2)
    assert rows(store.read("workloads").select("namespace", "name")) == [("a", "no spec"), ("a", "w")]


# ── feeds ─────────────────────────────────────────────────────────


def test_a_refresh_touches_what_differs(spark, store):
    kind = "category string, vuln_id string, wl_id long, image_id long, severity string, fixed_version string, env string, is_exposed boolean, escalation boolean, sensitive boolean, epss_percentile double, kev_listed boolean, rule int, band string"
    same = ("critical", "1.0", "dev", True, False, False)
    base = [("vulnerability", f"CVE-{k}", k, 1, *same, 0.5, False, 14, "scheduled") for k in range(60)] + [("config", "CVE-1", 99, 1, *same, 0.5, False, 14, "scheduled"), ("vulnerability", "GHSA-1", 98, None, *same, None, False, 14, "scheduled")]
    first = store.begin()
    first.replace("findings", spark.createDataFrame(base, kind), findings.KEY)
    first.publish()
    before = store.head()[1]["findings"]["buckets"]
    none = spark.createDataFrame([], "vuln_id string, percentile double")
    assert enrichment.refresh(store, none, none.select("vuln_id")) == 0 and store.head()[0] == 1
    epss = spark.createDataFrame([(f"CVE-{k}", 0.5) for k in range(60) if k != 7] + [("GHSA-1", 0.9)], "vuln_id string, percentile double")
    assert enrichment.refresh(store, epss, spark.createDataFrame([("CVE-1",), ("CVE-1",), ("GHSA-1",)], "vuln_id string")) == 2
    after = {(r.category, r.vuln_id): (r.epss_percentile, r.kev_listed, r.rule, r.band) for r in store.read("findings").collect()}
    assert len(after) == 62
    assert after.pop(("vulnerability", "CVE-1")) == (0.5, True, 1, "immediate") and after.pop(("vulnerability", "CVE-7")) == (None, False, 14, "scheduled")
    assert after.pop(("vulnerability", "GHSA-1")) == (None, False, 14, "scheduled")
    assert set(after.values()) == {(0.5, False, 14, "scheduled")}
    now = store.head()[1]["findings"]["buckets"]
    assert 1 <= sum(before[b] != now[b] for b in before) <= 2


KNOWN = "category string, vuln_id string, wl_id long, image_id long, severity string, fixed_version string, env string, is_exposed boolean, escalation boolean, sensitive boolean, epss_percentile double, kev_listed boolean, rule int, band string"


def test_a_refresh_rewrites_rows_where_they_lie(spark, store):
    """no batch is written beside the stored findings, and one without a workload is changed, not doubled."""
    same = ("critical", "1.0", "dev", True, False, False)
    base = [("vulnerability", f"CVE-{k}", k if k % 2 else None, None, *same, 0.5, False, 14, "scheduled") for k in range(20)]
    base += [("config", "CVE-1", 1, 1, *same, 0.25, False, 99, "as it was")]
    first = store.begin()
    first.replace("findings", spark.createDataFrame(base, KNOWN), findings.KEY)
    first.publish()
    epss = spark.createDataFrame([(f"CVE-{k}", 0.25) for k in range(20)], "vuln_id string, percentile double")
    assert enrichment.refresh(store, epss, spark.createDataFrame([("CVE-2",)], "vuln_id string")) == 2
    after = sorted((r.category, r.vuln_id, r.wl_id or 0, r.epss_percentile, r.kev_listed, r.rule, r.band) for r in store.read("findings").collect())
    band = lambda k: (True, 1, "immediate") if k == 2 else (False, 14, "scheduled") if k % 2 else (False, 2, "out_of_cycle")
    expected = [("vulnerability", f"CVE-{k}", k if k % 2 else 0, 0.25, *band(k)) for k in range(20)]
    assert after == sorted([*expected, ("config", "CVE-1", 1, 0.25, False, 99, "as it was")])  # what does not move is not scored
    assert len(names(spark, f"{store.root}/findings")) == 2  # a folder of each commit


def test_a_refresh_that_moves_nothing_writes_no_findings(spark, store):
    first = store.begin()
    first.replace("findings", spark.createDataFrame([("vulnerability", "CVE-1", 1, 1, "low", "", "dev", True, False, False, 0.5, False, 17, "defer")], KNOWN), findings.KEY)
    first.publish()
    before = store.head()[1]["findings"]
    assert enrichment.refresh(store, spark.createDataFrame([("CVE-1", 0.5)], "vuln_id string, percentile double")) == 2
    assert store.head()[1]["findings"] == before and store.read("epss").count() == 1


def test_stored_findings_are_shuffled_by_the_fold_alone(spark, monkeypatch):
    """the context that they join is stored first, so its size is known; before, they travelled once more by workload."""
    plans, replace = [], Commit.replace

    def seen(commit, name, rows, key):
        if name == "findings":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return replace(commit, name, rows, key)

    monkeypatch.setattr(Commit, "replace", seen)
    assert replay.refreshed_findings(spark, D).count() > 0
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and plans[0].count("Exchange hashpartitioning(category") == 1


def test_workloads_are_reached_by_selector_not_by_service(spark):
    """Services that share a selector are one step; before, each met all its workloads (two hundred times three hundred rows)."""
    made = lambda n, sql: spark.range(n).select(F.expr(sql).alias("raw"))
    load = made(200, """concat('{"kind":"Service","metadata":{"name":"s', id, '","namespace":"n"},"spec":{"type":"LoadBalancer","selector":{"app":"x"}}}')""")
    ports = made(200, """concat('{"kind":"Service","metadata":{"name":"p', id, '","namespace":"n"},"spec":{"type":"NodePort","selector":{"app":"y"}}}')""")
    own = made(300, """concat('{"kind":"Deployment","metadata":{"name":"w', id, '","namespace":"n"},"spec":{"template":{"metadata":{"labels":{"app":"', CASE id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END, '"}}}}}')""")
    way = made(50, """concat('{"kind":"Ingress","metadata":{"name":"i', id, '","namespace":"n"},"spec":{"defaultBackend":{"service":{"name":"p', id, '"}}}}')""")
    found = inventory.reached(reports.Inventory(load.unionByName(ports).unionByName(own).unionByName(way)))
    expected = [(f"n/Deployment/w{k}", s) for k in range(300) for s in {0: [inventory.BALANCER], 1: [inventory.INGRESS, inventory.NODE_PORT], 2: []}[k % 3]]
    assert rows(found) == sorted(expected)
    # the join with workloads comes after services are made distinct: its plan has no service left
    plan = found._jdf.queryExecution().optimizedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().apply(0)
    columns = {plan.output().apply(k).name() for k in range(plan.output().size())}
    assert columns <= {"ns_id", "entries_", "signal_id", "wl_id"}


def test_stored_rows_are_not_shuffled_to_be_written(spark, store):
    """What a merge combines lies by key already: the write adds no exchange, which before moved all rows once more."""
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("write", "write")
    try:
        commit = store.begin()
        commit.replace("t", spark.range(0, 1000, 1, 4).selectExpr("id AS k", "'a' AS v"), ("k",))
        commit.publish()
        stages = {s for j in seen.getJobIdsForGroup("write") for s in seen.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) == 1
    assert store.read("t").count() == 1000 and store.read("t").where("v = 'a'").select("k").distinct().count() == 1000


def test_items_are_parsed_once_for_both_inventories(spark):
    """The items of all manifests are stored typed; parts of them are read from there, kinds and fields as needed, without JSON."""
    whole = replay._manifests(spark, D)
    assert replay._manifests(spark, D) is whole and whole.store() is whole
    part = whole.where(F.col("kind") != "Service")
    plan = part.workloads()._jdf.queryExecution().optimizedPlan().toString()
    assert part.services().isEmpty() and not whole.services().isEmpty()
    assert "from_json" not in plan and "backend" not in plan
    parsed = reports.Inventory(replay.payloads.manifests(spark, D))
    columns = ["namespace", "kind", "name", "container", "ref", "digest"]
    assert rows(parsed.observations().select(columns).orderBy(columns)) == rows(whole.observations().select(columns).orderBy(columns))
    assert parsed.unknown().first().n == whole.unknown().first().n > 0
