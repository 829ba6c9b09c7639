"""Lists and their pages, requests and their reasons, series, licence expressions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import compliance, listing, snapshots
from ravelin.sources import envelopes

NAMES = "wl_id long, wl_name string, kind string, ns_name string, cluster_name string, deployed boolean, exposed boolean, last_seen_at int"


def workloads(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["Api", "api-2", "db", None]), rng.choice(["Pod", "Job"]), rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.random() < 0.5, None, rng.choice([None, 1, 2])) for k in range(90)]
    return rows, spark.createDataFrame(rows, NAMES)


@pytest.mark.parametrize("ordering", ["", "name", "-name", "-last_seen_at,name", "kind,-last_seen_at", "nonsense"])
def test_pages_put_together_are_the_list(spark, ordering):
    rows, df = workloads(spark)
    params = {"cluster": "x", "name": "AP", "deployed": "True", "unknown": "5", "ordering": ordering}
    wanted = [r for r in rows if r[4] == "x" and r[1] and "ap" in r[1].lower() and r[5]]
    names = [f.split()[0] for f in NAMES.split(", ")]
    for name, down in reversed(listing.order_of("workload", params)):
        wanted.sort(key=lambda r, k=names.index(name): (r[k] is not None, r[k] or 0 if isinstance(r[k], int) or r[k] is None else r[k]), reverse=down)
    found, after = [], None
    while True:
        page = listing.page(df, "workload", params, 7, after)
        got = page.collect()
        if not got:
            break
        found += [tuple(r) for r in got]
        after = listing.last_of(page, "workload", params)
    assert found == wanted and len(found) > 14


def test_a_far_page_costs_what_a_near_one_does(spark):
    _, df = workloads(spark)
    plan = listing.page(df, "workload", {}, 25, ("x", "b", "Job", "db", 70))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Offset" not in plan and "Exchange" not in plan


def test_a_list_without_rows(spark):
    _, df = workloads(spark)
    none = listing.page(df, "workload", {"kind": "nobody"}, 5)
    assert none.collect() == [] and listing.last_of(none, "workload", {}) is None


def requests(spark, *rows):
    found = envelopes.started(envelopes.judged(spark.createDataFrame(list(rows), "phase string, value string"))).collect()
    return {(r.phase, r.value): r for r in found}


def test_every_way_to_be_refused(spark):
    ok = '{"cluster": " c ", "kind": "k", "import_id": "i", "payload": {"a": 1}, "observed_count": 0}'
    cases = {
        ("start", None): "unreadable",
        ("start", ""): "unreadable",
        ("item", "{"): "unreadable",
        ("item", "null"): "unreadable",
        ("item", '"text"'): "unreadable",
        ("start", "{}"): "cluster is required",
        ("start", '{"cluster": null, "kind": "k", "import_id": "i"}'): "cluster is required",
        ("start", '{"cluster": {"a": 1}, "kind": "k", "import_id": "i"}'): "malformed",
        ("start", '{"cluster": "c", "kind": 5, "import_id": "i"}'): "malformed",
        ("start", '{"cluster": "c", "kind": " ", "import_id": "i"}'): "kind and import_id are required",
        ("start", '{"cluster": "c", "kind": "k"}'): "kind and import_id are required",
        ("item", '{"cluster": "c", "kind": "k", "import_id": "i"}'): "payload is required",
        ("item", '{"cluster": "c", "kind": "k", "import_id": "i", "payload": null}'): "payload is required",
        ("finish", '{"cluster": "c", "kind": "k", "import_id": "i"}'): "observed_count is required",
        ("finish", '{"cluster": "c", "kind": "k", "import_id": "i", "observed_count": "many"}'): "malformed",
        ("finish", '{"cluster": "c", "kind": "k", "import_id": "j", "observed_count": 1}'): "not started",
        ("start", ok): None,
        ("item", ok): None,
        ("finish", ok): None,
    }
    found = requests(spark, *cases)
    assert {k: r.reason for k, r in found.items()} == cases
    assert (found["finish", ok].cluster, found["finish", ok].observed_count) == ("c", 0)


@pytest.mark.parametrize(("top", "payload", "whole"), [("true", "{}", True), ("0", "{}", False), ("1", "{}", True), ('""', '{"complete_snapshot": "x"}', True), ("null", '{"complete_snapshot": []}', False), ("true", "[1]", False), ("true", '"x"', False)])
def test_complete_snapshots(spark, top, payload, whole):
    value = f'{{"cluster": "c", "kind": "k", "import_id": "i", "payload": {payload}, "complete_snapshot": {top}}}'
    assert requests(spark, ("item", value))["item", value].complete_snapshot == whole


def test_clusters_that_requests_bring_in(spark):
    rows = envelopes.judged(spark.createDataFrame([("start", '{"cluster": "new"}'), ("start", '{"cluster": "old", "kind": "k", "import_id": "i"}'), ("item", "{")], "phase string, value string"))
    assert [r.cluster_name for r in envelopes.registered(rows, spark.createDataFrame([("old",)], "cluster_name string")).collect()] == ["new"]


def test_series_have_one_length(spark):
    rows = spark.createDataFrame([("s", "a", 1, 5), ("s", "a", 1, 2), ("s", "b", 3, 1), ("s", "odd", 1, 9), ("t", "a", 99, 4)], "scope string, severity string, day int, n long")
    rows = rows.selectExpr("scope", "severity", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day) AS at", "n")
    lo, hi = (F.lit(f"2024-01-0{k}").cast("timestamp_ntz") for k in (2, 4))
    long = snapshots.aligned(rows, ["scope"], "severity", ("a", "b"), "at", "n", lo, hi, "1 day").withColumn("key", F.concat("scope", "severity"))
    assert {r.key: r["values"] for r in snapshots.series_arrays(long, "key", "n", "at").collect()} == {"sa": [7, 0, 0], "sb": [0, 0, 1], "ta": [0, 0, 0], "tb": [0, 0, 0]}
    assert [snapshots.window_days(x) for x in (None, 0, -4, 5, 9999)] == [90, 90, 1, 5, 365]
    with pytest.raises(ValueError):
        snapshots.in_scope(rows, namespace="n")


BINDING, FREE = ["GPL-3.0", "agpl-3.0", "GPL-3.0+", "GPL-3.0 WITH other"], ["MIT", "Apache-2.0", "GPL-3.0 with Linking", "ISC"]


def expression(rng, depth):
    """A random expression, and whether it binds: any way of choosing at each OR that needs no binding licence frees it."""
    kind = rng.choice(["leaf", "and", "or", "bracket"]) if depth else "leaf"
    if kind == "leaf":
        text = rng.choice(BINDING + FREE)
        return text, [{text}]
    if kind == "bracket":
        text, ways = expression(rng, depth - 1)
        return f"({text})", ways
    parts = [expression(rng, depth - 1) for _ in range(rng.choice([2, 3]))]
    texts = [f"({t})" if " OR " in t.upper() or " AND " in t.upper() else t for t, _ in parts]
    if kind == "or":
        return rng.choice([" OR ", " or "]).join(texts), [w for _, ways in parts for w in ways]
    return " AND ".join(texts), [set().union(*x) for x in itertools.product(*(w for _, w in parts))]


def test_licence_expressions_against_all_choices(spark):
    rng = random.Random(7)
    made = [expression(rng, 3) for _ in range(200)]
    expected = {t: all(w & set(BINDING) for w in ways) for t, ways in made}
    odd = {"": None, None: None, "(": None, "MIT)": None, "MIT OR": None, "AND MIT": None, "MIT ISC": None, "()": None, "MIT (ISC)": None, "OR": None, "((MIT))": False, "MIT OR GPL-3.0 AND ISC": False, "GPL-3.0 AND MIT OR AGPL-3.0": True}
    rows = spark.createDataFrame([(t,) for t in {**expected, **odd}], "t string")
    found = {r.t: r.v for r in rows.select("t", compliance.restrictive(F.col("t"), ("GPL-3.0", "AGPL-3.0"), ("Linking",)).alias("v")).collect()}
    assert found == {**expected, **odd}
    own = rows.where("t = 'GPL-3.0 AND MIT OR AGPL-3.0'").select(compliance.licences_of(F.col("t")).alias("l")).first()
    assert own.l == ["GPL-3.0", "MIT", "AGPL-3.0"]


def test_captures_are_stamped_with_the_kind_of_their_file(spark, tmp_path):
    import json

    from ravelin.sources import captures

    assert [captures.file_of(k) for k in ("Ingress", "NetworkPolicy", "Pod", "ClusterComplianceReport")] == ["ingresses", "networkpolicies", "pods", "clustercompliancereports"]
    node = lambda pid, **labels: {"metadata": {"labels": labels}, "spec": {"providerID": pid}}
    files = {
        "one/kubeapi/pods.json": {"kind": "PodList", "items": [{"metadata": {"name": "a"}}, {"kind": None}, {"kind": "Other"}, "text", 5, {}]},
        "one/kubeapi/nodes.json": [node("GCE://1", **{"cloud.google.com/gke-x": "1", "topology.kubernetes.io/region": "r1"}), node("aws://1")],
        "one/kubeapi/version.json": {"gitVersion": "v1.30"},
        "one/trivy/configauditreports.json": {"report": {}},
        "one/kubeapi/secrets.json": [{"a": 1}],
        "one/trivy/pods.json": [{"a": 1}],
        "two/kyverno/policyreports.json": [],
        "two/kubeapi/jobs.json": {"items": []},
    }
    for name, doc in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "two/kubeapi/services.json").write_text("{broken")
    found = [(r.cluster, r.kind, r.position, json.loads(r.raw)) for r in captures.items(spark, str(tmp_path)).where("kind <> 'Node'").orderBy("kind", "position").collect()]
    assert found == [("one", "ConfigAuditReport", 0, {"report": {}, "kind": "ConfigAuditReport"}), ("one", "Pod", 0, {"metadata": {"name": "a"}, "kind": "Pod"}), ("one", "Pod", 1, {"kind": None}), ("one", "Pod", 2, {"kind": "Other"}), ("one", "Pod", 5, {"kind": "Pod"})]
    facts = sorted(tuple(r) for r in captures.cluster_facts(spark, str(tmp_path)).collect())
    assert facts == [("one", "v1.30", "gke", "r1"), ("two", "", "onprem", "")]
