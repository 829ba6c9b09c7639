"""Urgency rules row by row, lifecycle branches, image-set changes and scalars."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ravelin.functions import scalars as S
from ravelin.functions import signals as G
from ravelin.operators import checks, findings, lifecycle, resolve, snapshots, views
from ravelin.plans import lens
from ravelin.queries import QUERIES

BASE = {"wl_id": 1, "severity": "low", "epss_percentile": None, "kev_listed": False, "fixed_version": "1.2", "env": "prod", "is_exposed": False, "escalation": False, "sensitive": False}
SCHEMA = "wl_id long, severity string, epss_percentile double, kev_listed boolean, fixed_version string, env string, is_exposed boolean, escalation boolean, sensitive boolean"
RULES = [
    (1, "immediate", {"kev_listed": True, "wl_id": None}),
    (2, "out_of_cycle", {"wl_id": None, "severity": "critical", "env": "dev"}),
    (3, "out_of_cycle", {"wl_id": None, "severity": "high"}),
    (4, "scheduled", {"wl_id": None, "severity": "high", "env": None}),
    (5, "immediate", {"severity": "high", "epss_percentile": 0.9, "is_exposed": True}),
    (6, "immediate", {"severity": "critical", "is_exposed": True}),
    (7, "out_of_cycle", {"severity": "high", "escalation": True}),
    (8, "out_of_cycle", {"epss_percentile": 0.95}),
    (9, "out_of_cycle", {"severity": "critical"}),
    (10, "out_of_cycle", {"severity": "high", "is_exposed": True}),
    (11, "scheduled", {"severity": "medium", "fixed_version": "", "sensitive": True, "env": "dev"}),
    (12, "defer", {"fixed_version": None}),
    (13, "scheduled", {"severity": "high", "fixed_version": "", "escalation": True, "env": "staging"}),
    (14, "scheduled", {"severity": "critical", "env": ""}),
    (15, "scheduled", {"severity": "high"}),
    (16, "scheduled", {"severity": "medium", "escalation": True}),
    (17, "defer", {}),
]


@pytest.mark.parametrize(("rule", "band", "change"), RULES)
def test_rule(spark, rule, band, change):
    row = findings.score(spark.createDataFrame([BASE | change], SCHEMA)).first()
    assert (row.rule, row.band) == (rule, band)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("ref", "digest", "registry", "repository"), [
    ("r.io/team/app:1", "", "r.io", "team/app"),
    ("nginx", "", "", "nginx"),
    ("team/app:2", "", "", "team/app"),
    ("app@sha256:ab", "sha256:ab", "", "app"),
    ("app@md5:1", "", "", "app"),
    ("host:5000/app", "", "", "host"),
    (None, "", "", ""),
])
def test_image_references(spark, ref, digest, registry, repository):
    c = F.lit(ref).cast("string")
    assert one(spark, F.struct(S.ref_digest(c).alias("a"), S.registry_of(c).alias("b"), S.repository_of(c).alias("c"))).asDict() == {"a": digest, "b": registry, "c": repository}


@pytest.mark.parametrize(("raw", "avd"), [("KSV051", "AVD-KSV-0051"), ("KSV-0051", "AVD-KSV-0051"), ("AVD-KSV-0051", "AVD-KSV-0051"), ("KSV12345", "AVD-KSV-12345"), ("KSVx", "AVD-KSVx"), ("DS1", "DS1"), (None, "")])
def test_avd(spark, raw, avd):
    assert one(spark, S.avd_id(F.lit(raw).cast("string"))) == avd


def test_registry(spark):
    rows = G.registry(spark).collect()
    assert len(rows) == 27 and len({r.signal_id for r in rows}) == 27 and len(G.ESCALATION_IDS) == 16
    assert [len(G.reap_scope(k)) for k in ("kyverno.PolicyReport", "trivy.ConfigAuditReport", "trivy.RbacAssessmentReport", "trivy.ExposedSecretReport", "trivy.VulnerabilityReport")] == [9, 15, 2, 1, 0]
    found = G.lookup(spark.createDataFrame([("KSV051",), ("AVD-KSV-0001",), ("KSV-0013",), ("nothing",), (None,)], "c string"), "c").collect()
    assert {r.c: r.signal_id for r in found} == {"KSV051": "ksv:KSV-0051", "AVD-KSV-0001": "ksv:KSV-0001", "KSV-0013": "ksv:KSV-0013", "nothing": None, None: None}


def test_flags_and_maps(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p]) if k else F.create_map().cast("map<string,string>")
    lb = F.create_map(F.lit("networking.gke.io/load-balancer-type"), F.lit("internal"))
    assert one(spark, S.internal_balancer(lb)) and not one(spark, S.internal_balancer(m(a="b")))
    assert one(spark, S.internal_ingress(F.lit("my-Private"), m())) and not one(spark, S.internal_ingress(F.lit(None).cast("string"), m(a="internal")))
    assert one(spark, S.sensitive(F.lit(None).cast("boolean"), F.lit(False), m(s="TRUE"), m(s="no"), "s"))
    assert not one(spark, S.sensitive(F.lit(True), F.lit(False), m(s="true"), m(), "s"))
    assert one(spark, S.provider(F.lit("AWS://x"), F.create_map(F.lit("eks.amazonaws.com/g"), F.lit("1")))) == "eks" and one(spark, S.provider(F.lit(None).cast("string"), m())) == "onprem"
    assert one(spark, S.tolerant_date(F.lit("2024-02-30T00:00"))) is None and str(one(spark, S.tolerant_date(F.lit("2024-02-03T00:00")))) == "2024-02-03"
    assert one(spark, resolve.selects(m(a="1"), m(a="1", b="2"))) and not one(spark, resolve.selects(m(), m(a="1"))) and not one(spark, resolve.selects(m(a="1"), m(b="1")))


def test_fold_takes_the_latest_whatever_the_order(spark):
    rows = [("v", "CVE-1", 1, 1, s, "", datetime(2024, 1, d), o, 1, 1.0) for s, d, o in [("low", 3, 1), ("high", 3, 2), ("critical", 1, 9)]]
    schema = "category string, vuln_id string, wl_id long, image_id long, severity string, fixed_version string, seen_at timestamp_ntz, order_id long, line int, price double"
    for own in (rows, rows[::-1]):
        r = findings.fold(spark.createDataFrame(own, schema)).first()
        assert (r.severity, r.first_seen.day, r.last_seen.day) == ("high", 1, 3)


def test_enrichment_wants_the_prefix(spark):
    rows = spark.createDataFrame([("GHSA-1", "vulnerability"), ("CVE-1", "vulnerability"), ("CVE-1", "config")], "vuln_id string, category string")
    feed = spark.createDataFrame([("GHSA-1", 0.5), ("CVE-1", 0.7)], "vuln_id string, percentile double")
    found = findings.enrich(rows, feed, feed.select("vuln_id")).collect()
    assert {(r.vuln_id, r.category): (r.epss_percentile, r.kev_listed) for r in found} == {("GHSA-1", "vulnerability"): (None, False), ("CVE-1", "vulnerability"): (0.7, True), ("CVE-1", "config"): (0.7, False)}


def test_visibility_and_muting(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 1, True, None, t), (2, 1, False, None, t), (3, None, None, None, t), (4, 1, True, datetime(2024, 2, 1), t), (5, 1, True, t, t)], "order_id long, wl_id long, deployed boolean, last_complete timestamp_ntz, last_seen timestamp_ntz")
    seen = findings.relevant(rows)
    assert {r.order_id for r in seen.collect()} == {1, 3, 5}
    acts = spark.createDataFrame([(1, "accept", False, None), (3, "accept", True, None), (5, "acknowledge", False, None), (5, "false_positive", False, t)], "order_id long, action string, revoked boolean, expires_at timestamp_ntz")
    assert {r.order_id for r in findings.unmuted(seen, acts, F.lit("2024-01-02").cast("timestamp_ntz")).collect()} == {3, 5}


def test_image_set_changes(spark):
    steps = [([], "first_seen"), ([1], "first_seen"), ([1], "none"), ([1, 2], "added"), ([], "removed"), ([1], "removed"), ([3], "replaced"), ([4, 5], "mixed")]
    rows = [(1, k, images) for k, (images, _) in enumerate(steps)]
    found = snapshots.classified(spark.createDataFrame(rows, "wl_id long, cycle int, images array<long>")).orderBy("cycle").collect()
    assert [r.change_kind for r in found] == [k for _, k in steps]
    assert [r.changed for r in found][:2] == [False, False] and found[7].n_added == 2


def test_sweep_and_retention(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 5), False), (2, datetime(2023, 1, 1), True), (3, None, True)], "id long, seen timestamp_ntz, deployed boolean")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    assert {r.id: r.deployed for r in lifecycle.sweep(rows, "seen", at).collect()} == {1: True, 2: False, 3: False}
    assert {r.id: r.deployed for r in lifecycle.sweep(rows, "seen", at, F.lit(False)).collect()} == {1: False, 2: True, 3: True}
    assert {r.id for r in lifecycle.retained(rows, "seen", at).collect()} == {1, 3}


def test_reap_branches(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("ksv:KSV-0051", True, at), ("kp:exposed-secret-in-image", True, at), ("kyverno:disallow-host-path", True, at), ("ksv:KSV-0001", True, datetime(2024, 3, 1))], "signal_id string, active boolean, last_seen timestamp_ntz")
    off = lambda kind, n: {r.signal_id for r in lifecycle.deactivate(rows, G.reap_scope(kind), F.lit("2024-02-01").cast("timestamp_ntz"), F.lit(n)).where("NOT active").collect()}
    assert off("trivy.ConfigAuditReport", 3) == {"ksv:KSV-0051", "kp:exposed-secret-in-image"}
    assert off("trivy.ConfigAuditReport", 0) == set() and off("kyverno.PolicyReport", 1) == {"kyverno:disallow-host-path"}


def test_empty_feed_changes_nothing(spark):
    old = spark.createDataFrame([("a",)], "vuln_id string")
    assert [r.vuln_id for r in lifecycle.replaced(old, old.limit(0)).collect()] == ["a"]
    assert [r.vuln_id for r in lifecycle.replaced(old, spark.createDataFrame([("b",)], "vuln_id string")).collect()] == ["b"]


def test_streaks_and_images(spark):
    rows = spark.createDataFrame([(1, k, h) for k, h in enumerate([True, True, False, True, True, True])], "id long, cycle int, hit boolean")
    assert [r.streak for r in lifecycle.streaks(rows, ["id"], "cycle", "hit").orderBy("cycle").collect()] == [1, 2, 0, 1, 2, 3]
    df = lambda *r: spark.createDataFrame(list(r), "digest string, ref string")
    merged = lifecycle.merged_images(df(("a", "x"), ("b", "old")), df(("a", "z")), df(("b", "longer"), ("c", "new")))
    assert {r.digest: r.ref for r in merged.collect()} == {"a": "z", "b": "longer", "c": "new"}


def test_owner_chains(spark):
    edge = lambda *r: spark.createDataFrame(list(r), "child string, parent string")
    known = spark.createDataFrame([("dep",), ("cron",)], "node string")
    found = resolve.owners(edge(("pod", "rs"), ("rs", "dep"), ("x", "y"), ("y", "x"), ("lost", "none")), known, edge(("job", "cron"), ("rs", "cron")))
    assert {(r.node, r.owner, r.hops) for r in found.collect()} == {("pod", "dep", 2), ("rs", "dep", 1), ("job", "cron", 1)}
    reports = spark.createDataFrame([("pod",), ("dep",), ("gone",)], "target string")
    ok, rejected = resolve.attach(reports, spark.createDataFrame([("dep", 7)], "node string, wl_id long"), found)
    assert {(r.target, r.wl_id) for r in ok.collect()} == {("pod", 7), ("dep", 7)} and [r.target for r in rejected.collect()] == ["gone"]


def test_owner_chains_of_any_length(spark):
    """One of 41 hops beside circles of 1 and 3 nodes, one with a tail, and a chain to nowhere."""
    edges = [(f"n{k}", f"n{k + 1}") for k in range(41)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("tail", "c0"), ("self", "self"), ("m0", "m1"), ("m1", "m2")]
    known = spark.createDataFrame([("n41",)], "node string")
    found = resolve.owners(spark.createDataFrame(edges, "child string, parent string"), known)
    assert {(r.node, r.owner, r.hops) for r in found.collect()} == {(f"n{k}", "n41", 41 - k) for k in range(41)} and found.count() == 41


def test_alias_chain_beyond_six_hops(spark, tmp_path):
    keys = [5, 9, 10, 40_959, 40_960, 700_000, 3_000_000_000]
    every = {k // 4**j for k in keys for j in range(17)} - {0}
    spark.createDataFrame([(k,) for k in every], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    expected = set()
    for k in every:
        owner, hops = k, 0
        while owner > 9:
            owner, hops = owner // 4, hops + 1
        if hops:
            expected.add((k, owner, hops))
    assert {(r.node, r.owner, r.hops) for r in QUERIES["alias_chain"](spark, str(tmp_path)).collect()} == expected


def test_details_and_series(spark):
    extra = views.detail_extras(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), ("a",))
    assert one(spark, extra) == {"b": "2"}
    rows = spark.createDataFrame([("x", 2, 20), ("x", 1, 10), ("y", 1, 5)], "k string, at int, n int")
    assert {r.k: list(r["values"]) for r in snapshots.series_arrays(rows, "k", "n", "at").collect()} == {"x": [10, 20], "y": [5]}


def test_assertion_kinds(spark):
    assert len(checks.KINDS) == 29
    t = {"workloads": spark.createDataFrame([("a", datetime(2024, 1, 2))], "name string, last_inventory_at timestamp_ntz"), "snapshots": spark.createDataFrame([(datetime(2024, 1, 1),)], "captured_at timestamp_ntz")}
    asked = [
        ({"kind": "workload_exists", "filter": {"name": "a"}}, True),
        ({"kind": "workload_absent", "filter": {"name": ["a", "b"]}}, False),
        ({"kind": "workload_count", "expect": 1}, True),
        ({"kind": "workload_last_inventory_advanced", "since": "2024-01-01"}, True),
        ({"kind": "workload_last_inventory_unchanged", "since": "2024-01-01"}, False),
        ({"kind": "snapshot_absent_since", "since": "2024-02-01"}, True),
        ({"kind": "snapshot_count", "min": 2}, False),
        ({"kind": "scan_health_widget"}, True),
        ({"kind": "workload_exists", "filter": {"no_such": 1}}, False),
        ({"kind": "image_exists"}, False),
    ]
    found = checks.evaluate(spark, t, [a for a, _ in asked]).orderBy("index").collect()
    assert [r["pass"] for r in found] == [p for _, p in asked]
    assert checks.evaluate(spark, t, []).count() == 0


def test_assertions_on_a_table_are_one_aggregate(spark):
    """Filters, nulls and the verdicts that look at single rows hold side by side, and a table is read once however often it is asked."""
    made = [("a", 1, True, datetime(2024, 1, 1)), ("b", 2, False, datetime(2024, 1, 3)), (None, 3, None, datetime(2024, 1, 2))]
    rows = spark.createDataFrame(made, "name string, n long, active boolean, captured_at timestamp_ntz")
    tables = {"findings": rows, "signals": rows, "snapshots": rows, "images": spark.range(2).withColumnRenamed("id", "n")}
    asked = [
        ({"kind": "finding_count", "filter": {"name": None}, "expect": 1}, True, 1),
        ({"kind": "finding_count", "filter": {"name": ["a", "b"]}, "min": 2}, True, 2),
        ({"kind": "finding_priority", "filter": {"n": [2, 3]}, "attributes": {"name": None}}, True, 2),
        ({"kind": "finding_priority", "filter": {"n": 9}}, False, 0),
        ({"kind": "signal_present", "filter": {"n": 1}}, True, 1),
        ({"kind": "signal_absent", "filter": {"n": [2, 3]}}, True, 0),
        ({"kind": "snapshot_delta", "attributes": {"n": 2}}, True, 3),
        ({"kind": "snapshot_delta", "filter": {"n": [1, 3]}, "attributes": {"n": 2}}, False, 2),
        ({"kind": "snapshot_absent_since", "since": "2024-01-03"}, False, 1),
        ({"kind": "image_count", "expect": 2}, True, 2),
    ]
    found = checks.evaluate(spark, tables, [a for a, _, _ in asked])
    assert [(r["pass"], r["found"]) for r in found.orderBy("index").collect()] == [(p, n) for _, p, n in asked]
    assert found._jdf.queryExecution().analyzed().toString().count("Aggregate [") == 2


def test_fold_keeps_what_its_order_lacks(spark):
    """Columns that the order holds come from it, also null or negative; another column comes from the same row."""
    schema = "category string, vuln_id string, wl_id long, image_id long, severity string, fixed_version string, order_id long, line int, price double, seen_at timestamp_ntz, note string"
    at = lambda day: datetime(2024, 1, day)
    made = [("c", "v", 1, 1, "low", "", 5, 1, 1.0, at(2), "old"), ("c", "v", 1, 1, "high", None, -7, 2, 2.0, at(3), "new"), ("c", "v", 1, 1, "high", "1", -8, 9, 2.0, at(3), "lesser order")]
    rows = spark.createDataFrame(made, schema)
    plain = findings.fold(rows)
    assert [tuple(r) for r in plain.collect()] == [("c", "v", 1, 1, "high", None, -7, 2, at(2), at(3))]
    more = findings.fold(rows, keep=("note", "price", "order_id"))
    assert [tuple(r) for r in more.collect()] == [("c", "v", 1, 1, "new", 2.0, -7, at(2), at(3))]
    assert [f.dataType for f in plain.schema.fields[4:8]] == [rows.schema[c].dataType for c in ("severity", "fixed_version", "order_id", "line")]
    # severity and version travel once: the aggregate holds the order alone
    assert "min_by" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_first_partitions_follow_the_tables(spark, tmp_path):
    """A session with few shuffle partitions gets more of them for large tables, and keeps its own for small ones."""
    spark.range(1000).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).write.parquet(f"{tmp_path}/small/lineitem.parquet")
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before, own = spark.conf.get(name, None), int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        spark.conf.unset(name)
        assert lens.sized(spark, f"{tmp_path}/small") == own and spark.conf.get(name, None) is None
        assert lens.sized(spark, str(tmp_path), rows=50) == 20 and spark.conf.get(name) == "20"
        assert lens.sized(spark, str(tmp_path), rows=500) == 20 and spark.conf.get(name) == "20"  # never fewer
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_what_a_task_reads_is_bounded_unless_the_session_says_so(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/lineitem.parquet")
    split, merged = lens._PIECES
    before = {name: spark.conf.get(name, None) for name in lens._PIECES}
    try:
        spark.conf.unset(split)
        spark.conf.set(merged, "48m")
        lens.sized(spark, str(tmp_path))
        assert spark.conf.get(split) == "32m" and spark.conf.get(merged) == "48m"
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
