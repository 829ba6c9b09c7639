"""Registered queries over stored tables: three import cycles applied one after the other, each a commit."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import ravelin.intake  # noqa: F401 - its SQL is a part of that below
from ravelin.functions import signals as G
from ravelin.functions.scalars import SEVERITIES
from ravelin.operators import checks, cycle, enrichment, findings, inventory, marks, snapshots
from ravelin.operators.resolve import settled
from ravelin.panels import _CYCLES, _queue
from ravelin.plans import lens, payloads
from ravelin.queries import KEY, ORACLE, QUERIES, _at, _banded, _enriched, _signals, register
from ravelin.sources import envelopes, reports
from ravelin.sources.feeds import shared_folder
from ravelin.sources.versions import Versions

#: When each cycle's inventory and its scans began.
STARTS = ("1995-01-01", "1998-01-01", "2000-01-01")
SCANS = ("2024-01-01", "2024-01-11", "2024-01-21")
IMAGE = ("digest", "ref", "os_family", "os_version", "base_eosl")
_RUNS: dict[tuple[str, str], Versions] = {}
_ITEMS: dict[tuple[str, str], reports.Inventory] = {}


def _manifests(spark: SparkSession, d: str) -> reports.Inventory:
    """The items of all manifests, in the shared folder; parsed once per application and folder of tables."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _ITEMS:
        _ITEMS[at] = reports.Inventory(payloads.manifests(spark, d)).store()
    return _ITEMS[at]


def _cycle(spark: SparkSession, d: str, k: int) -> cycle.Cycle:
    """The ``k``-th cycle: six of seven workloads, another one exposed, the clusters complete in turn and one never."""

    def within(rows: DataFrame, at: str, bounds: tuple[str, ...]) -> DataFrame:
        rows = rows.where(F.col(at) >= _at(bounds[k - 1])) if k > 1 else rows
        return rows.where(F.col(at) < _at(bounds[k])) if k < len(bounds) else rows

    items = within(lens.observations(spark, d), "seen_at", STARTS).where((F.col("wl_id") + k) % 7 != 0)
    marks = lens.clusters(spark, d).select("cluster_id", ((F.col("cluster_id") != 4) & ((F.col("cluster_id") + k) % 4 != 0)).alias("complete"))
    shown = lens.workloads(spark, d).select("wl_id", ((F.col("wl_id") + k) % 4 == 0).alias("exposed"))
    return cycle.Cycle(k, _at(STARTS[k - 1]), _at(SCANS[k - 1]), marks, items, findings.fold(items), within(lens.signals(spark, d), "seen_at", SCANS), shown)


def _state(spark: SparkSession, d: str) -> Versions:
    """The tables after all cycles, in the shared folder; run once per application and folder of tables."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _RUNS:
        store = Versions(spark, f"{shared_folder(spark)}/cycles-{uuid.uuid4().hex}", buckets=4)
        spaces = lens.namespaces(spark, d).select("ns_id", "cluster_id", "sensitive")
        workloads = lens.workloads(spark, d).join(spaces, "ns_id").select("wl_id", "ns_id", "cluster_id")
        for k in range(1, len(STARTS) + 1):
            # before the third cycle a person declares a cluster to be in production
            env = F.when((F.col("cluster_id") == 2) & F.lit(k == 3), "prod").otherwise(F.col("env"))
            environments = lens.clusters(spark, d).select("cluster_id", env.alias("env"))
            cycle.run(store, _cycle(spark, d, k), workloads, spaces, environments, lens.epss(spark, d), lens.kev(spark, d), G.ESCALATION_IDS, G.reap_scope("trivy.ConfigAuditReport"))
        _RUNS[at] = store
    return _RUNS[at]


_RULES = re.search(r"scored AS \(SELECT \*, (CASE.*?END) AS rule FROM wide\)", lens.SQL, re.S)[1]
_BANDS = re.search(r"banded AS \(SELECT \*, (CASE.*?END) AS band FROM scored\)", lens.SQL, re.S)[1]
#: The state after the third cycle, told without going through the first two: from when each thing was last seen.
_STATE = f""", item AS (SELECT * FROM (SELECT *, CASE WHEN seen_at < TIMESTAMP '1998-01-01' THEN 1 WHEN seen_at < TIMESTAMP '2000-01-01' THEN 2 ELSE 3 END AS k FROM observation) WHERE (wl_id + k) % 7 <> 0),
mark AS (SELECT cluster_id, k, cluster_id <> 4 AND (cluster_id + k) % 4 <> 0 AS complete FROM cluster, (VALUES (1), (2), (3)) v(k)),
whole AS (SELECT cluster_id, bool_or(complete AND k = 2) AS c2, bool_or(complete AND k = 3) AS c3, max(CASE WHEN complete THEN k END) AS last_k FROM mark GROUP BY cluster_id),
seen AS (SELECT wl_id, image_id, min(seen_at) AS f, max(seen_at) AS l, min(seen_at) FILTER (WHERE k = 1) AS f1, max(seen_at) FILTER (WHERE k = 1) AS l1, min(seen_at) FILTER (WHERE k = 2) AS f2, max(seen_at) FILTER (WHERE k = 2) AS l2,
    min(seen_at) FILTER (WHERE k = 3) AS f3, max(seen_at) FILTER (WHERE k = 3) AS l3 FROM item GROUP BY wl_id, image_id),
second AS (SELECT *, f2 IS NOT NULL OR (f1 IS NOT NULL AND NOT (c2 AND l1 < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY)) AS here2, coalesce(f1, f2) AS from2, coalesce(l2, l1) AS to2, CASE WHEN c2 THEN f2 IS NOT NULL ELSE true END AS up2
    FROM seen JOIN workload USING (wl_id) JOIN namespace USING (ns_id) JOIN whole USING (cluster_id)),
pair AS (SELECT wl_id, image_id, CASE WHEN here2 THEN from2 ELSE f3 END AS first_seen, CASE WHEN f3 IS NOT NULL THEN l3 ELSE to2 END AS last_seen, CASE WHEN f3 IS NOT NULL THEN true WHEN c3 THEN false ELSE up2 END AS deployed
    FROM second WHERE f3 IS NOT NULL OR (here2 AND NOT (c3 AND to2 < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY))),
shown AS (SELECT wl_id, ns_id, cluster_id, s1, s2, s3, l AS last_seen, CASE WHEN s3 THEN (wl_id + 3) % 4 = 0 WHEN s2 THEN (wl_id + 2) % 4 = 0 WHEN s1 THEN (wl_id + 1) % 4 = 0 ELSE false END AS exposed,
    CASE WHEN c3 THEN s3 ELSE s3 OR CASE WHEN c2 THEN s2 ELSE s2 OR s1 END END AS deployed FROM (
      SELECT w.wl_id, w.ns_id, n.cluster_id, coalesce(bool_or(k = 1), false) AS s1, coalesce(bool_or(k = 2), false) AS s2, coalesce(bool_or(k = 3), false) AS s3, max(seen_at) AS l
      FROM workload w JOIN namespace n USING (ns_id) LEFT JOIN item USING (wl_id) GROUP BY ALL) JOIN whole USING (cluster_id)),
told AS (SELECT wl_id, signal_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen, NOT (signal_id LIKE 'k%:KSV-%' AND max(seen_at) < TIMESTAMP '2024-01-21') AS active FROM raw_signal JOIN workload USING (wl_id) GROUP BY wl_id, signal_id),
grave AS (SELECT DISTINCT wl_id FROM told WHERE active AND signal_id IN ('kyverno:disallow-privileged-containers', 'ksv:KSV-0051', 'ksv:KSV-0001')),
last_finding AS (SELECT *, row_number() OVER (PARTITION BY category, vuln_id, wl_id, image_id ORDER BY seen_at DESC, order_id DESC, line DESC, price DESC, severity, fixed_version) AS place,
    min(seen_at) OVER (PARTITION BY category, vuln_id, wl_id, image_id) AS first_seen, max(seen_at) OVER (PARTITION BY category, vuln_id, wl_id, image_id) AS last_seen FROM item),
around AS (SELECT f.*, e.percentile AS epss_percentile, x.vuln_id IS NOT NULL AND f.category = 'vulnerability' AS kev_listed, s.exposed OR bool_or_ns AS is_exposed, g.wl_id IS NOT NULL AS escalation,
    CASE WHEN c.cluster_id = 2 THEN 'prod' ELSE c.env END AS env, n.sensitive
    FROM last_finding f JOIN shown s USING (wl_id) JOIN (SELECT ns_id, bool_or(exposed AND deployed) AS bool_or_ns FROM shown GROUP BY ns_id) o USING (ns_id) JOIN namespace n ON n.ns_id = s.ns_id JOIN cluster c ON c.cluster_id = s.cluster_id
    LEFT JOIN epss e ON e.vuln_id = f.vuln_id LEFT JOIN kev x ON x.vuln_id = f.vuln_id LEFT JOIN grave g ON g.wl_id = f.wl_id WHERE f.place = 1),
ruled AS (SELECT *, {_RULES} AS rule FROM around)
"""


@register(_STATE + f"SELECT category, vuln_id, wl_id, image_id, severity, fixed_version, order_id, line, first_seen, last_seen, rule, {_BANDS} AS band FROM ruled")
def cycle_state_findings(spark, d):
    """Findings as stored after three cycles, of which each scored only what it saw or what moved; the SQL scores all."""
    return _state(spark, d).read("findings").select(*KEY, *cycle.KEEP, "first_seen", "last_seen", "rule", "band")


@register(_STATE + "SELECT * FROM pair")
def cycle_state_observations(spark, d):
    """Containers after three reaps: in use or not, and gone a month after a complete cycle no longer saw them."""
    return _state(spark, d).read("pairs")


@register(_STATE + "SELECT wl_id, ns_id, cluster_id, exposed, deployed, last_seen FROM shown")
def cycle_state_workloads(spark, d):
    return _state(spark, d).read("workloads")


@register(_STATE + """SELECT c.cluster_id, CASE WHEN c.cluster_id = 2 THEN 'prod' ELSE env END AS env, CASE last_k WHEN 1 THEN TIMESTAMP '1995-01-01' WHEN 2 THEN TIMESTAMP '1998-01-01' WHEN 3 THEN TIMESTAMP '2000-01-01' END AS last_complete,
    CAST(3 - coalesce(last_k, 0) AS INTEGER) AS incomplete, coalesce(last_k, 0) = 0 AS alarm FROM cluster c JOIN whole USING (cluster_id)""")
def cycle_state_clusters(spark, d):
    """The last complete inventory of each cluster, and how many incomplete ones came since."""
    return _state(spark, d).read("clusters")


@register(_STATE + "SELECT * FROM told")
def cycle_state_signals(spark, d):
    """Signals after three cycles of reports: what a scan in scope no longer reports is out of use."""
    return _state(spark, d).read("signals").select("wl_id", "signal_id", "first_seen", "last_seen", "active")


@register(_STATE + """, turn AS (SELECT wl_id, signal_id, bool_or(seen_at < TIMESTAMP '2024-01-11') AS t1, bool_or(seen_at >= TIMESTAMP '2024-01-11' AND seen_at < TIMESTAMP '2024-01-21') AS t2, bool_or(seen_at >= TIMESTAMP '2024-01-21') AS t3
      FROM raw_signal JOIN workload USING (wl_id) WHERE signal_id LIKE 'k%:KSV-%' GROUP BY wl_id, signal_id)
    SELECT CAST(k AS INTEGER) AS cycle, obs_deployed, obs_undeployed, obs_swept, signals_cleared, (SELECT count(*) FROM (SELECT DISTINCT category, vuln_id, wl_id, image_id FROM item i WHERE i.k = x.k)) AS reported FROM (
      SELECT 1 AS k, (SELECT count(*) FROM seen WHERE f1 IS NOT NULL) AS obs_deployed, 0 AS obs_undeployed, 0 AS obs_swept, 0 AS signals_cleared UNION ALL
      SELECT 2, (SELECT count(*) FROM second WHERE here2 AND up2), (SELECT count(*) FROM second WHERE here2 AND NOT up2), (SELECT count(*) FROM second WHERE f1 IS NOT NULL AND NOT here2), (SELECT count(*) FROM turn WHERE t1 AND NOT t2) UNION ALL
      SELECT 3, (SELECT count(*) FROM pair WHERE deployed), (SELECT count(*) FROM pair WHERE NOT deployed), (SELECT count(*) FROM second WHERE here2 OR f3 IS NOT NULL) - (SELECT count(*) FROM pair), (SELECT count(*) FROM turn WHERE t2 AND NOT t3)) x""")
def cycle_counters(spark, d):
    """What each cycle's writes counted as they wrote."""
    return _state(spark, d).read("counters").select("cycle", "obs_deployed", "obs_undeployed", "obs_swept", "signals_cleared", "reported")


@register("""WITH scan AS (SELECT 'sha256:' || o_orderkey AS digest, CASE WHEN o_orderkey % 3 <> 0 THEN 'r.io/' ELSE '' END || 'team/app' || (o_custkey % 20) || ':1.' || (o_orderkey % 4) AS ref, o_orderkey % 2 = 0 AS early,
      CASE WHEN o_orderkey % 2 = 0 THEN '3.19' ELSE '' END AS os_version, o_orderkey % 7 = 0 AS base_eosl FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    told AS (SELECT digest, max(ref) AS ref FROM (SELECT 'sha256:' || s_suppkey AS digest, 'r.io/team/app' || (s_suppkey % 20) || '@sha256:' || s_suppkey AS ref FROM supplier WHERE s_suppkey % 3 = 0
      UNION ALL SELECT 'sha256:run' || s_suppkey, 'r.io/team/app' || (s_suppkey % 20) || ':v' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY digest),
    first_two AS (SELECT coalesce(t.digest, s.digest) AS digest, coalesce(t.ref, s.ref) AS ref FROM told t FULL JOIN (SELECT * FROM scan WHERE early) s ON s.digest = t.digest)
    SELECT coalesce(f.digest, s.digest) AS digest, CASE WHEN f.ref IS NULL OR (NOT s.early AND length(s.ref) > length(f.ref)) THEN s.ref ELSE f.ref END AS ref,
      CASE WHEN s.digest IS NULL THEN '' ELSE 'alpine' END AS os_family, coalesce(s.os_version, '') AS os_version, coalesce(s.base_eosl, false) AS base_eosl FROM first_two f FULL JOIN scan s ON s.digest = f.digest""", on_lens=False)
def stored_images(spark, d):
    """Images after scans, an inventory and further scans, each merged into the buckets that it touches."""
    found = reports.vulnerability_rows(payloads.vulnerabilities(spark, d)).select(F.col("image_digest").alias("digest"), F.col("image_ref").alias("ref"), "os_family", "os_version", "base_eosl").distinct()
    scans = settled(found.withColumn("early", F.substring("digest", 8, 20).try_cast("long") % 2 == 0))  # parsed once for both
    none = {"os_family": F.lit(None).cast("string"), "os_version": F.lit(None).cast("string"), "base_eosl": F.lit(None).cast("boolean")}
    inventory = _manifests(spark, d).observations().select("digest", "ref").distinct().withColumns(none)
    store = Versions(spark, f"{shared_folder(spark)}/images-{uuid.uuid4().hex}")
    for rows, told in ((scans.where("early"), False), (inventory, True), (scans.where("NOT early"), False)):
        commit = store.begin()
        if not commit.number:
            commit.replace("images", rows.select(*IMAGE).limit(0), ("digest",))
        commit.merge("images", rows.select(*IMAGE, F.lit(told).alias("told")).where("digest <> ''"), ("digest",), cycle.merged_images)
        commit.publish()
    return store.read("images")


_REQUESTS = """WITH request AS (SELECT *, o_orderkey % 17 AS k, CASE o_orderkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'item' ELSE 'finish' END AS phase, 'c' || (o_custkey % 5) AS cluster, 'i' || (o_custkey % 50) AS import_id FROM orders),
    told AS (SELECT *, CASE WHEN k IN (0, 1, 13) THEN 'unreadable' WHEN k = 3 THEN 'malformed' WHEN k = 2 THEN 'cluster is required' WHEN k IN (4, 5) THEN 'kind and import_id are required' WHEN phase = 'finish' AND k = 8 THEN 'observed_count is required'
      WHEN phase = 'finish' AND k = 12 THEN 'malformed' WHEN phase = 'item' AND k IN (6, 7) THEN 'payload is required' END AS first_reason FROM request),
    judged AS (SELECT *, CASE WHEN first_reason IS NULL AND phase = 'finish' AND NOT EXISTS (SELECT 1 FROM told s WHERE s.phase = 'start' AND s.first_reason IS NULL AND s.cluster = t.cluster AND s.import_id = t.import_id) THEN 'not started' ELSE first_reason END AS reason FROM told t)
"""


def _judged(spark, d):
    return envelopes.started(envelopes.judged(payloads.requests(spark, d)))


@register(_REQUESTS + "SELECT o_orderkey, phase, cluster, 'inventory' AS kind, import_id, CASE WHEN phase = 'finish' THEN CASE k WHEN 14 THEN 7 ELSE o_orderkey % 9 END END AS observed_count, k IN (10, 11) AS complete_snapshot FROM judged WHERE reason IS NULL", on_lens=False)
def requests_accepted(spark, d):
    """Requests that start and finish cycles and bring items, as far as nothing is wrong with them."""
    rows, _ = envelopes.split(_judged(spark, d))
    return rows.select("o_orderkey", "phase", "cluster", "kind", "import_id", "observed_count", "complete_snapshot")


@register(_REQUESTS + "SELECT phase, reason, count(*) AS n, count(*) FILTER (WHERE k <> 13) AS texts FROM judged WHERE reason IS NOT NULL GROUP BY phase, reason", on_lens=False)
def requests_refused(spark, d):
    """Why the other requests are refused."""
    _, rows = envelopes.split(_judged(spark, d))
    return rows.groupBy("phase", "reason").agg(F.count("*").alias("n"), F.count("value").alias("texts"))


@register(_CYCLES + """, waits AS (SELECT DISTINCT c.cluster_id, q.kind, q.import_id FROM queue q JOIN cluster c USING (cluster_name) WHERE q.status IN ('pending', 'processing'))
    SELECT m.cluster_id, m.kind, m.import_id, CASE WHEN m.state = 'draining' AND w.cluster_id IS NULL THEN 'reaped' ELSE m.state END AS state, CASE WHEN m.state = 'draining' AND w.cluster_id IS NULL THEN 1 ELSE 0 END AS effects
    FROM mark m LEFT JOIN waits w ON w.cluster_id = m.cluster_id AND w.kind = m.kind AND w.import_id = m.import_id""", on_lens=False)
def marks_reaped_once(spark, d):
    """Marks after three sweeps, two of them at once: each drained one is reaped, and acted on once."""
    queue, own, clusters = _queue(spark, d)
    store = Versions(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")

    def effect(commit, rows):
        commit.merge("effects", rows.withColumn("n", F.lit(1)), tuple(marks.TUPLE), lambda old, new: old.unionByName(new))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda name: marks.reap_drained(store, own, queue, clusters, name, effect), ("one", "two")))
    marks.reap_drained(store, own, queue, clusters, "three", effect)
    acted = store.read("effects").groupBy(*marks.TUPLE).agg(F.sum("n").cast("int").alias("effects"))
    return marks.flipped(own, store.read("reaped")).join(acted, marks.TUPLE, "left").withColumn("effects", F.coalesce("effects", F.lit(0)))


@register(""", point AS (SELECT unnest(generate_series(TIMESTAMP '1998-06-01', TIMESTAMP '2002-06-01', INTERVAL 1 MONTH)) AS month),
    scope AS (SELECT DISTINCT cluster_name, ns_name FROM banded WHERE cluster_name = 'ASIA'), kind AS (SELECT unnest(['critical', 'high', 'medium', 'low', 'info', 'unknown']) AS severity),
    counted AS (SELECT cluster_name, ns_name, severity, CAST(date_trunc('month', last_seen) AS TIMESTAMP) AS month, count(*) AS n FROM banded GROUP BY ALL)
    SELECT s.cluster_name, s.ns_name, k.severity, string_agg(coalesce(c.n, 0), ',' ORDER BY a.month) AS counts, count(*) AS points, min(a.month) AS since
    FROM scope s CROSS JOIN kind k CROSS JOIN point a LEFT JOIN counted c ON c.cluster_name = s.cluster_name AND c.ns_name = s.ns_name AND c.severity = k.severity AND c.month = a.month GROUP BY s.cluster_name, s.ns_name, k.severity""")
def series_aligned(spark, d):
    """Series of one cluster's namespaces, of one length each, with zeros where a month has nothing."""
    rows = snapshots.in_scope(_banded(spark, d), cluster="ASIA").groupBy("cluster_name", "ns_name", "severity", F.date_trunc("month", "last_seen").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))
    long = snapshots.aligned(rows, ["cluster_name", "ns_name"], "severity", SEVERITIES, "month", "n", _at("1998-06-01"), _at("2002-06-01"), "1 month")
    long = long.withColumn("scope_", F.struct("cluster_name", "ns_name", "severity"))
    out = snapshots.series_arrays(long, "scope_", "n", "month")
    return out.select("scope_.*", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("counts"), F.size("values").cast("long").alias("points"), F.element_at("at", 1).alias("since"))


_INVENTORIES: dict[tuple[str, str], Versions] = {}


def _inventories(spark, d):
    """Two complete inventories, one after the other, of one cluster; the second has less of everything, but more network policies.

    It lacks some replica sets whose pods are still there. Run once per application and folder of tables.
    """
    at = (spark.sparkContext.applicationId, d)
    if at not in _INVENTORIES:
        store = Versions(spark, f"{shared_folder(spark)}/inventory-{uuid.uuid4().hex}", buckets=4)
        kind, number, space = F.col("kind"), *[F.regexp_extract(c, "([0-9]+)$", 1).try_cast("int") for c in ("name", "namespace")]
        first = ~F.coalesce((kind == "NetworkPolicy") & (space % 2 == 0), F.lit(False))
        second = F.coalesce((number % 4 != 1) & ~((kind == "ReplicaSet") & (number % 8 == 2)), F.lit(True))
        for part, started in ((first, "2024-01-01"), (second, "2024-02-01")):
            inventory.persist(store, "prod-1", _manifests(spark, d).where(part), _at(started), complete=True)
        _INVENTORIES[at] = store
    return _INVENTORIES[at]


_INVENTORY = """WITH wl AS (SELECT s_suppkey AS s, s_nationkey AS n, 'ns' || s_nationkey AS namespace, kind, prefix || s_suppkey AS name, s_suppkey % 4 <> 1 AS here FROM supplier,
      LATERAL (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'StatefulSet' ELSE 'DaemonSet' END AS kind, 'wl' AS prefix UNION ALL SELECT 'CronJob', 'cron' WHERE s_suppkey % 6 = 5) k),
    svc AS (SELECT c_custkey AS c, c_nationkey AS n, c_custkey % 10 AS app, c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AS lb, c_custkey % 25 = c_nationkey AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0) AS ing FROM customer WHERE c_custkey % 3 <> 0),
    hit AS (SELECT n, app, bool_or(lb) AS lb1, bool_or(ing) AS ing1, bool_or(lb AND c % 4 <> 1) AS lb2, bool_or(ing AND c % 4 <> 1) AS ing2 FROM svc GROUP BY n, app),
    own AS (SELECT w.*, coalesce(lb1, false) AS lb1, coalesce(ing1, false) AS ing1, coalesce(lb1 OR ing1, false) AS open1, coalesce(lb2 OR ing2, false) AS open2 FROM wl w LEFT JOIN hit h ON h.n = w.n AND h.app = w.s % 10)
"""


@register(_INVENTORY + """SELECT 'prod-1' AS cluster, namespace, kind, name, CASE WHEN s % 2 = 0 THEN 'runner' ELSE 'default' END AS service_account, CASE WHEN here THEN open2 ELSE open1 END AS exposed, CASE WHEN here THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS last_inventory FROM own""", on_lens=False)
def persisted_workloads(spark, d):
    """Workloads after both inventories, exposed where a balancer or an ingress from outside leads to them."""
    return _inventories(spark, d).read("workloads").select("cluster", "namespace", "kind", "name", "service_account", "exposed", "last_inventory")


@register(_INVENTORY + """, place AS (SELECT n_nationkey AS n, n_nationkey % 6 <> 5 AND n_nationkey % 4 <> 1 AS told, bool_or(here) AS any_here, bool_or(here AND open2) AS open2, bool_or(open1) AS open1 FROM nation LEFT JOIN own ON n = n_nationkey WHERE n_nationkey % 6 <> 5 OR n IS NOT NULL GROUP BY n_nationkey)
    SELECT 'prod-1' AS cluster, 'ns' || n AS name, told AS active, false AS sensitive, coalesce(CASE WHEN told OR any_here THEN open2 ELSE open1 END, false) AS exposed FROM place""", on_lens=False)
def persisted_namespaces(spark, d):
    """Namespaces after both: those without an item in the second, which is complete, are out of use."""
    return _inventories(spark, d).read("namespaces")


@register("SELECT 'prod-1' AS cluster, 'ns' || s_nationkey AS namespace, 'ReplicaSet' AS kind, 'rs' || s_suppkey AS name, 'Deployment' AS target_kind, 'wl' || s_suppkey AS target_name FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 <> 1 AND s_suppkey % 8 <> 2", on_lens=False)
def persisted_aliases(spark, d):
    """Owners as the second inventory has them."""
    return _inventories(spark, d).read("aliases")


@register(_INVENTORY + """SELECT 'prod-1' AS cluster, namespace, kind, name, digest || s AS digest, container, container = 'setup' AS init_container, CASE WHEN here THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS last_seen, false AS deployed
    FROM own, (VALUES ('sha256:', 'main'), ('sha256:', 'setup'), ('sha256:run', 'main')) v(digest, container) WHERE kind = 'Deployment' AND (container = 'main' OR s % 4 = 0)""", on_lens=False)
def persisted_containers(spark, d):
    """Containers under their workloads; of some pods only the owners of the inventory before tell whose they are."""
    return _inventories(spark, d).read("containers")


@register(_INVENTORY + """SELECT 'prod-1' AS cluster, namespace, kind, name, signal_id, CASE WHEN signal_id = 'kp:missing-networkpolicy' AND here THEN n % 3 <> 0 ELSE true END AS active FROM own,
    LATERAL (SELECT 'kyverno:disallow-host-namespaces' AS signal_id WHERE s % 7 = 0 UNION ALL SELECT 'kyverno:disallow-privileged-containers' WHERE s % 5 = 0 UNION ALL SELECT 'kyverno:require-run-as-nonroot' WHERE s % 4 = 0
      UNION ALL SELECT 'kp:has-external-lb' WHERE lb1 UNION ALL SELECT 'kp:has-external-ingress' WHERE ing1 UNION ALL SELECT 'kp:missing-networkpolicy' WHERE NOT (n % 3 = 0 AND n % 2 = 1)) g""", on_lens=False)
def persisted_signals(spark, d):
    """Signals of pods, of how workloads are reached, and of namespaces without a network policy, cleared where one came."""
    return _inventories(spark, d).read("signals").select("cluster", "namespace", "kind", "name", "signal_id", "active")


def _asked(*rows: tuple[str, str, str, str]) -> str:
    """A row for each (kind, table, which rows count, when it passes, as a condition on n)."""
    return " UNION ALL ".join(f"SELECT {k} AS \"index\", '{kind}' AS kind, {passes} AS pass, n AS found FROM (SELECT count(*) AS n FROM {table} WHERE {where}) x" for k, (kind, table, where, passes) in enumerate(rows))


_TABLES = {"spaces": "persisted_namespaces", "placed": "persisted_workloads", "links": "persisted_aliases", "pictures": "stored_images", "known": "cycle_state_findings", "gaps": "scan_outages"}


@register("WITH " + ", ".join(f"{t} AS ({ORACLE[q]})" for t, q in _TABLES.items()) + _CYCLES.replace("WITH ", ", ", 1) + _asked(
    ("namespace_attributes", "spaces", "name = 'ns0'", "n > 0 AND (SELECT bool_and(active) FROM spaces WHERE name = 'ns0')"),
    ("namespace_attributes", "spaces", "NOT active", "n > 0 AND (SELECT bool_and(exposed) FROM spaces WHERE NOT active)"),
    ("workload_exists", "placed", "kind = 'CronJob'", "n > 0"),
    ("workload_alias_count", "links", "true", "n >= 1"),
    ("image_count", "pictures", "true", "n = 0"),
    ("image_exists", "pictures", "os_family = 'alpine' AND base_eosl", "n > 0"),
    ("finding_count", "known", "band = 'immediate'", "n >= 10"),
    ("import_mark_count", "mark", "state = 'draining'", "n >= 5"),
    ("ingest_queue_count", "queue", "status IN ('pending', 'processing')", "n >= 1"),
    ("snapshot_delta", "known", "severity = 'critical'", "n > 0"),
    ("snapshot_delta", "known", "severity = 'critical'", "false"),
    ("scan_inconsistency", "gaps", "streak = 2", "n = 1"),
    ("scan_inconsistency_count", "gaps", "true", "n >= 1"),
    ("log_event_count", "placed", "false", "true"),
    ("log_event_exists", "placed", "false", "true"),
    ("workload_last_inventory_advanced", "placed", "last_inventory > TIMESTAMP '2024-01-15 00:00:01'", "n > 0"),
    ("workload_last_inventory_unchanged", "placed", "last_inventory <= TIMESTAMP '2024-01-15 00:00:01' AND kind = 'Deployment'", "n > 0"),
), on_lens=False)
def assertion_batch_state(spark, d):
    """Assertions on what cycles have stored: the kinds that ``assertion_batch`` does not ask."""
    queue, own, _ = _queue(spark, d)
    findings_ = QUERIES["cycle_state_findings"](spark, d).withColumn("captured_at", F.col("last_seen"))
    tables = {
        "namespaces": persisted_namespaces(spark, d),
        "workloads": persisted_workloads(spark, d).withColumnRenamed("last_inventory", "last_inventory_at"),
        "aliases": persisted_aliases(spark, d),
        "images": stored_images(spark, d),
        "findings": findings_,
        "snapshots": findings_,
        "marks": own,
        "queue": queue,
        "inconsistencies": QUERIES["scan_outages"](spark, d),
    }
    asked = [
        {"kind": "namespace_attributes", "filter": {"name": "ns0"}, "attributes": {"active": True}},
        {"kind": "namespace_attributes", "filter": {"active": False}, "attributes": {"exposed": True}},
        {"kind": "workload_exists", "filter": {"kind": "CronJob"}},
        {"kind": "workload_alias_count", "min": 1},
        {"kind": "image_count"},
        {"kind": "image_exists", "filter": {"os_family": "alpine", "base_eosl": True}},
        {"kind": "finding_count", "filter": {"band": "immediate"}, "min": 10},
        {"kind": "import_mark_count", "filter": {"state": "draining"}, "min": 5},
        {"kind": "ingest_queue_count", "filter": {"status": ["pending", "processing"]}, "min": 1},
        {"kind": "snapshot_delta", "filter": {"severity": "critical"}, "attributes": {"severity": "critical"}},
        {"kind": "snapshot_delta", "filter": {"severity": "critical"}, "attributes": {"severity": "low"}},
        {"kind": "scan_inconsistency", "filter": {"streak": 2}},
        {"kind": "scan_inconsistency_count", "min": 1},
        {"kind": "log_event_count"},
        {"kind": "log_event_exists"},
        {"kind": "workload_last_inventory_advanced", "since": "2024-01-15"},
        {"kind": "workload_last_inventory_unchanged", "since": "2024-01-15", "filter": {"kind": "Deployment"}},
    ]
    return checks.evaluate(spark, tables, asked).withColumn("index", F.col("index").cast("int"))


_FEEDS = (
    ("(id % 100) / 100.0::DOUBLE AS percentile FROM range(300) t(id))", "((id * 7) % 100) / 100.0::DOUBLE AS percentile FROM range(300) t(id) WHERE id % 3 <> 0)"),
    ("FROM range(300) t(id) WHERE id % 37 = 0)", "FROM range(300) t(id) WHERE id % 41 = 0)"),
)


def _refreshed_sql() -> str:
    sql = lens.SQL
    for old, new in _FEEDS:
        assert old in sql
        sql = sql.replace(old, new)
    return sql + "SELECT category, vuln_id, wl_id, image_id, epss_percentile, kev_listed, rule, band FROM banded"


@register(_refreshed_sql(), on_lens=False)
def refreshed_findings(spark, d):
    """Stored findings after both feeds were refreshed: what the new ones lack is cleared, and only what differs is scored anew."""
    columns = [*KEY, "severity", "fixed_version", "env", "is_exposed", "escalation", "sensitive", "epss_percentile", "kev_listed", "rule", "band"]
    store = Versions(spark, f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}", buckets=4)
    first = store.begin()
    # stored before the findings, so that the plan of these knows its size: they are shuffled by the fold alone
    dims = findings.dimensions(lens.workloads(spark, d), lens.namespaces(spark, d), lens.clusters(spark, d), _signals(spark, d))
    first.replace("context", dims.select("wl_id", "exposed", "ns_exposed", "escalation", "env", "sensitive"), ("wl_id",))
    first.replace("findings", findings.score(findings.within(_enriched(spark, d), first.read("context"))).select(*columns), tuple(KEY))
    first.publish()
    ids = spark.range(300).withColumn("vuln_id", F.expr("concat('CVE-', lpad(cast(id AS string), 4, '0'))"))
    epss = ids.where("id % 3 <> 0").select("vuln_id", (F.col("id") * 7 % 100 / 100).alias("percentile"))
    enrichment.refresh(store, epss, ids.where("id % 41 = 0").select("vuln_id"))
    return store.read("findings").select(*KEY, "epss_percentile", "kev_listed", "rule", "band")
