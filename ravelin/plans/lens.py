"""The domain's tables, seen through the TPC-H-like tables that stand in for them.

region is cluster, nation namespace, supplier workload, part image, lineitem raw observation, orders finding
action, events signal stream. Each function returns a lazy DataFrame; ``SQL`` says the same as common table
expressions for the checks in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which the views are taken, and the start of the signal cycle.
AS_OF = "1997-01-01"
CYCLE_START = "2024-01-15"


#: Rows of the largest table for one partition of a shuffle, before Spark merges small ones.
ROWS = 200_000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: What one task reads of files and of shuffles at most, unless the session states sizes of its own; tasks sort it unpacked.
_PIECES = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
_COUNTS: dict[tuple[str, str], int] = {}


def sized(spark: SparkSession, d: str, rows: int = ROWS) -> int:
    """Give shuffles of this session as many first partitions as the tables of ``d`` need; their number.

    With a fixed number the memory of a task grows with the tables until it spills. Spark merges the partitions that
    turn out small, so a larger number costs little; a session's own larger number stays as it is. By default it merges
    them up to 64 MB, and reads 128 MB of a file in one task: packed, some twentieth of what is then sorted.
    """
    for name, size in _PIECES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, size)
    at = (spark.sparkContext.applicationId, d)
    if at not in _COUNTS:
        _COUNTS[at] = spark.read.parquet(f"{d}/lineitem.parquet").count()
    own = int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    need = -(-_COUNTS[at] // rows)
    if need > own:
        spark.conf.set(_INITIAL, str(need))
    return max(need, own)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "region").select(
        F.col("r_regionkey").cast("long").alias("cluster_id"),
        F.col("r_name").alias("cluster_name"),
        F.expr("CASE r_regionkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END").alias("env"),
        F.expr("CASE WHEN r_regionkey <> 4 THEN timestamp_ntz'1996-01-01 00:00:00' END").alias("last_complete"),
    )


def workloads(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("wl_id"),
        F.col("s_name").alias("wl_name"),
        F.col("s_nationkey").cast("long").alias("ns_id"),
        (F.col("s_acctbal") >= 0).alias("deployed"),
        (F.col("s_suppkey") % 4 == 0).alias("exposed"),
        F.expr("element_at(array('Deployment','StatefulSet','DaemonSet','CronJob','Job','Pod'), cast(s_suppkey % 6 + 1 AS int))").alias("kind"),
    )


def namespaces(spark: SparkSession, d: str) -> DataFrame:
    shown = workloads(spark, d).groupBy("ns_id").agg(F.bool_or("exposed").alias("ns_exposed"))
    own = _read(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("ns_id"),
        F.col("n_name").alias("ns_name"),
        F.col("n_regionkey").cast("long").alias("cluster_id"),
        (F.col("n_nationkey") % 5 == 0).alias("sensitive"),
    )
    return own.join(shown, "ns_id", "left").select("ns_id", "ns_name", "cluster_id", "sensitive", F.coalesce("ns_exposed", F.lit(False)).alias("ns_exposed"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Raw scanner rows: several may speak of one finding."""
    sized(spark, d)
    return _read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("wl_id"),
        F.col("l_partkey").alias("image_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'vulnerability' WHEN 'R' THEN 'config' ELSE 'exposed-secret' END").alias("category"),
        F.expr("concat('CVE-', lpad(cast(l_partkey % 300 AS string), 4, '0'))").alias("vuln_id"),
        F.expr("CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 35 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 8 THEN 'low' WHEN l_quantity > 3 THEN 'info' ELSE 'unknown' END").alias("severity"),
        F.expr("CASE WHEN l_linestatus = 'F' THEN '1.0' ELSE '' END").alias("fixed_version"),
        F.col("l_shipdate").alias("seen_at"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"),
    )


def epss(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.range(300).select("id")
    return ids.select(F.expr("concat('CVE-', lpad(cast(id AS string), 4, '0'))").alias("vuln_id"), (F.col("id") % 100 / 100).alias("percentile"))


def kev(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(300).where("id % 37 = 0").select(F.expr("concat('CVE-', lpad(cast(id AS string), 4, '0'))").alias("vuln_id"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    """What was decided about findings: order_id, action, whether revoked, when it ends."""
    return _read(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'accept' WHEN '2-HIGH' THEN 'false_positive' WHEN '3-MEDIUM' THEN 'acknowledge' ELSE 'scheduled' END").alias("action"),
        (F.col("o_orderstatus") == "F").alias("revoked"),
        F.expr("CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END").alias("expires_at"),
    )


def signals(spark: SparkSession, d: str) -> DataFrame:
    """One row per event that reports a signal."""
    return _read(spark, d, "events").select(
        F.col("user_id").alias("wl_id"),
        F.expr("CASE event_type WHEN 'purchase' THEN 'kyverno:disallow-privileged-containers' WHEN 'signup' THEN 'ksv:KSV-0051' WHEN 'error' THEN 'ksv:KSV-0001' WHEN 'click' THEN 'ksv:KSV-0013' ELSE 'kp:missing-networkpolicy' END").alias("signal_id"),
        F.col("ts").alias("seen_at"),
    )


SQL = """
WITH cluster AS (SELECT CAST(r_regionkey AS BIGINT) AS cluster_id, r_name AS cluster_name,
    CASE r_regionkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS env,
    CASE WHEN r_regionkey <> 4 THEN TIMESTAMP '1996-01-01' END AS last_complete FROM region),
workload AS (SELECT s_suppkey AS wl_id, s_name AS wl_name, CAST(s_nationkey AS BIGINT) AS ns_id, s_acctbal >= 0 AS deployed,
    s_suppkey % 4 = 0 AS exposed,
    CASE s_suppkey % 6 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'StatefulSet' WHEN 2 THEN 'DaemonSet' WHEN 3 THEN 'CronJob' WHEN 4 THEN 'Job' ELSE 'Pod' END AS kind
    FROM supplier),
namespace AS (SELECT CAST(n_nationkey AS BIGINT) AS ns_id, n_name AS ns_name, CAST(n_regionkey AS BIGINT) AS cluster_id, n_nationkey % 5 = 0 AS sensitive,
    EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 4 = 0) AS ns_exposed FROM nation),
observation AS (SELECT l_suppkey AS wl_id, l_partkey AS image_id,
    CASE l_returnflag WHEN 'A' THEN 'vulnerability' WHEN 'R' THEN 'config' ELSE 'exposed-secret' END AS category,
    'CVE-' || lpad(CAST(l_partkey % 300 AS VARCHAR), 4, '0') AS vuln_id,
    CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 35 THEN 'high' WHEN l_quantity > 20 THEN 'medium'
         WHEN l_quantity > 8 THEN 'low' WHEN l_quantity > 3 THEN 'info' ELSE 'unknown' END AS severity,
    CASE WHEN l_linestatus = 'F' THEN '1.0' ELSE '' END AS fixed_version,
    l_shipdate AS seen_at, l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS price FROM lineitem),
finding AS (SELECT category, vuln_id, wl_id, image_id, severity, fixed_version, order_id, line, first_seen, last_seen FROM (
    SELECT *, row_number() OVER (PARTITION BY category, vuln_id, wl_id, image_id ORDER BY seen_at DESC, order_id DESC, line DESC, price DESC, severity, fixed_version) AS k,
      min(seen_at) OVER (PARTITION BY category, vuln_id, wl_id, image_id) AS first_seen,
      max(seen_at) OVER (PARTITION BY category, vuln_id, wl_id, image_id) AS last_seen FROM observation) WHERE k = 1),
epss AS (SELECT 'CVE-' || lpad(CAST(id AS VARCHAR), 4, '0') AS vuln_id, (id % 100) / 100.0::DOUBLE AS percentile FROM range(300) t(id)),
kev AS (SELECT 'CVE-' || lpad(CAST(id AS VARCHAR), 4, '0') AS vuln_id FROM range(300) t(id) WHERE id % 37 = 0),
enriched AS (SELECT f.*, e.percentile AS epss_percentile, k.vuln_id IS NOT NULL AND category = 'vulnerability' AS kev_listed
    FROM finding f LEFT JOIN epss e ON f.vuln_id = e.vuln_id AND f.vuln_id LIKE 'CVE-%' LEFT JOIN kev k ON f.vuln_id = k.vuln_id),
action AS (SELECT o_orderkey AS order_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'accept' WHEN '2-HIGH' THEN 'false_positive' WHEN '3-MEDIUM' THEN 'acknowledge' ELSE 'scheduled' END AS action,
    o_orderstatus = 'F' AS revoked, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS expires_at FROM orders),
raw_signal AS (SELECT user_id AS wl_id, CASE event_type WHEN 'purchase' THEN 'kyverno:disallow-privileged-containers' WHEN 'signup' THEN 'ksv:KSV-0051'
    WHEN 'error' THEN 'ksv:KSV-0001' WHEN 'click' THEN 'ksv:KSV-0013' ELSE 'kp:missing-networkpolicy' END AS signal_id, ts AS seen_at FROM events),
signal AS (SELECT wl_id, signal_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen, max(seen_at) >= TIMESTAMP '2024-01-15' AS active
    FROM raw_signal JOIN workload USING (wl_id) GROUP BY wl_id, signal_id),
escalated AS (SELECT DISTINCT wl_id FROM signal WHERE active AND signal_id IN ('kyverno:disallow-privileged-containers', 'ksv:KSV-0051', 'ksv:KSV-0001')),
wide AS (SELECT f.*, w.wl_name, w.kind, w.deployed, w.exposed OR n.ns_exposed AS is_exposed, n.ns_id, n.ns_name, n.sensitive, c.cluster_id, c.cluster_name, c.env, c.last_complete,
    x.wl_id IS NOT NULL AS escalation
    FROM enriched f JOIN workload w USING (wl_id) JOIN namespace n USING (ns_id) JOIN cluster c USING (cluster_id) LEFT JOIN escalated x ON x.wl_id = f.wl_id),
scored AS (SELECT *, CASE
    WHEN kev_listed THEN 1
    WHEN severity IN ('critical', 'high') AND epss_percentile >= 0.9 AND is_exposed AND env = 'prod' THEN 5
    WHEN severity = 'critical' AND is_exposed AND env = 'prod' THEN 6
    WHEN severity IN ('critical', 'high') AND env = 'prod' AND escalation THEN 7
    WHEN epss_percentile >= 0.9 AND env = 'prod' THEN 8
    WHEN severity = 'critical' AND env = 'prod' THEN 9
    WHEN severity = 'high' AND is_exposed AND env = 'prod' THEN 10
    WHEN severity IN ('high', 'medium') AND fixed_version = '' AND sensitive THEN 11
    WHEN fixed_version = '' AND NOT is_exposed AND NOT escalation THEN 12
    WHEN fixed_version = '' AND severity IN ('critical', 'high') AND (is_exposed OR escalation) THEN 13
    WHEN severity = 'critical' AND env <> 'prod' THEN 14
    WHEN severity = 'high' AND env = 'prod' THEN 15
    WHEN severity = 'medium' AND env = 'prod' AND escalation THEN 16
    ELSE 17 END AS rule FROM wide),
banded AS (SELECT *, CASE WHEN rule IN (1, 5, 6) THEN 'immediate' WHEN rule IN (7, 8, 9, 10) THEN 'out_of_cycle'
    WHEN rule IN (11, 13, 14, 15, 16) THEN 'scheduled' ELSE 'defer' END AS band FROM scored),
muted AS (SELECT DISTINCT order_id FROM action WHERE action IN ('accept', 'false_positive') AND NOT revoked AND (expires_at IS NULL OR expires_at > TIMESTAMP '1997-01-01')),
relevant AS (SELECT * FROM banded WHERE deployed AND (last_complete IS NULL OR last_seen >= last_complete)),
visible AS (SELECT * FROM relevant r WHERE NOT EXISTS (SELECT 1 FROM muted m WHERE m.order_id = r.order_id)),
listed AS (SELECT w.wl_id, w.wl_name, w.kind, w.deployed, n.ns_name, c.cluster_name,
    count(*) FILTER (WHERE v.band = 'immediate') AS immediate, count(*) FILTER (WHERE v.band = 'out_of_cycle') AS out_of_cycle,
    count(*) FILTER (WHERE v.band = 'scheduled') AS scheduled, count(*) FILTER (WHERE v.band = 'defer') AS defer
    FROM workload w JOIN namespace n USING (ns_id) JOIN cluster c USING (cluster_id) LEFT JOIN visible v ON v.wl_id = w.wl_id
    WHERE w.deployed GROUP BY ALL)
"""
