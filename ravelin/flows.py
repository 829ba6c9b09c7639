"""Registered queries over streams: the cycle barrier, windows that close, late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.queries import register
from ravelin.sources.feeds import shared_folder
from ravelin.streaming import barrier, late


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("""WITH envelope AS (SELECT 'c' || (o_custkey % 5) AS cluster, CASE o_orderkey % 3 WHEN 0 THEN 'inventory' WHEN 1 THEN 'trivy.VulnerabilityReport' ELSE 'kyverno.PolicyReport' END AS kind, strftime(o_orderdate, '%Y%m') AS import_id,
      CASE WHEN o_orderkey % 7 = 0 THEN 'start' WHEN o_orderkey % 11 = 0 THEN 'finish' ELSE 'item' END AS phase, o_orderdate AS seen, o_orderkey AS n FROM orders),
    mark AS (SELECT cluster, kind, import_id, max(seen) AS last, max(seen) FILTER (WHERE phase = 'start') AS start, max(seen) FILTER (WHERE phase = 'finish') AS finish, max({'seen': seen, 'n': n}) FILTER (WHERE phase = 'finish') AS told FROM envelope GROUP BY ALL),
    state AS (SELECT *, coalesce(start <= finish, false) AS done, last + INTERVAL 8 DAY <= (SELECT max(seen) FROM envelope) AS over FROM mark)
    SELECT cluster, kind, import_id, 'cycle' AS what, CASE WHEN done THEN 'draining' ELSE 'open' END AS outcome, 1::BIGINT AS n, CASE WHEN done THEN told.n END AS observed_count FROM state WHERE start IS NOT NULL
    UNION ALL SELECT cluster, kind, import_id, 'cycle', 'expired', 1, NULL FROM state WHERE NOT done AND over
    UNION ALL SELECT cluster, kind, import_id, 'item', CASE WHEN done THEN 'released' ELSE 'expired' END, count(*), max(CASE WHEN done THEN told.n END) FROM envelope JOIN state USING (cluster, kind, import_id) WHERE phase = 'item' AND (done OR over) GROUP BY cluster, kind, import_id, done""", on_lens=False)
def cycle_barrier(spark, d):
    """Orders as envelopes of import cycles: what the barrier releases, what it opens, and what it ends as never finished."""
    envelope = {
        "cluster": "concat('c', o_custkey % 5)",
        "kind": "CASE o_orderkey % 3 WHEN 0 THEN 'inventory' WHEN 1 THEN 'trivy.VulnerabilityReport' ELSE 'kyverno.PolicyReport' END",
        "import_id": "date_format(o_orderdate, 'yyyyMM')",
        "phase": "CASE WHEN o_orderkey % 7 = 0 THEN 'start' WHEN o_orderkey % 11 = 0 THEN 'finish' ELSE 'item' END",
        "payload": "cast(o_orderkey AS string)",
        "created_at": "o_orderdate",
        "observed_count": "o_orderkey",
    }
    rows = spark.readStream.schema(spark.read.parquet(f"{d}/orders.parquet").schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    at = _folder(spark, "barrier")
    stream = barrier.barrier(rows.select(*[F.expr(e).alias(n) for n, e in envelope.items()]))
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(barrier.OUT).parquet(f"{at}/out").groupBy(*barrier.KEY, "what", "outcome").agg(F.count("*").alias("n"), F.max("observed_count").alias("observed_count"))


RUNS = 4
#: Rows land in four runs of eight days; of fifty one comes two runs too late.
_LANDED = """WITH landed AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN least((day(ts) - 1) // 8 + 2, 3) ELSE (day(ts) - 1) // 8 END AS run, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS cycle_start FROM events),
    mark AS (SELECT r.run, max(l.ts) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT run FROM landed) r LEFT JOIN landed l ON l.run < r.run GROUP BY r.run),
    judged AS (SELECT l.*, coalesce(l.cycle_start + INTERVAL 6 HOUR <= m.mark, false) AS late FROM landed l JOIN mark m USING (run))
"""


def _landed(spark: SparkSession, d: str, branch) -> DataFrame:
    """``branch`` run once after each landing."""
    events = spark.read.parquet(f"{d}/events.parquet")
    day = F.expr("cast((day(ts) - 1) div 8 AS int)")
    run = F.when(F.col("event_id") % 50 == 0, F.least(day + 2, F.lit(RUNS - 1))).otherwise(day)
    at = _folder(spark, "landed")
    for k in range(RUNS):
        events.where(run == k).write.mode("append").parquet(f"{at}/in")
        branch(late.landing(spark, events.schema, f"{at}/in"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@register(_LANDED + "SELECT cycle_start, event_type, count(*) AS n, max(value) AS most FROM judged WHERE NOT late AND cycle_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL", on_lens=False)
def stream_closed_cycles(spark, d):
    """Six-hour windows as they close, each once; rows that land after their window has closed do not count."""
    return _landed(spark, d, late.closed_windows)


@register(_LANDED + "SELECT event_id, ts, event_type FROM judged WHERE late", on_lens=False)
def stream_late_rows(spark, d):
    """The rows that ``stream_closed_cycles`` leaves out."""
    return _landed(spark, d, late.late_rows).select("event_id", "ts", "event_type")
