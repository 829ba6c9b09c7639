"""Every query against its SQL, run by another engine on the same tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ravelin.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(frame, columns):
    value = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if hasattr(v, "is_integer") and not isinstance(v, bool) else str(v)
    return sorted(repr([value(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    found, expected = QUERIES[name](spark, D).toPandas(), con.execute(ORACLE[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert plain(found, columns) == plain(expected, columns)


def test_entry_runs_in_its_order(spark):
    rows = entry.entry(spark).collect()
    assert rows == sorted(rows, key=lambda r: (-r.immediate, -r.out_of_cycle, -r.scheduled, r.wl_name.lower(), r.wl_id))


def test_assertions_of_single_rows(spark):
    from ravelin.operators import checks

    rows = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 2, "2024-01-03"), ("b", 3, "2024-01-02")], "name string, n int, captured_at string").selectExpr("name", "n", "cast(captured_at AS timestamp_ntz) AS captured_at")
    tables = {"snapshots": rows, "findings": rows, "inconsistencies": rows}
    asked = [
        ({"kind": "snapshot_delta", "filter": {"name": "a"}, "attributes": {"n": 2}}, True),
        ({"kind": "snapshot_delta", "filter": {"name": "a"}, "attributes": {"n": 1}}, False),
        ({"kind": "finding_priority", "attributes": {"n": 1}}, True),
        ({"kind": "scan_inconsistency", "filter": {"name": "b"}}, True),
        ({"kind": "scan_inconsistency", "filter": {"name": "a"}}, False),
        ({"kind": "scan_inconsistency_count", "filter": {"name": "a"}}, False),
        ({"kind": "scan_inconsistency_count", "filter": {"name": "a"}, "expect": 2}, True),
    ]
    found = checks.evaluate(spark, tables, [a for a, _ in asked]).orderBy("index").collect()
    assert [r["pass"] for r in found] == [p for _, p in asked]


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_retention_is_of_all_findings(spark, con):
    """The whole job: findings as of the views' moment, not only the containers of the last weeks."""
    kept = con.execute("SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_returnflag, l_partkey, l_suppkey HAVING max(l_shipdate) >= TIMESTAMP '1997-01-01' - INTERVAL 30 DAY)").fetchone()[0]
    found = QUERIES["observation_retention"](spark, D)
    assert sorted(found.columns) == ["category", "image_id", "vuln_id", "wl_id"] and found.count() == kept
    assert kept > QUERIES["container_retention"](spark, D).count()
