"""The cycle barrier as a stream, whatever the order of arrival; late rows."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from ravelin.streaming import barrier

KIND = "cluster string, kind string, import_id string, phase string, payload string, created_at timestamp_ntz, observed_count long"
DAY = datetime.datetime(2024, 1, 1)


def event(cluster, phase, hour, payload=None, count=None, kind="inventory"):
    return (cluster, kind, "i1", phase, payload, DAY + datetime.timedelta(hours=hour), count)


def replayed(spark, path, batches, **how):
    """Land one batch after the other and run the barrier after each; its rows, and the rows of state after each run."""
    state = []
    for batch in batches:
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = barrier.barrier(spark.readStream.schema(KIND).parquet(f"{path}/in"), **how)
        run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        state.append(sum(o["numRowsTotal"] for o in run.lastProgress["stateOperators"]))
    rows = spark.read.schema(barrier.OUT).parquet(f"{path}/out").collect()
    return rows, state


def outcomes(rows):
    return sorted((r.cluster, r.payload, r.outcome, r.observed_count) for r in rows if r.what == "item")


START, ITEM, MORE, FINISH = event("c", "start", 0), event("c", "item", 1, "x"), event("c", "item", 2, "y"), event("c", "finish", 3, None, 2)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2), (2, 0, 3, 1)])
def test_any_order_of_arrival_releases_the_same(spark, tmp_path, order):
    events = [START, ITEM, MORE, FINISH]
    rows, _ = replayed(spark, tmp_path, [[events[k]] for k in order[:2]] + [[events[k] for k in order[2:]]])
    assert outcomes(rows) == [("c", "x", "released", 2), ("c", "y", "released", 2)]
    assert max((r.created_at, r.outcome) for r in rows if r.what == "cycle")[1] == "draining"


def test_repeats_and_openings_anew(spark, tmp_path):
    again, late, end = event("c", "start", 5), event("c", "item", 6, "z"), event("c", "finish", 7, None, 1)
    rows, _ = replayed(spark, tmp_path, [[START, START, ITEM, FINISH, FINISH], [FINISH, START], [again, late], [end]])
    assert outcomes(rows) == [("c", "x", "released", 2), ("c", "z", "released", 1)]
    cycles = [(r.outcome, r.observed_count) for r in sorted((r for r in rows if r.what == "cycle"), key=lambda r: r.created_at)]
    assert cycles == [("draining", 2), ("open", None), ("draining", 1)]


def test_state_is_bounded(spark, tmp_path):
    """Cycles that finish and cycles that never do leave nothing behind once they are long past."""
    far = [[event("f", "start", 24 * d)] for d in (40, 80)]
    rows, state = replayed(spark, tmp_path, [[event(f"c{k}", p, k % 5, f"p{k}") for k in range(40) for p in ("start", "item")] + [event(f"c{k}", "finish", 6, None, k) for k in range(0, 40, 2)], *far], idle_days=3)
    assert state[0] > 40 and state[-1] <= 2
    found = outcomes(rows)
    assert [x[2] for x in found].count("released") == 20 == [x[2] for x in found].count("expired")


def test_ingest_parts_valid_items_from_the_rest(spark, tmp_path):
    spark.createDataFrame([START, ITEM, MORE, FINISH, event("c", "item", 1, None), event(None, "item", 1, "no cluster"), event("lost", "item", 1, "w"), event("f", "start", 900)], KIND).write.parquet(f"{tmp_path}/in")
    paths = [f"{tmp_path}/{x}" for x in ("out", "rejects", "state")]
    barrier.ingest(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), *paths, lambda df: F.col("payload") != "y").awaitTermination()
    assert [r.payload for r in spark.read.parquet(paths[0]).collect()] == ["x"]
    assert sorted((r.reason, r.payload or "") for r in spark.read.parquet(paths[1]).collect()) == [("expired", "w"), ("invalid", ""), ("invalid", "y")]


def test_when_a_cycle_is_settled():
    for start, finish in itertools.product((None, 1, 2), repeat=2):
        assert barrier.settled(start, finish) == (start is not None and finish is not None and start <= finish)
