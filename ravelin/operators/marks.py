"""Marks of import cycles and the items queued for them: what may be worked on, what has drained, what came complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.sources.versions import Commit, Conflict, Versions

#: What makes a cycle, and the states in which an item is still to be waited for.
TUPLE = ["cluster_id", "kind", "import_id"]
UNSETTLED = ("pending", "processing")


def _known(queue: DataFrame, clusters: DataFrame) -> DataFrame:
    """Items with the id of the cluster that they name; those of an unknown cluster belong to no mark."""
    return queue.join(clusters.select("cluster_id", "cluster_name"), "cluster_name")


def claimable(queue: DataFrame, marks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pending items of draining marks."""
    return _known(queue.where("status = 'pending'"), clusters).join(marks.where("state = 'draining'").select(*TUPLE), TUPLE, "left_semi")


def drained(marks: DataFrame, queue: DataFrame, clusters: DataFrame) -> DataFrame:
    """Draining marks with no item left to wait for: those whose end may be worked out, again or for the first time."""
    rest = _known(queue.where(F.col("status").isin(*UNSETTLED)), clusters)
    return marks.where("state = 'draining'").join(rest.select(*TUPLE), TUPLE, "left_anti")


def with_complete(marks: DataFrame, queue: DataFrame) -> DataFrame:
    """``marks`` with complete: some item of the import, whatever its kind, came as a complete snapshot."""
    whole = queue.where("complete_snapshot").select("import_id").distinct().withColumn("complete", F.lit(True))
    return marks.join(whole, "import_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def reap_drained(store: Versions, marks: DataFrame, queue: DataFrame, clusters: DataFrame, sweep: str, effect: Callable[[Commit, DataFrame], None], tries: int = 10) -> int:
    """Act on every drained mark that no sweep has acted on, once; the number of the commit, or 0 without such marks.

    ``effect(commit, marks)`` writes to the commit that also puts the marks into the ledger, table ``reaped``. Of sweeps
    that run at once one commit is published; the others see its ledger, find what is left and try again. So a sweep may
    run as often as it likes, and one that breaks off has done nothing.
    """
    for _ in range(tries):
        commit = store.begin()
        left = drained(marks, queue, clusters).select(*TUPLE).distinct()
        if "reaped" in commit.tables:
            left = left.join(commit.read("reaped"), TUPLE, "left_anti")
        else:
            commit.replace("reaped", left.limit(0).withColumn("sweep", F.lit(sweep)), tuple(TUPLE))
        commit.merge("reaped", left.withColumn("sweep", F.lit(sweep)), tuple(TUPLE), lambda old, new: old.unionByName(new))
        if not commit.touched["reaped"]:
            return 0
        effect(commit, commit.read("reaped").where(F.col("sweep") == sweep))
        try:
            return commit.publish()
        except Conflict:
            continue
    raise Conflict(f"{tries} other commits came first")


def flipped(marks: DataFrame, ledger: DataFrame) -> DataFrame:
    """``marks`` with the state that the ledger gives them: a draining one that a sweep has acted on is reaped."""
    done = ledger.select(*TUPLE).withColumn("done_", F.lit(True))
    out = marks.join(done, TUPLE, "left")
    return out.withColumn("state", F.when((F.col("state") == "draining") & F.col("done_"), "reaped").otherwise(F.col("state"))).drop("done_")
