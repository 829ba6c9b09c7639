"""The pipeline, stage by stage against plain versions, and the contract queries."""

import corpus_pipeline as P
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ravelin.llm import chat_format, decontaminate, pseudonyms, quality_trees
from tests.llm import cases

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    kept = P.quality(spark, docs, D).cache()
    verdicts = {r.doc_id: r.kept for r in quality_trees.judge(docs, quality_trees.train(docs, labels)).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, v in verdicts.items() if v}
    good = {r.doc_id for r in labels.where("quality = 1").collect() if verdicts[r.doc_id]}
    assert len(good) > 0.9 * labels.where("quality = 1").count() - 10

    single = P.near_duplicates(spark, kept, D).cache()
    brute = cases.jaccard([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {k for k, (_, c) in brute.items() if c == k}

    clean = P.benchmark(spark, single, D).cache()
    dirty = {r.doc_id for r in decontaminate.find_overlaps(single, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - dirty

    hidden = P.private_data(spark, clean, D).cache()
    finds = {r.doc_id: r.finds for r in pseudonyms.pseudonymise(clean, pseudonyms.session_key(spark)).collect()}
    for r in hidden.collect():
        assert all(f.value not in r.text for f in finds[r.doc_id] if f.kind in ("card", "email", "secret"))
    assert hidden.columns == list(P.COLUMNS) and hidden.count() == clean.count()

    coded = P.tokens(spark, hidden, D)
    assert coded.where("NOT restored").count() == 0 and coded.count() == hidden.count()
    ran = {(r.doc_id, r.text, tuple(r.ids)) for r in P.run(spark, D).collect()}
    assert ran == {(r.doc_id, r.text, tuple(r.ids)) for r in coded.collect()}


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_bear_odd_rows(spark, stage):
    rows = spark.createDataFrame(cases.odd_rows(), cases.SCHEMA)
    out = stage(spark, cases.crowded(rows), D)
    if stage is P.quality:
        assert {r.doc_id for r in out.collect()} <= {6, 7, 8}
    else:
        assert {r.doc_id for r in out.collect()} >= {None, 1, 2, 3, 4}
    assert stage(spark, rows.limit(0), D).count() == 0


def test_repeated_and_null_ids(spark):
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").first().text
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    row = lambda i, t, source="s": (i, t, "en", source, len(t))
    rows = [row(1, a), row(2, a), row(2, b), row(3, c), row(3, c, "t"), row(None, a + " more"), row(None, item), row(5, "clean " + b[::-1]), row(5, item + " tail"), row(6, ""), row(6, "")]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    kept = sorted((r.doc_id or 0, r.text) for r in P.near_duplicates(spark, docs, D).collect())
    assert kept == sorted([(1, a), (2, b), (3, c), (5, rows[7][1]), (5, item + " tail"), (6, ""), (6, "")])
    clean = sorted((r.doc_id or 0, r.text) for r in P.benchmark(spark, docs, D).collect())
    assert clean == sorted((r[0] or 0, r[1]) for r in rows if item not in r[1])


def test_a_sample_of_labelled_rows_is_bounded(spark):
    from ravelin.llm.common import bounded, labelled_sample

    docs = spark.range(6000).select(F.when(F.col("id") < 5000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3000).alias("text"))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    assert bounded(labelled_sample(docs, labels, "quality", 1000), 10).count() == 10
    assert bounded(labelled_sample(docs, labels.where("doc_id = 7"), "quality", 10), 4000).count() == 3000


def test_chat_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{D}/conversations.parquet'")
    found = chat_format.op5_chat_format(spark, D)
    rows = con.execute(chat_format.OP5_SQL).df()[found.columns]
    assert sorted(map(repr, rows.itertuples(index=False, name=None))) == sorted(map(repr, found.toPandas().itertuples(index=False, name=None)))


def test_all_operators_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
