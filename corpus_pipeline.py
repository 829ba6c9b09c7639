"""Cleaning of a corpus in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontaminate, piece_codec, pseudonyms, quality_trees, sketch_join
from ravelin.llm.common import cut, removed, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``key_``, a hash of id and text: rows with equal key are equal in both."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key_"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and the forest.

    Each row is judged alone, so repeated rows, ties and null ids need no rule. A null or empty text has no words and
    goes; very long texts are read whole; an empty table stays empty. Columns other than those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    forest = quality_trees.train(docs, table(spark, sf_dir, "labels"))
    return quality_trees.judge(docs, forest).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, similarity 0.8).

    It is the one with the smallest doc_id, null last, then the smallest hash of id and text. Rows are told apart by
    id and text, so a document that shares its id with a copy of another stays, and of rows equal in both one stays.
    Null and empty texts and those without a word belong to no group and all stay. An empty table stays empty.
    """
    keyed = _keyed(docs)
    found = sketch_join.jaccard_components(keyed.select(F.col("key_").alias("doc_id"), "text"), width=5, percent=80).where("n_shingles > 0")
    rows = found.groupBy("doc_id", "component_id").count().withColumnRenamed("doc_id", "key_")
    ids = keyed.groupBy("key_").agg(F.first("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key_"))["key_"]
    rows = cut(rows.join(ids, "key_"))
    marks = rows.join(rows.groupBy("component_id").agg(first.alias("first_")), "component_id").where("key_ <> first_ OR count > 1")
    marked = keyed.join(marks.select("key_", (F.col("key_") == F.col("first_")).alias("stays_")), "key_", "left")
    once = marked.where("stays_").dropDuplicates(["key_"])
    return marked.where("stays_ IS NULL").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a benchmark item.

    Rows are told apart by id and text, so a row goes or stays by its own text, whatever ids repeat or are null. Null,
    empty and short texts hold no passage and stay; an empty table stays empty.
    """
    keyed = _keyed(docs)
    found = decontaminate.find_overlaps(keyed.select(F.col("key_").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("key_")).distinct(), "key_", "left_anti").select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms for personal data; n_chars follows the new text.

    The key comes from the session's settings. Null and empty texts and rows without a find stay as they are; rows are
    independent; an empty table stays empty.
    """
    docs = pseudonyms.pseudonymise(docs.select(*COLUMNS), pseudonyms.session_key(spark))
    return docs.withColumn("n_chars", F.when(F.size("finds") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it (markers as blanks).

    A null or empty text has no ids and is restored as the empty one; rows are independent; an empty table stays empty.
    """
    coded = piece_codec.encode_decode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.translate(F.coalesce("text", F.lit("")), piece_codec.MARK, " ") == F.col("decoded")
    return coded.select("doc_id", "text", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("restored"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("pii", private_data),
    ("sentencepiece", tokens),
]

#: The forest of the first stage is trained, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again, and goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if k:
            removed(spark, f"{top}/{STAGES[k - 1][0]}")
    return docs
