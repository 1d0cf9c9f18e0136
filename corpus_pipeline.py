"""A corpus pipeline of five stages, each one operator of tallyforge.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup, mixing, sentencepiece_dropout, simhash, toxicity
from tallyforge.llm.common import WORD, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5.

    Null and empty texts get the score of a text without words. Rows of equal ids go or stay by each one's own text, and
    repeated rows alike. An empty table stays empty. Extra columns are dropped, whatever their names.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, model).select(*COLUMNS)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with earlier ones; one of which nothing is left goes.

    Rows with a null id or text stay as they are, empty texts too. Of equal texts the smallest id keeps its lines; rows of
    equal ids don't take lines from each other. An empty table stays empty. Extra columns are dropped.
    """
    found = line_dedup.dedup(docs.select(*COLUMNS))
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that are alike: 0.8 or more of their shingles of five words.

    Texts without a word, null ones included, are one group. Rows that repeat both id and text are one document. Rows
    without an id can't be named by a group: they stay. An empty table stays empty. Extra columns are dropped.
    """
    first = simhash.near_dedup(docs, words=5, similarity=0.8).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    return named.dropDuplicates(["doc_id", "_text"]).select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each epoch that takes it whole, and once cut after the words that the last one takes.

    Documents without a word have no weight in a mix: they stay once. Rows of equal id, source and size share what the
    mix takes of them evenly. A null source is a source of its own. An empty table stays empty; extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.floor(F.sum("taken") / F.count(F.lit(1))).alias("taken"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "size", "taken")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("size"))
    rows = docs.withColumn("_size", size).join(taken, same)
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size"))).cast("int")
    rest = F.when(F.col("size") == 0, 0).otherwise(F.col("taken") % F.col("size"))
    times = F.concat(F.array_repeat(F.lit(None).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("_words", F.explode(times))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("_words").isNull(), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), ""))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with what tells that they decode to its text; null and empty texts have none."""
    return sentencepiece_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", lines_once),
    ("simhash_near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("sentencepiece", tokens),
]

#: SQL can't express the stages; tests/llm holds each one against a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
