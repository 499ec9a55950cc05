"""Documents to training tokens: five operators in a row, each on what its predecessor kept.

Every stage takes whole texts of any length, null and empty ones, rows without a doc_id, repeated rows, empty tables and further
columns of whatever name, and says below what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listlight.llm import bpe, mixing, secrets, toxicity
from listlight.llm.near_dup import near_duplicates
from listlight.llm.queries import VOCABULARY
from listlight.llm.shared import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, finds toxic go.

    Null and empty texts are scored like others. Each row is judged by its own text, repeated ones alike; a score on the threshold is toxic. Where
    no label says toxic nothing goes. An empty table stays empty.
    """
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays: the one with the smallest doc_id, so there are no ties.

    Texts without words are like nothing and stay, as do rows without a doc_id. Rows that share a doc_id are one document and stay or go together.
    """
    gone = near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text gives way to its kind in brackets, and n_chars follows.

    Where secrets overlap, one bracket stands for all of them. Null texts stay null; texts without secrets and their n_chars stay as they are.
    """
    found = secrets.scan(docs, keep=[c for c in docs.columns if c != "text"], redact=True).withColumnRenamed("redacted", "text")
    changed = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return found.withColumn("n_chars", changed).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, at most twice.

    A null source is a source like others, the last. Documents without words add none; they are taken as often as their source's target holds it, in whole
    times. Rows that share a doc_id are drawn alike, so ties of the draw fall together.
    """
    return mixing.repeated(mixing.mix(docs), docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and the text that the ids decode to. Null and empty texts have no ids and decode to the empty string."""
    decoded = bpe.encode(docs, VOCABULARY, keep=["doc_id", "source"], decoded=True)
    return decoded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None  # trained scores and hashes have no SQL; tests/llm checks the stages by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
