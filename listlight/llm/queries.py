"""The numbered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, hard_negatives, html, knn, lm, mixing, oracles, quality, rules, secrets, toxicity, whitening
from .near_dup import near_duplicates
from .textbuf import held_out

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~out))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(_table(spark, sf_dir, "documents"), VOCABULARY, keep=["doc_id"], decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    model = quality.train(docs, _table(spark, sf_dir, "labels").where(~out))
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(rules.measure(_table(spark, sf_dir, "documents"), keep=["doc_id"]))
    judged = rules.apply_policy(book)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits", rules.only_rule().alias("only_rule"))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8's ledger: what each rule of each policy drops, and drops alone."""
    book = rules.ledger(rules.measure(_table(spark, sf_dir, "documents"), keep=["doc_id"])).select("failed_bits")
    return rules.ablation(book, *rules.POLICIES)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background: all documents. Target: the benchmark's passages. A low score is like the benchmark."""
    docs = _table(spark, sf_dir, "documents")
    model = lm.train(docs, _table(spark, sf_dir, "benchmark"))
    scores = lm.score(docs, model, keep=["doc_id"])
    model.drop()
    return scores


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, keep=["doc_id"], packed=True, decode=True)
    count = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", count, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_knn": op4_knn,
    "op5_quality": op5_quality,
    "op6_html": op6_html,
    "op7_near_dup": op7_near_dup,
    "op8_rules": op8_rules,
    "op9_lm": op9_lm,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
    "rules_ablation": rules_ablation,
}

ORACLES: dict[str, str] = {
    "op7_near_dup": oracles.NEAR_DUP,
    "op8_rules": oracles.RULES,
    "rules_ablation": oracles.ABLATION,
    "op4_knn": oracles.KNN,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
}
