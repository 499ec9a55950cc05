"""Bounded samples of labelled documents on which classifiers are fitted, and calibration on all the others."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000  # ids (8 MB) up to which labelled documents are found by a broadcast
STEPS, MOST = 64, 30.0  # bins of a unit of logits, and the largest logit told apart


def _usable(labels: DataFrame, label: str) -> DataFrame:
    of_class = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return of_class.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))


def unseen_logits(docs: DataFrame, labels: DataFrame, label: str, fitted: list[int], logits: Callable[[DataFrame], DataFrame]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group: (logits in ascending order, documents of class 0 and of class 1 there), over all labelled documents, of any length, but the fitted ones.

    logits maps (doc_id, text) to (doc_id, group, logit). What reaches the driver is a histogram: for each group
    and class a row for each of 2 * STEPS * MOST bins at most.
    """
    seen = docs.sparkSession.createDataFrame([(int(i),) for i in fitted], "doc_id long")  # of a bounded sample
    usable = _usable(labels, label).join(F.broadcast(seen), "doc_id", "left_anti")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if usable.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(usable.select("doc_id")), "doc_id", "left_semi")
    at = F.round(F.greatest(F.least("logit", F.lit(MOST)), F.lit(-MOST)) * STEPS).cast("int").alias("bin")
    rows = logits(texts).join(usable, "doc_id").groupBy("group", at).agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))
    out: dict[int, list] = {}
    for r in rows.collect():
        out.setdefault(r["group"], []).append((r["bin"] / STEPS, r["zeros"], r["ones"]))
    return {g: tuple(np.array(x) for x in zip(*sorted(x))) for g, x in out.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, max_chars: int) -> DataFrame:
    """doc_id, text, label: at most per_class documents of each class, of at most max_chars characters each.

    They are the first by a hash of doc_id, so that reruns agree. Labels that are null or neither 0 nor 1
    are left out; a document labelled twice has the larger label. per_class bounds the ids that are
    broadcast, and per_class * max_chars the text that reaches the driver.
    """
    usable = _usable(labels, label)
    lengths = docs.where(F.length("text") <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id"))
    usable = usable.join(lengths.distinct(), "doc_id", "left_semi")
    first = [usable.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))
    texts = docs.where(F.length("text") <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(chosen, "doc_id").select("doc_id", "text", "label")
