"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """``(doc_id, text, label)``: of each label 0 and 1 at most ``per_class`` ids, in the order of a hash.

    Ids of the held-out fifth take no part, nor do null ids and labels. An id labelled twice
    counts as the larger label; an id with several texts gives the smallest one. What is joined
    by broadcast are two times ``per_class`` ids at most, so only sampled texts leave the scan.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
    )
    ids = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
