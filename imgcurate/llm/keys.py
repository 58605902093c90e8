"""Names of documents that hold whatever their ids are."""

from __future__ import annotations

from pyspark.sql import functions as F

KEY = ["id", "tie"]


def document_key() -> list:
    """``id`` and ``tie``: the id, with null before all others, and a hash that tells texts of one id apart.

    Both depend on the row alone, so they survive a task that runs again.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("tie"),
    ]
