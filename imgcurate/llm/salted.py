"""Joins of many rows with one row a key, where a key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salted_lookup(df: DataFrame, found: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``df`` joined with ``found``, which has one row a key; the rows of a key are dealt to ``salts`` by ``spread``.

    Only pairs of key and salt that occur meet ``found``, after partial aggregation, so that no
    join has a key with more than ``salts`` rows or more than its share of ``df``.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = dealt.select(*keys, "_salt").distinct()
    return dealt.join(parts.join(found, list(keys)), [*keys, "_salt"], how).drop("_salt")
