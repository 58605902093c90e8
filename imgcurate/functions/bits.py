"""Bit-vector expressions. A hash is ``words ARRAY<BIGINT>``, 64 bits to a word."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two hashes differ."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")),
        F.lit(0),
        lambda total, n: total + n,
    )


def hamming_of(a: str, b: str, words: int) -> Column:
    """D2 for hashes of a known number of words, without a lambda."""
    return sum(
        (F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w])).cast("int") for w in range(words)), F.lit(0)
    )


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def band_masks(bits: int, threshold: int, level: int) -> list[list[int]]:
    """Bit masks of which two hashes within ``threshold`` agree on at least one.

    The bits are dealt out to ``threshold + level`` bands in turn. Up to
    ``threshold`` differing bits spoil as many bands, so ``level`` bands are equal:
    one mask for every choice of ``level`` bands. A higher level gives more and
    finer masks.
    """
    bands = threshold + level
    words = (bits + 63) // 64
    masks = []
    for chosen in combinations(range(bands), level):
        mask = 0
        for band in chosen:
            mask |= sum(1 << bit for bit in range(band, bits, bands))
        masks.append([_signed((mask >> (64 * w)) & ((1 << 64) - 1)) for w in range(words)])
    return masks


def with_band_keys(rows: DataFrame, bits: int, threshold: int, level: int) -> DataFrame:
    """One row per mask with its ``key``. Unequal bits may share a key: verify matches."""
    masks = band_masks(bits, threshold, level)
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, m)).alias("m")) for i, m in enumerate(masks)])
    masked = [F.col("words")[w].bitwiseAND(F.col("_mask.m")[w]) for w in range(len(masks[0]))]
    return (
        rows.withColumn("_mask", F.explode(table))
        .withColumn("key", F.xxhash64(F.lit(level), "_mask.i", *masked))
        .drop("_mask")
    )
