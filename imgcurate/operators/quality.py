"""Local technical quality: expressions over gray statistics of a picture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sharpness_score(lap_var: Column) -> Column:
    """Q2: full marks from a Laplacian variance of 500 on."""
    return F.least(lap_var / 500.0, F.lit(1.0)) * 100


def brightness_score(mean: Column) -> Column:
    """Q3: very dark and very bright pictures lose up to half and more."""
    return (
        F.when(mean < 30, mean / 30.0 * 50)
        .when(mean > 230, (F.lit(255) - mean) / 25.0 * 50)
        .otherwise(F.lit(100.0))
    )


def contrast_score(std: Column) -> Column:
    """Q4: full marks from a deviation of 60 on."""
    return F.least(std / 60.0, F.lit(1.0)) * 100


def size_score(min_dim: Column, min_size: int = 256) -> Column:
    """Q5: share of the wanted size of the shorter side."""
    return F.least(min_dim / F.lit(float(min_size)), F.lit(1.0)) * 100


def quality_score(stats: DataFrame, min_size: int = 256) -> DataFrame:
    """Q6: add ``score`` (0 to 100, one decimal) and ``details``.

    ``stats`` has ``gray_mean, gray_std, lap_var, width, height``.
    """
    min_dim = F.least("width", "height")
    sharp = sharpness_score(F.col("lap_var"))
    bright = brightness_score(F.col("gray_mean"))
    contrast = contrast_score(F.col("gray_std"))
    size = size_score(min_dim, min_size)
    score = sharp * 0.35 + bright * 0.20 + contrast * 0.20 + size * 0.25
    return stats.withColumns(
        {
            "score": F.bround(score, 1),
            "details": F.struct(
                F.bround("lap_var", 1).alias("sharpness"),
                F.bround("gray_mean", 1).alias("brightness"),
                F.bround("gray_std", 1).alias("contrast"),
                F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")).alias("size"),
                min_dim.alias("min_dim"),
                F.struct(
                    F.bround(sharp, 1).alias("sharpness"),
                    F.bround(bright, 1).alias("brightness"),
                    F.bround(contrast, 1).alias("contrast"),
                    F.bround(size, 1).alias("size"),
                ).alias("subscores"),
            ),
        }
    )


def quality_split(stats: DataFrame, min_score: float = 30.0, min_size: int = 256) -> DataFrame:
    """Q7: ``passed`` where the rounded score reaches ``min_score``, and a log line."""
    scored = stats if "score" in stats.columns else quality_score(stats, min_size)
    text = F.col("score").cast("decimal(10,1)").cast("string")
    return scored.withColumn("passed", F.col("score") >= min_score).withColumn(
        "log_line",
        F.concat(
            F.when(F.col("passed"), F.lit("PASS ")).otherwise(F.lit("FAIL ")),
            "filename",
            F.lit(": "),
            text,
            F.lit("/100 — "),
            F.col("width").cast("string"),
            F.lit("x"),
            F.col("height").cast("string"),
        ),
    )


def score_distribution(df: DataFrame, col: str = "score", low: float = 0.0, high: float = 100.0, bins: int = 20) -> DataFrame:
    """Q8: histogram of a score, with the share of rows at or above each bin."""
    width = (high - low) / bins
    inner = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(col) - low) / width)))
    counts = df.filter(F.col(col).isNotNull()).groupBy(inner.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(low) + F.col("bin") * width).alias("from_score"), "n")


def score_sketches(df: DataFrame, by: Sequence[str], col: str = "score", k: int = 200) -> DataFrame:
    """Q8: a sketch of the scores of each group, a few kilobytes whatever its rows; null scores do not count.

    Sketches of days, say, can be stored and merged later without the scores. A larger ``k`` is more exact.
    """
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(col).cast("double"), k).alias("sketch"))


def score_quantiles(sketches: DataFrame, by: Sequence[str] = (), shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Q8: ``(*by, share, quantile)`` of merged sketches, for choosing a threshold.

    With the usual ``k`` about a hundredth of the rows, seldom more, lie between a quantile and the true one.
    A group without scores has null quantiles.
    """
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    some = F.when(F.kll_sketch_get_n_double("sketch") > 0, F.col("sketch"))
    ranks = F.array(*[F.lit(float(s)) for s in shares])
    found = merged.select(*by, F.kll_sketch_get_quantile_double(some, ranks).alias("_found"), F.posexplode(ranks).alias("_at", "share"))
    return found.select(*by, "share", F.get("_found", F.col("_at")).alias("quantile"))
