"""Weighted detection scores, tiers and systematic sampling by tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgcurate.operators.ranking import join_in_order, with_position
from imgcurate.session import cut_lineage

HIGH, MEDIUM, LOW, DROP = "high", "medium", "low", "drop"


def weighted_detection_score(images: DataFrame, detections: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight times confidence, and the reportable classes in order of detection.

    ``detections(image_id, det_no, class, score)``; ``weights(class, weight, report)``.
    Unknown classes weigh nothing, and an image without detections scores 0. Terms
    are summed as decimals, so the result does not hang on the order of rows.
    """
    scored = detections.join(weights, "class")
    term = (F.col("weight") * F.col("score")).cast("decimal(28,12)")
    totals = scored.groupBy("image_id").agg(F.sum(term).alias("_sum"))
    parts = join_in_order(scored.filter("report"), ["image_id"], "det_no", "class", ", ", "parts")
    return (
        images.join(totals, "image_id", "left")
        .join(parts, "image_id", "left")
        .withColumn("score", F.coalesce(F.bround("_sum", 2), F.lit(0)).cast("double"))
        .withColumn("parts", F.coalesce("parts", F.lit("")))
        .drop("_sum")
    )


def tier(score: Column | str = "score", high: float = 5.0, medium: float = 2.0, low: float = 0.5) -> Column:
    """The tier of a score; a score on a threshold belongs to the upper tier."""
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s >= high, HIGH).when(s >= medium, MEDIUM).when(s >= low, LOW).otherwise(DROP)
    )


def tiered_sample(
    df: DataFrame,
    high: float = 5.0,
    medium: float = 2.0,
    low: float = 0.5,
    medium_every: int = 3,
    low_every: int = 10,
    order_by: Sequence[str] = ("image_id",),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Mark ``kept``: all high rows, and every k-th medium and low row from the first on."""
    # Read twice below, and scores may come from a model: score once.
    tiered = cut_lineage(df.withColumn("tier", tier("score", high, medium, low)))
    sampled = tiered.filter(F.col("tier").isin(MEDIUM, LOW))
    placed = with_position(sampled, order_by, [*partition_by, "tier"], "_pos", "_n")
    every = F.when(F.col("tier") == MEDIUM, medium_every).otherwise(low_every)
    picked = placed.withColumn("kept", F.col("_pos") % every == 0).drop("_pos", "_n")
    # High and drop rows need no position: they stay out of the sort.
    rest = tiered.filter(F.col("tier").isin(HIGH, DROP)).withColumn("kept", F.col("tier") == HIGH)
    return picked.unionByName(rest)


def tier_summary(sampled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per tier, rows kept, and the summary line."""

    def in_tier(name: str) -> Column:
        return F.count_if(F.col("tier") == name).alias(name)

    counts = sampled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scored"),
        *[in_tier(t) for t in (HIGH, MEDIUM, LOW, DROP)],
        F.count_if("kept").alias("kept"),
    )
    return counts.withColumn(
        "summary",
        F.format_string(
            "Scored %d frames: %d high, %d med, %d low, %d drop → kept %d",
            "scored", HIGH, MEDIUM, LOW, DROP, "kept",
        ),
    )


def tier_log(sampled: DataFrame) -> DataFrame:
    """One line per kept row."""
    shown = F.col("score").cast("decimal(20,2)")
    s = F.bround(shown, 1).cast("string")
    return sampled.filter("kept").withColumn(
        "log_line",
        F.when(F.col("tier") == HIGH, F.concat(F.lit("HIGH "), s, F.lit(" "), "filename", F.lit(" ["), "parts", F.lit("]")))
        .when(F.col("tier") == MEDIUM, F.concat(F.lit("MED  "), s, F.lit(" "), "filename", F.lit(" ["), "parts", F.lit("]")))
        .otherwise(F.concat(F.lit("LOW  "), s, F.lit(" "), "filename")),
    )
