"""Time ranges around high-value frames, and denser frames inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgcurate.functions.arith import floor_div
from imgcurate.operators.dedup import dedup_first_wins
from imgcurate.operators.ranking import with_position
from imgcurate.operators.sampling import one_per_interval


def select_high(frames: DataFrame) -> DataFrame:
    """Frames of the high tier that have a number; if there is none anywhere, every frame that has one."""
    usable = frames.filter("video is not null and frame_no is not null")
    any_high = usable.select(F.max(F.col("tier") == "high").alias("any")).scalar()
    return usable.filter(
        F.when(F.coalesce(any_high, F.lit(False)), F.col("tier") == "high").otherwise(True)
    )


def _number_in_video(clusters: DataFrame, start: str, block: int) -> DataFrame:
    """Add ``cluster_id``: 0-based rank of ``start`` in the video, block by block."""
    blocked = clusters.withColumn("_block", floor_div(start, block))
    before = Window.partitionBy("video").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("video", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("video", "_block").orderBy(start)
    return (
        blocked.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["video", "_block"])
        .withColumn("cluster_id", F.col("_offset") + F.col("_rank"))
        .drop("_block", "_rank", "_offset")
    )


def _islands(rows: DataFrame, group: list[str], max_gap: int) -> DataFrame:
    """Merge ``(lo, hi)`` stretches of a group whose gap is at most ``max_gap``."""
    ordered = Window.partitionBy(*group).orderBy("lo")
    opens = F.coalesce(F.col("lo") - F.lag("hi").over(ordered) > max_gap, F.lit(True))
    return (
        rows.withColumn("_opens", opens.cast("int"))
        .withColumn("_island", F.sum("_opens").over(ordered))
        .groupBy(*group, "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def cluster_ranges(frames: DataFrame, max_gap: int = 10, padding: int = 5, block: int = 65536) -> DataFrame:
    """R2: ``ranges(video, cluster_id, start_no, end_no, start_s, end_s)``.

    Frame numbers more than ``max_gap`` apart start a new cluster; padded ranges
    may overlap. Clusters are built inside blocks of frame numbers; only those at
    the edge of a block can go on in the next one, and just these are merged over
    the whole video, at most two per block.
    """
    # One shuffle, by video and block, serves the distinct and the windows.
    blocked = (
        frames.select(
            "video",
            floor_div("frame_no", block).alias("_block"),
            F.col("frame_no").alias("lo"),
        )
        .repartition("video", "_block")
        .distinct()
        .withColumn("hi", F.col("lo"))
    )
    local = _islands(blocked, ["video", "_block"], max_gap)
    at_edge = (F.col("lo") - F.col("_block") * block <= max_gap) | (
        (F.col("_block") + 1) * block - F.col("hi") <= max_gap
    )
    merged = _islands(local.filter(at_edge), ["video"], max_gap)
    clusters = local.filter(~at_edge).select("video", "lo", "hi").unionByName(merged)
    return _number_in_video(clusters, "lo", block).select(
        "video",
        "cluster_id",
        F.col("lo").alias("start_no"),
        F.col("hi").alias("end_no"),
        F.greatest(F.lit(0), F.col("lo") - padding).alias("start_s"),
        (F.col("hi") + padding).alias("end_s"),
    )


def frames_in_ranges(source: DataFrame, ranges: DataFrame, bin_seconds: int = 60) -> DataFrame:
    """Pair source frames with every range of their video they lie in.

    Both sides are cut into bins of time, so a long video is joined bin by bin.
    """
    width = F.lit(bin_seconds)
    last = F.greatest(F.floor(F.col("start_s") / width), F.ceil(F.col("end_s") / width) - 1)
    binned = ranges.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("start_s") / width), last))
    )
    frames = source.withColumn("_bin", F.floor(F.col("ts") / width))
    return (
        frames.join(binned, ["video", "_bin"])
        .filter((F.col("ts") >= F.col("start_s")) & (F.col("ts") < F.col("end_s")))
        .drop("_bin")
    )


def _in_range_tick(dense_fps: float) -> Column:
    return F.floor((F.col("ts") - F.col("start_s")) * F.lit(float(dense_fps)))


def dense_resample(
    source: DataFrame,
    ranges: DataFrame,
    dense_fps: float = 5.0,
    dedup_threshold: int = 6,
    bits: int = 256,
    bin_seconds: int = 60,
) -> DataFrame:
    """Frames inside the ranges at ``dense_fps``, named by cluster and tick.

    With ``words`` in the source and a threshold above 0, near copies among the
    dense frames are dropped (D6); originals are not looked at.
    """
    paired = frames_in_ranges(source, ranges, bin_seconds).withColumn("tick", _in_range_tick(dense_fps))
    dense = one_per_interval(paired, ["video", "cluster_id"], F.col("tick")).withColumn(
        "filename",
        F.format_string(
            "%s_dense_d%02d_d%02d_%06d.jpg", "video", "cluster_id", "cluster_id", F.col("tick") + 1
        ),
    )
    if "words" not in source.columns or dedup_threshold <= 0:
        return dense
    return dedup_new_only(dense, dedup_threshold, bits)


def dedup_new_only(dense: DataFrame, threshold: int = 6, bits: int = 256) -> DataFrame:
    """Dense frames that are no near copy of an earlier dense frame of any video.

    The order is video, cluster, tick. A source frame may occur in two ranges, so
    occurrences get ids of their own. Threshold 0 leaves all frames.
    """
    if threshold <= 0:
        return dense
    keys = ["video", "cluster_id", "tick"]
    named = dense.withColumnRenamed("image_id", "_source")
    placed = with_position(named, keys, position="image_id", total="_n")
    kept = dedup_first_wins(placed, threshold, bits).filter("not is_duplicate").drop("image_id")
    return kept.withColumnRenamed("_source", "image_id").select(*dense.columns)


def combine(originals: DataFrame, dense: DataFrame) -> DataFrame:
    """Originals and dense frames together, told apart by ``origin``."""
    return originals.withColumn("origin", F.lit("original")).unionByName(
        dense.withColumn("origin", F.lit("dense")), allowMissingColumns=True
    )


def missing_source(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Videos that are wanted but have no source."""
    return wanted.select("video").distinct().join(catalog, "video", "left_anti")
