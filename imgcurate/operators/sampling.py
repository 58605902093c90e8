"""Choosing frames from a table ``frames(video, image_id, frame_no, ts, scene_score, is_keyframe, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgcurate.operators.ranking import top_per_group, with_position

ORDER = ("ts", "image_id")


def one_per_interval(df: DataFrame, group: Sequence[str], interval: Column) -> DataFrame:
    """The first row by time of every interval of every group."""
    w = Window.partitionBy(*group, "_interval").orderBy(*ORDER)
    return (
        df.withColumn("_interval", interval)
        .withColumn("_rank", F.row_number().over(w))
        .filter("_rank = 1")
        .drop("_rank", "_interval")
    )


def cap_per_video(frames: DataFrame, n: int | Column | None) -> DataFrame:
    """The first ``n`` frames of each video; None leaves all."""
    return frames if n is None else top_per_group(frames, ["video"], ORDER, n, spread="image_id")


def sample_fps(frames: DataFrame, fps: float = 1.0, max_frames: int | None = None) -> DataFrame:
    """one frame per ``1/fps`` seconds, of a video at most ``max_frames`` if given."""
    if not 0.1 <= fps <= 30:
        raise ValueError("fps must lie in 0.1 to 30")
    ticks = F.floor(F.col("ts") * F.lit(float(fps)))
    return cap_per_video(one_per_interval(frames, ["video"], ticks), max_frames)


# A later pass thins these samples, so they take so many times the cap of a video.
SCENE_FACTOR = 3
KEYFRAME_FACTOR = 2


def sample_scene(
    frames: DataFrame, threshold: float = 0.10, max_frames: int | None = None, factor: int = SCENE_FACTOR
) -> DataFrame:
    """F2: frames whose scene score exceeds the threshold, of a video at most ``factor * max_frames`` if given."""
    most = None if max_frames is None else factor * max_frames
    return cap_per_video(frames.filter(F.col("scene_score") > threshold), most)


def sample_keyframes(frames: DataFrame, max_frames: int | None = None, factor: int = KEYFRAME_FACTOR) -> DataFrame:
    """keyframes, of a video at most ``factor * max_frames`` if given."""
    return cap_per_video(frames.filter("is_keyframe"), None if max_frames is None else factor * max_frames)


def with_fallback(
    chosen: DataFrame, frames: DataFrame, fps: float = 1.0, max_frames: int | None = None
) -> DataFrame:
    """videos of which nothing was chosen are sampled by rate instead."""
    rest = frames.join(chosen.select("video").distinct(), "video", "left_anti")
    return chosen.withColumn("fallback", F.lit(False)).unionByName(
        sample_fps(rest, fps, max_frames).withColumn("fallback", F.lit(True))
    )


def _is_even_pick(pos: Column, n: Column, m: Column) -> Column:
    """Is ``pos`` one of ``int(i * (n / m))`` for i below m?

    The step stays a double: integer arithmetic picks other rows for some n, m.
    """
    step = n.cast("double") / m.cast("double")
    near = F.floor(pos / step)

    def hits(i: Column) -> Column:
        return (i >= 0) & (i < m) & (F.floor(i.cast("double") * step) == pos)

    return (n <= m) | hits(near) | hits(near + 1) | hits(near - 1)


def even_subsample(
    df: DataFrame,
    max_frames: int | Column,
    order: Sequence[str] = ("image_id",),
    group: Sequence[str] = (),
) -> DataFrame:
    """evenly spaced rows when a group has more than ``max_frames``."""
    m = max_frames if isinstance(max_frames, Column) else F.lit(max_frames)
    placed = with_position(df, order, group, "_pos", "_n")
    return placed.filter(_is_even_pick(F.col("_pos"), F.col("_n"), m)).drop("_pos", "_n")


def video_quota(frames: DataFrame, max_frames: int) -> DataFrame:
    """one row with the share of frames each video may bring."""
    return frames.agg(F.count_distinct("video").alias("videos")).select(
        "videos",
        F.when(F.col("videos") <= 1, F.lit(max_frames))
        .otherwise(F.greatest(F.lit(50), F.floor(F.lit(max_frames) / F.col("videos")).cast("int")))
        .alias("quota"),
    )


def per_video_quota(frames: DataFrame, max_frames: int) -> DataFrame:
    """subsample every video to its quota, then all videos together to ``max_frames``."""
    quota = video_quota(frames, max_frames).select("quota").scalar()
    each = even_subsample(frames, quota, ORDER, ["video"])
    return even_subsample(each, max_frames, ("video", *ORDER))


def frame_name(video: Column | str, frame_no: Column | str) -> Column:
    """``<video>_frame_NNNNNN.jpg``."""
    return F.format_string("%s_frame_%06d.jpg", video, frame_no)


# Split at the last "_frame_" with something before it; the rest must be a whole number.
_FRAME_NAME = r"(?s)^(.+)_frame_([+-]?[0-9]+)(?:\.jpg)*$"


def parse_frame_name(df: DataFrame, name: str = "filename") -> DataFrame:
    """add ``video`` and ``frame_no``, null where the name has another form."""
    number = F.regexp_extract(name, _FRAME_NAME, 2)
    return df.withColumns(
        {
            "video": F.nullif(F.regexp_extract(name, _FRAME_NAME, 1), F.lit("")),
            "frame_no": F.nullif(number, F.lit("")).try_cast("bigint"),
        }
    )


def extraction_summary(extracted: DataFrame, kept: DataFrame) -> DataFrame:
    """F8: frames extracted and kept, per video and in all (``video`` is null there)."""
    marks = extracted.select("video", F.lit(0).alias("kept")).unionByName(
        kept.select("video", F.lit(1).alias("kept"))
    )
    return marks.rollup("video").agg(
        F.count_if(F.col("kept") == 0).alias("extracted"),
        F.count_if(F.col("kept") == 1).alias("kept"),
    )


def normalize_to_first(df: DataFrame, order: str = "image_id") -> DataFrame:
    """every row gets the size of the first row as its target."""
    first = df.agg(F.min_by(F.struct("width", "height"), order).alias("size"))
    size = first.select("size").scalar()
    return (
        df.withColumn("_size", size)
        .withColumns({"target_w": F.col("_size.width"), "target_h": F.col("_size.height")})
        .withColumn(
            "needs_resize",
            (F.col("width") != F.col("target_w")) | (F.col("height") != F.col("target_h")),
        )
        .drop("_size")
    )


def min_size_filter(df: DataFrame, min_size: int = 256) -> DataFrame:
    """drop small and unreadable pictures."""
    return df.filter(F.least("width", "height") >= min_size).filter("width is not null and height is not null")
