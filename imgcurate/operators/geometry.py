"""Crop, correction and resize geometry as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACKS = ("keep_original", "center_crop", "skip")
RESIZE_MODES = ("resize", "pad", "crop_center", "longest_side")


def _int(value: Column) -> Column:
    """Cut the fraction off, towards zero."""
    return value.cast("int")


def _half(value: Column) -> Column:
    """Half, rounded down also below zero."""
    return F.floor(value / F.lit(2)).cast("int")


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def crop_box(df: DataFrame, padding_pct: int = 5, square: bool = True, bbox: str = "bbox") -> DataFrame:
    """``crop`` box of a percent box (0 to 100), padded, and squared if asked.

    The square may fall short when the picture is too small. A box without area
    gives the whole picture.
    """
    w, h = F.col("width"), F.col("height")

    def edge(size: Column, i: int) -> Column:
        return _int(size * F.get(bbox, F.lit(i)).cast("double") / 100)

    df = df.withColumns({"_x1": edge(w, 0), "_y1": edge(h, 1), "_x2": edge(w, 2), "_y2": edge(h, 3)})
    x1, y1, x2, y2 = (F.col(c) for c in ("_x1", "_y1", "_x2", "_y2"))
    pad_x = _int((x2 - x1) * F.lit(padding_pct) / 100)
    pad_y = _int((y2 - y1) * F.lit(padding_pct) / 100)
    df = df.withColumn("_empty", (x2 <= x1) | (y2 <= y1)).withColumns(
        {
            "_x1": F.greatest(F.lit(0), x1 - pad_x),
            "_y1": F.greatest(F.lit(0), y1 - pad_y),
            "_x2": F.least(w, x2 + pad_x),
            "_y2": F.least(h, y2 + pad_y),
        }
    )
    if square:
        df = df.withColumns({"_cw": x2 - x1, "_ch": y2 - y1})
        cw, ch = F.col("_cw"), F.col("_ch")

        def grow(near: Column, far: Column, limit: Column, side: Column, other: Column):
            """Grow the edges (near, far) of length ``other`` to length ``side``."""
            start = F.greatest(F.lit(0), near - _half(side - other))
            end = F.least(limit, start + side)
            return F.when(end - start < side, F.greatest(F.lit(0), end - side)).otherwise(start), end

        top, bottom = grow(y1, y2, h, cw, ch)
        left, right = grow(x1, x2, w, ch, cw)
        df = df.withColumns(
            {
                "_x1": F.when(ch > cw, left).otherwise(x1),
                "_x2": F.when(ch > cw, right).otherwise(x2),
                "_y1": F.when(cw > ch, top).otherwise(y1),
                "_y2": F.when(cw > ch, bottom).otherwise(y2),
            }
        )
    whole = _box(F.lit(0), F.lit(0), w, h)
    return df.withColumn("crop", F.when(F.col("_empty"), whole).otherwise(_box(x1, y1, x2, y2))).drop(
        "_x1", "_y1", "_x2", "_y2", "_empty", "_cw", "_ch"
    )


def smart_crop(
    df: DataFrame,
    padding_pct: int = 5,
    square: bool = True,
    fallback: str = "keep_original",
    bbox: str = "bbox",
) -> DataFrame:
    """Crop to the box where there is one of four numbers, else fall back."""
    if fallback not in FALLBACKS:
        raise ValueError(f"fallback must be one of {FALLBACKS}")
    w, h = F.col("width"), F.col("height")
    usable = F.coalesce(
        (F.size(bbox) == 4) & ~F.exists(bbox, lambda v: v.cast("double").isNull()), F.lit(False)
    )
    df = crop_box(df.withColumn("has_bbox", usable), padding_pct, square, bbox)
    if fallback == "skip":
        return df.filter("has_bbox")
    if fallback == "center_crop":
        side = F.least(w, h)
        left, top = _half(w - side), _half(h - side)
        instead = _box(left, top, left + side, top + side)
    else:
        instead = _box(F.lit(0), F.lit(0), w, h)
    return df.withColumn("crop", F.when(F.col("has_bbox"), F.col("crop")).otherwise(instead))


def correction_params(
    df: DataFrame, brightness: bool = True, contrast: bool = True, sharpness: bool = True
) -> DataFrame:
    """Factors to apply, null where there is nothing to do.

    ``unsharp_percent`` has only two values, 10 below a sharpness of 2 and 150
    from there on; ``soften`` is for a sharpness below 1.
    """

    def asked(name: str, on: bool) -> Column:
        return F.coalesce(F.col(f"corrections.{name}").cast("double"), F.lit(1.0)) if on else F.lit(1.0)

    def clamped(v: Column) -> Column:
        return F.greatest(F.lit(0.5), F.least(F.lit(1.5), v))

    b, c, s = asked("brightness", brightness), asked("contrast", contrast), asked("sharpness", sharpness)

    def acts(v: Column) -> Column:
        return F.abs(v - 1.0) > 0.01

    percent = F.greatest(F.lit(10), F.least(F.lit(300), _int(F.least(s, F.lit(2.0)) - 1.0) * 150))
    return df.withColumns(
        {
            "brightness": F.when(acts(b), clamped(b)),
            "contrast": F.when(acts(c), clamped(c)),
            "unsharp_percent": F.when(acts(s) & (s > 1.0), percent),
            "soften": F.when(acts(s) & (s <= 1.0), F.greatest(F.lit(0.3), s)),
        }
    )


_EDGES = ("crop_left_pct", "crop_top_pct", "crop_right_pct", "crop_bottom_pct")


def edge_crop(df: DataFrame, crop: bool = True) -> DataFrame:
    """``crop`` box after cutting percents off the edges, if more than 64 pixels remain each way."""
    w, h = F.col("width"), F.col("height")
    if not crop:
        return df.withColumn("crop", _box(F.lit(0), F.lit(0), w, h))

    def cut(size: Column, name: str) -> Column:
        return _int(size * F.coalesce(F.col(f"corrections.{name}").cast("double"), F.lit(0.0)) / 100)

    left, top, right, bottom = (cut(s, n) for s, n in zip((w, h, w, h), _EDGES))
    does = (left + right + top + bottom > 0) & (w - left - right > 64) & (h - top - bottom > 64)
    return df.withColumn(
        "crop",
        F.when(does, _box(left, top, w - right, h - bottom)).otherwise(_box(F.lit(0), F.lit(0), w, h)),
    )


def correction_log(
    df: DataFrame, brightness: bool = True, contrast: bool = True, sharpness: bool = True, crop: bool = True
) -> DataFrame:
    """What was asked for, as text."""

    def two_places(name: str, label: str, on: bool) -> Column:
        v = F.col(f"corrections.{name}").cast("double") if on else F.lit(None).cast("double")
        return F.when(v != 1.0, F.concat(F.lit(label), v.cast("decimal(20,2)").cast("string")))

    parts = [
        two_places("brightness", "bright=", brightness),
        two_places("contrast", "contrast=", contrast),
        two_places("sharpness", "sharp=", sharpness),
    ]
    if crop:
        total = sum((F.coalesce(F.col(f"corrections.{n}").cast("double"), F.lit(0.0)) for n in _EDGES), F.lit(0.0))
        parts.append(F.when(total > 0, F.concat(F.lit("crop="), F.bround(total, 0).cast("bigint").cast("string"), F.lit("%"))))
    text = F.concat_ws(", ", *parts)
    return df.withColumn("log_line", F.when(text == "", F.lit("No corrections needed")).otherwise(text))


def auto_correct(
    df: DataFrame, brightness: bool = True, contrast: bool = True, sharpness: bool = True, crop: bool = True
) -> DataFrame:
    """P3, P4, P6 together."""
    df = correction_params(df, brightness, contrast, sharpness)
    return correction_log(edge_crop(df, crop), brightness, contrast, sharpness, crop)


def fit_within(width: Column, height: Column, max_size: int) -> tuple[Column, Column]:
    """Size scaled down so that the longer side is at most ``max_size``."""
    longest = F.greatest(width, height)
    ratio = F.lit(float(max_size)) / longest
    return (
        F.when(longest > max_size, _int(width * ratio)).otherwise(width),
        F.when(longest > max_size, _int(height * ratio)).otherwise(height),
    )


def resize(df: DataFrame, target_size: int = 1024, mode: str = "resize", strict: bool = True) -> DataFrame:
    """P5: ``scaled_w/h`` after resampling, offset of the picture, and ``out_w/h``.

    ``offset_x/y`` is where the picture lies on the canvas (pad, positive) or where
    the canvas lies in the picture (crop, negative).
    """
    w, h = F.col("width"), F.col("height")
    t = F.lit(target_size)
    zero = F.lit(0)
    if mode not in RESIZE_MODES:
        if strict:
            raise ValueError(f"mode must be one of {RESIZE_MODES}")
        return df.withColumns(
            {"scaled_w": w, "scaled_h": h, "offset_x": zero, "offset_y": zero, "out_w": w, "out_h": h}
        )
    if mode == "resize":
        return df.withColumns(
            {"scaled_w": t, "scaled_h": t, "offset_x": zero, "offset_y": zero, "out_w": t, "out_h": t}
        )
    side = F.least(w, h) if mode == "crop_center" else F.greatest(w, h)
    ratio = F.lit(float(target_size)) / side
    new_w, new_h = _int(w * ratio), _int(h * ratio)
    if mode == "longest_side":

        def to_64(v: Column) -> Column:
            return F.greatest(F.lit(64), (F.floor(v / F.lit(64)) * 64).cast("int"))

        return df.withColumns(
            {
                "scaled_w": to_64(new_w),
                "scaled_h": to_64(new_h),
                "offset_x": zero,
                "offset_y": zero,
                "out_w": to_64(new_w),
                "out_h": to_64(new_h),
            }
        )
    shift = (lambda v: _half(t - v)) if mode == "pad" else (lambda v: -_half(v - t))
    return df.withColumns(
        {
            "scaled_w": new_w,
            "scaled_h": new_h,
            "offset_x": shift(new_w),
            "offset_y": shift(new_h),
            "out_w": t,
            "out_h": t,
        }
    )
