"""Jobs over pixel bytes: ``pixels(image_id, height, width, n_channels, data)``.

Only these jobs read ``data``. They take a picture at a time out of an Arrow batch
and hand on narrow columns, so pictures are never sorted, grouped or joined by
content. For large pictures set ``spark.sql.execution.arrow.maxRecordsPerBatch`` to
about 64.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgcurate.functions.kernels import (
    EQUAL_FREQUENCIES,
    as_array,
    brighten,
    encode_png,
    phash,
    pixel_stats,
    resample,
    soften,
    stretch_contrast,
    unsharp,
)
from imgcurate.operators.geometry import fit_within

PIXELS = ("height", "width", "n_channels", "data")


def _kernel(fn: Callable, returns: str) -> Callable[..., Column]:
    """An Arrow function that the optimizer neither copies nor moves.

    A filter on its result would else be pushed below it, and every picture be
    worked on twice.
    """
    return F.arrow_udf(fn, returns).asNondeterministic()


def _pictures(batch: pa.StructArray | pa.RecordBatch) -> Iterator[np.ndarray]:
    """The pictures of a batch one by one; what else of the batch is unpacked is narrow."""
    height, width, channels, data = (batch.field(c) if isinstance(batch, pa.StructArray) else batch.column(c) for c in PIXELS)
    for h, w, c, d in zip(height.to_pylist(), width.to_pylist(), channels.to_pylist(), data):
        yield as_array(d.as_buffer(), h, w, c)


def _struct(rows: list[tuple], **columns: pa.DataType) -> pa.StructArray:
    """Rows as a column of structs."""
    made = zip(*rows) if rows else ((),) * len(columns)
    return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(made, columns.values())], names=list(columns))


def with_pixel_stats(pixels: DataFrame) -> DataFrame:
    """Q1-Q4: replace the bytes by ``gray_mean, gray_std, lap_var``."""

    def stats(batch: pa.Array) -> pa.Array:
        return _struct([pixel_stats(p) for p in _pictures(batch)], gray_mean=pa.float64(), gray_std=pa.float64(), lap_var=pa.float64())

    return pixels.withColumn("_s", _kernel(stats, "gray_mean double, gray_std double, lap_var double")(F.struct(*PIXELS))).select(
        *[c for c in pixels.columns if c != "data"], "_s.gray_mean", "_s.gray_std", "_s.lap_var"
    )


def with_phash(pixels: DataFrame, hash_size: int = 16, equal: float = EQUAL_FREQUENCIES) -> DataFrame:
    """Replace the bytes by ``words``, the perceptual hash of ``hash_size**2`` bits.

    With ``equal`` of 0 the rounding of sums decides whether a frequency that equals the median is above it.
    """
    if hash_size not in (8, 16, 24, 32):
        raise ValueError("hash_size must be 8, 16, 24 or 32")

    def words(batch: pa.Array) -> pa.Array:
        return pa.array([phash(p, hash_size, equal) for p in _pictures(batch)], pa.list_(pa.int64()))

    return pixels.withColumn("words", _kernel(words, "array<bigint>")(F.struct(*PIXELS))).drop("data")


def _edited(picture, row):
    """Apply the steps whose columns are set: factors first, then crop, resample, canvas."""
    if row.brightness == row.brightness:
        picture = brighten(picture, row.brightness)
    if row.contrast == row.contrast:
        picture = stretch_contrast(picture, row.contrast)
    if row.unsharp_percent == row.unsharp_percent:
        picture = unsharp(picture, int(row.unsharp_percent))
    if row.soften == row.soften:
        picture = soften(picture, row.soften)
    picture = picture[int(row.y1) : int(row.y2), int(row.x1) : int(row.x2)]
    picture = resample(picture, int(row.scaled_w), int(row.scaled_h))
    x, y, w, h = int(row.offset_x), int(row.offset_y), int(row.out_w), int(row.out_h)
    if (w, h) != (picture.shape[1], picture.shape[0]):
        canvas = np.zeros((h, w, picture.shape[2]), dtype=np.uint8)
        part = picture[max(0, -y) : h - y, max(0, -x) : w - x]
        canvas[max(0, y) : max(0, y) + part.shape[0], max(0, x) : max(0, x) + part.shape[1]] = part
        picture = canvas
    return picture


OUTPUT_BYTES = 4 << 20

_GEOMETRY = ("scaled_w", "scaled_h", "offset_x", "offset_y", "out_w", "out_h")
_FACTORS = ("brightness", "contrast", "unsharp_percent", "soften")


def apply_pixels(pixels: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """New pixels after the corrections, crop and resize.

    The columns of ``auto_correct``, ``smart_crop`` and ``resize`` say what to do;
    what is missing leaves the picture as it is. Sizes for ``resize`` are those of
    the cropped picture. The columns may stand in ``pixels`` already, which saves
    moving the bytes; else ``geometry(image_id, ...)`` is joined, without a shuffle
    of the bytes where ``pixels`` is bucketed by ``image_id``.
    """
    plan = pixels
    if geometry is not None:
        more = [c for c in geometry.columns if c not in pixels.columns]
        plan = pixels.join(geometry.select("image_id", *more), "image_id")
    have = set(plan.columns)

    def factor(name: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast("double").alias(name)

    whole = {"x1": F.lit(0), "y1": F.lit(0), "x2": F.col("width"), "y2": F.col("height")}
    box = [(F.col(f"crop.{e}") if "crop" in have else v).alias(e) for e, v in whole.items()]
    cw, ch = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    same = dict(zip(_GEOMETRY, (cw, ch, F.lit(0), F.lit(0), cw, ch)))
    sized = [c for c in _GEOMETRY if c in have]
    plan = plan.select("image_id", *PIXELS, *map(factor, _FACTORS), *box, *sized).withColumns(
        {name: value for name, value in same.items() if name not in have}
    )

    steps = namedtuple("Steps", [c for c in plan.columns if c not in ("image_id", *PIXELS)])
    names = ["image_id", "height", "width", "n_channels", "data"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ((),) * len(names)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            # Numbers that are missing become NaN.
            asked = zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in steps._fields))
            ids, channels = batch.column("image_id").to_pylist(), batch.column("n_channels").to_pylist()
            for p, i, c, row in zip(_pictures(batch), ids, channels, map(steps._make, asked)):
                picture = _edited(p, row)
                rows.append((i, picture.shape[0], picture.shape[1], c, picture.tobytes()))
                size += picture.nbytes
                # Pictures may grow, so what is handed on is bounded by what comes out.
                if size >= OUTPUT_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    return plan.mapInArrow(run, "image_id long, height int, width int, n_channels int, data binary")


def preview_pixels(pixels: DataFrame, max_preview_size: int = 512) -> DataFrame:
    """Pictures scaled into a square, each centred on a canvas of the largest sides."""
    w, h = fit_within(F.col("width"), F.col("height"), max_preview_size)
    sizes = pixels.agg(F.struct(F.max(w).alias("w"), F.max(h).alias("h")).alias("size"))

    def middle(outer: str, inner: str) -> Column:
        return F.floor((F.col(outer) - F.col(inner)) / F.lit(2)).cast("int")

    return apply_pixels(
        pixels.withColumns({"scaled_w": w, "scaled_h": h, "_size": sizes.scalar()})
        .withColumns({"out_w": F.col("_size.w"), "out_h": F.col("_size.h")})
        .withColumns({"offset_x": middle("out_w", "scaled_w"), "offset_y": middle("out_h", "scaled_h")})
    )


def thumbnail_pixels(pixels: DataFrame, size: int = 192) -> DataFrame:
    """Pictures scaled into a square of fixed size."""
    w, h = fit_within(F.col("width"), F.col("height"), size)
    return apply_pixels(pixels.withColumns({"scaled_w": w, "scaled_h": h, "out_w": w, "out_h": h}))


def with_png(pixels: DataFrame) -> DataFrame:
    """Replace the bytes by ``encoded``, a lossless file."""

    def png(batch: pa.Array) -> pa.Array:
        return pa.array([encode_png(p) for p in _pictures(batch)], pa.binary())

    return pixels.withColumn("encoded", _kernel(png, "binary")(F.struct(*PIXELS))).drop("data")


def encode_for_model(pixels: DataFrame, max_size: int = 1024) -> DataFrame:
    """M1: ``encoded`` files of pictures scaled down to ``max_size``, for ``build_requests``."""
    return with_png(thumbnail_pixels(pixels, max_size))


def with_model_file(pixels: DataFrame, max_size: int = 1024) -> DataFrame:
    """M1: add ``encoded`` as ``encode_for_model`` makes it; all other columns stay."""
    w, h = fit_within(F.col("width"), F.col("height"), max_size)

    def png(batch: pa.Array) -> pa.Array:
        sizes = zip(batch.field("sent_w").to_pylist(), batch.field("sent_h").to_pylist())
        return pa.array([encode_png(resample(p, *size)) for p, size in zip(_pictures(batch), sizes)], pa.binary())

    return pixels.withColumn("encoded", _kernel(png, "binary")(F.struct(*PIXELS, w.alias("sent_w"), h.alias("sent_h"))))


def alpha_mask(pixels: DataFrame) -> DataFrame:
    """``mask`` bytes from the alpha channel, zeros without one, and plain colour bytes."""

    def split(batch: pa.Array) -> pa.Array:
        rows = []
        for p in _pictures(batch):
            has_alpha = p.shape[2] == 4
            mask = p[:, :, 3] if has_alpha else np.zeros(p.shape[:2], dtype=np.uint8)
            plain = p[:, :, :3] if has_alpha else p
            rows.append((mask.tobytes(), plain.tobytes(), plain.shape[2]))
        return _struct(rows, mask=pa.binary(), data=pa.binary(), n_channels=pa.int32())

    kept = [c for c in pixels.columns if c not in ("data", "n_channels")]
    return pixels.withColumn("_m", _kernel(split, "mask binary, data binary, n_channels int")(F.struct(*PIXELS))).select(*kept, "_m.n_channels", "_m.data", "_m.mask")


def byte_sum(column: str) -> Column:
    """Sum of the bytes of a binary column."""

    def total(data: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(b.as_buffer(), dtype=np.uint8).sum()) for b in data], pa.int64())

    return _kernel(total, "bigint")(F.col(column))


def with_byte_sums(pixels: DataFrame) -> DataFrame:
    """``bytes`` and ``placed``: plain and position-weighted sums of the bytes, to compare pictures."""

    def totals(data: pa.Array) -> pa.Array:
        rows = []
        for b in data:
            v = np.frombuffer(b.as_buffer(), dtype=np.uint8).astype(np.int64)
            rows.append((int(v.sum()), int((v * np.arange(1, v.size + 1)).sum())))
        return _struct(rows, bytes=pa.int64(), placed=pa.int64())

    kept = [c for c in pixels.columns if c != "data"]
    return pixels.withColumn("_t", _kernel(totals, "bytes bigint, placed bigint")("data")).select(*kept, "_t.bytes", "_t.placed")
