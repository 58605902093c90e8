"""Joining metadata and captions to images, and routing by a metadata value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgcurate.functions.parsing import field_text, strict_json


def explode_metadata(batches: DataFrame, batch: Sequence[str] = ("batch",), source: str = "metadata_json") -> DataFrame:
    """One row per record of the JSON arrays: ``(batch, index, position, metadata)``.

    A lone object counts as a list of one. Records without a usable ``_index`` are
    left out, and of several with the same index the last wins.
    """
    parsed = strict_json(F.col(source))
    is_object = F.try_variant_get(parsed, "$", "map<string,variant>").isNotNull()
    records = F.coalesce(
        F.try_variant_get(parsed, "$", "array<variant>"), F.when(is_object, F.array(parsed))
    )
    rows = batches.select(*batch, F.posexplode(records).alias("position", "record"))
    indexed = rows.withColumn("index", F.try_variant_get("record", "$._index", "bigint")).filter("index >= 0")
    return indexed.groupBy(*batch, "index").agg(F.max_by(F.to_json("record"), "position").alias("metadata"))


def attach_metadata(
    images: DataFrame, batches: DataFrame, batch: Sequence[str] = ("batch",), source: str = "metadata_json"
) -> DataFrame:
    """Left join of images to the records of their batch by index.

    Adds ``metadata`` (JSON text, ``{}`` without a record) and ``metadata_valid``,
    which is false for a batch whose JSON cannot be read. A batch may come in several
    texts: it is valid if one of them is, and no image is multiplied.
    """
    read = strict_json(F.col(source)).isNotNull()
    valid = batches.select(*batch, read.alias("_valid")).groupBy(*batch).agg(F.max("_valid").alias("_valid"))
    return (
        images.join(valid, list(batch), "left")
        .join(explode_metadata(batches, batch, source), [*batch, "index"], "left")
        .withColumns(
            {
                "metadata": F.coalesce("metadata", F.lit("{}")),
                "metadata_valid": F.coalesce("_valid", F.lit(False)),
            }
        )
        .drop("_valid")
    )


def _route_values(values: str) -> list[str]:
    """Values of a comma list; whole numbers match with and without ``.0``."""
    listed = [v.strip().lower() for v in values.split(",")]
    short = [v[: -len(".0")] for v in listed if v.endswith(".0") and v[: -len(".0")].lstrip("-").isdigit()]
    return listed + short


def matches(field: str, values: str, metadata: str = "metadata") -> Column:
    """Is the field's text, in lower case, in the comma list? A missing field is ``""``."""
    return _matches(F.try_parse_json(metadata), field, values)


def _matches(parsed: Column, field: str, values: str) -> Column:
    return F.lower(F.coalesce(field_text(parsed, field), F.lit(""))).isin(_route_values(values))


def route(df: DataFrame, field: str = "pose", values: str = "standing") -> DataFrame:
    """Add ``matched``. Rows of a batch whose metadata cannot be read all match."""
    hit = matches(field, values)
    if "metadata_valid" in df.columns:
        hit = ~F.col("metadata_valid") | hit
    return df.withColumn("matched", hit)


def route_multi(df: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Add ``matched`` for rows that match every step. The metadata is parsed once a row, whatever the steps."""
    hit = F.lit(True)
    for field, values in steps:
        hit = hit & _matches(F.col("_parsed"), field, values)
    if "metadata_valid" in df.columns:
        hit = ~F.col("metadata_valid") | hit
    return df.withColumn("_parsed", F.try_parse_json("metadata")).withColumn("matched", hit).drop("_parsed")


def join_captions(images: DataFrame, captions: DataFrame, positional: bool = False) -> DataFrame:
    """Left join ``captions(position, filename, caption)`` by filename, last one wins.

    With ``positional``, images (with a ``position``) left without a caption take
    the one at their position; that can pair the wrong two when rows were dropped.
    """
    by_name = (
        captions.filter("filename is not null")
        .groupBy("filename")
        .agg(F.max_by("caption", "position").alias("caption"))
    )
    joined = images.join(by_name, "filename", "left").withColumn("caption", F.coalesce("caption", F.lit("")))
    if not positional:
        return joined
    by_place = captions.groupBy("position").agg(F.max("caption").alias("_placed"))
    return (
        joined.join(by_place, "position", "left")
        .withColumn(
            "caption", F.when(F.col("caption") != "", F.col("caption")).otherwise(F.coalesce("_placed", F.lit("")))
        )
        .drop("_placed")
    )
