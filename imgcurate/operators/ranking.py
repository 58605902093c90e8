"""Ranks, positions and caps that never put one whole group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgcurate.functions.arith import floor_div
from imgcurate.session import cut_lineage


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    n: int | Column,
    spread: str,
    salts: int = 256,
) -> DataFrame:
    """First ``n`` rows of every group, exactly.

    Rows are ranked inside salted shares of a group first, so a group that holds
    much of the table is thinned by many tasks; only ``salts * n`` rows of it are
    left for the final rank. ``spread`` is a column that differs between rows.
    """
    share = F.pmod(F.xxhash64(spread), F.lit(salts))
    first = Window.partitionBy(*group, "_share").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_share", share)
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= n)
        .drop("_share", "_rank")
    )


def with_position(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str] = (),
    position: str = "pos",
    total: str = "n",
    running: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add the 0-based position in the group and the size of the group.

    ``order`` must be total. The table is range-sorted by (group, order) and
    written once, so its partitions stay as they are; each partition counts its
    stretch of every group, and the stretches are added up. A group may span any
    number of partitions. ``running`` maps a column name to a number to be summed
    from the start of the group up to and including each row.

    Hand in a narrow table: sorting moves every column given.
    """
    running = dict(running or {})
    keys = list(group)
    laid = cut_lineage(df.orderBy(*keys, *order))
    laid = laid.withColumn("_row", F.monotonically_increasing_id())
    laid = laid.withColumn("_part", F.shiftright("_row", 33))

    stretch = laid.groupBy(*keys, "_part").agg(
        F.min("_row").alias("_first"),
        F.count(F.lit(1)).alias("_size"),
        *[F.sum(expr).alias(f"_sum_{name}") for name, expr in running.items()],
    )
    # One row per group and partition it touches: small, whatever the group holds.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    stretch = stretch.select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"),
        "_first",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias(total),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_offset_{name}")
            for name in running
        ],
    )
    if not keys:
        # One row per partition of the sorted table.
        stretch = F.broadcast(stretch)
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    out = laid.join(stretch, match)
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy("_row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added = {position: F.col("_offset") + F.col("_row") - F.col("_first")}
    for name, expr in running.items():
        added[name] = F.col(f"_offset_{name}") + F.sum(expr).over(inside)
    return out.withColumns(added).select(*df.columns, position, total, *running)


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows, by their position in a distributed sort."""
    placed = with_position(df, order, position="_pos", total="_n")
    return placed.filter(F.col("_pos") < n).drop("_pos", "_n")


def join_in_order(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    text: str,
    separator: str,
    out: str,
    block: int = 1024,
) -> DataFrame:
    """Join texts of a group in the order of an integer column.

    Blocks of the order are joined first, each by its own task, and the blocks
    are joined then: no task sorts the single pieces of a long group.
    """
    pieces = df.withColumn("_block", floor_div(order, block))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(items), lambda s: s["t"]), separator)

    blocks = pieces.groupBy(*group, "_block").agg(
        joined(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_text")
    )
    return blocks.groupBy(*group).agg(
        joined(F.collect_list(F.struct(F.col("_block").alias("o"), F.col("_text").alias("t")))).alias(out)
    )
