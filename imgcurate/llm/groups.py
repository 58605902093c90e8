"""Comparison of the rows of a group with those of other kinds, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgcurate.session import written


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and value[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = value[a]
    if held:
        yield pa.Table.from_batches(held)


def crossed(members: DataFrame, group: str, member: str, kind: str, block: int) -> DataFrame:
    """``members`` of groups with two kinds and more, dealt so that members of different kinds meet; ``unit`` names a meeting.

    ``members`` must be a written table of distinct rows. The largest kind of a group meets the
    others but not itself, so a group of one kind is not dealt at all, and a large kind with few
    others costs its own size times those. Both sides are cut into blocks by a hash of
    ``member``; a unit holds about two blocks, whatever the size of its group.
    """
    sizes = members.groupBy(group, kind).agg(F.count("*").alias("size"))
    sizes = sizes.groupBy(group).agg(F.sum("size").alias("all"), F.max(F.struct("size", kind)).alias("most"), F.count("*").alias("kinds"))
    sizes = written(sizes.where("kinds > 1").select(group, "all", F.col("most.size").alias("most"), F.col(f"most.{kind}").alias("main")), "group-sizes")
    dealt = members.join(sizes, group).withColumn("_all", F.ceil(F.col("all") / block)).withColumn("_rest", F.ceil((F.col("all") - F.col("most")) / block))
    place = F.xxhash64(member)
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_rest") - 1), lambda i: F.xxhash64(group, i, F.pmod(place, F.col("_all"))))
    along = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1), lambda j: F.xxhash64(group, F.pmod(place, F.col("_rest")), j))
    units = F.when(F.col(kind) == F.col("main"), across).otherwise(F.array_union(across, along))
    return dealt.withColumn("unit", F.explode(units)).drop("all", "most", "main", "_all", "_rest")


def linked(units: DataFrame, link: Callable[[pa.Table], np.ndarray], member: str) -> DataFrame:
    """``(a, b)``: links that connect the rows of each unit as ``link``'s matrix of truth values does.

    Each row that has links is joined with the smallest member it reaches, so a unit gives
    fewer links than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in runs_of(batches, "unit"):
            if rows.num_rows < 2:
                continue
            ids = rows.column(member).to_numpy()
            matrix = link(rows)
            np.fill_diagonal(matrix, True)
            order = np.argsort(ids)
            ids, matrix = ids[order], matrix[np.ix_(order, order)]
            label = np.arange(len(matrix))
            while True:
                least = np.where(matrix, label, len(matrix)).min(axis=1)
                least = least[least]
                if (least == label).all():
                    break
                label = least
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                a.append(ids[moved])
                b.append(ids[label[moved]])
            if sum(map(len, a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")
