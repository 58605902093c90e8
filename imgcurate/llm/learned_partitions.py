"""Nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts that keep neighbours
together, and a small softmax classifier learns which part a vector belongs to. Every row is
indexed under its most probable part. A query goes to its most probable parts and the rows
there are ranked by their exact cosine. How many parts are searched is measured on the sample:
as many as its own neighbours need for ``recall``. Neighbours in the whole table are nearer
than in a sample of it, so this errs on the safe side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imgcurate.session import written

from .groups import runs_of
from .registry import query, table

#: Vectors that the index is fitted on, at most.
SAMPLE = 4_096
PARTS = 32
NEIGHBOURS = 10
#: Different vectors of the sample in a part, at least: twice the neighbours that it is learned from.
PART_ROWS = 2 * NEIGHBOURS
RECALL = 0.97
#: Rows and queries that meet in one unit of work, about.
CELL_ROWS = 20_000
CELL_QUERIES = 2_000


@dataclass(frozen=True)
class Router:
    """Weights of the classifier (a last row for the bias), and how many parts a query is sent to."""

    weights: np.ndarray
    probes: int

    def odds(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.weights[:-1] + self.weights[-1]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled first, as squares of very large or small numbers leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row of unit vectors."""
    out = []
    for low in range(0, len(unit), 512):
        near = unit[low : low + 512] @ unit.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -2
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, unit: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """A part for each node, none over 1.1 times its share, with few graph edges between parts.

    Starts from rows dealt to centres with room, then moves nodes to the part in which most of
    their neighbours are, those first that gain most, while there is room.
    """
    n = len(unit)
    room = int(np.ceil(1.1 * n / parts))
    random = np.random.default_rng(seed)
    centres = unit[random.choice(n, parts, replace=False)]
    for _ in range(5):
        near = unit @ centres.T
        label = np.full(n, -1)
        size = np.zeros(parts, int)
        order = np.argsort(-near.max(axis=1), kind="stable")
        wish = np.argsort(-near, axis=1, kind="stable")
        for i in order:
            p = next(p for p in wish[i] if size[p] < room)
            label[i] = p
            size[p] += 1
        centres = np.stack([unit[label == p].sum(axis=0) if size[p] else centres[p] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    k = graph.shape[1]
    sources = np.repeat(np.arange(n), k)
    targets = graph.ravel()
    for _ in range(10):
        inside = np.zeros((n, parts))
        np.add.at(inside, (sources, label[targets]), 1)
        np.add.at(inside, (targets, label[sources]), 1)
        best = inside.argmax(axis=1)
        gain = inside[np.arange(n), best] - inside[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit_router(vectors: np.ndarray, parts: int = PARTS, recall: float = RECALL, seed: int = 1) -> Router:
    """A router from sampled vectors. There are as many parts as hold ``PART_ROWS`` different ones each, ``parts`` at most."""
    unit = np.unique(unit_rows(vectors), axis=0) if len(vectors) else vectors
    dim = vectors.shape[1] if vectors.ndim == 2 else 0
    parts = min(parts, len(unit) // PART_ROWS)
    if parts < 2:
        return Router(np.zeros((dim + 1, 1)), 1)
    graph = neighbour_graph(unit, NEIGHBOURS)
    label = balanced_parts(graph, unit, parts, seed)
    # What is learned: the parts of a vector and of its neighbours.
    wanted = np.zeros((len(unit), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(unit)), NEIGHBOURS), label[graph.ravel()]), 0.5 / NEIGHBOURS)
    wanted[np.arange(len(unit)), label] += 0.5
    random = np.random.default_rng(seed)
    weights, mean, square = (np.zeros((dim + 1, parts)) for _ in range(3))
    inputs = np.hstack([unit, np.ones((len(unit), 1))])
    step = 0
    for _ in range(60):
        order = random.permutation(len(unit))
        for low in range(0, len(unit), 256):
            some = order[low : low + 256]
            odds = inputs[some] @ weights
            share = np.exp(odds - odds.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            grad = inputs[some].T @ (share - wanted[some]) / len(some)
            step += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad * grad
            weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    odds = inputs @ weights
    home = odds.argmax(axis=1)
    ranks = np.empty_like(odds, int)
    np.put_along_axis(ranks, np.argsort(-odds, axis=1), np.arange(parts)[None, :], axis=1)
    needed = ranks[np.arange(len(unit))[:, None], home[graph]].ravel()
    reached = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    return Router(weights, int(np.argmax(reached >= recall)) + 1)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a finite vector other than zero, its components as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & whole & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def routed(rows: DataFrame, router: Router, probes: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the parts, most probable first."""
    shared = rows.sparkSession.sparkContext.broadcast(router)  # its size is that of the weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"))
                odds = router.odds(unit_rows(x))
                best = np.argsort(-odds, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best), pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, f"vec_id long, vector array<double>, {out} array<int>")


def nearest_in(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` rows of largest cosine for each query but itself, ties to smaller ids."""
    # Scaled first, as squares of very large or small components leave the range of doubles.
    scale = lambda x: x / np.abs(x).max(axis=1, keepdims=True)
    a, b = scale(queries), scale(rows)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    out = []
    for low in range(0, len(a), 256):
        near = (a[low : low + 256] / na[low : low + 256, None]) @ (b / nb[:, None]).T
        near[query_ids[low : low + 256, None] == row_ids[None, :]] = -np.inf
        last = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -3.0)
        for i, floor in enumerate(last):
            # A product of matrices rounds by place, so what is near the last place is worked out anew.
            some = np.flatnonzero(near[i] >= max(floor, -3.0) - 1e-9)
            exact = (a[low + i] * b[some]).sum(axis=1) / (na[low + i] * nb[some])
            order = np.lexsort((row_ids[some], -exact))[:k]
            out += [(int(query_ids[low + i]), int(row_ids[some[j]]), float(exact[j])) for j in order]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` nearest rows found, by cosine in double precision.

    Both tables have ``vec_id`` and ``embedding``. Vectors that are null, zero, not finite, or
    of another length than most of the sample take no part, nor do null ids. Rows with the
    query's id are its own. Rows of equal id and vector count once. Ties go to the smaller
    id. An empty table gives an empty one. A part may hold any share of the rows, as with many
    copies of a vector: it is cut into cells by id, and queries are sent to each of them.
    """
    rows, asked = _usable(vectors), _usable(queries).dropDuplicates(["vec_id", "vector"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()["vector"].to_pylist()
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    router = fit_router(np.array([v for v in sample if len(v) == dim], float).reshape(-1, dim), parts, recall)
    rows, asked = rows.where(F.size("vector") == dim), asked.where(F.size("vector") == dim)
    homes = written(routed(rows, router, 1, "parts").select("vec_id", "vector", F.col("parts")[0].alias("part")), "indexed")
    asked = written(routed(asked, router, router.probes, "parts").select("vec_id", "vector", F.explode("parts").alias("part")), "asked")
    cells = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("long")
    sizes = homes.groupBy("part").agg(cells(F.count("*"), CELL_ROWS).alias("row_cells"))
    loads = asked.groupBy("part").agg(cells(F.count("*"), CELL_QUERIES).alias("query_cells"))
    grid = F.broadcast(written(sizes.join(loads, "part"), "grid"))  # a row for each part
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    unit = F.xxhash64("part", "r", "q").alias("unit")
    left = homes.join(grid, "part").withColumn("r", own("row_cells")).withColumn("q", every("query_cells"))
    right = asked.join(grid, "part").withColumn("q", own("query_cells")).withColumn("r", every("row_cells"))
    both = left.select(unit, F.lit(False).alias("asks"), "vec_id", "vector").unionByName(right.select(unit, F.lit(True).alias("asks"), "vec_id", "vector"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, "unit"):
            asks = group.column("asks").to_numpy()
            ids, x = group.column("vec_id").to_numpy(), _matrix(group.column("vector"))
            if asks.all() or not asks.any():
                continue
            row_ids, row = ids[~asks], x[~asks]
            # Repeated rows have one part and one id, so they are in one cell.
            keyed = np.column_stack([row_ids.view(np.float64), row])
            once = np.unique(keyed.view(f"V{keyed.itemsize * keyed.shape[1]}").ravel(), return_index=True)[1]
            found = nearest_in(x[asks], ids[asks], row[once], row_ids[once], k)
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(made, names=["query_id", "vec_id", "score"])

    found = both.repartition("unit").sortWithinPartitions("unit").mapInArrow(rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op6_learned_partitions")
def op6_learned_partitions(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
