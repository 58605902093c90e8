"""Documents that hold passages of a benchmark, substitutions allowed, by spaced seeds.

A mask is a row of positions, some of which are ignored. Hashing the tokens under each mask at
each place of an item and of a text, and joining the hashes, finds a common passage even if
tokens at ignored positions were replaced. Each hit names a diagonal (place in the text less
place in the item), on which the best overlap is then worked out token by token.

The masks were chosen by enumeration, so that no overlap which passes is without a hit: ``MASKS``
for overlaps of 13 equal tokens and more, ``LIGHT`` for those of items of 15 tokens and fewer. It
is enough to try each placement of replaced tokens in 13, 14, 15, 16, 20, 25 and 30 tokens (0, 1, 2,
3, 4, 5, 6 replaced). Longer overlaps hold one of these, as no more than a fifth of them is replaced:
of 35 tokens and more, if every 20 had 5 replaced ones, what is left over would have too few.

What is broadcast to the scan of the documents is a filter of seed hashes of bounded size. It
only spares rows: all that pass it meet the seeds in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgcurate.session import written

from .arrow import give_back, slices, text_bytes
from .hashing import hashes, mix, spans
from .keys import KEY, document_key
from .registry import query, table

MASKS = ("1101111", "1100010111", "11110101")
#: For items of up to so many tokens, of which fewer than 13 equal ones are enough.
LIGHT = ("1111", "111011")
LIGHT_MOST = 15
#: Shorter items take no part: so few words are common property.
SHORTEST = 8
#: An overlap needs so many equal tokens (or four fifths of a short item) and four of five tokens equal.
MATCHED = 13
SHARE = 0.8
#: Bits of the filter for each seed, 8 of which are set, and how many bits it has at most (8 MB).
FILTER_BITS = 64
FILTER_PROBES = 8
FILTER_LOG2_MOST = 26

TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens_of(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's tokens (runs of letters and digits, A-Z as a-z) and the offsets of its rows."""
    data, offsets = text_bytes(part.column(text))
    starts, ends, rows = spans(data, offsets, TOKEN_BYTE)
    return hashes(data, starts, ends, fold=True), np.searchsorted(rows, np.arange(part.num_rows + 1))


def seeds_at(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The seed of a mask at each place of a row of tokens where it fits; rows may be joined and cut after."""
    n = max(0, len(tokens) - len(mask) + 1)
    value = np.full(n, number + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            value = mix(value + tokens[k : k + n] * np.uint64(2 * k + 3))
    return value


def item_tokens(items: DataFrame) -> DataFrame:
    """``(item_id, n, tokens)`` of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                tokens, offsets = tokens_of(part, "text")
                held = pa.array([tokens[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(np.diff(offsets).astype(np.int32)), held], names=["item_id", "n", "tokens"])

    return items.select("item_id", "text").mapInArrow(run, "item_id long, n int, tokens binary")


def item_seeds(items: DataFrame) -> DataFrame:
    """``(seed, item_id, at)``: every seed of the items of ``item_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, held in zip(batch.column("item_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(held, np.uint64)
                if len(tokens) < SHORTEST:
                    continue
                some = range(len(MASKS), len(MASKS + LIGHT)) if len(tokens) <= LIGHT_MOST else range(len(MASKS))
                for number in some:
                    seed = seeds_at(tokens, (MASKS + LIGHT)[number], number)
                    for k in range(0, len(seed), 1 << 16):
                        own = seed[k : k + (1 << 16)]
                        at = np.arange(k, k + len(own), dtype=np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own.view(np.int64)), pa.array(np.full(len(own), item), pa.int64()), pa.array(at)], names=["seed", "item_id", "at"]
                        )

    return items.mapInArrow(run, "seed long, item_id long, at int")


def seed_filter(seeds: DataFrame, bits: int = FILTER_BITS, log2_most: int = FILTER_LOG2_MOST) -> np.ndarray:
    """A Bloom filter of the seeds, ``2**log2_most`` bits at most. Tasks send parts of 4 KB with set bits only.

    With more seeds than fit it lets more through, which the join then sorts out.
    """
    n = max(1, seeds.count())
    log2 = min(log2_most, max(16, (bits * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column("seed").to_numpy().view(np.uint64)
            at = np.concatenate([_bit_of(own, log2, probe) for probe in range(FILTER_PROBES)])
            for part in np.unique(at >> 15):
                bits = np.zeros(1 << 15, np.uint8)
                bits[at[at >> 15 == part] & 0x7FFF] = 1
                bits = np.packbits(bits, bitorder="little")
                held[int(part)] = held.get(int(part), 0) | bits
        yield _parts(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                held[part] = held.get(part, 0) | np.frombuffer(bits, np.uint8)
        yield _parts(held)

    kind = "part int, bits binary"
    rows = seeds.select("seed").mapInArrow(run, kind).repartition("part").mapInArrow(merge, kind).toArrow()
    out = np.zeros((1 << log2) // 8, np.uint8)
    for part, bits in zip(rows["part"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _parts(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "bits"]
    )


def _bit_of(seeds: np.ndarray, log2: int, probe: int) -> np.ndarray:
    return (mix(seeds + np.uint64(probe)) >> np.uint64(64 - log2)).astype(np.int64)


def passing(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the seeds that may be in the filter."""
    log2 = (8 * len(bits) - 1).bit_length()
    at = np.arange(len(seeds))
    for probe in range(FILTER_PROBES):
        bit = _bit_of(seeds[at], log2, probe)
        at = at[((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)]
    return at


def document_hits(docs: DataFrame, masks: tuple[str, ...], bits: np.ndarray) -> DataFrame:
    """``(id, tie, doc_id, tokens, hits)`` for texts with seeds that pass the filter: their tokens, and the seeds with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, offsets = tokens_of(part, "text")
                places, seeds = [], []
                for number, mask in enumerate(masks):
                    seed = seeds_at(tokens, mask, number)
                    at = passing(seed, bits)
                    row = np.searchsorted(offsets, at, side="right") - 1
                    at = at[at + len(mask) <= offsets[row + 1]]
                    places.append(at)
                    seeds.append(seed[at])
                at, seed = np.concatenate(places), np.concatenate(seeds)
                row = np.searchsorted(offsets, at, side="right") - 1
                order = np.argsort(row, kind="stable")
                at, seed, row = at[order], seed[order].view(np.int64), row[order]
                found = np.unique(row)
                cuts = np.searchsorted(row, np.append(found, len(offsets)))
                hits = [
                    [{"seed": s, "place": p} for s, p in zip(seed[a:b].tolist(), (at[a:b] - offsets[r]).tolist(), strict=True)]
                    for r, a, b in zip(found, cuts[:-1], cuts[1:], strict=True)
                ]
                some = pa.array(found, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(some) for c in (*KEY, "doc_id")),
                        pa.array([tokens[offsets[r] : offsets[r + 1]].tobytes() for r in found], pa.binary()),
                        pa.array(hits, pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))),
                    ],
                    names=[*KEY, "doc_id", "tokens", "hits"],
                )
        give_back()

    schema = "id long, tie long, doc_id long, tokens binary, hits array<struct<seed: long, place: int>>"
    return docs.select(*KEY, "doc_id", "text").mapInArrow(run, schema)


def best_overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """On one diagonal the stretch ``[low, high)`` of the text with most equal tokens, each unequal one costing two, and how many are equal.

    Of stretches as good the longest counts, then the first.
    """
    low, high = max(0, shift), min(len(text), len(item) + shift)
    equal = text[low:high] == item[low - shift : high - shift]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    least = np.minimum.accumulate(total)
    gain = total - least
    ends = np.flatnonzero(gain == gain.max())
    starts = np.searchsorted(-least, -least[ends])  # where the minimum was first reached
    k = int(np.argmax(ends - starts))
    start, end = int(starts[k]), int(ends[k])
    return low + start, low + end, int(equal[start:end].sum())


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, id, tie, item_id, matched, low, high)``: the best overlap of each document with each item that it holds.

    ``low`` and ``high`` are tokens of the text. Equal rows of ``docs`` count as one, as do
    equal items, under the smallest id. Null and empty texts hold nothing, null ids are kept,
    empty tables give an empty one, and other columns play no part.
    """
    items = benchmark.where("text is not null").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    items = written(item_tokens(items).where(F.col("n") >= SHORTEST), "items")
    masks = MASKS + LIGHT if not items.where(F.col("n") <= LIGHT_MOST).isEmpty() else MASKS
    seeds = written(item_seeds(items), "seeds")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *document_key(), "text")
    held = written(document_hits(rows, masks, seed_filter(seeds)), "hits")
    hits = held.select(*KEY, F.explode("hits").alias("hit")).select(*KEY, "hit.*")
    met = hits.join(seeds, "seed").groupBy(*KEY, "item_id").agg(F.collect_set(F.col("place") - F.col("at")).alias("shifts"))
    texts = written(held.groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("tokens").alias("tokens")), "texts")
    # One row a document and item, whatever the diagonals, and the tokens of both once in it.
    pairs = written(met, "met").join(texts, KEY).join(items.select("item_id", F.col("tokens").alias("item")), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["tokens", "item", "shifts"])
            keep, found = [], []
            for k in range(rows.num_rows):
                text, item = (np.frombuffer(rows.column(c)[k].as_py(), np.uint64) for c in ("tokens", "item"))
                best = None
                for shift in rows.column("shifts")[k].as_py():
                    low, high, matched = best_overlap(text, item, shift)
                    if matched >= min(MATCHED, SHARE * len(item)) and matched >= SHARE * (high - low):
                        best = max(best or (0, 0, 0), (matched, -low, -high))
                if best:
                    keep.append(k)
                    found.append((best[0], -best[1], -best[2]))
            some = pa.array(keep, pa.int64())
            columns = [batch.column(c).take(some) for c in ("doc_id", *KEY, "item_id")]
            columns += [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEY, "item_id", "matched", "low", "high"])

    kind = "doc_id long, id long, tie long, item_id long, matched int, low int, high int"
    return pairs.select("doc_id", *KEY, "item_id", "tokens", "item", "shifts").mapInArrow(verify, kind)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    found = written(overlaps(docs, benchmark).select(*KEY).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), *document_key())
    return rows.join(found, KEY, "left_anti").select("row.*")


@query("op8_decontamination")
def op8_decontamination(spark, folder):
    return overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop(*KEY)
