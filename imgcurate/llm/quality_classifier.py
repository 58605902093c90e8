"""Text quality by supervised subword embeddings.

A document is the average of learned vectors of its features: words and their character
n-grams, hashed into buckets, and a marker for the end of the text. A word that repeats the
one before it has a marker in place of each of its features. A softmax layer follows. Vectors and layer are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows. The average is
linear, so for scoring each bucket shrinks to one number and each distinct word to a sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import give_back, slices
from .hashing import mix
from .registry import held_out, query, table
from .sample import labelled_sample

#: At most so many labelled rows of each class are learned from.
PER_CLASS = 1_000
#: The end marker counts as so many features, so that a few odd words do not decide on a short text alone.
END = 5.0
#: Distinct words whose sums a task keeps; a full table is emptied.
TABLE_WORDS = 100_000
#: Words whose features are made at once.
WORDS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Shape:
    buckets_log2: int = 18
    shortest: int = 3
    longest: int = 5
    size: int = 10
    epochs: int = 6
    rate: float = 0.5
    seed: int = 1

    @property
    def buckets(self) -> int:
        """The last two are the markers."""
        return (1 << self.buckets_log2) + 2


def word_features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their n-grams, and for each the place of its word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))
    shift = np.uint64(64 - shape.buckets_log2)
    spread = points * np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
    whole = np.add.reduceat(mix(spread + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), ends - lengths)
    buckets, owners = [mix(whole + np.uint64(1)) >> shift], [np.arange(len(words))]
    value = np.zeros(len(points), np.uint64)
    for n in range(1, min(shape.longest, len(points)) + 1):
        value[: len(points) - n + 1] = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + spread[n - 1 :]
        if n >= shape.shortest:
            # The word itself with its ends is a feature already.
            at = np.flatnonzero((left >= n) & ~((place == 0) & (left == n)))
            buckets.append(mix(value[at] + np.uint64(n)) >> shift)
            owners.append(owner[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def document_features(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of its features in each."""
    words = text.split()
    counts, repeats = Counter(words), Counter(b for a, b in zip(words, words[1:], strict=False) if a == b)
    markers = np.array([shape.buckets - 2, shape.buckets - 1])
    buckets, weight, marked = np.zeros(0, np.int64), np.zeros(0), 0.0
    if counts:
        buckets, owner = word_features(list(counts), shape)
        again = np.array([repeats[w] for w in counts], np.float64)
        weight = (np.fromiter(counts.values(), np.float64, len(counts)) - again)[owner]
        marked = again[owner].sum()
    buckets, at = np.unique(np.concatenate([buckets, markers]), return_inverse=True)
    weight = np.bincount(at, np.concatenate([weight, [marked, END]]))
    return buckets, weight / weight.sum()


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], shape: Shape) -> np.ndarray:
    """For each bucket, what it adds to the log odds of label 1.

    Steps are scaled by each vector's own past gradients, as features differ in frequency by
    orders of magnitude. Without examples of both labels, all odds are even.
    """
    if len({y for _, _, y in examples}) < 2:
        return np.zeros(shape.buckets, np.float32)
    random = np.random.default_rng(shape.seed)
    vectors = random.uniform(-1, 1, (shape.buckets, shape.size)) / shape.size
    layer = random.uniform(-1, 1, (shape.size, 2)) / shape.size
    seen, seen_layer = np.full(shape.buckets, 1e-8), np.full((shape.size, 2), 1e-8)
    steps = shape.epochs * len(examples)
    step = 0
    for _ in range(shape.epochs):
        for k in random.permutation(len(examples)):
            buckets, share, label = examples[k]
            rate = shape.rate * (1 - step / steps)
            hidden = share @ vectors[buckets]
            odds = hidden @ layer
            wrong = np.exp(odds - odds.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = layer @ wrong
            grad = np.outer(hidden, wrong)
            seen_layer += grad * grad
            layer -= rate * grad / np.sqrt(seen_layer)
            seen[buckets] += share * share * (back @ back) / shape.size
            vectors[buckets] -= (rate * share / np.sqrt(seen[buckets]))[:, None] * back
            step += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)


class Scorer:
    """Scores of texts, with the sums of distinct words kept."""

    def __init__(self, odds: np.ndarray, shape: Shape, most: int = TABLE_WORDS):
        self.odds, self.shape, self.most = odds.astype(np.float64), shape, most
        self.place: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def _add(self, words: list[str]) -> None:
        sums, counts = [self.sums], [self.counts]
        self.place.update(zip(words, range(len(self.sums), len(self.sums) + len(words)), strict=True))
        for low in range(0, len(words), WORDS_AT_ONCE):
            some = words[low : low + WORDS_AT_ONCE]
            buckets, owner = word_features(some, self.shape)
            sums.append(np.bincount(owner, self.odds[buckets], len(some)))
            counts.append(np.bincount(owner, minlength=len(some)).astype(np.float64))
        self.sums, self.counts = np.concatenate(sums), np.concatenate(counts)

    def score(self, texts: list[str]) -> np.ndarray:
        words = [t.split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        need = set(flat)
        missing = {w for w in need if w not in self.place}
        if len(self.place) + len(missing) > self.most:
            self.place, self.sums, self.counts, missing = {}, np.zeros(0), np.zeros(0), need
        if missing:
            self._add(sorted(missing))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), lengths)
        again = np.zeros(len(at), bool)
        again[1:] = (at[1:] == at[:-1]) & (owner[1:] == owner[:-1])
        count = self.counts[at]
        total = np.bincount(owner, np.where(again, count * self.odds[-2], self.sums[at]), len(texts)) + END * self.odds[-1]
        count = np.bincount(owner, count, len(texts)) + END
        return 1 / (1 + np.exp(-total / count))


def fit(sample: DataFrame, shape: Shape = Shape()) -> np.ndarray:
    """Odds by bucket from ``(doc_id, text, label)``. Features are made in tasks; their number bounds what is collected."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                made = [document_features(t, shape) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([b.astype("<u4").tobytes() for b, _ in made], pa.binary()),
                        pa.array([s.astype("<f4").tobytes() for _, s in made], pa.binary()),
                        part.column("label"),
                    ],
                    names=["doc_id", "buckets", "share", "label"],
                )

    rows = sample.mapInArrow(features, "doc_id long, buckets binary, share binary, label int").toArrow()
    rows = rows.sort_by("doc_id")
    unpack = lambda name, kind, to: [np.frombuffer(b, kind).astype(to) for b in rows[name].to_pylist()]
    examples = zip(unpack("buckets", "<u4", np.int64), unpack("share", "<f4", float), rows["label"].to_pylist(), strict=True)
    return train(list(examples), shape)


def with_score(df: DataFrame, odds: np.ndarray, shape: Shape = Shape(), text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 in ``out``. A null text counts as empty and is scored by its end marker.

    Only the text goes to Python, and only the score comes back.
    """
    shared = df.sparkSession.sparkContext.broadcast(odds)  # one number a bucket, whatever the input

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value, shape)
        for column in columns:
            parts = slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text", 1 << 20)
            made = [scorer.score([t or "" for t in part.column("text").to_pylist()]) for part in parts]
            yield pa.array(np.concatenate([np.zeros(0), *made]))
        del scorer
        give_back()

    return df.withColumn(out, score(F.col(text)))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    return fit(labelled_sample(docs, labels, "quality", per_class))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, held_out, score, predicted)`` for each row of ``docs``.

    Rows are independent: repeated rows are scored alike, null ids pass and are not held out,
    an empty table gives an empty one. Without labels of both classes every score is 0.5.
    """
    scored = with_score(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select(
        "doc_id", "text", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op5_quality_classifier")
def op5_quality_classifier(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = with_score(docs.select("doc_id", "text"), fit_quality(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
    return scored
