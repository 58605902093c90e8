"""Toxicity by the nearest labelled examples, by exact TF-IDF cosine.

Terms are all words of the labelled examples, besides beginnings and repetitions of words that
the two labels differ in. Weights are term frequency times inverse frequency over all documents,
times the term's strength: the root of the log-likelihood ratio of its counts under the two
labels, in either direction, so that rare words that only one label has count and common ones
hardly do. The examples, a bounded sample, lie in an inverted index whose posting lists are cut
into blocks of examples. The largest weight of a term in a block bounds what any example there
can reach, so only blocks that can hold a near enough example are visited. The result is exact. Near examples vote, weighted by cosine and by how rarely their label was
sampled; votes are calibrated on the examples themselves, each judged by the others, and
they are given as evidence, with all ties of the last.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imgcurate.session import written

from .arrow import added, map_slices, slices, text_bytes, with_arrays
from .hashing import hashes, mix, shingles, spans
from .registry import held_out, query, table
from .sample import labelled_sample

#: At most so many labelled rows of each label are learned from.
PER_CLASS = 2_000
NEAREST = 10
BLOCK = 64
BEGINNINGS = (4, 5, 6, 7)
#: A term that is in a text so often is a term of its own besides: once may be chance.
LEVELS = (2, 3, 5)
#: A beginning or repetition must be in so many examples, and its log-likelihood ratio must be so large (once in 1,000 by chance). Words need not.
LEAST = 5
SIGNIFICANT = 10.83
#: The strength of a word that both labels have alike, above 0 so that it counts as well.
WEAKEST = 0.1
#: So many blocks are visited first; their nearest examples rule out others.
FIRST_BLOCKS = 4
TABLE_WORDS = 300_000
#: Posting lists that are kept as rows of a matrix.
COMMON = 256
#: Terms and texts that are scored at once; a longer text is scored alone.
SLICE_TERMS = 1 << 15
SLICE_TEXTS = 128

WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked as such, as words are inflected and joined."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def leveled(term: str, level: int) -> str:
    return f"{term}@{level}" if level > 1 else term


class TermTable:
    """Term numbers of texts; what a distinct word holds is looked up once while it is in the table."""

    def __init__(self, vocabulary: dict[str, int], most: int = TABLE_WORDS):
        self.vocabulary, self.most = vocabulary, most
        # Terms that count only by repetition have numbers behind those of the vocabulary.
        self.bases: dict[str, int] = {}
        repeated: list[tuple[int, int, int]] = []
        for t, number in vocabulary.items():
            base, _, level = t.partition("@")
            if level:
                own = vocabulary.get(base)
                own = self.bases.setdefault(base, len(vocabulary) + len(self.bases)) if own is None else own
                repeated.append((own, int(level), number))
        self.numbers = len(vocabulary) + len(self.bases)
        made = np.array(sorted(repeated), np.int64).reshape(-1, 3)
        self.level, self.leveled = made[:, 1], made[:, 2]
        self.level_start = np.searchsorted(made[:, 0], np.arange(self.numbers + 1))
        self._clear()

    def _clear(self) -> None:
        self.held: dict[str, int] = {}
        self.starts, self.terms = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _numbers(self, word: str) -> list[int]:
        found = [self.vocabulary.get(t, self.bases.get(t)) for t in terms_of(word)]
        return [n for n in found if n is not None]

    def _learn(self, words: list[str]) -> None:
        """Words enter the table, which is emptied first where they would be too many."""
        distinct = dict.fromkeys(words)
        new = [w for w in distinct if w not in self.held]
        if len(self.held) + len(new) > self.most:
            self._clear()
            new = list(distinct)
        if new:
            found = [self._numbers(w) for w in new]
            self.held.update(zip(new, range(len(self.held), len(self.held) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(f) for f in found])])
            self.terms = np.concatenate([self.terms, np.array(list(chain.from_iterable(found)), np.int64)])

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the texts' terms, the terms' numbers, ascending in a text, and their counts."""
        words = [WORD.findall(t.lower()) for t in texts]
        flat = list(chain.from_iterable(words))
        self._learn(flat)
        number = np.fromiter(map(self.held.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        key, count = np.unique(doc * max(1, len(self.held)) + number, return_counts=True)
        doc, number = np.divmod(key, max(1, len(self.held)))
        starts, ends = self.starts[number], self.starts[number + 1]
        doc, count = np.repeat(doc, ends - starts), np.repeat(count, ends - starts)
        doc, term, count = _summed(doc, self.terms[_ranges(starts, ends)], count, self.numbers)
        if len(self.level):
            starts, ends = self.level_start[term], self.level_start[term + 1]
            at = _ranges(starts, ends)
            often = np.repeat(count, ends - starts) >= self.level[at]
            own = np.repeat(doc, ends - starts)[often]
            doc, term = np.concatenate([doc, own]), np.concatenate([term, self.leveled[at[often]]])
            count = np.concatenate([count, np.ones(len(own), np.int64)])
            doc, term, count = _summed(doc, term, count, self.numbers)
        kept = term < len(self.vocabulary)
        return np.searchsorted(doc[kept], np.arange(len(texts) + 1)), term[kept], count[kept]

    def counts(self, text: str) -> dict[int, int]:
        _, terms, counts = self.of_texts([text])
        return dict(zip(terms.tolist(), counts.tolist(), strict=True))


def _summed(doc: np.ndarray, term: np.ndarray, count: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts summed by text and term, in order."""
    key = doc * max(1, terms) + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(count[order], first) if len(first) else count[:0]
    return *np.divmod(key[first], max(1, terms)), total


@dataclass(frozen=True)
class Example:
    doc_id: int
    label: int
    terms: tuple[int, ...]
    counts: tuple[int, ...]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class BlockMaxIndex:
    """Distinct unit vectors in blocks. Equal ones are kept once, with all the examples they stand for."""

    def __init__(self, examples: list[Example], idf: np.ndarray, block: int = BLOCK):
        self.idf = idf
        groups: dict[tuple, list[Example]] = {}
        for e in examples:
            if e.terms:
                groups.setdefault((e.terms, e.counts), []).append(Example(e.doc_id, e.label, (), ()))
        # Like vectors lie together, which makes the bounds of blocks tight.
        keys = sorted(groups, key=lambda k: (k[0][int(np.argmax(self.weigh(*k)))], k))
        self.groups = [sorted(groups[k], key=lambda e: e.doc_id) for k in keys]
        self.sizes = np.array([len(g) for g in self.groups], np.int64)
        self.of: dict[int, list[int]] = {}
        for i, g in enumerate(self.groups):
            for e in g:
                self.of.setdefault(e.doc_id, []).append(i)
        self.block, self.blocks = block, -(-len(keys) // block)
        terms = np.concatenate([np.zeros(0, np.int64), *(np.array(k[0]) for k in keys)])
        rows = np.repeat(np.arange(len(keys)), [len(k[0]) for k in keys])
        weights = np.concatenate([np.zeros(0), *(self.weigh(*k) for k in keys)])
        order = np.lexsort((rows, terms))
        terms, self.rows, self.weights = terms[order], rows[order].astype(np.int32), weights[order]
        # Parts of posting lists: those of one term lie together, by block.
        part = terms * max(1, self.blocks) + self.rows // block
        first = np.flatnonzero(np.diff(part, prepend=-1))
        self.part_block = (self.rows[first] // block).astype(np.int32)
        self.part_start = np.append(first, len(terms))
        self.part_top = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_part = np.searchsorted(terms[first], np.arange(len(idf) + 1))
        # The longest posting lists are kept as rows of a matrix, whose products are faster.
        length = np.diff(self.part_start[self.term_part])
        common = np.argsort(-length, kind="stable")[:COMMON]
        self.slot = np.full(len(idf), -1, np.int32)
        self.slot[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(keys)))
        at = np.flatnonzero(self.slot[terms] >= 0)
        self.dense[self.slot[terms[at]], self.rows[at]] = self.weights[at]
        self.dense_top = np.maximum.reduceat(self.dense, np.arange(0, len(keys), block), axis=1) if keys else np.zeros((len(common), 0))

    def weigh(self, terms: tuple[int, ...], counts: tuple[int, ...]) -> np.ndarray:
        w = (1 + np.log(np.array(counts, float))) * self.idf[np.array(terms, np.int64)]
        return w / np.sqrt((w * w).sum())

    def _visit(self, scores: np.ndarray, dense: np.ndarray, rare: tuple[np.ndarray, ...], visited: np.ndarray) -> None:
        """Adds to ``scores`` what the visited blocks of each text hold: rare terms by parts of posting lists, common ones by products."""
        doc, parts, weights = (x[visited[rare[0], self.part_block[rare[1]]]] for x in rare)
        starts, ends = self.part_start[parts], self.part_start[parts + 1]
        at = _ranges(starts, ends)
        place = np.repeat(doc * scores.shape[1], ends - starts) + self.rows[at]
        scores += np.bincount(place, np.repeat(weights, ends - starts) * self.weights[at], scores.size).reshape(scores.shape)
        for b in np.flatnonzero(visited.any(axis=0)):
            some = np.flatnonzero(visited[:, b])
            own = slice(b * self.block, (b + 1) * self.block)
            scores[some, own] += dense[some] @ self.dense[:, own]

    def nearest_of(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int = NEAREST, but: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the groups of equal examples by falling cosine until they are ``k`` examples, with all ties of the last, and their cosines above 0.

        ``but`` names for each text the example that does not count.
        """
        n, groups = len(offsets) - 1, len(self.groups)
        if not groups:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        doc = np.repeat(np.arange(n), np.diff(offsets))
        w = (1 + np.log(counts.astype(float))) * self.idf[terms]
        w /= np.sqrt(np.bincount(doc, w * w, n))[doc]
        slot = self.slot[terms]
        has, lacks = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        dense = np.zeros((n, len(self.dense)))
        dense[doc[has], slot[has]] = w[has]
        first, last = self.term_part[terms[lacks]], self.term_part[terms[lacks] + 1]
        parts = _ranges(first, last)
        rare = np.repeat(doc[lacks], last - first), parts, np.repeat(w[lacks], last - first)
        bounds = np.bincount(rare[0] * self.blocks + self.part_block[parts], rare[2] * self.part_top[parts], n * self.blocks)
        bounds = bounds.reshape(n, self.blocks) + dense @ self.dense_top
        now = np.zeros(bounds.shape, bool)
        np.put_along_axis(now, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        scores = np.zeros((n, groups))
        self._visit(scores, dense, rare, now)
        # Every group holds an example, but one that may hold only the one that does not count.
        most = k + (but is not None)
        least = lambda: np.partition(scores, groups - most, axis=1)[:, groups - most] if groups > most else np.zeros(n)
        rest = ~now & (bounds > 0) & (bounds >= least()[:, None] - 1e-9)
        if rest.any():
            self._visit(scores, dense, rare, rest)
        row, group = np.nonzero((scores > 0) & (scores >= least()[:, None] - 1e-9))
        cut = np.searchsorted(row, np.arange(n + 1))
        out = []
        for i in range(n):
            some = group[cut[i] : cut[i + 1]]
            own = scores[i, some]
            order = np.argsort(-own, kind="stable")
            some, own = some[order], own[order]
            size = self.sizes[some]
            if but is not None and but[i] in self.of:
                size = size - np.isin(some, self.of[but[i]])
                some, own, size = some[size > 0], own[size > 0], size[size > 0]
            reached = int(np.searchsorted(np.cumsum(size), k))
            if reached < len(own):
                stop = int(np.searchsorted(-own, -(own[reached] - 1e-9), side="right"))
                some, own = some[:stop], own[:stop]
            out.append((some, own))
        return out

    def nearest(self, terms: tuple[int, ...], counts: tuple[int, ...], k: int = NEAREST, but: int | None = None) -> list[tuple[float, list[Example]]]:
        """The nearest groups of one text, as cosines and the examples that they stand for."""
        (groups, scores), *_ = self.nearest_of(np.array([0, len(terms)]), np.array(terms, np.int64), np.array(counts, np.int64), k, None if but is None else [but])
        return [(s, [e for e in self.groups[g] if e.doc_id != but]) for g, s in zip(groups.tolist(), scores.tolist(), strict=True)]


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps that fit ``y`` over ``x`` best: places and heights."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for i in order:
        steps.append([y[i] * weight[i], weight[i], x[i]])
        while len(steps) > 1 and (steps[-2][2] == steps[-1][2] or steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]):
            a, w, at = steps.pop()
            steps[-1] = [steps[-1][0] + a, steps[-1][1] + w, at]
    return np.array([s[2] for s in steps]), np.array([s[0] / s[1] for s in steps])


class Voter:
    """Scores by votes of the nearest examples."""

    def __init__(self, examples: list[Example], idf: np.ndarray, totals: tuple[int, int]):
        sampled = Counter(e.label for e in examples)
        self.weight = [totals[v] / sampled[v] if sampled[v] else 0.0 for v in (0, 1)]
        self.index = BlockMaxIndex(examples, idf)
        share = totals[1] / sum(totals) if sum(totals) else 0.5
        plain = Counter(e.label for e in examples if not e.terms)
        # One more example as the whole, so that no rate is had from nothing.
        self.plain = (plain[1] * self.weight[1] + share) / (plain[0] * self.weight[0] + plain[1] * self.weight[1] + 1)
        judged = [e for e in examples if e.terms]
        votes = np.array([self.vote(self.index.nearest(e.terms, e.counts, but=e.doc_id)) for e in judged])
        weights = np.array([self.weight[e.label] for e in judged])
        self.steps = rising(votes, np.array([e.label for e in judged], float), weights) if judged else (np.zeros(1), np.full(1, self.plain))

    def vote(self, near: list[tuple[float, list[Example]]]) -> float:
        total = [0.0, 0.0]
        for score, own in near:
            for e in own:
                total[e.label] += score * self.weight[e.label]
        return total[1] / sum(total) if sum(total) else self.plain

    def scores(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[tuple[float, list[dict]]]:
        """The calibrated score of each text, and the nearest examples as evidence."""
        out = []
        for k, (groups, cosines) in enumerate(self.index.nearest_of(offsets, terms, counts)):
            if offsets[k] == offsets[k + 1]:
                out.append((self.plain, []))
                continue
            near = [(s, self.index.groups[g]) for g, s in zip(groups.tolist(), cosines.tolist(), strict=True)]
            vote = self.vote(near)
            # A little of the vote keeps apart what one step of the calibration joins.
            score = 0.98 * float(np.interp(vote, *self.steps)) + 0.02 * vote
            out.append((score, [{"doc_id": e.doc_id, "cosine": s, "label": e.label} for s, own in near for e in own]))
        return out

    def score(self, terms: tuple[int, ...], counts: tuple[int, ...]) -> tuple[float, list[dict]]:
        """The score and the evidence of one text."""
        return self.scores(np.array([0, len(terms)]), np.array(terms, np.int64), np.array(counts, np.int64))[0]


def _distinct(sample: DataFrame) -> DataFrame:
    """The sample with one of each group of near copies left, so that copies do not make their words look telling.

    Texts are copies if the smallest hash of their 5-word shingles is the same, by either of two hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, rows = spans(data, offsets)
                value, rows = shingles(hashes(data, starts, ends, fold=True), rows, 5)
                first = np.searchsorted(rows, np.arange(part.num_rows + 1))
                least = [[int(mix(value[a:b] + np.uint64(k)).min().view(np.int64)) if b > a else 0 for a, b in zip(first[:-1], first[1:], strict=True)] for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "label", "text")), pa.array(least[0]), pa.array(least[1])], names=["doc_id", "label", "text", "a", "b"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, text string, a long, b long")
    for key in ("a", "b"):
        rows = rows.groupBy(key).agg(F.min_by(F.struct("doc_id", "label", "text", "a", "b"), "doc_id").alias("row")).select("row.*")
    return written(rows.select("doc_id", "label", "text"), "examples")


def strength(p: np.ndarray, q: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """The log-likelihood ratio of terms that are in ``p`` of the toxic and ``q`` of the clean examples, that the two rates differ."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    p, q, n = p.astype(float), q.astype(float), max(1, toxic + clean)
    has, lacks = (p + q) / n, (toxic + clean - p - q) / n
    return np.maximum(0.0, 2 * (part(p, has * toxic) + part(q, has * clean) + part(toxic - p, lacks * toxic) + part(clean - q, lacks * clean)))


def vocabulary_of(sample: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """The terms of a bounded sample, numbered in order, and what each weighs: all words, and beginnings and repetitions that tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                terms = []
                for x in part.column("text").to_pylist():
                    seen: Counter = Counter()
                    for w, n in Counter(WORD.findall(x.lower())).items():
                        seen.update(dict.fromkeys(terms_of(w), n))
                    terms.append([leveled(t, level) for t, n in seen.items() for level in (1, *LEVELS) if n >= level])
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(terms, pa.list_(pa.string()))], names=["label", "terms"])

    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    seen = sample.select("label", "text").mapInArrow(run, "label int, terms array<string>").select("label", F.explode("terms").alias("term"))
    counts = seen.groupBy("term").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    word = ~F.col("term").rlike("[*@]")
    found = counts.where(word | (F.col("p") + F.col("q") >= LEAST)).orderBy("term").toArrow()  # of a bounded sample
    ratio = strength(found["p"].to_numpy(), found["q"].to_numpy(), size.toxic, size.n - size.toxic)
    kept = [k for k, t in enumerate(found["term"].to_pylist()) if ratio[k] >= SIGNIFICANT or not ("*" in t or "@" in t)]
    terms = found["term"].take(pa.array(kept, pa.int64())).to_pylist()
    return {t: i for i, t in enumerate(terms)}, np.maximum(np.sqrt(ratio[kept]), WEAKEST)


def with_terms(df: DataFrame, vocabulary: dict[str, int], text: str = "text") -> DataFrame:
    """``df`` without its text, with ``terms`` (numbers, ascending) and ``counts``."""
    schema = added(df, ("terms", T.ArrayType(T.IntegerType())), ("counts", T.ArrayType(T.IntegerType())), dropped=(text,))
    names = schema.fieldNames()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # from a bounded sample

    def make():
        held = TermTable(shared.value)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            offsets, *found = held.of_texts([t or "" for t in part.column(text).to_pylist()])
            terms, counts = (pa.ListArray.from_arrays(offsets.astype(np.int32), v.astype(np.int32)) for v in found)
            return with_arrays(part, names, terms=terms, counts=counts)

        return step

    return map_slices(df, make, schema, text)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` for each row of ``docs``.

    ``score`` is the probability of label 1, ``evidence`` the nearest examples with their
    cosines and labels. A text without any word of the examples, as a null or empty one, has the
    rate of such examples and no evidence. Rows are independent, so repeated ones are scored alike;
    null ids pass and are not held out. Without labels every score is 0.5; an empty table gives
    an empty one. Other columns play no part.
    """
    sample = _distinct(labelled_sample(docs, labels, "toxic", per_class))
    vocabulary, strengths = vocabulary_of(sample)
    rows = written(with_terms(docs.select("doc_id", "text"), vocabulary), "terms")
    size = rows.count()
    found = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row a term
    df = np.zeros(len(vocabulary))
    df[found["term"].to_numpy()] = found["count"].to_numpy()
    idf = (np.log((1 + size) / (1 + df)) + 1) * strengths
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    counted = {r.label: r["count"] for r in known.groupBy("doc_id").agg(F.max("toxic").alias("label")).groupBy("label").count().collect()}
    examples = [
        Example(r.doc_id, r.label, tuple(r.terms), tuple(r.counts))
        for r in with_terms(sample, vocabulary).orderBy("doc_id", "label").collect()  # at most twice per_class
    ]
    voter = docs.sparkSession.sparkContext.broadcast(Voter(examples, idf, (counted.get(0, 0), counted.get(1, 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))])
            terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[start] + SLICE_TERMS, side="right")) - 1
                stop = min(max(stop, start + 1), start + SLICE_TEXTS)
                low, high = offsets[start], offsets[stop]
                found = voter.value.scores(offsets[start : stop + 1] - low, terms[low:high], counts[low:high])
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
                ids = batch.column("doc_id").slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([ids, pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], kind)], names=["doc_id", "score", "evidence"])
                start = stop

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>"
    scored = rows.mapInArrow(run, kind)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op4_toxicity")
def op4_toxicity(spark, folder):
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
