"""Frequent phrases of each language and how strongly their words belong together, by fingerprints.

Texts are cut into pieces at punctuation and pieces into words. A word's fingerprint is a
polynomial over its bytes, a phrase's one over the fingerprints of its words, both read off
running sums (see ``hashing``), so every phrase of a text costs the same whatever its length.

1. Fingerprints of single words are counted, then those of longer phrases level by level. A
   phrase can be frequent only if the two phrases that lack its first and its last word are, so
   others are left out by a filter of bounded size. Colliding fingerprints only add counts.
2. Phrases with a frequent fingerprint are taken up once more, with their words, their number and
   a pointer to an occurrence (document and byte). Equal ones of a slice are put together by
   their words, not their fingerprints; so are those of all slices. Fingerprints that collide
   come apart here, and only frequent phrases are ever made into strings.
3. Phrases are scored by the counts of their parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgcurate.operators.ranking import with_position
from imgcurate.session import written

from .arrow import give_back, slices, text_bytes
from .decontamination import passing, seed_filter
from .hashing import hashes, mix, prefix_sums, spans
from .keys import document_key
from .registry import query, table
from .salted import salted_lookup

LEAST = 10
MOST_WORDS = 3
TOP = 2000
#: Percent of a phrase's occurrences that lie in a longer one which then stands for it.
COVERED = 50
UNKNOWN = "und"
#: Bits of the filter of frequent phrases for each of them, and at most (64 MB).
FILTER_BITS = 16
FILTER_LOG2_MOST = 29
#: Fingerprints that a task holds before it gives its counts away, and bytes of text that it takes up at once.
HELD = 1 << 20
COUNTED_BYTES = 1 << 20
TEXT_BYTES = 2 << 20

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] = np.arange(97, 123)


class Words:
    """The words of a slice, and where their pieces begin and end."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = text_bytes(part.column("text"))
        self.starts, self.ends, self.rows = spans(data, offsets, WORD)
        breaks = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int32)])
        # Both terms only grow, so their sum changes wherever one of them does.
        self.piece = breaks[self.starts] + self.rows
        self.data, self.offsets = data, offsets
        langs = pc.fill_null(part.column("lang"), UNKNOWN).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[self.rows].astype(np.int64)
        seeds = [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in self.langs]
        self.seed = np.array([*seeds, 0], np.uint64)[self.lang]
        self.value = hashes(data, self.starts, self.ends, fold=True)

    def places(self, size: int) -> np.ndarray:
        """The first words of all phrases of ``size`` words."""
        n = max(0, len(self.piece) - size + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 :])

    def fingerprints(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix(prefix_sums(self.value, at, at + size) ^ mix(self.seed[at] + np.uint64(size)))

    def exact(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words only, and the words by number."""
        data = FOLDED[self.data][WORD[self.data]]
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts, dtype=np.int64)])
        words = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
        known = words.dictionary_encode()
        return known.indices.to_numpy().astype(np.int64), known.dictionary


def _candidates(words: Words, size: int, bits: np.ndarray | None) -> np.ndarray:
    """First words of the phrases whose parts without the first and without the last word pass the filter."""
    at = words.places(size)
    if bits is None:
        return at
    shorter = np.zeros(len(words.piece) + 1, bool)
    places = words.places(size - 1)
    shorter[places[passing(words.fingerprints(places, size - 1), bits)]] = True
    return at[shorter[at] & shorter[at + 1]]


def fingerprint_counts(docs: DataFrame, size: int, bits: np.ndarray | None) -> DataFrame:
    """``(seed, n)``: how often each fingerprint of phrases of ``size`` words occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def together() -> tuple[np.ndarray, np.ndarray]:
            value = np.concatenate([v for v, _ in held])
            count = np.concatenate([c for _, c in held])
            order = np.argsort(value)
            value, count = value[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            return value[first], np.add.reduceat(count, first)

        def given(value: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(value), 1 << 16):
                own = [pa.array(value[k : k + (1 << 16)].view(np.int64)), pa.array(count[k : k + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(own, names=["seed", "n"])

        for batch in batches:
            for part in slices(batch, "text", COUNTED_BYTES):
                words = Words(part)
                at = _candidates(words, size, shared.value)
                if not len(at):
                    continue
                held.append(np.unique(words.fingerprints(at, size), return_counts=True))
                if sum(len(v) for v, _ in held) > 2 * HELD:
                    held = [together()]
                    if len(held[0][0]) > HELD:
                        yield from given(*held.pop())
        if held:
            yield from given(*together())
        held.clear()
        give_back()

    rows = docs.select("lang", "text").mapInArrow(run, "seed long, n long")
    return rows.groupBy("seed").agg(F.sum("n").alias("n"))


def phrases_with(docs: DataFrame, bits: np.ndarray, most_words: int) -> DataFrame:
    """``(lang, phrase, words, f, id, at)`` of all phrases whose fingerprints pass the filter.

    ``id`` and ``at`` point to the occurrence in the document of the smallest id, at a byte of its
    text. The phrase of no words is there too; its ``f`` is the number of words of the language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                words = Words(part)
                if not len(words.piece):
                    continue
                number, known = words.exact()
                langs = pa.array(words.langs, pa.string())
                ids = part.column("id")
                count = np.bincount(words.lang, minlength=len(words.langs))
                some = np.flatnonzero(count)
                null = pa.nulls(len(some), pa.int64())
                yield _row(langs.take(pa.array(some)), pa.array([""] * len(some)), 0, count[some], null, null)
                for size in range(1, most_words + 1):
                    at = words.places(size)
                    at = at[passing(words.fingerprints(at, size), shared.value)]
                    if not len(at):
                        continue
                    key = words.lang[at]
                    for k in range(size):
                        key = np.unique(key, return_inverse=True)[1] << 32 | number[at + k]
                    # Rows are in the order of documents' places, and so is each phrase's first occurrence.
                    _, first, count = np.unique(key, return_index=True, return_counts=True)
                    at = at[first]
                    text = [known.take(pa.array(number[at + k])) for k in range(size)]
                    text = pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string())) if size > 1 else text[0]
                    row = words.rows[at]
                    place = pa.array(words.starts[at] - words.offsets[row])
                    yield _row(langs.take(pa.array(words.lang[at])), text.cast(pa.string()), size, count, ids.take(pa.array(row)), place)
        give_back()

    kind = "lang string, phrase string, words int, f long, id long, at long"
    rows = docs.select("lang", "id", "text").mapInArrow(run, kind)
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"), F.min("id").alias("id"), F.min_by("at", "id").alias("at"))


def _row(lang: pa.Array, phrase: pa.Array, size: int, count: np.ndarray, ids: pa.Array, at: pa.Array) -> pa.RecordBatch:
    sizes = pa.array(np.full(len(phrase), size, np.int32))
    return pa.RecordBatch.from_arrays(
        [lang, phrase, sizes, pa.array(count.astype(np.int64)), ids, at], names=["lang", "phrase", "words", "f", "id", "at"]
    )


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """``(lang, phrase, words, f, id, at)`` of the phrases of one to ``most_words`` words that occur ``least`` times and more.

    With them comes, for each language, the phrase of no words, counted once a word.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), document_key()[0], "text")
    bits, frequent = None, None
    for size in range(1, most_words + 1):
        level = written(fingerprint_counts(rows, size, bits).where(F.col("n") >= least).select("seed"), f"phrases-{size}")
        frequent = level if frequent is None else frequent.unionByName(level)
        bits = seed_filter(level, FILTER_BITS, FILTER_LOG2_MOST)
    bits = seed_filter(frequent, FILTER_BITS, FILTER_LOG2_MOST)
    return phrases_with(rows, bits, most_words).where((F.col("f") >= least) | (F.col("words") == 0))


def mined_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, covered: int = COVERED) -> DataFrame:
    """``(lang, phrase, words, a, l, r, n, score, doc_id, at)`` of each phrase of two words and more.

    ``a`` counts the phrase; ``l`` and ``r`` its first part and its rest, cut where ``score``,
    ``floor(1000000 * a * a / (l * r))``, is lowest (ties: after the fewest words); ``n`` all words
    of the language. A phrase within a longer frequent one that has at least ``covered`` percent of
    its occurrences is left out. ``doc_id`` and ``at`` point to an occurrence.

    Everything is per language, null being ``und``. Null and empty texts hold nothing, repeated rows
    count as often as they are there, null ids are pointed to by a null, an empty table gives an
    empty one, and other columns play no part. Decimals of 38 digits hold the products for counts
    below 10**16.
    """
    if least < 1 or most_words < 2:
        raise ValueError("least must be positive, and phrases have two words and more")
    known = written(frequent_phrases(docs, least, most_words), "phrases")
    parts = known.where("words > 0").select("lang", "phrase", "f")
    found = known.where("words > 1").withColumnRenamed("f", "a").withColumn("list", F.split("phrase", " "))
    piece = lambda start, size: F.array_join(F.slice("list", start, size), " ")
    cuts = found.select("lang", "phrase", "words", "a", "list", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    for name, count in (("first", "l"), ("rest", "r")):
        cuts = salted_lookup(cuts, parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)), ["lang", name], F.col("phrase"))
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.where("words > 2").select("lang", "a", "list", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "list", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    inner = inner.groupBy("lang", piece(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    total = known.where("words = 0").select("lang", F.col("f").alias("n"))
    out = found.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a")))
    out = out.join(scored, ["lang", "phrase"]).join(total, "lang")
    pointer = F.when(F.col("id") != F.lit(-(2**63)), F.col("id")).alias("doc_id")
    return out.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score", pointer, "at")


def top_phrases(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """``phrases`` with ``rank``: the first ``top`` of each language by score, count and phrase."""
    placed = with_position(phrases, [F.col("score").desc(), F.col("a").desc(), "phrase"], ["lang"], position="rank", total="_of")
    return placed.where(F.col("rank") < top).withColumn("rank", F.col("rank") + 1).drop("_of")


@query(
    "op11_phrase_mining",
    r"""
    WITH docs AS (
      SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
             string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[.,;:!?\x0A-\x0D]') AS pieces
      FROM documents),
    pieces AS (SELECT lang, unnest(pieces) AS piece FROM docs),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    sizes AS (SELECT unnest([1, 2, 3]) AS size),
    grams AS (
      SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i
      FROM lists, sizes WHERE len(w) >= size),
    f AS (
      SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*)::BIGINT AS f
      FROM grams GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
    cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
    parts AS (
      SELECT c.lang, c.phrase, c.a, c.size, c.w, k, l.f AS l, r.f AS r,
             (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts c
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
    best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (
      SELECT lang, phrase, max(a) AS m FROM (
        SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE size = 3
        UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE size = 3) GROUP BY ALL),
    kept AS (
      SELECT b.lang, b.phrase, b.a, b.l, b.r, n.n, b.score
      FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
      WHERE g.m IS NULL OR 100 * g.m < 50 * b.a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    WHERE rank <= 2000
    """,
)
def op11_phrase_mining(spark, folder):
    found = mined_phrases(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return top_phrases(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
