"""Removal of runs of lines that occurred earlier, by winnowing over line hashes.

Documents are ordered by id, then by a hash of the text; lines by place. Rows of equal id and
text count as one document. A window starts at
each line and takes as many lines as give ``min_words`` words. Its fingerprint is its line of
the smallest hash. Any repeated run of ``min_words`` words holds a whole window, hence its
fingerprint. Only fingerprints that occur twice are followed: their windows are matched with
the first occurrence of the same window, matches are extended both ways line by line, and the
later run of each match is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from imgcurate.session import written

from .arrow import give_back, slices, text_bytes
from .hashing import hashes, mix, prefix_sums, spans
from .keys import KEY, document_key
from .registry import query, table

MIN_WORDS = 50
#: More shifts between two texts than this are extended by numbered blocks.
FEW_SHIFTS = 16


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and number of words of each line, and the offsets of the rows' lines.

    Lines are what newlines separate, so a row has one line more than newlines. White space
    counts, as equal lines must be interchangeable; an empty line has no words and one hash.
    """
    n = len(data)
    breaks = np.flatnonzero(data == 0x0A)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    counts = np.bincount(row_of_break, minlength=len(offsets) - 1) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(first[-1], np.int64)
    at_row = np.zeros(first[-1], bool)
    at_row[first[:-1]] = True
    starts[at_row], starts[~at_row] = offsets[:-1], breaks + 1
    ends = np.empty(first[-1], np.int64)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    ends[last], ends[~last] = offsets[1:], breaks
    value = hashes(data, starts, ends)
    word_starts = spans(data, offsets)[0] if n else np.zeros(0, np.int64)
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    return value, words, first


def windows(value: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one document: first line, line after the last, place of the fingerprint, hash of the content."""
    total = np.concatenate([[0], np.cumsum(words)])
    stops = np.searchsorted(total, total[:-1] + min_words, side="left")
    starts = np.flatnonzero(stops <= len(words))
    stops = stops[starts]
    smallest = np.empty(len(starts), np.int64)
    content = np.empty(len(starts), np.uint64)
    # The minimum of a sliding window: a queue of lines that may still become one.
    queue: list[int] = []
    head, end = 0, 0
    for k, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        end = max(end, a)
        while end < b:
            while len(queue) > head and value[queue[-1]] > value[end]:
                queue.pop()
            queue.append(end)
            end += 1
        while queue[head] < a:
            head += 1
        smallest[k] = queue[head]
    if len(starts):
        content = mix(prefix_sums(mix(value + np.uint64(7)), starts, stops) + (stops - starts).astype(np.uint64))
    return starts, stops, smallest, content


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each text: its lines' hashes, and its windows with fingerprints."""
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("tie", T.LongType()),
            T.StructField("lines", T.BinaryType()),
            T.StructField("start", T.ArrayType(T.IntegerType())),
            T.StructField("mark", T.ArrayType(T.IntegerType())),
            T.StructField("fingerprint", T.ArrayType(T.LongType())),
            T.StructField("content", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                value, words, first = line_table(data, offsets)
                lines, start, mark, fingerprint, content = [], [], [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = value[a:b]
                    s, _, m, c = windows(own, words[a:b], min_words)
                    lines.append(own.tobytes())
                    start.append(s.astype(np.int32))
                    mark.append(m.astype(np.int32))
                    fingerprint.append(own[m].view(np.int64))
                    content.append(c.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("tie"),
                        pa.array(lines, pa.binary()),
                        pa.array(start, pa.list_(pa.int32())),
                        pa.array(mark, pa.list_(pa.int32())),
                        pa.array(fingerprint, pa.list_(pa.int64())),
                        pa.array(content, pa.list_(pa.int64())),
                    ],
                    names=schema.fieldNames(),
                )
        give_back()

    return docs.select(*document_key(), "text").mapInArrow(run, schema)


def _block_classes(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each power of two, numbers of the blocks of so many lines in both texts; equal blocks have equal numbers."""
    _, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    levels = [(number[: len(x)], number[len(x) :])]
    size = 1
    while 2 * size <= min(len(x), len(y)):
        joined = [own[:-size].astype(np.int64) * (len(x) + len(y)) + own[size:] for own in levels[-1]]
        _, number = np.unique(np.concatenate(joined), return_inverse=True)
        number = number.astype(np.int32)
        levels.append((number[: len(joined[0])], number[len(joined[0]) :]))
        size *= 2
    return levels


def _reached(levels: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, firsts: np.ndarray, back: bool) -> np.ndarray:
    """How many lines are equal from places on, or before them if ``back``; longest blocks first."""
    i, j = starts.copy(), firsts.copy()
    for k in range(len(levels) - 1, -1, -1):
        x, y = levels[k]
        a, b = (i - (1 << k), j - (1 << k)) if back else (i, j)
        some = np.flatnonzero((a >= 0) & (b >= 0) & (a < len(x)) & (b < len(y)))
        some = some[x[a[some]] == y[b[some]]]
        step = -(1 << k) if back else 1 << k
        i[some] += step
        j[some] += step
    return np.abs(i - starts)


def matched_runs(later: bytes, earlier: bytes, starts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``[low, high)`` of lines of ``later``, apart and ascending, that hold a start and are equal to ``earlier`` around its first place.

    Few shifts are compared line by line, each whole; many would make this the square of the
    lines, so there blocks of lines are numbered and every start is extended by them.
    """
    x, y = np.frombuffer(later, np.uint64), np.frombuffer(earlier, np.uint64)
    shifts = np.unique(starts - firsts)
    if len(shifts) <= FEW_SHIFTS:
        runs = []
        for shift in shifts.tolist():
            low, high = max(0, shift), min(len(x), len(y) + shift)
            equal = np.concatenate([[False], x[low:high] == y[low - shift : high - shift], [False]])
            edges = np.flatnonzero(equal[1:] != equal[:-1]) + low
            at = np.unique(np.searchsorted(edges, starts[starts - firsts == shift], side="right")) - 1
            runs.append(np.stack([edges[at], edges[at + 1]]))
        low, high = np.concatenate(runs, axis=1)
    else:
        levels = _block_classes(x, y)
        low, high = starts - _reached(levels, starts, firsts, True), starts + _reached(levels, starts, firsts, False)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    return low[new], high[np.append(new[1:], len(low)) - 1]


def _extended(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "first_lines"):
                which, low, high = [], [], []
                seeds = part.column("seeds")
                offsets = seeds.offsets.to_numpy()
                places = [seeds.values.field(name).to_numpy() for name in ("start", "first_start")]
                for k in range(part.num_rows):
                    own = [p[offsets[k] : offsets[k + 1]].astype(np.int64) for p in places]
                    a, b = matched_runs(part.column("lines")[k].as_py(), part.column("first_lines")[k].as_py(), *own)
                    which.append(np.full(len(a), k, np.int32))
                    low.append(a)
                    high.append(b)
                which = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(which), part.column("tie").take(which), *(pa.array(np.concatenate(v).astype(np.int32)) for v in (low, high))],
                    names=["id", "tie", "low", "high"],
                )

    wanted = pairs.select("id", "tie", "lines", "first_lines", "seeds")
    return wanted.mapInArrow(run, "id long, tie long, low int, high int")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, tie, deleted)``: the places of the lines that go from a document, ascending.

    Every join meets a written table, so that hot lines and passages are split by size at run
    time and small sides are broadcast only where their size is known.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    lines = written(_lines(docs, min_words), "lines")
    own = written(lines.groupBy(*KEY).agg(F.first("lines").alias("lines")), "own-lines")
    seen = lines.select(*KEY, F.explode(F.arrays_zip("start", "mark", "fingerprint", "content")).alias("w")).select(*KEY, "w.*")
    place = F.struct(*KEY, "mark")
    twice = seen.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("fingerprint")
    seen = written(seen.join(written(twice, "fingerprints"), "fingerprint", "left_semi").drop("mark", "fingerprint"), "windows")
    place = F.struct(*KEY, "start")
    first = seen.groupBy("content").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b")
    first = written(first.select("content", F.col("a.id").alias("first_id"), F.col("a.tie").alias("first_tie"), F.col("a.start").alias("first_start")), "first")
    seeds = (
        seen.join(first, "content")
        .where("id != first_id or tie != first_tie or start != first_start")
        .groupBy(*KEY, "first_id", "first_tie")
        .agg(F.collect_list(F.struct("start", "first_start")).alias("seeds"))
    )
    earlier = own.select(F.col("id").alias("first_id"), F.col("tie").alias("first_tie"), F.col("lines").alias("first_lines"))
    pairs = seeds.join(own, KEY).join(earlier, ["first_id", "first_tie"])
    # What a run adds to those that begin before it.
    before = F.max("high").over(Window.partitionBy(*KEY).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    runs = _extended(pairs).withColumn("low", F.greatest(F.col("low"), before)).where("low < high")
    places = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "high"))), lambda r: F.sequence(r["low"], r["high"] - 1)))
    return written(runs.groupBy(*KEY).agg(places.alias("deleted")), "deleted")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeats of runs of lines deleted from ``text``, and ``n_lines``, ``n_deleted``.

    A window of ``min_words`` words that occurred before is matched with its first occurrence,
    the match is extended both ways, and its later side goes. Every row comes out once; a
    text of repeats only becomes empty, a null text stays null with no lines. Rows of equal id
    and text have equal results. A null id comes first in the order. An empty table gives an
    empty one. Other columns pass unchanged; those named like the two counts are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    rows = docs.select(F.struct(*own).alias("row"), "doc_id", "text")
    gone = deleted_lines(rows, min_words)
    cut = (
        rows.select("row", *document_key())
        .join(gone.hint("shuffle_hash"), KEY, "left")  # rows of one document only; the same plan at every size
        .select("row", "deleted", F.split("row.text", "\n", -1).alias("lines"))
        .withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "deleted"))
    )
    rest = F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n")
    text = F.when(F.col("deleted").isNull(), F.col("row.text")).otherwise(rest)
    return cut.select(
        *[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own],
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.when(F.col("deleted").isNotNull(), F.size("deleted")), F.lit(0)).alias("n_deleted"),
    )


@query("op10_line_dedup")
def op10_line_dedup(spark, folder):
    return dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
