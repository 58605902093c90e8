"""Streaming forms of operators that make sense on arriving data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from imgcurate.functions.arith import floor_div
from imgcurate.functions.bits import with_band_keys
from imgcurate.operators.dedup import dedup_first_wins

KEPT = "image_id long, words array<long>"


def incremental_scan(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Files as they arrive; the checkpoint of the query remembers those seen."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "modificationTime", "length")


def dedup_exact_stream(frames: DataFrame, delay: str) -> DataFrame:
    """First arrival of every hash; the state of a hash is dropped after ``delay``.

    Copies that come later than that are let through. ``dedup_stream`` with
    ``threshold=0`` keeps a table of all hashes instead and lets none through.
    """
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["words"])


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table whose batches are folders named by their number; empty before the first."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], f"{schema}, batch long")


RESPONSES = "request_id long, response string, ended boolean"
FRAGMENT_STATE = "seqs array<long>, texts array<string>, last long"


def _fragments(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The response of one request after its new fragments, and those up to its end as state."""
    seqs, texts, last = state.get if state.exists else ([], [], None)
    held = list(zip(seqs, texts))
    fresh = False
    for rows in batches:
        for seq, text, done in zip(rows["seq"], rows["fragment"], rows["done"]):
            if pd.isna(seq):
                continue
            seq = int(seq)
            if last is not None and seq > last:
                continue
            fresh = True
            held.append((seq, "" if text is None else text))
            if done is not None and not pd.isna(done) and done:
                last = seq
                held = [h for h in held if h[0] <= last]
    if fresh:
        held.sort()
        state.update(([s for s, _ in held], [t for _, t in held], last))
        yield pd.DataFrame({"request_id": [key[0]], "response": ["".join(t for _, t in held)], "ended": [last is not None]})


def assemble_fragments_stream(chunks: DataFrame, table: str) -> DataStreamWriter:
    """M5: responses as requests end, whatever the pauses between their fragments.

    ``chunks(request_id, seq, fragment, done)``. The state of a request is its fragments up to its
    end, so a batch costs what it brings and what the requests it touches hold; earlier batches are
    not read. A batch writes the texts of the requests it touches to ``table/batch=<number>``, ended
    or not, over what an earlier attempt of it wrote. ``responses`` and ``open_requests`` read the newest.
    Fragments behind the first ``done`` are cut off, as are those without a ``seq``; an end that comes
    later but lies before cuts the response anew. State is kept for ever, so choose the RocksDB
    provider of state for streams of many requests.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    rows = chunks.select(F.col("request_id").cast("long").alias("request_id"), F.col("seq").cast("long").alias("seq"), "fragment", "done")
    texts = rows.groupBy("request_id").applyInPandasWithState(_fragments, RESPONSES, FRAGMENT_STATE, "update", GroupStateTimeout.NoTimeout)
    return texts.writeStream.outputMode("update").foreachBatch(write)


def _newest(spark: SparkSession, table: str) -> DataFrame:
    known = _stored(spark, table, RESPONSES)
    return known.groupBy("request_id").agg(F.max_by(F.struct("response", "ended"), "batch").alias("r")).select("request_id", "r.*")


def responses(spark: SparkSession, table: str) -> DataFrame:
    """M5: ``(request_id, response)`` of the requests that have ended, with all fragments that have come."""
    return _newest(spark, table).filter("ended").drop("ended")


def open_requests(spark: SparkSession, table: str) -> DataFrame:
    """M5: what there is of the requests that have not ended, to be called when no more will come."""
    return _newest(spark, table).filter("not ended").drop("ended")


SESSIONS = "video string, start_ts timestamp, end_ts timestamp, frames long"
BLOCKS = "video string, block long, start_us long, end_us long, frames long"
BLOCK_STATE = "starts array<long>, ends array<long>, frames array<long>"
#: Gaps in a block, which bounds the clusters of one and with them a state.
BLOCK_GAPS = 1000


def _merged(sessions: DataFrame, gap: str) -> DataFrame:
    """Sessions of a video that lie at most ``gap`` apart become one."""
    ordered = Window.partitionBy("video").orderBy("start_ts", "end_ts")
    before = F.max("end_ts").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start_ts") > before + F.expr(f"INTERVAL {gap}"), F.lit(True)).cast("int")
    numbered = sessions.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(ordered))
    return (
        numbered.groupBy("video", "_session")
        .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("frames").alias("frames"))
        .drop("_session")
    )


def cluster_ranges_stream(frames: DataFrame, table: str, gap: str = "10 seconds") -> DataStreamWriter:
    """R2: a table of clusters of high frames, kept up to date; a gap of exactly ``gap`` still merges.

    Time is cut into blocks, and the clusters of a block of a video are its state, a thousand at
    most. A batch costs what it brings and the blocks it touches, however late their frames come and
    however long the video; it writes these blocks to ``table/batch=<number>``. ``stored_clusters``
    reads the newest of each block and joins clusters that go on in the next one. Frames without a
    time are left out.
    """
    gap_us = frames.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {gap})")).first()[0]

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [])
        starts, ends, counts = (np.array(c, np.int64) for c in held)
        for rows in batches:
            times, n = np.unique(rows["us"].to_numpy(np.int64), return_counts=True)
            starts, ends, counts = (np.concatenate(c) for c in ((starts, times), (ends, times), (counts, n)))
            order = np.argsort(starts, kind="stable")
            starts, ends, counts = starts[order], ends[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], starts[1:] - np.maximum.accumulate(ends)[:-1] > gap_us]))
            starts, ends, counts = starts[first], np.maximum.reduceat(ends, first), np.add.reduceat(counts, first)
        state.update((starts.tolist(), ends.tolist(), counts.tolist()))
        yield pd.DataFrame({"video": key[0], "block": key[1], "start_us": starts, "end_us": ends, "frames": counts})

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    rows = frames.filter("ts is not null").select("video", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = rows.withColumn("block", floor_div("us", BLOCK_GAPS * max(1, gap_us)))
    blocks = rows.groupBy("video", "block").applyInPandasWithState(merge, BLOCKS, BLOCK_STATE, "update", GroupStateTimeout.NoTimeout)
    return blocks.withColumn("gap", F.lit(gap)).writeStream.outputMode("update").foreachBatch(write)


def stored_clusters(spark: SparkSession, table: str) -> DataFrame:
    """R2: the clusters after all batches, open ones included."""
    known = _stored(spark, table, f"{BLOCKS}, gap string")
    last = known.groupBy(F.col("video").alias("_video"), F.col("block").alias("_block")).agg(F.max("batch").alias("_batch"))
    same = F.col("video").eqNullSafe(F.col("_video")) & (F.col("block") == F.col("_block")) & (F.col("batch") == F.col("_batch"))
    gap = known.select("gap").first()
    newest = known.join(last, same).select(
        "video", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "frames"
    )
    return newest if gap is None else _merged(newest, gap[0])


def dedup_against_kept(batch: DataFrame, kept: DataFrame, threshold: int, bits: int) -> DataFrame:
    """Rows of a batch that repeat neither a kept row nor an earlier kept one of the batch.

    All kept rows come before the batch and are no near copies of each other. So the
    kept rows that share a band key with the batch are put in front of it; the
    others cannot matter.
    """
    new = batch.select("image_id", "words", F.lit(False).alias("_old"))
    keys = with_band_keys(new.filter("words is not null").select("words"), bits, threshold, 1).select("key").distinct()
    touched = with_band_keys(kept.filter("words is not null"), bits, threshold, 1).join(keys.hint("merge"), "key", "left_semi")
    old = touched.dropDuplicates(["image_id"]).select("image_id", "words", F.lit(True).alias("_old"))
    marked = dedup_first_wins(old.unionByName(new), threshold, bits)
    return marked.filter("not is_duplicate and not _old").select("image_id", "words")


def dedup_stream(
    frames: DataFrame, table: str, threshold: int = 6, bits: int = 256
) -> DataStreamWriter:
    """D3: keep a Parquet table of kept hashes up to date from a stream.

    ``image_id`` must grow with arrival. Every batch writes a folder of its own,
    named by its number, so a batch that runs again replaces its own rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("image_id", "words")
        kept = _stored(batch.sparkSession, table, KEPT)
        fresh = dedup_against_kept(rows, kept.filter(F.col("batch") < number), threshold, bits)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return frames.writeStream.foreachBatch(merge)


def kept_hashes(spark: SparkSession, table: str) -> DataFrame:
    """D3: the rows that ``dedup_stream`` has kept; none before its first batch."""
    return _stored(spark, table, KEPT)
