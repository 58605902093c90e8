"""Exact deduplication of a stream of documents with keyed state on disk.

1. New files are digested: SHA-256 of each whole text with A-Z as a-z, next to the row's id and its
   locator (file and place in the file). Texts are not kept.
2. A stateful aggregation keeps a row for each digest, for ever: how many texts had it, the row
   that stays (largest id) and the row that had it first, each as id and locator. Its state lies
   in RocksDB, and only digests of the new files are looked up. Tasks combine their rows of a
   digest before the shuffle, so copies of one text are a row a task.
3. A digest that more than one row has is a hit. The bytes of all its new rows and of the first
   one, which its locator leads to, are compared: the smallest and the largest of them must be
   one. Smallest and largest combine in tasks, too. Digests of unequal bytes are written down, and
   their rows are told apart by their texts in the result.

Each step writes over what an interrupted attempt of the same batch has written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.session import file_system, path_exists, scratch_path, written

from .arrow import give_back, slices
from .decontamination import passing, seed_filter
from .registry import query
from .salted import salted_lookup

ROWS = "doc_id long, text string"
ENTRY = "doc_id long, digest string, path string, row long"
#: State on disk; no room is set aside in advance, as that takes megabytes a partition however small.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of files that a batch takes in, and hex digits of a digest that are the key of the state.
BATCH_BYTES = 64 << 30
DIGITS = 64


def normalised(part: pa.RecordBatch) -> pa.Array:
    """Texts with A-Z as a-z; null as empty."""
    return pc.ascii_lower(pc.fill_null(part.column("text"), ""))


def digests(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(t).hexdigest() for t in texts.cast(pa.large_binary()).to_pylist()]


def _located(docs: DataFrame) -> DataFrame:
    # Only the two columns of ROWS are read, so that no other column hides the metadata.
    return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))


def _digested(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digests(normalised(part)), pa.string()), part.column("path"), part.column("row")],
                    names=["doc_id", "digest", "path", "row"],
                )
        give_back()

    return _located(docs).mapInArrow(run, ENTRY)


def _watched(spark: SparkSession, source: str) -> str:
    """A path that a stream can watch: of one file a pattern that it alone fits, as streams take folders and patterns."""
    system, known = file_system(spark, source)
    return f"{source[:-1]}[{source[-1]}]" if system.exists(known) and not system.getFileStatus(known).isDirectory() else source


class StreamingDedup:
    """Documents of the Parquet files under ``source``, deduplicated as files come.

    ``store`` is a folder in the shared file system that holds digests and checkpoints; another
    object on the same folder goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, source: str, store: str | None = None, digits: int = DIGITS, batch_bytes: int = BATCH_BYTES):
        self.spark, self.source, self.digits, self.batch_bytes = spark, source, digits, batch_bytes
        self.store = store or scratch_path(spark, "streaming-dedup")

    def advance(self) -> None:
        """Take in all files that have come since."""
        self._ingest()
        self._update()

    def _ingest(self) -> None:
        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("seq", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.store}/entries/{number:09d}")

        stream = self.spark.readStream.schema(ROWS).option("maxBytesPerTrigger", self.batch_bytes).parquet(_watched(self.spark, self.source))
        run = _digested(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{self.store}/ingest")
        run.trigger(availableNow=True).start().awaitTermination()

    def _update(self) -> None:
        if not path_exists(self.spark, f"{self.store}/entries"):
            return
        stream = self.spark.readStream.schema(f"{ENTRY}, seq long").parquet(f"{self.store}/entries/*")
        state = (
            stream.withColumn("key", F.substring("digest", 1, self.digits))
            .groupBy("key")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.max(F.struct("doc_id", "path", "row")).alias("keep"),
                F.min(F.struct("seq", "path", "row")).alias("first"),
                F.max("seq").alias("last_seq"),
            )
        )
        before = {name: self.spark.conf.get(name, None) for name in STATE}
        for name, value in STATE.items():
            self.spark.conf.set(name, value)
        try:
            run = state.writeStream.outputMode("update").foreachBatch(self._touched).option("checkpointLocation", f"{self.store}/state")
            run.trigger(availableNow=True).start().awaitTermination()
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def _touched(self, batch: DataFrame, number: int) -> None:
        """Write the state of the digests of a batch, and check the bytes of hits."""
        spark, groups = batch.sparkSession, f"{self.store}/groups"
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{groups}/{number:09d}")
        hits = spark.read.parquet(f"{groups}/{number:09d}").where("n > 1")
        seen = -1
        if number:
            seen = spark.read.parquet(f"{groups}/{number - 1:09d}").agg(F.max("last_seq")).first()[0]
        entries = spark.read.parquet(f"{self.store}/entries/*").where(F.col("seq") > F.lit(-1 if seen is None else seen))
        paths = entries.select("path").unionByName(hits.select("first.path")).distinct()
        texts = self._texts(spark, paths, hits.select("key"))
        unequal = texts.groupBy("key").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").select("key")
        unequal.write.mode("overwrite").parquet(f"{self.store}/unequal/{number:09d}")

    def _texts(self, spark: SparkSession, paths: DataFrame, keys: DataFrame) -> DataFrame:
        """``(key, doc_id, path, row, text)`` of the files ``paths``: all rows with one of ``keys``, and few others.

        Names of files go to the driver, which lists them for any scan; keys reach the scan as a
        filter of bounded size.
        """
        files = [unquote(r.path) for r in paths.collect()]
        if not files:
            return spark.createDataFrame([], "key string, doc_id long, path string, row long, text binary")
        seeds = keys.select(F.xxhash64("key").alias("seed"))
        shared, digits = spark.sparkContext.broadcast(seed_filter(seeds)), self.digits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = pa.array(passing(batch.column("seed").to_numpy().view("uint64"), shared.value))
                if not len(some):
                    continue
                few = batch.take(some)
                texts = normalised(few).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [few.column("key"), few.column("doc_id"), few.column("path"), few.column("row"), texts],
                    names=["key", "doc_id", "path", "row", "text"],
                )
            give_back()

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keys = pa.array([d[:digits] for d in digests(normalised(part))], pa.string())
                    yield pa.RecordBatch.from_arrays([keys, *part.columns], names=["key", *part.schema.names])

        rows = _located(spark.read.schema(ROWS).parquet(*files))
        rows = rows.mapInArrow(keyed, "key string, doc_id long, text string, path string, row long")
        return rows.withColumn("seed", F.xxhash64("key")).mapInArrow(run, "key string, doc_id long, path string, row long, text binary")

    def result(self) -> DataFrame:
        """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row taken in so far.

        Of rows with equal texts the one with the largest id stays, of repeated ids the last by
        locator; a null id is the least. Null texts count as empty and equal each other.
        """
        spark = self.spark
        if not path_exists(spark, f"{self.store}/entries"):
            return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
        entries = spark.read.parquet(f"{self.store}/entries/*").withColumn("key", F.substring("digest", 1, self.digits))
        groups = spark.read.parquet(f"{self.store}/groups/*").groupBy("key").agg(F.max(F.struct("batch", "n", "keep")).alias("g")).select("key", "g.n", "g.keep")
        place = F.struct("path", "row")
        rows = salted_lookup(entries, groups, ["key"], place)
        unequal = spark.read.parquet(f"{self.store}/unequal/*").distinct()
        if not unequal.isEmpty():
            unequal = written(unequal, "unequal")
            told = entries.join(unequal, "key", "left_semi")
            texts = self._texts(spark, told.select("path").distinct(), unequal).join(unequal, "key", "left_semi")
            texts = written(texts, "unequal-texts")
            own = texts.groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "path", "row")).alias("keep"))
            digest = F.sha2("text", 256)
            apart = salted_lookup(texts.withColumn("digest", digest), own, ["key", "text"], place).drop("text")
            rows = rows.join(unequal, "key", "left_anti").drop("seq").unionByName(apart)
        return rows.select(
            "doc_id",
            F.col("keep.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            ((F.col("path") == F.col("keep.path")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op13_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256, {LOWER} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY t)
    """,
)
def op13_exact_dedup(spark, folder):
    dedup = StreamingDedup(spark, f"{folder}/documents.parquet")
    dedup.advance()
    return dedup.result()
