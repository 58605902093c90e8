"""Streaming forms, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from imgcurate.plans import tables as t
from imgcurate.plans.picture_queries import keep_first_sql
from imgcurate.plans.registry import query
from imgcurate.session import scratch_path
from imgcurate.streaming import streams as st


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them, which a pattern takes alike."""
    schema = t.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def _instant() -> Column:
    """The clock of an event as an instant, whatever the time zone of the session."""
    start_of_2024 = 1_704_067_200_000_000
    return F.timestamp_micros(t.clock() + F.lit(start_of_2024)).alias("ts")


def _run(stream: DataFrame) -> DataFrame:
    """Work off what is there, and read the result back."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint")
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _drain(writer: DataStreamWriter, path: str) -> None:
    """Work off what is there with a writer that keeps its own table."""
    writer.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_d4_dedup_exact",
    "SELECT DISTINCT user_id, CAST(round(value * 100) AS BIGINT) AS word FROM events",
)
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _stream(spark, sf_dir, "events").select(
        _instant(),
        F.array("user_id", F.round(F.col("value") * 100).cast("bigint")).alias("words"),
    )
    kept = _run(st.dedup_exact_stream(frames, "60 days"))
    return kept.select(F.get("words", F.lit(0)).alias("user_id"), F.get("words", F.lit(1)).alias("word"))


@query(
    "stream_r2_cluster_ranges",
    """WITH opened AS (
      SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 18000000000 THEN 0 ELSE 1 END AS o FROM events
    ), islands AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS c FROM opened)
    SELECT 'v' || user_id AS video, min(us) AS start_us, max(us) AS end_us, count(*) AS frames FROM islands GROUP BY user_id, c""",
)
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters, those still open included."""
    frames = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video"), _instant()
    )
    path = scratch_path(spark, "clusters")
    _drain(st.cluster_ranges_stream(frames, path, "5 hours"), path)
    return st.stored_clusters(spark, path).select("video", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "frames")


@query(
    "stream_d3_dedup_first_wins",
    f"WITH RECURSIVE {t.sign_words_sql()}, {keep_first_sql('hashes', 6)} SELECT image_id FROM walk WHERE NOT dup",
)
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.array(t.sign_word(32)).alias("words")
    rows = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), word)
    path = scratch_path(spark, "kept")
    _drain(st.dedup_stream(rows, path, 6, bits=32), path)
    return st.kept_hashes(spark, path).select("image_id")


@query(
    "stream_m5_assemble",
    """WITH ends AS (SELECT conv_id, min(turn) AS e FROM conversations WHERE length(text) < 40 GROUP BY conv_id)
    SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS response
    FROM conversations LEFT JOIN ends USING (conv_id) WHERE e IS NULL OR turn <= e GROUP BY conv_id""",
)
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that have ended, and what there is of those that have not."""
    chunks = _stream(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("seq"),
        F.col("text").alias("fragment"),
        (F.length("text") < 40).alias("done"),
    )
    path = scratch_path(spark, "requests")
    _drain(st.assemble_fragments_stream(chunks, path), path)
    return st.responses(spark, path).unionByName(st.open_requests(spark, path))
