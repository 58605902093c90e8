"""Queries over outputs and accounts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.operators import sinks as sk
from imgcurate.plans import tables as t
from imgcurate.plans.registry import query
from imgcurate.session import scratch_path

STEMS = """named AS (
  SELECT doc_id AS image_id, CASE WHEN lang <> 'es' THEN lang || '.v1.' || doc_id || '.jpg' END AS filename, text, source FROM documents
), stems AS (
  SELECT *, CASE WHEN filename IS NOT NULL THEN 'set_' || regexp_replace(filename, '\\.jpg$', '') ELSE printf('set_%04d', image_id) END AS stem FROM named
)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with file names, Spanish ones without; toxic ones have no caption."""
    docs = t.table(spark, sf_dir, "documents").join(
        t.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    name = F.concat("lang", F.lit(".v1."), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return docs.select(
        F.col("doc_id").alias("image_id"),
        F.when(F.col("lang") != "es", name).alias("filename"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 0, F.col("text")).alias("caption"),
        "source",
    ).withColumn("stem", sk.output_stem(F.col("filename"), F.col("image_id"), "set_"))


@query("k1_output_stem", f"WITH {STEMS} SELECT image_id, filename, stem FROM stems")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("image_id", "filename", "stem")


@query(
    "k2_write_dataset",
    f"""WITH {STEMS} SELECT image_id, filename, stem, CASE WHEN coalesce(toxic, 0) = 0 AND text <> '' THEN text END AS caption
    FROM stems LEFT JOIN (SELECT doc_id AS image_id, toxic FROM labels) USING (image_id)""",
)
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the dataset, and read the manifest back."""
    path = scratch_path(spark, "dataset")
    sk.write_dataset(_named(spark, sf_dir), path, partition_by=["source"])
    return spark.read.schema("image_id long, filename string, stem string, caption string").json(f"{path}/manifest")


@query(
    "k2_written_data",
    f"""WITH {STEMS} SELECT image_id, filename, stem, source, CASE WHEN coalesce(toxic, 0) = 0 THEN text END AS caption
    FROM stems LEFT JOIN (SELECT doc_id AS image_id, toxic FROM labels) USING (image_id)""",
)
def k2_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the dataset, and read the data back."""
    path = scratch_path(spark, "dataset")
    sk.write_dataset(_named(spark, sf_dir), path, partition_by=["source"])
    schema = "image_id long, filename string, caption string, stem string, source string"
    return spark.read.schema(schema).parquet(f"{path}/data")


@query(
    "k2_repeated_stems",
    "SELECT lang || '_' || source AS stem, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def k2_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("lang", F.lit("_"), "source", F.lit(".png"))
    stems = t.table(spark, sf_dir, "documents").select(sk.output_stem(name, F.col("doc_id")).alias("stem"))
    return sk.repeated_stems(stems)


@query(
    "k3_write_split",
    f"""WITH {t.FRAMES} SELECT image_id, CASE WHEN score >= 2 THEN 'kept' ELSE 'rejected' END AS decision FROM frames""",
)
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write both sides of a decision in one go, and read them back."""
    path = scratch_path(spark, "split")
    sk.write_split(t.frames(spark, sf_dir).select("image_id", "score"), path, F.col("score") >= 2)
    return spark.read.schema("image_id long, decision string").parquet(path)


@query(
    "k4_run_counts",
    f"""WITH {t.FRAMES} SELECT video, count(*) AS total, count_if(score >= 2)::BIGINT AS kept_count, count_if(score < 2)::BIGINT AS rejected_count
    FROM frames GROUP BY video""",
)
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = t.frames(spark, sf_dir).withColumn("kept", F.col("score") >= 2)
    return sk.run_counts(frames, "kept", ["video"])


@query(
    "k5_throughput",
    f"""WITH {t.RUNS} SELECT count_if(ok)::BIGINT AS succeeded, count_if(NOT ok)::BIGINT AS failed, max(end_s) - min(start_s) AS elapsed_s,
      (max(end_s) - min(start_s)) / count(*)::DOUBLE AS s_per_image FROM runs""",
)
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.throughput(t.runs(spark, sf_dir))


@query(
    "k5_progress",
    f"""WITH {t.RUNS}, done AS (
      SELECT image_id, row_number() OVER w AS done, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY end_s, image_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failed,
             end_s - (SELECT min(start_s) FROM runs) AS elapsed, (SELECT count(*) FROM runs) AS total
      FROM runs WINDOW w AS (ORDER BY end_s, image_id)
    ) SELECT image_id, done, failed, elapsed / done::DOUBLE AS s_per_image, elapsed / done::DOUBLE * (total - done) AS eta_s FROM done""",
)
def k5_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.progress(t.runs(spark, sf_dir))
