"""Queries over real files: embeddings are exported as PNG files with captions, and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.operators import sinks as sk
from imgcurate.operators.pixels import alpha_mask, byte_sum, with_byte_sums, with_png
from imgcurate.plans import tables as t
from imgcurate.plans.curation import curate_folder
from imgcurate.plans.registry import query
from imgcurate.session import scratch_path
from imgcurate.sources import catalog as ct
from imgcurate.streaming.streams import incremental_scan


def _new_folder(spark: SparkSession) -> str:
    path = scratch_path(spark, "files")
    return path if "://" in path else f"file://{path}"


def _pictures(spark: SparkSession, sf_dir: str, channels: int = 3) -> DataFrame:
    """Pictures of 8 by 8 pixels, and of 32 by 32 for even ids; two of three have a caption."""
    small = t.pictures(spark, sf_dir, 1, channels).filter("image_id % 2 <> 0")
    large = t.pictures(spark, sf_dir, 4, channels).filter("image_id % 2 = 0")
    caption = F.when(F.col("image_id") % 3 != 0, F.concat(F.lit("a picture of "), F.col("label").cast("string")))
    made = small.unionByName(large).withColumn("caption", caption)
    return made.withColumn("stem", sk.output_stem(F.concat("filename", F.lit(".jpg")), F.col("image_id")))


def files_sql(channels: int) -> str:
    """``cells``: level, channel and place of each block; ``files``: sums over the bytes, as ``with_byte_sums`` has them.

    A block of k by k pixels is worth its level times the sum of its bytes' places.
    """
    return f"""levels AS (
  SELECT vec_id AS image_id, label, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 1 END AS k,
         list_transform(embedding, lambda x: CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 128 + 400 * CAST(x AS DOUBLE)))) AS BIGINT)) AS v
  FROM embeddings
), cells AS (
  SELECT image_id, label, k, i // 8 AS y, i % 8 AS x, c, v[(i + c) % 64 + 1] AS l FROM levels, range(64) a(i), range({channels}) b(c)
), files AS (
  SELECT image_id, any_value(label) AS label, any_value(k) AS k, sum(l * k * k)::BIGINT AS bytes,
         sum(l * (k * k * (c + 1) + {channels} * k * k * ((2 * y * k + k - 1) * 8 * k + 2 * x * k + k - 1) // 2))::BIGINT AS placed
  FROM cells GROUP BY image_id
)"""


@query(
    "s1_scan_files",
    f"""WITH {files_sql(3)} SELECT 'image_' || image_id || '.png' AS filename, 32 AS width, 32 AS height, 3 AS n_channels, bytes, placed
    FROM files WHERE k = 4""",
)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pictures as files among captions, and scan them for those of at least 16 pixels."""
    folder = _new_folder(spark)
    sk.export_files(with_png(_pictures(spark, sf_dir)), folder)
    return with_byte_sums(ct.scan_images(spark, folder, min_size=16)).select("filename", "width", "height", "n_channels", "bytes", "placed")


@query(
    "s3_list_files",
    f"""WITH {t.CATALOG}, one AS (SELECT host FROM catalog GROUP BY host ORDER BY count(*) DESC, host LIMIT 1)
    SELECT 'image' AS type, name, 1::BIGINT AS images, length AS size, '/data' AS parent
    FROM catalog WHERE host = (SELECT host FROM one) AND ext IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.gif') AND name NOT LIKE '.%'""",
)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the fullest folder, with their sizes."""
    listed = t.catalog(spark, sf_dir)
    folders = listed.groupBy(F.substring_index("path", "/", 3).alias("folder")).count()
    folder = folders.orderBy(F.col("count").desc(), "folder").first().folder
    return ct.list_folder(listed, folder)


@query(
    "s8_load_file",
    f"""WITH {files_sql(4)} SELECT 'image_' || image_id || '.png' AS filename, 3 AS n_channels,
      sum(CASE WHEN c = 3 THEN l * k * k ELSE 0 END)::BIGINT AS mask_sum, sum(CASE WHEN c < 3 THEN l * k * k ELSE 0 END)::BIGINT AS colour_sum
    FROM cells WHERE image_id = (SELECT min(vec_id) FROM embeddings) GROUP BY image_id""",
)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pictures with an alpha channel, and load the first with its mask."""
    folder = _new_folder(spark)
    made = _pictures(spark, sf_dir, channels=4)
    sk.export_files(with_png(made), folder)
    first = t.table(spark, sf_dir, "embeddings").agg(F.min("vec_id")).first()[0]
    one = alpha_mask(ct.load_one(spark, f"{folder}/image_{first}.png"))
    return one.select("filename", "n_channels", byte_sum("mask").alias("mask_sum"), byte_sum("data").alias("colour_sum"))


@query(
    "s10_incremental_scan",
    "SELECT 'image_' || vec_id || '.png' AS name, (vec_id % 2 <> 0)::BIGINT AS batch FROM embeddings",
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan a folder as a stream, add files, and scan it again: each file comes once, in its batch."""
    folder, seen, made = _new_folder(spark), scratch_path(spark, "seen"), _pictures(spark, sf_dir)

    def keep(batch: DataFrame, number: int) -> None:
        named = ct.in_shares(batch).select(ct.file_name().alias("name"), F.lit(number).cast("bigint").alias("batch"))
        named.write.mode("overwrite").parquet(f"{seen}/files/{number:06d}")

    for some in ("image_id % 2 = 0", "image_id % 2 <> 0"):
        sk.export_files(with_png(made.filter(some)), folder)
        scan = incremental_scan(spark, folder, "*.png").writeStream.foreachBatch(keep)
        scan.option("checkpointLocation", f"{seen}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("name string, batch bigint").parquet(f"{seen}/files/*")


@query(
    "k2_export_files",
    f"""WITH {files_sql(3)} SELECT 'image_' || image_id AS stem, CASE WHEN image_id % 3 <> 0 THEN 'a picture of ' || label END AS caption, bytes, placed
    FROM files""",
)
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pictures and captions as files, and read all of them back."""
    folder = _new_folder(spark)
    sk.export_files(with_png(_pictures(spark, sf_dir)), folder)
    stem = lambda name: F.regexp_replace(name, r"\.[a-z]+$", "")
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder)
    captions = ct.in_shares(texts.select(stem(F.col("_metadata.file_name")).alias("stem"), F.col("value").alias("caption")))
    pictures = with_byte_sums(ct.read_pictures(spark, folder)).select(stem(ct.file_name()).alias("stem"), "bytes", "placed")
    return pictures.join(captions, "stem", "left").select("stem", "caption", "bytes", "placed")


def _number(batch: pd.DataFrame) -> pd.Series:
    return batch["filename"].str.extract(r"(\d+)", expand=False).astype(int)


def judge(batch: pd.DataFrame) -> pd.Series:
    """Stands in for a model; one of eleven answers cannot be read."""
    return _number(batch).map(lambda i: "hm" if i % 11 == 0 else f'{{"keep": {str(i % 7 != 0).lower()}, "quality": {i % 10}}}')


def describe(batch: pd.DataFrame) -> pd.Series:
    """Stands in for a model that has nothing to say on one of thirteen pictures."""
    return _number(batch).map(lambda i: None if i % 13 == 0 else f"picture {i}")


@query(
    "curate_folder",
    f"""WITH {files_sql(3)}, pictures AS (
      SELECT image_id, v, 'image_' || image_id AS stem FROM levels WHERE k = 4
    ), firsts AS (
      SELECT * FROM pictures QUALIFY row_number() OVER (PARTITION BY v ORDER BY stem || '.png') = 1
    ) SELECT stem, CASE WHEN image_id % 13 <> 0 THEN 'picture ' || image_id END AS caption, bytes, placed
    FROM firsts JOIN files USING (image_id) WHERE image_id % 11 = 0 OR (image_id % 7 <> 0 AND image_id % 10 >= 5)""",
)
def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files scanned, judged, captioned and written as files again, which are read back."""
    folder, out = _new_folder(spark), _new_folder(spark)
    sk.export_files(with_png(_pictures(spark, sf_dir)), folder)
    curate_folder(spark, folder, out, judge, describe, min_size=16, threshold=None, calls=4)
    captions = spark.read.schema("stem string, caption string").json(f"{out}/manifest")
    files = ct.with_ids(ct.list_files(spark, f"{out}/files"), "name").filter("ext = '.png'").select("path", "image_id")
    made = ct.decode_in_parts(spark, files, lambda p: with_byte_sums(p).select("path", "bytes", "placed"))
    pictures = made.select(F.regexp_replace(ct.file_name(), r"\.png$", "").alias("stem"), "bytes", "placed")
    return captions.join(pictures, "stem", "full").select("stem", "caption", "bytes", "placed")
