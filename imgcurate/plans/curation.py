"""Whole curations: operators put together as a user would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.operators.dedup import dedup_exact, dedup_first_wins, dedup_split
from imgcurate.operators.geometry import resize
from imgcurate.operators.metadata import join_captions
from imgcurate.operators.model import Model, map_model, model_filter
from imgcurate.operators.pixels import apply_pixels, with_model_file, with_phash, with_pixel_stats, with_png
from imgcurate.operators.quality import quality_split
from imgcurate.operators.ranges import cluster_ranges, combine, dense_resample, select_high
from imgcurate.operators.sampling import ORDER
from imgcurate.operators.scoring import tiered_sample
from imgcurate.operators.sinks import export_files, output_stem, write_dataset
from imgcurate.plans import tables as t
from imgcurate.plans.frame_queries import DENSE, RANGES
from imgcurate.plans.registry import query
from imgcurate.session import written
from imgcurate.sources.catalog import IMAGE_EXTENSIONS, decode_in_parts, extension, list_files, with_ids


def curate_frames(frames: DataFrame, high: float = 4.0, dense_fps: float = 0.5) -> DataFrame:
    """Scored frames to the kept ones, and denser frames around the best.

    Gives ``image_id, video, tier, kept, origin``.
    """
    sampled = tiered_sample(
        frames.select("image_id", "video", "frame_no", "ts", "score"), high=high, order_by=ORDER, partition_by=["video"]
    )
    ranges = cluster_ranges(select_high(sampled))
    dense = dense_resample(frames.select("image_id", "video", "ts"), ranges, dense_fps)
    return combine(
        sampled.select("image_id", "video", "tier", "kept"),
        dense.select("image_id", "video", F.lit("dense").alias("tier"), F.lit(True).alias("kept")),
    )


def high_value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and kept rows of a frame curation by origin and tier."""
    return (
        curate_frames(t.frames(spark, sf_dir))
        .groupBy("origin", "tier")
        .agg(F.count(F.lit(1)).alias("scored"), F.count_if("kept").alias("kept"))
    )


@query(
    "curate_frames",
    f"""WITH {t.FRAMES}{RANGES}{DENSE}, tiers AS (
      SELECT *, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'drop' END AS tier FROM frames
    ), sampled AS (
      SELECT tier, CASE tier WHEN 'high' THEN true WHEN 'drop' THEN false
        WHEN 'medium' THEN (row_number() OVER (PARTITION BY video, tier ORDER BY ts, image_id) - 1) % 3 = 0
        ELSE (row_number() OVER (PARTITION BY video, tier ORDER BY ts, image_id) - 1) % 10 = 0 END AS kept FROM tiers
    ) SELECT 'original' AS origin, tier, count(*) AS scored, count_if(kept)::BIGINT AS kept FROM sampled GROUP BY tier
    UNION ALL SELECT 'dense', 'dense', count(*), count(*) FROM dense HAVING count(*) > 0""",
)
def frames_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_value_summary(spark, sf_dir)


def curate_pictures(
    pixels: DataFrame,
    captions: DataFrame,
    min_score: float = 30.0,
    min_size: int = 256,
    threshold: int = 6,
    hash_size: int = 16,
    target_size: int = 1024,
) -> DataFrame:
    """Pictures to a captioned data set: cheap checks first, pixels last.

    The bytes are read once for hash and statistics; copies and poor pictures are
    found on the narrow table, and only what is left is resized.
    """
    hashed = with_phash(pixels.withColumn("pixels", F.col("data")), hash_size)
    measured = with_pixel_stats(hashed.withColumnRenamed("pixels", "data"))
    narrow = written(quality_split(measured, min_score, min_size).select("image_id", "filename", "words", "passed", "score"), "narrow")
    kept, _ = dedup_split(dedup_first_wins(narrow.filter("passed"), threshold, bits=hash_size**2))
    captioned = join_captions(kept.select("image_id", "filename", "score"), captions)
    made = apply_pixels(resize(pixels.join(kept.select("image_id"), "image_id", "left_semi"), target_size, "pad"))
    return made.join(captioned, "image_id").withColumn("stem", output_stem(F.col("filename"), F.col("image_id")))


def curate_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    judge: Model,
    captioner: Model,
    min_size: int = 256,
    threshold: int | None = 6,
    hash_size: int = 16,
    min_quality: float = 5,
    calls: int | None = None,
) -> DataFrame:
    """A folder of pictures to a captioned data set: scan, first of near copies, judged, captioned, written.

    ``judge`` and ``captioner`` are models that get ``encoded`` files and ``filename``; at most ``calls``
    of one run at a time. Copies are found by perceptual hash, or with a ``threshold`` of None by equal
    bytes. Pictures that the judge cannot be read on are kept, as are those without a caption. The
    data set goes to ``out``, and pictures and captions as files to ``out/files``. Gives what was kept:
    ``(image_id, filename, stem, quality, reason, caption)``.

    Models run once: their answers are written before they are used. The files are listed by a task and
    decoded in parts, so that the driver never holds a list of all. Each is decoded once for its hash and
    the file the models get, which are written; those that are kept are decoded again to be exported.
    """
    ids = written(with_ids(list_files(spark, folder), "name").select("path", "image_id", F.col("name").alias("filename")), "ids")
    images = ids.filter(extension(F.col("filename")).isin(*IMAGE_EXTENSIONS))

    def scanned(pictures: DataFrame) -> DataFrame:
        shown = with_model_file(pictures.filter(F.least("width", "height") >= min_size))
        if threshold is None:
            return shown.select("image_id", "filename", "encoded", F.array(F.sha2("data", 256)).alias("words"))
        return with_phash(shown, hash_size).select("image_id", "filename", "encoded", "words")

    pictures = decode_in_parts(spark, images, scanned)
    narrow = pictures.select("image_id", "filename", "words")
    kept, _ = dedup_split(dedup_exact(narrow) if threshold is None else dedup_first_wins(narrow, threshold, bits=hash_size**2))
    kept = written(kept.select("image_id"), "kept")

    def asked(rows: DataFrame, model: Model, out: str) -> DataFrame:
        shown = pictures.select("image_id", "filename", "encoded").join(rows.select("image_id"), "image_id", "left_semi")
        return written(map_model(shown, model, ["encoded", "filename"], calls, out).select("image_id", "filename", out), out)

    judged = model_filter(asked(kept, judge, "response"), min_quality).filter("keep")
    chosen = written(judged.select("image_id", "filename", "quality", "reason"), "chosen")
    captions = asked(chosen, captioner, "caption").select("image_id", "caption")
    made = chosen.join(captions, "image_id").withColumn("stem", output_stem(F.col("filename"), F.col("image_id")))
    write_dataset(made.select("image_id", "filename", "stem", "quality", "reason", "caption"), out)
    made = spark.read.parquet(f"{out}/data")
    files = written(images.select("path", "image_id").join(made.select("image_id", "stem", "caption"), "image_id"), "exported")
    export_files(decode_in_parts(spark, files, lambda p: with_png(p).select("stem", "encoded", "caption")), f"{out}/files")
    return made


@query("curate_pictures")
def pictures_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures from embeddings, captioned by documents of the same number."""
    pixels = t.pictures(spark, sf_dir, repeat=4)
    captions = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("position"),
        F.concat(F.lit("image_"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("text").alias("caption"),
    )
    made = curate_pictures(pixels, captions, min_score=60.0, min_size=64, threshold=12, hash_size=8, target_size=48)
    return made.select("image_id", "stem", "width", "height", "score", F.length("caption").alias("caption_length"))


