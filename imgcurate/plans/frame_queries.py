"""Queries over frames: sampling, scoring, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.functions.arith import floor_div
from imgcurate.operators import ranges as rg
from imgcurate.operators import sampling as sm
from imgcurate.operators import scoring as sc
from imgcurate.operators.quality import score_quantiles, score_sketches
from imgcurate.plans import tables as t
from imgcurate.plans.registry import half_even, query

RATED = """, rated AS (
  SELECT *, row_number() OVER (PARTITION BY video, floor(ts * 0.1::DOUBLE) ORDER BY ts, image_id) AS r FROM frames
), by_rate AS (
  SELECT *, row_number() OVER (PARTITION BY video ORDER BY ts, image_id) AS k FROM rated WHERE r = 1
)"""


@query(
    "f1_sample_fps",
    f"WITH {t.FRAMES}{RATED} SELECT image_id, video, frame_no FROM by_rate WHERE k <= 20",
)
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_fps(t.frames(spark, sf_dir), 0.1, 20).select("image_id", "video", "frame_no")


@query(
    "f2_sample_scene",
    f"""WITH {t.FRAMES} SELECT image_id, video, scene_score FROM (
      SELECT *, row_number() OVER (PARTITION BY video ORDER BY ts, image_id) AS k FROM frames WHERE scene_score > 0.1
    ) WHERE k <= 9""",
)
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_scene(t.frames(spark, sf_dir), 0.10, 3).select("image_id", "video", "scene_score")


@query(
    "f3_sample_keyframes",
    f"""WITH {t.FRAMES} SELECT image_id, video FROM (
      SELECT *, row_number() OVER (PARTITION BY video ORDER BY ts, image_id) AS k FROM frames WHERE is_keyframe
    ) WHERE k <= 10""",
)
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_keyframes(t.frames(spark, sf_dir), 5).select("image_id", "video")


@query("f1_sample_fps_all", f"WITH {t.FRAMES}{RATED} SELECT image_id, video, frame_no FROM by_rate")
def f1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_fps(t.frames(spark, sf_dir), 0.1).select("image_id", "video", "frame_no")


@query("f2_sample_scene_all", f"WITH {t.FRAMES} SELECT image_id, video, scene_score FROM frames WHERE scene_score > 0.1")
def f2_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_scene(t.frames(spark, sf_dir), 0.10).select("image_id", "video", "scene_score")


@query("f3_sample_keyframes_all", f"WITH {t.FRAMES} SELECT image_id, video FROM frames WHERE is_keyframe")
def f3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_keyframes(t.frames(spark, sf_dir)).select("image_id", "video")


@query(
    "f4_with_fallback",
    f"""WITH {t.FRAMES}{RATED}, scenes AS (
      SELECT *, row_number() OVER (PARTITION BY video ORDER BY ts, image_id) AS k FROM frames WHERE scene_score > 0.25
    ) SELECT image_id, video, false AS fallback FROM scenes WHERE k <= 60
    UNION ALL SELECT image_id, video, true FROM by_rate WHERE k <= 20 AND video NOT IN (SELECT video FROM scenes)""",
)
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = t.frames(spark, sf_dir)
    chosen = sm.sample_scene(frames, 0.25, 20)
    return sm.with_fallback(chosen, frames, 0.1, 20).select("image_id", "video", "fallback")


def _even_sql(source: str, m: str, group: str, order: str) -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"""(
      SELECT * EXCLUDE (pos, n) FROM (
        SELECT *, row_number() OVER ({part}ORDER BY {order}) - 1 AS pos, count(*) OVER ({part}) AS n FROM {source}
      ) WHERE n <= {m} OR list_contains(
        list_transform(range({m}), lambda i: CAST(floor(i::DOUBLE * (n::DOUBLE / {m}::DOUBLE)) AS BIGINT)), pos))"""


@query("f5_even_subsample", f"WITH {t.FRAMES} SELECT image_id FROM {_even_sql('frames', '83', '', 'image_id')}")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.even_subsample(t.frames(spark, sf_dir).select("image_id"), 83)


@query(
    "f5_even_subsample_per_video",
    f"WITH {t.FRAMES} SELECT image_id, video FROM {_even_sql('frames', '7', 'video', 'ts, image_id')}",
)
def f5_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = t.frames(spark, sf_dir).select("image_id", "video", "ts")
    return sm.even_subsample(narrow, 7, sm.ORDER, ["video"]).select("image_id", "video")


@query(
    "f6_video_quota",
    f"""WITH {t.FRAMES} SELECT count(DISTINCT video) AS videos,
      CAST(CASE WHEN count(DISTINCT video) <= 1 THEN 50000 ELSE greatest(50, 50000 // count(DISTINCT video)) END AS INTEGER) AS quota FROM frames""",
)
def f6_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.video_quota(t.frames(spark, sf_dir), 50_000)


@query(
    "f6_per_video_quota",
    f"""WITH {t.FRAMES}, quota AS (
      SELECT CASE WHEN count(DISTINCT video) <= 1 THEN 600 ELSE greatest(50, 600 // count(DISTINCT video)) END AS q FROM frames
    ), placed AS (
      SELECT image_id, video, ts, q, row_number() OVER (PARTITION BY video ORDER BY ts, image_id) - 1 AS p,
             count(*) OVER (PARTITION BY video) AS c FROM frames, quota
    ), each AS (
      SELECT * FROM placed WHERE c <= q OR list_contains(
        list_transform(range(q), lambda i: CAST(floor(i::DOUBLE * (c::DOUBLE / q::DOUBLE)) AS BIGINT)), p)
    ) SELECT image_id, video FROM {_even_sql('each', '600', '', 'video, ts, image_id')}""",
)
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = t.frames(spark, sf_dir).select("image_id", "video", "ts")
    return sm.per_video_quota(narrow, 600).select("image_id", "video")


@query(
    "f7_frame_name",
    f"WITH {t.FRAMES} SELECT image_id, filename, video, frame_no FROM frames",
)
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = t.frames(spark, sf_dir).select("image_id", "filename")
    return sm.parse_frame_name(named).select("image_id", "filename", "video", "frame_no")


@query(
    "f7_parse_other_names",
    f"WITH {t.CATALOG} SELECT name, NULL::VARCHAR AS video, NULL::BIGINT AS frame_no FROM catalog",
)
def f7_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.substring_index("path", "/", -1).alias("name")
    return sm.parse_frame_name(t.catalog(spark, sf_dir).select(name), "name")


@query(
    "f8_extraction_summary",
    f"""WITH {t.FRAMES}, marked AS (SELECT video, scene_score > 0.1 AS kept FROM frames)
    SELECT video, count(*) AS extracted, count_if(kept)::BIGINT AS kept FROM marked GROUP BY ROLLUP (video)""",
)
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = t.frames(spark, sf_dir)
    return sm.extraction_summary(frames, frames.filter("scene_score > 0.1"))


@query(
    "f9_normalize_to_first",
    f"""WITH {t.FRAMES}, one AS (SELECT width AS w, height AS h FROM frames ORDER BY image_id LIMIT 1)
    SELECT image_id, w AS target_w, h AS target_h, width <> w OR height <> h AS needs_resize FROM frames, one""",
)
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.normalize_to_first(t.frames(spark, sf_dir).select("image_id", "width", "height")).select(
        "image_id", "target_w", "target_h", "needs_resize"
    )


@query(
    "f10_min_size_filter",
    f"WITH {t.FRAMES} SELECT image_id, width, height FROM frames WHERE least(width, height) >= 256",
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.min_size_filter(t.frames(spark, sf_dir)).select("image_id", "width", "height")


SCORED = f"""{t.DETECTIONS}, sums AS (
  SELECT d.image_id, sum(CAST(w.weight * d.score AS DECIMAL(28,12))) AS s,
         string_agg(CASE WHEN w.report THEN d.class END, ', ' ORDER BY d.det_no) AS parts
  FROM detections d LEFT JOIN weights w USING (class) GROUP BY d.image_id
), scored AS (
  SELECT image_id, printf('frame_%06d.jpg', image_id) AS filename,
         {half_even('coalesce(s, 0)', 2)} AS score, coalesce(parts, '') AS parts FROM sums
)"""

TIERED = """, tiers AS (
  SELECT *, CASE WHEN score >= 5 THEN 'high' WHEN score >= 2 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'drop' END AS tier
  FROM scored
), sampled AS (
  SELECT *, CASE tier WHEN 'high' THEN true WHEN 'drop' THEN false
    WHEN 'medium' THEN (row_number() OVER (PARTITION BY tier ORDER BY image_id) - 1) % 3 = 0
    ELSE (row_number() OVER (PARTITION BY tier ORDER BY image_id) - 1) % 10 = 0 END AS kept
  FROM tiers
)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.detections(spark, sf_dir)
    images = t.detection_images(found)
    return sc.weighted_detection_score(images, found, t.weights(spark)).drop("found")


@query("w1_weighted_detection_score", f"WITH {SCORED} SELECT image_id, score, parts FROM scored")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("image_id", "score", "parts")


@query("w2_tier", f"WITH {SCORED}{TIERED} SELECT image_id, score, tier FROM tiers")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("image_id", "score", sc.tier().alias("tier"))


@query("w3_systematic_sample", f"WITH {SCORED}{TIERED} SELECT image_id, tier, kept FROM sampled")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.tiered_sample(_scored(spark, sf_dir)).select("image_id", "tier", "kept")


@query(
    "w3_systematic_sample_per_video",
    f"""WITH {t.FRAMES}, tiers AS (
      SELECT *, CASE WHEN score >= 5 THEN 'high' WHEN score >= 2 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'drop' END AS tier FROM frames
    ) SELECT image_id, video, tier, CASE tier WHEN 'high' THEN true WHEN 'drop' THEN false
        WHEN 'medium' THEN (row_number() OVER (PARTITION BY video, tier ORDER BY ts, image_id) - 1) % 3 = 0
        ELSE (row_number() OVER (PARTITION BY video, tier ORDER BY ts, image_id) - 1) % 10 = 0 END AS kept
      FROM tiers""",
)
def w3_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = t.frames(spark, sf_dir).select("image_id", "video", "ts", "score")
    return sc.tiered_sample(narrow, order_by=sm.ORDER, partition_by=["video"]).select("image_id", "video", "tier", "kept")


COUNTS = """count(*) AS scored, count_if(tier = 'high')::BIGINT AS high, count_if(tier = 'medium')::BIGINT AS medium,
  count_if(tier = 'low')::BIGINT AS low, count_if(tier = 'drop')::BIGINT AS "drop", count_if(kept)::BIGINT AS kept"""


@query(
    "w4_tier_summary",
    f"""WITH {SCORED}{TIERED}, counts AS (SELECT {COUNTS} FROM sampled)
    SELECT *, printf('Scored %d frames: %d high, %d med, %d low, %d drop → kept %d', scored, high, medium, low, "drop", kept) AS summary
    FROM counts""",
)
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.tier_summary(sc.tiered_sample(_scored(spark, sf_dir)))


@query(
    "w5_tier_log",
    f"""WITH {SCORED}{TIERED} SELECT image_id, CASE tier
      WHEN 'high' THEN 'HIGH ' || CAST(CAST({half_even('score', 1)} AS DECIMAL(20,1)) AS VARCHAR) || ' ' || filename || ' [' || parts || ']'
      WHEN 'medium' THEN 'MED  ' || CAST(CAST({half_even('score', 1)} AS DECIMAL(20,1)) AS VARCHAR) || ' ' || filename || ' [' || parts || ']'
      ELSE 'LOW  ' || CAST(CAST({half_even('score', 1)} AS DECIMAL(20,1)) AS VARCHAR) || ' ' || filename END AS log_line
    FROM sampled WHERE kept""",
)
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.tier_log(sc.tiered_sample(_scored(spark, sf_dir))).select("image_id", "log_line")


def _tiered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.frames(spark, sf_dir).withColumn("tier", sc.tier(high=4.0))


@query("r1_select_high", f"WITH {t.FRAMES} SELECT image_id, video, frame_no FROM frames WHERE score >= 4")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.select_high(_tiered_frames(spark, sf_dir)).select("image_id", "video", "frame_no")


@query("r1_select_high_fallback", f"WITH {t.FRAMES} SELECT image_id, video, frame_no FROM frames")
def r1_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = t.frames(spark, sf_dir).withColumn("tier", sc.tier(high=1000.0))
    return rg.select_high(frames).select("image_id", "video", "frame_no")


RANGES = """, numbers AS (
  SELECT DISTINCT video, frame_no AS n FROM frames WHERE score >= 4
), opened AS (
  SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY video ORDER BY n) <= 10 THEN 0 ELSE 1 END AS o FROM numbers
), islands AS (
  SELECT *, sum(o) OVER (PARTITION BY video ORDER BY n) - 1 AS c FROM opened
), ranges AS (
  SELECT video, CAST(c AS BIGINT) AS cluster_id, min(n) AS start_no, max(n) AS end_no,
         greatest(0, min(n) - 5) AS start_s, max(n) + 5 AS end_s
  FROM islands GROUP BY video, c
)"""


def _ranges(spark: SparkSession, sf_dir: str, block: int = 65536) -> DataFrame:
    return rg.cluster_ranges(rg.select_high(_tiered_frames(spark, sf_dir)), block=block)


@query("r2_cluster_ranges", f"WITH {t.FRAMES}{RANGES} SELECT * FROM ranges")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


@query("r2_cluster_ranges_small_blocks", f"WITH {t.FRAMES}{RANGES} SELECT * FROM ranges")
def r2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir, block=32)


DENSE = """, paired AS (
  SELECT f.*, r.cluster_id, CAST(floor((f.ts - r.start_s) * 0.5::DOUBLE) AS BIGINT) AS tick
  FROM frames f JOIN ranges r ON f.video = r.video AND f.ts >= r.start_s AND f.ts < r.end_s
), dense AS (
  SELECT *, printf('%s_dense_d%02d_d%02d_%06d.jpg', video, cluster_id, cluster_id, tick + 1) AS dense_name FROM (
    SELECT *, row_number() OVER (PARTITION BY video, cluster_id, tick ORDER BY ts, image_id) AS r FROM paired
  ) WHERE r = 1
)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = t.frames(spark, sf_dir).select("image_id", "video", "ts", "score")
    return rg.dense_resample(source, _ranges(spark, sf_dir), 0.5)


@query(
    "r3_dense_resample",
    f"WITH {t.FRAMES}{RANGES}{DENSE} SELECT image_id, video, cluster_id, tick, dense_name AS filename FROM dense",
)
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("image_id", "video", "cluster_id", "tick", "filename")


@query(
    "r4_combine",
    f"""WITH {t.FRAMES}{RANGES}{DENSE} SELECT image_id, filename, 'original' AS origin FROM frames
    UNION ALL SELECT image_id, dense_name, 'dense' FROM dense""",
)
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    originals = t.frames(spark, sf_dir).select("image_id", "filename")
    return rg.combine(originals, _dense(spark, sf_dir).select("image_id", "filename"))


@query(
    "r5_missing_source",
    f"""WITH {t.FRAMES} SELECT DISTINCT video FROM frames WHERE score >= 4
      AND video NOT IN (SELECT 'v' || c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = t.table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    sources = known.select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("video"))
    return rg.missing_source(rg.select_high(_tiered_frames(spark, sf_dir)), sources)


@query(
    "q8_score_quantiles",
    f"""WITH {t.FRAMES}, shares AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS share)
    SELECT is_keyframe, share, true AS close FROM (SELECT DISTINCT is_keyframe FROM frames WHERE score IS NOT NULL), shares""",
)
def q8_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each day merged; three hundredths of the rows at most lie between a quantile and the true one."""
    rows = t.frames(spark, sf_dir).withColumn("day", floor_div("us", 86_400_000_000))
    found = score_quantiles(score_sketches(rows, ["is_keyframe", "day"]), ["is_keyframe"])
    # Five quantiles a side.
    counted = rows.filter("score is not null").join(F.broadcast(found), "is_keyframe").groupBy("is_keyframe", "share").agg(
        F.avg((F.col("score") < F.col("quantile")).cast("double")).alias("below"),
        F.avg((F.col("score") <= F.col("quantile")).cast("double")).alias("up_to"),
    )
    close = (F.col("below") <= F.col("share") + 0.03) & (F.col("up_to") >= F.col("share") - 0.03)
    return counted.select("is_keyframe", "share", close.alias("close"))
