"""Queries over file catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.operators.pixels import alpha_mask, byte_sum, preview_pixels, thumbnail_pixels, with_byte_sums
from imgcurate.operators.ranking import with_position
from imgcurate.plans import tables as t
from imgcurate.plans.registry import query
from imgcurate.sources import catalog as ct

# File extensions, as in the catalog.
IMAGES = "('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.tiff')"
BROWSED = "('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.gif')"


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the readable pictures: files of less than 400 characters are corrupt."""
    return t.catalog(spark, sf_dir).filter("length >= 400").select(
        "path",
        (F.lit(100) + F.col("length") % 900).cast("int").alias("width"),
        (F.lit(100) + F.col("length") % 700).cast("int").alias("height"),
    )


@query(
    "s1_scan_images",
    f"""WITH {t.CATALOG}, chosen AS (
      SELECT * FROM catalog WHERE ext IN {IMAGES} ORDER BY length DESC, path LIMIT 120
    ) SELECT path, CAST(100 + length % 900 AS INTEGER) AS width, CAST(100 + length % 700 AS INTEGER) AS height
    FROM chosen WHERE length >= 400 AND least(100 + length % 900, 100 + length % 700) >= 256""",
)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ct.choose_images(t.catalog(spark, sf_dir), max_images=120, sort_by="size")
    return ct.keep_large(chosen, _decoded(spark, sf_dir), 256).select("path", "width", "height")


@query(
    "s1_scan_images_all",
    f"""WITH {t.CATALOG} SELECT path, CAST(100 + length % 900 AS INTEGER) AS width, CAST(100 + length % 700 AS INTEGER) AS height
    FROM catalog WHERE ext IN {IMAGES} AND length >= 400 AND least(100 + length % 900, 100 + length % 700) >= 256""",
)
def s1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a cut of the listing."""
    chosen = ct.choose_images(t.catalog(spark, sf_dir))
    return ct.keep_large(chosen, _decoded(spark, sf_dir), 256).select("path", "width", "height")


def _placed(named: DataFrame, keys: list) -> DataFrame:
    return with_position(named.select("path", "name", "modificationTime", "length"), keys, position="place").select("path", "place")


@query(
    "s2_sort_catalog",
    f"WITH {t.CATALOG} SELECT path, row_number() OVER (ORDER BY mtime, path) - 1 AS place FROM catalog",
)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(ct.with_names(t.catalog(spark, sf_dir)), ct.sort_keys("date"))


@query(
    "s2_sort_catalog_newest_first",
    f"WITH {t.CATALOG} SELECT path, row_number() OVER (ORDER BY mtime DESC, path) - 1 AS place FROM catalog",
)
def s2_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(ct.with_names(t.catalog(spark, sf_dir)), ct.sort_keys("date", descending=True))


@query(
    "s2_sort_catalog_random",
    f"WITH {t.CATALOG} SELECT path, row_number() OVER (ORDER BY md5('7:' || path), path) - 1 AS place FROM catalog",
)
def s2_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(ct.with_names(t.catalog(spark, sf_dir)), ct.sort_keys("random", seed=7))


@query(
    "s3_list_folder",
    f"""WITH {t.CATALOG} SELECT 'dir' AS type, host AS name, count_if(ext IN {BROWSED})::BIGINT AS images,
      NULL::BIGINT AS size, '/' AS parent FROM catalog GROUP BY host""",
)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.list_folder(t.catalog(spark, sf_dir), "/data")


@query(
    "s4_search_catalog",
    f"WITH {t.CATALOG} SELECT path, name FROM catalog WHERE contains(lower(name), lower('p1'))",
)
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.search_catalog(t.catalog(spark, sf_dir), "p1").select("path", "name")


@query(
    "s5_sort_toggle",
    f"WITH {t.CATALOG} SELECT path, row_number() OVER (ORDER BY length, path) - 1 AS place FROM catalog",
)
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(ct.with_names(t.catalog(spark, sf_dir)), ct.sort_keys("size", descending=False))


PAGE = """numbered AS (
  SELECT path, row_number() OVER (ORDER BY name, path) - 1 AS "row", count(*) OVER () AS total FROM catalog
), paged AS (
  SELECT *, CAST(ceil(total / 16.0) AS BIGINT) AS total_pages FROM numbered
), shown AS (
  SELECT *, least({page}, total_pages) AS page FROM paged
) SELECT path, "row", total, total_pages, page,
    printf('Page %d/%d | Showing %d of %d images', page, total_pages, least(16, total - (page - 1) * 16), total) AS info
  FROM shown WHERE "row" >= (page - 1) * 16 AND "row" < page * 16"""


@query("s6_paginate", f"WITH {t.CATALOG}, {PAGE.format(page=2)}")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.paginate(t.catalog(spark, sf_dir), 2).select("path", "row", "total", "total_pages", "page", "info")


@query("s6_paginate_past_end", f"WITH {t.CATALOG}, {PAGE.format(page=1_000_000)}")
def s6_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.paginate(t.catalog(spark, sf_dir), 1_000_000).select("path", "row", "total", "total_pages", "page", "info")


def sums(made: DataFrame) -> DataFrame:
    """Sizes of pictures, and sums over their bytes that tell content and place."""
    return with_byte_sums(made).select("image_id", "width", "height", "bytes", "placed")


@query(
    "s7_preview",
    """WITH levels AS (
      SELECT vec_id AS image_id, 4 << CAST(label % 4 AS INTEGER) AS w, 64 // (4 << CAST(label % 4 AS INTEGER)) AS h,
             list_transform(embedding, lambda x: CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 128 + 400 * CAST(x AS DOUBLE)))) AS BIGINT)) AS v
      FROM embeddings
    ), page AS (SELECT max(w) AS ww, max(h) AS hh FROM levels), cells AS (
      SELECT image_id, ww, hh, v[i + 1] AS b, CAST((i // w + (hh - h) // 2) * ww + i % w + (ww - w) // 2 AS BIGINT) AS place
      FROM levels, page, range(64) AS t(i)
    ) SELECT image_id, CAST(any_value(ww) AS INTEGER) AS width, CAST(any_value(hh) AS INTEGER) AS height, sum(b)::BIGINT AS bytes, sum(b * (place + 1))::BIGINT AS placed
    FROM cells GROUP BY image_id""",
)
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sums(preview_pixels(t.strips(spark, sf_dir), 512))


@query(
    "s7_thumbnail",
    f"""WITH {t.PICTURES}, channels AS (
      SELECT image_id, y, x, unnest([0, 1, 2]) AS c, unnest([b, g, r]) AS v FROM blocks
    ), {t.resampled_sql('channels', 4, 24)}
    SELECT image_id, 24 AS width, 24 AS height, sum(v)::BIGINT AS bytes, sum(v * ((y * 24 + x) * 3 + c + 1))::BIGINT AS placed
    FROM resampled GROUP BY image_id""",
)
def s7_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sums(thumbnail_pixels(t.pictures(spark, sf_dir, repeat=4), 24))


@query(
    "s8_load_with_mask",
    f"""WITH {t.PICTURES} SELECT image_id, 3 AS n_channels, 0::BIGINT AS mask_sum, sum(b + g + r)::BIGINT AS colour_sum
    FROM blocks GROUP BY image_id""",
)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = alpha_mask(t.pictures(spark, sf_dir))
    return masked.select(
        "image_id", "n_channels", byte_sum("mask").alias("mask_sum"), byte_sum("data").alias("colour_sum")
    )


@query(
    "s9_list_videos",
    f"""WITH {t.CATALOG} SELECT name FROM catalog WHERE ext = '.mp4'
    UNION ALL SELECT '** ALL VIDEOS **' WHERE (SELECT count(*) FROM catalog WHERE ext = '.mp4') > 1""",
)
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.list_videos(t.catalog(spark, sf_dir)).select("name")


@query(
    "s9_choose_videos",
    f"WITH {t.CATALOG} SELECT path FROM catalog WHERE ext = '.mp4'",
)
def s9_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.choose_videos(t.catalog(spark, sf_dir), ct.ALL_VIDEOS).select("path")


@query(
    "s10_changed_files",
    f"""WITH {t.CATALOG} SELECT path, length FROM catalog WHERE host LIKE '%.org' OR length > 4000""",
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last time there were no .org hosts, and files of over 4,000 characters were older."""
    now = t.catalog(spark, sf_dir)
    seen = now.filter(~F.contains("path", F.lit(".org/"))).withColumn(
        "modificationTime",
        F.when(F.col("length") > 4000, F.expr("modificationTime - INTERVAL 1 MINUTE")).otherwise(F.col("modificationTime")),
    )
    return ct.changed_files(now, seen).select("path", "length")


@query(
    "s11_parse_name_list",
    """SELECT conv_id AS batch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
      CASE WHEN role = 'user' THEN 'image_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) ELSE role || turn || '.jpg' END AS filename
    FROM conversations WHERE conv_id % 10 <> 3""",
)
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name list per conversation, with nulls for users; some lists are broken JSON."""
    turns = t.table(spark, sf_dir, "conversations")
    name = F.when(F.col("role") != "user", F.concat("role", F.col("turn").cast("string"), F.lit(".jpg")))
    quoted = F.coalesce(F.concat(F.lit('"'), name, F.lit('"')), F.lit("null"))
    lists = turns.groupBy(F.col("conv_id").alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("turn", quoted.alias("name")))).alias("names")
    )
    text = F.concat(F.lit("["), F.array_join(F.transform("names", lambda s: s["name"]), ", "), F.lit("]"))
    broken = F.col("batch") % 10 == 3
    lists = lists.select("batch", F.when(broken, F.concat(F.lit("{"), text)).otherwise(text).alias("filenames"))
    return ct.parse_name_list(lists).select(
        "batch", F.col("position").cast("bigint").alias("position"),
        ct.name_or_default(F.col("filename"), F.col("position")).alias("filename"),
    )


@query(
    "s11_names_or_frames",
    """WITH n AS (SELECT conv_id AS batch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role || turn AS name,
        count(*) OVER (PARTITION BY conv_id) AS names FROM conversations)
    SELECT batch, position, CASE WHEN names = 4 THEN name ELSE printf('frame_%06d.jpg', position) END AS filename FROM n""",
)
def s11_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name lists of conversations against four rows each: other lengths give numbered names."""
    turns = t.table(spark, sf_dir, "conversations")
    lists = turns.groupBy(F.col("conv_id").alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("name")))).alias("s")
    )
    text = F.to_json(F.transform("s", lambda x: x["name"]))
    named = ct.parse_name_list(lists.select("batch", F.size("s").alias("names"), text.alias("filenames")))
    return named.select(
        "batch",
        F.col("position").cast("bigint").alias("position"),
        ct.names_or_frames(F.col("filename"), F.col("position"), F.col("names"), F.lit(4)).alias("filename"),
    )
