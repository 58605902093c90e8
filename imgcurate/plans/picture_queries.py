"""Queries over pictures: hashes, near copies, quality, geometry, pixel edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.functions.bits import hamming
from imgcurate.operators import dedup as dd
from imgcurate.operators import geometry as gm
from imgcurate.operators import quality as ql
from imgcurate.operators.pixels import apply_pixels, with_byte_sums, with_phash, with_pixel_stats
from imgcurate.operators.ranges import dedup_new_only
from imgcurate.plans import tables as t
from imgcurate.plans.frame_queries import DENSE, RANGES, _dense
from imgcurate.plans.registry import query


def keep_first_sql(source: str, threshold: int, group: str = "") -> str:
    """Walk the rows of every group in order with the list of kept hashes."""
    part = f"PARTITION BY {group} " if group else ""
    g = group or "0"
    return f"""ordered AS (
      SELECT *, {g} AS grp, row_number() OVER ({part}ORDER BY image_id) AS rn FROM {source}
    ), walk(grp, rn, kept, dup, image_id) AS (
      SELECT grp, rn, [word], false, image_id FROM ordered WHERE rn = 1
      UNION ALL
      SELECT o.grp, o.rn,
             CASE WHEN list_bool_or(list_transform(w.kept, lambda k: bit_count(xor(k, o.word)) <= {threshold})) THEN w.kept
                  ELSE list_append(w.kept, o.word) END,
             list_bool_or(list_transform(w.kept, lambda k: bit_count(xor(k, o.word)) <= {threshold})), o.image_id
      FROM walk w JOIN ordered o ON o.grp = w.grp AND o.rn = w.rn + 1
    )"""


def nearest_kept_sql(source: str, threshold: int, group: str = "0") -> str:
    """Verdicts of ``walk`` with the smallest kept row near each removed one."""
    return f"""(
      WITH told AS (SELECT s.image_id, s.word, {group} AS grp, dup FROM {source} s JOIN walk USING (image_id)), near AS (
        SELECT r.image_id, min(k.image_id) AS duplicate_of FROM told r JOIN told k
        ON r.grp = k.grp AND r.dup AND NOT k.dup AND bit_count(xor(r.word, k.word)) <= {threshold} GROUP BY r.image_id
      ) SELECT image_id, dup AS is_duplicate, duplicate_of FROM told LEFT JOIN near USING (image_id)
    )"""


# Frequencies of 32 by 32 pictures made of 4 by 4 blocks. Those equal to the median are not above it, whatever
# the order of their sums.
HASHED = (
    t.PICTURES
    + """, waves AS (
  SELECT u, x, sum(cos(pi() * u * (2 * p + 1) / 64)) AS c
  FROM range(8) a(u), range(8) b(x), range(4) d(q), LATERAL (SELECT 4 * x + q AS p) GROUP BY u, x
), rows_done AS (
  SELECT image_id, u, x, sum(h * c) AS s FROM grays JOIN waves w(u, y2, c) ON w.y2 = grays.y GROUP BY image_id, u, x
), frequencies AS (
  SELECT image_id, r.u AS v, w.u AS u, sum(s * c) AS f FROM rows_done r JOIN waves w ON w.x = r.x GROUP BY image_id, r.u, w.u
), bits AS (
  SELECT image_id, v * 8 + u AS i, f > median(f) OVER (PARTITION BY image_id) + 0.000001::DOUBLE AS bit FROM frequencies
)"""
)


@query(
    "d1_phash",
    f"""WITH {HASHED} SELECT image_id,
      sum(CASE WHEN bit AND i < 32 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS low_bits,
      sum(CASE WHEN bit AND i >= 32 THEN 1::BIGINT << (i - 32) ELSE 0 END)::BIGINT AS high_bits
    FROM bits GROUP BY image_id""",
)
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = with_phash(t.pictures(spark, sf_dir, repeat=4), hash_size=8)
    word = F.get("words", F.lit(0))
    return hashed.select(
        "image_id",
        word.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low_bits"),
        F.shiftrightunsigned(word, 32).alias("high_bits"),
    )


@query(
    "d1_phash_resampled",
    f"""WITH {t.PICTURES}, hues AS (SELECT image_id, y, x, 0 AS c, h AS v FROM grays), {t.resampled_sql('hues', 5, 64)},
    waves AS (SELECT u, p, cos(pi() * u * (2 * p + 1) / 128) AS w FROM range(16) a(u), range(64) b(p)),
    upright AS (SELECT image_id, u, x, sum(v * w) AS s FROM resampled JOIN waves ON p = y GROUP BY image_id, u, x),
    frequencies AS (SELECT image_id, r.u AS v, k.u AS u, sum(s * w) AS f FROM upright r JOIN waves k ON p = x GROUP BY image_id, r.u, k.u),
    bits AS (SELECT image_id, v * 16 + u AS i, f > median(f) OVER (PARTITION BY image_id) AS bit FROM frequencies)
    SELECT image_id, count_if(bit)::BIGINT AS ones, sum(CASE WHEN bit THEN i ELSE 0 END)::BIGINT AS places,
      sum(CASE WHEN bit THEN i * i ELSE 0 END)::BIGINT AS squares FROM bits GROUP BY image_id""",
)
def d1_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of 256 bits, told by how many bits are set and sums of their places."""
    places = F.sequence(F.lit(0), F.lit(255))
    bit = lambda i: F.getbit(F.get("words", F.shiftright(i, 6)), i % 64).cast("bigint")

    def total(term) -> Column:
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda s, i: s + term(i))

    return with_phash(t.pictures(spark, sf_dir, repeat=5), hash_size=16, equal=0.0).select(
        "image_id",
        total(bit).alias("ones"),
        total(lambda i: bit(i) * i).alias("places"),
        total(lambda i: bit(i) * i * i).alias("squares"),
    )


@query(
    "d2_hamming",
    f"""WITH {t.sign_words_sql()}, firsts AS (
      SELECT label, arg_min(word, image_id) AS first_word FROM hashes GROUP BY label
    ) SELECT image_id, bit_count(xor(word, first_word))::INTEGER AS distance FROM hashes JOIN firsts USING (label)""",
)
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every picture to the first of its label."""
    hashes = t.sign_words(spark, sf_dir)
    firsts = hashes.groupBy("label").agg(F.min_by("words", "image_id").alias("first_words"))
    return hashes.join(firsts, "label").select(
        "image_id", hamming(F.col("words"), F.col("first_words")).alias("distance")
    )


@query(
    "d3_dedup_first_wins",
    f"WITH RECURSIVE {t.sign_words_sql()}, {keep_first_sql('hashes', 6)} SELECT * FROM {nearest_kept_sql('hashes', 6)}",
)
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup_first_wins(t.sign_words(spark, sf_dir), 6, bits=32).select("image_id", "is_duplicate", "duplicate_of")


@query(
    "d3_dedup_orders",
    f"WITH RECURSIVE {t.ORDER_HASHES}, {keep_first_sql('order_hashes', 2)} SELECT * FROM {nearest_kept_sql('order_hashes', 2)}",
)
def d3_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many near copies: about ten orders of a customer within two bits of each other."""
    return dd.dedup_first_wins(t.order_hashes(spark, sf_dir), 2, bits=60).select("image_id", "is_duplicate", "duplicate_of")


@query(
    "d4_dedup_exact",
    f"""WITH {t.sign_words_sql(8)} SELECT image_id, image_id > first_id AS is_duplicate, CASE WHEN image_id > first_id THEN first_id END AS duplicate_of
    FROM (SELECT image_id, min(image_id) OVER (PARTITION BY word) AS first_id FROM hashes)""",
)
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup_exact(t.sign_words(spark, sf_dir, 8)).select("image_id", "is_duplicate", "duplicate_of")


@query(
    "d5_dedup_per_group",
    f"""WITH RECURSIVE {t.FRAMES}, hashed AS (SELECT image_id, video, word FROM frames WHERE word IS NOT NULL),
    {keep_first_sql('hashed', 2, 'video')}
    SELECT * FROM {nearest_kept_sql('hashed', 2, 'video')} UNION ALL SELECT image_id, false, NULL FROM frames WHERE word IS NULL""",
)
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = t.frames(spark, sf_dir).select("image_id", "video", "words")
    return dd.dedup_first_wins(frames, 2, bits=16, group=["video"]).select("image_id", "is_duplicate", "duplicate_of")


@query(
    "d6_dedup_new_only",
    f"""WITH RECURSIVE {t.FRAMES}{RANGES}{DENSE}, hashed AS (
      SELECT row_number() OVER (ORDER BY video, cluster_id, tick) AS image_id, video, cluster_id, tick,
             coalesce(word, CAST(event_word AS BIGINT)) AS word
      FROM (SELECT *, us % 65536 AS event_word FROM dense)
    ), {keep_first_sql('hashed', 2)}
    SELECT video, cluster_id, tick FROM hashed JOIN walk USING (image_id) WHERE NOT dup""",
)
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t.frames(spark, sf_dir).select(
        "image_id", F.coalesce("words", F.array(F.col("us") % 65536)).alias("words")
    )
    dense = _dense(spark, sf_dir).join(words, "image_id")
    return dedup_new_only(dense, 2, bits=16).select("video", "cluster_id", "tick")


@query(
    "d7_dedup_split",
    f"""WITH RECURSIVE {t.sign_words_sql()}, {keep_first_sql('hashes', 7)}
    SELECT count_if(NOT dup)::BIGINT AS kept_count, count_if(dup)::BIGINT AS removed_count FROM walk""",
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup_counts(dd.dedup_first_wins(t.sign_words(spark, sf_dir), 7, bits=32, smallest=False))


@query(
    "d7_dedup_split_rows",
    f"""WITH RECURSIVE {t.sign_words_sql()}, {keep_first_sql('hashes', 7)}
    SELECT CASE WHEN is_duplicate THEN 'removed' ELSE 'kept' END AS side, image_id, duplicate_of FROM {nearest_kept_sql('hashes', 7)}""",
)
def d7_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = dd.dedup_first_wins(t.sign_words(spark, sf_dir), 7, bits=32)
    kept, removed = dd.dedup_split(marked)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "image_id", "duplicate_of")
    return side(kept, "kept").unionByName(side(removed, "removed"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pixel_stats(t.pictures(spark, sf_dir))


for _name, _column in (("q1_gray_mean", "gray_mean"), ("q2_sharpness", "lap_var"), ("q4_contrast", "gray_std")):

    def _measure(spark: SparkSession, sf_dir: str, column: str = _column) -> DataFrame:
        return _stats(spark, sf_dir).select("image_id", F.round(column, 6).alias(column))

    query(_name, f"WITH {t.STATS} SELECT image_id, round({_column}, 6) AS {_column} FROM stats")(_measure)

SUBSCORES = """, subscores AS (
  SELECT *, least(lap_var / 500.0::DOUBLE, 1.0::DOUBLE) * 100 AS sharp,
         CASE WHEN gray_mean < 30 THEN gray_mean / 30.0::DOUBLE * 50 WHEN gray_mean > 230 THEN (255 - gray_mean) / 25.0::DOUBLE * 50 ELSE 100.0::DOUBLE END AS bright,
         least(gray_std / 60.0::DOUBLE, 1.0::DOUBLE) * 100 AS contrast, least(8 / 16.0::DOUBLE, 1.0::DOUBLE) * 100 AS size
  FROM stats
), scores AS (
  SELECT *, round_even(sharp * 0.35::DOUBLE + bright * 0.20::DOUBLE + contrast * 0.20::DOUBLE + size * 0.25::DOUBLE, 1) AS score FROM subscores
)"""


@query("q3_brightness", f"WITH {t.STATS}{SUBSCORES} SELECT image_id, round(bright, 6) AS bright FROM scores")
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("image_id", F.round(ql.brightness_score(F.col("gray_mean")), 6).alias("bright"))


@query(
    "q3_brightness_of_prices",
    """SELECT l_orderkey, l_linenumber, CASE WHEN m < 30 THEN m / 30.0::DOUBLE * 50 WHEN m > 230 THEN (255 - m) / 25.0::DOUBLE * 50 ELSE 100.0::DOUBLE END AS bright
    FROM (SELECT l_orderkey, l_linenumber, l_quantity * 5.1::DOUBLE AS m FROM lineitem)""",
)
def q3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole range of brightness, from order lines."""
    mean = F.col("l_quantity") * 5.1
    return t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ql.brightness_score(mean).alias("bright"))


@query(
    "q5_size_score",
    f"WITH {t.FRAMES} SELECT image_id, least(least(width, height) / 256.0::DOUBLE, 1.0::DOUBLE) * 100 AS size FROM frames",
)
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.frames(spark, sf_dir).select("image_id", ql.size_score(F.least("width", "height")).alias("size"))


@query("q6_quality_score", f"WITH {t.STATS}{SUBSCORES} SELECT image_id, score, round_even(sharp, 1) AS sharp, '8x8' AS size FROM scores")
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.quality_score(_stats(spark, sf_dir), 16).select(
        "image_id", "score", F.col("details.subscores.sharpness").alias("sharp"), F.col("details.size").alias("size")
    )


@query(
    "q7_quality_split",
    f"""WITH {t.STATS}{SUBSCORES} SELECT image_id, score >= 74 AS passed,
      (CASE WHEN score >= 74 THEN 'PASS ' ELSE 'FAIL ' END) || 'image_' || image_id || ': ' || CAST(CAST(score AS DECIMAL(10,1)) AS VARCHAR) || '/100 — 8x8' AS log_line
    FROM scores""",
)
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.quality_split(_stats(spark, sf_dir), 74.0, 16).select("image_id", "passed", "log_line")


@query(
    "q8_score_distribution",
    f"""WITH {t.STATS}{SUBSCORES} SELECT CAST(greatest(0, least(19, floor(score / 5.0))) AS INTEGER) AS bin,
      5.0::DOUBLE * CAST(greatest(0, least(19, floor(score / 5.0))) AS INTEGER) AS from_score, count(*) AS n FROM scores GROUP BY ALL""",
)
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.score_distribution(ql.quality_score(_stats(spark, sf_dir), 16))


P1_SQL = """, cut AS (
  SELECT *, trunc(width * bx1 / 100)::BIGINT AS x1, trunc(height * by1 / 100)::BIGINT AS y1,
         trunc(width * bx2 / 100)::BIGINT AS x2, trunc(height * by2 / 100)::BIGINT AS y2 FROM boxes
), padded AS (
  SELECT l_orderkey, l_linenumber, width, height, has_bbox, x2 <= x1 OR y2 <= y1 AS empty,
         greatest(0, x1 - trunc((x2 - x1) * 5 / 100)::BIGINT) AS x1, greatest(0, y1 - trunc((y2 - y1) * 5 / 100)::BIGINT) AS y1,
         least(width, x2 + trunc((x2 - x1) * 5 / 100)::BIGINT) AS x2, least(height, y2 + trunc((y2 - y1) * 5 / 100)::BIGINT) AS y2
  FROM cut
), grown AS (
  SELECT *, x2 - x1 AS cw, y2 - y1 AS ch,
         greatest(0, y1 - (x2 - x1 - (y2 - y1)) // 2) AS ny1, greatest(0, x1 - (y2 - y1 - (x2 - x1)) // 2) AS nx1 FROM padded
), far AS (
  SELECT *, least(height, ny1 + cw) AS ny2, least(width, nx1 + ch) AS nx2 FROM grown
), squared AS (
  SELECT l_orderkey, l_linenumber, width, height, has_bbox, empty,
         CASE WHEN ch > cw THEN (CASE WHEN nx2 - nx1 < ch THEN greatest(0, nx2 - ch) ELSE nx1 END) ELSE x1 END AS x1,
         CASE WHEN cw > ch THEN (CASE WHEN ny2 - ny1 < cw THEN greatest(0, ny2 - cw) ELSE ny1 END) ELSE y1 END AS y1,
         CASE WHEN ch > cw THEN nx2 ELSE x2 END AS x2, CASE WHEN cw > ch THEN ny2 ELSE y2 END AS y2
  FROM far
)"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "crop.x1", "crop.y1", "crop.x2", "crop.y2")


def _p1_select(otherwise: str, more: str = "") -> str:
    ox1, oy1, ox2, oy2 = otherwise.split(";")
    return f"""WITH {t.BOXES}{P1_SQL} SELECT l_orderkey, l_linenumber,
      CAST(CASE WHEN NOT has_bbox THEN {ox1} WHEN empty THEN 0 ELSE x1 END AS INTEGER) AS x1,
      CAST(CASE WHEN NOT has_bbox THEN {oy1} WHEN empty THEN 0 ELSE y1 END AS INTEGER) AS y1,
      CAST(CASE WHEN NOT has_bbox THEN {ox2} WHEN empty THEN width ELSE x2 END AS INTEGER) AS x2,
      CAST(CASE WHEN NOT has_bbox THEN {oy2} WHEN empty THEN height ELSE y2 END AS INTEGER) AS y2 FROM squared {more}"""


@query("p1_crop_box", _p1_select("0;0;0;0", "WHERE has_bbox"))
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(gm.crop_box(t.boxes(spark, sf_dir).filter("bbox is not null")))


@query("p2_crop_keep_original", _p1_select("0;0;width;height"))
def p2_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(gm.smart_crop(t.boxes(spark, sf_dir)))


_SIDE = "least(width, height)"


@query(
    "p2_crop_center",
    _p1_select(
        f"(width - {_SIDE}) // 2;(height - {_SIDE}) // 2;(width - {_SIDE}) // 2 + {_SIDE};(height - {_SIDE}) // 2 + {_SIDE}"
    ),
)
def p2_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(gm.smart_crop(t.boxes(spark, sf_dir), fallback="center_crop"))


@query("p2_crop_skip", _p1_select("0;0;0;0", "WHERE has_bbox"))
def p2_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(gm.smart_crop(t.boxes(spark, sf_dir), fallback="skip"))


@query(
    "p3_correction_params",
    f"""WITH {t.CORRECTIONS} SELECT l_orderkey, l_linenumber,
      CASE WHEN abs(b - 1.0) > 0.01 THEN greatest(0.5::DOUBLE, least(1.5::DOUBLE, b)) END AS brightness,
      CASE WHEN abs(c - 1.0) > 0.01 THEN greatest(0.5::DOUBLE, least(1.5::DOUBLE, c)) END AS contrast,
      CASE WHEN abs(s - 1.0) > 0.01 AND s > 1 THEN (CASE WHEN s >= 2 THEN 150 ELSE 10 END) END AS unsharp_percent,
      CASE WHEN abs(s - 1.0) > 0.01 AND s <= 1 THEN greatest(0.3::DOUBLE, s) END AS soften FROM asked""",
)
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.correction_params(t.corrections(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "brightness", "contrast", "unsharp_percent", "soften"
    )


@query(
    "p4_edge_crop",
    f"""WITH {t.CORRECTIONS}, cut AS (
      SELECT *, trunc(width * pl / 100)::INTEGER AS l, trunc(width * pr / 100)::INTEGER AS r, trunc(height * pb / 100)::INTEGER AS d FROM asked
    ), decided AS (SELECT *, l + r + d > 0 AND width - l - r > 64 AND height - d > 64 AS does FROM cut)
    SELECT l_orderkey, l_linenumber, CASE WHEN does THEN l ELSE 0 END AS x1, 0 AS y1,
      CASE WHEN does THEN width - r ELSE width END AS x2, CASE WHEN does THEN height - d ELSE height END AS y2 FROM decided""",
)
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(gm.edge_crop(t.corrections(spark, sf_dir)))


def _p5_sql(mode: str) -> str:
    side = "least(width, height)" if mode == "crop_center" else "greatest(width, height)"
    fit = f"trunc(width * (512.0::DOUBLE / {side}))::BIGINT AS nw, trunc(height * (512.0::DOUBLE / {side}))::BIGINT AS nh"
    made = {
        "resize": ("512", "512", "0", "0", "512", "512"),
        "pad": ("nw", "nh", "(512 - nw) // 2", "(512 - nh) // 2", "512", "512"),
        "crop_center": ("nw", "nh", "-floor((nw - 512) / 2.0)", "-floor((nh - 512) / 2.0)", "512", "512"),
        "longest_side": ("greatest(64, nw // 64 * 64)", "greatest(64, nh // 64 * 64)", "0", "0", "greatest(64, nw // 64 * 64)", "greatest(64, nh // 64 * 64)"),
    }[mode]
    names = ("scaled_w", "scaled_h", "offset_x", "offset_y", "out_w", "out_h")
    chosen = ", ".join(f"CAST({e} AS INTEGER) AS {n}" for e, n in zip(made, names))
    return f"WITH {t.BOXES} SELECT l_orderkey, l_linenumber, {chosen} FROM (SELECT *, {fit} FROM boxes)"


for _mode in gm.RESIZE_MODES:

    def _resized(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        return gm.resize(t.boxes(spark, sf_dir), 512, mode).drop("width", "height", "bbox")

    query(f"p5_resize_{_mode}", _p5_sql(_mode))(_resized)


@query(
    "p6_correction_log",
    f"""WITH {t.CORRECTIONS}, parts AS (SELECT *,
      CASE WHEN b <> 1 THEN 'bright=' || CAST(CAST(b AS DECIMAL(20,2)) AS VARCHAR) END AS pb1,
      CASE WHEN c <> 1 THEN 'contrast=' || CAST(CAST(c AS DECIMAL(20,2)) AS VARCHAR) END AS pc1,
      CASE WHEN s <> 1 THEN 'sharp=' || CAST(CAST(round(s * 10000) / 10000 AS DECIMAL(20,4)) AS DECIMAL(20,2)) END AS ps1,
      CASE WHEN pl + pr + pb > 0 THEN 'crop=' || CAST(round_even(pl + pr + pb, 0) AS BIGINT) || '%' END AS pt1 FROM asked)
    SELECT l_orderkey, l_linenumber, CASE WHEN concat_ws(', ', pb1, pc1, ps1, pt1) = '' THEN 'No corrections needed'
      ELSE concat_ws(', ', pb1, pc1, ps1, pt1) END AS log_line FROM parts""",
)
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.correction_log(t.corrections(spark, sf_dir)).select("l_orderkey", "l_linenumber", "log_line")


@query(
    "p7_apply_pixels",
    f"""WITH {t.PICTURES}, edited AS (
      SELECT image_id, y, x, least(255, floor(b * f))::BIGINT AS b, least(255, floor(g * f))::BIGINT AS g, least(255, floor(r * f))::BIGINT AS r
      FROM (SELECT *, 0.5::DOUBLE + 0.125::DOUBLE * (label % 9) AS f FROM blocks) WHERE x >= 1 AND y >= 2 AND x < 7
    ) SELECT image_id, 6 AS width, 6 AS height, sum(b + g + r)::BIGINT AS bytes,
      sum(b * (((y - 2) * 6 + x - 1) * 3 + 1) + g * (((y - 2) * 6 + x - 1) * 3 + 2) + r * (((y - 2) * 6 + x - 1) * 3 + 3))::BIGINT AS placed
    FROM edited GROUP BY image_id""",
)
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor of brightness by label, and a crop of six by six."""
    plan = t.pictures(spark, sf_dir).withColumns(
        {
            "brightness": 0.5 + 0.125 * (F.col("label") % 9),
            "crop": F.struct(F.lit(1).alias("x1"), F.lit(2).alias("y1"), F.lit(7).alias("x2"), F.lit(8).alias("y2")),
        }
    )
    return with_byte_sums(apply_pixels(plan)).select("image_id", "width", "height", "bytes", "placed")


@query(
    "p7_resize_and_pad",
    f"""WITH {t.PICTURES}, channels AS (
      SELECT image_id, y, x, unnest([0, 1, 2]) AS c, unnest([b, g, r]) AS v FROM blocks
    ), {t.resampled_sql('channels', 2, 20, '0.5000000001::DOUBLE')}
    SELECT image_id, 30 AS width, 26 AS height, sum(v)::BIGINT AS bytes, sum(v * (((y + 3) * 30 + x + 5) * 3 + c + 1))::BIGINT AS placed
    FROM resampled GROUP BY image_id""",
)
def p7_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {"scaled_w": 20, "scaled_h": 20, "offset_x": 5, "offset_y": 3, "out_w": 30, "out_h": 26}
    plan = t.pictures(spark, sf_dir, repeat=2).withColumns({name: F.lit(n) for name, n in sizes.items()})
    return with_byte_sums(apply_pixels(plan)).select("image_id", "width", "height", "bytes", "placed")


@query(
    "p7_contrast",
    f"""WITH {t.PICTURES}, means AS (SELECT image_id, floor(sum(h) / 64.0::DOUBLE + 0.5) AS m FROM grays GROUP BY image_id),
    channels AS (SELECT image_id, i, unnest([0, 1, 2]) AS c, unnest([b, g, r]) AS v FROM blocks),
    changed AS (SELECT image_id, i, c, floor(greatest(0, least(255, m + 1.25::DOUBLE * (v - m)))) AS v FROM channels JOIN means USING (image_id))
    SELECT image_id, sum(v)::BIGINT AS bytes, sum(v * (i * 3 + c + 1))::BIGINT AS placed FROM changed GROUP BY image_id""",
)
def p7_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = t.pictures(spark, sf_dir).withColumn("contrast", F.lit(1.25))
    return with_byte_sums(apply_pixels(plan)).select("image_id", "bytes", "placed")


@query(
    "p7_soften",
    f"""WITH {t.PICTURES}, channels AS (SELECT image_id, y, x, unnest([0, 1, 2]) AS c, unnest([b, g, r]) AS v FROM blocks),
    lists AS (SELECT image_id, c, list(v ORDER BY y * 8 + x) AS l FROM channels GROUP BY image_id, c),
    around AS (
      SELECT image_id, c, y, x, any_value(v) AS v, sum(l[greatest(0, least(7, y + dy)) * 8 + greatest(0, least(7, x + dx)) + 1]) AS s
      FROM channels JOIN lists USING (image_id, c), (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b GROUP BY image_id, c, y, x
    ), smooth AS (SELECT *, (s + 4 * v) / 13.0::DOUBLE AS m FROM around),
    changed AS (SELECT *, floor(greatest(0, least(255, m + 0.5::DOUBLE * (v - m) + 0.5))) AS n FROM smooth)
    SELECT image_id, sum(n)::BIGINT AS bytes, sum(n * ((y * 8 + x) * 3 + c + 1))::BIGINT AS placed FROM changed GROUP BY image_id""",
)
def p7_soften(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = t.pictures(spark, sf_dir).withColumn("soften", F.lit(0.5))
    return with_byte_sums(apply_pixels(plan)).select("image_id", "bytes", "placed")


@query(
    "p7_unsharp",
    f"""WITH {t.PICTURES}, channels AS (SELECT image_id, y, x, unnest([0, 1, 2]) AS c, unnest([b, g, r]) AS v FROM blocks),
    taps AS (SELECT n, exp(-(n * n) / 8.0::DOUBLE) / sum(exp(-(n * n) / 8.0::DOUBLE)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS n)),
    reach AS (SELECT o, greatest(0, least(7, o + n)) AS i, sum(w) AS w FROM range(8) a(o), taps GROUP BY ALL),
    upright AS (SELECT image_id, c, o AS y, x, sum(v * w) AS v FROM channels JOIN reach ON i = y GROUP BY image_id, c, o, x),
    blurred AS (SELECT image_id, c, y, o AS x, sum(v * w) AS m FROM upright JOIN reach ON i = x GROUP BY image_id, c, y, o),
    detail AS (SELECT image_id, c, y, x, v, CASE WHEN abs(v - m) <= 3 THEN 0.0::DOUBLE ELSE v - m END AS d FROM channels JOIN blurred USING (image_id, c, y, x)),
    changed AS (SELECT *, floor(greatest(0, least(255, v + d * 150 / 100 + 0.5))) AS n FROM detail)
    SELECT image_id, sum(n)::BIGINT AS bytes, sum(n * ((y * 8 + x) * 3 + c + 1))::BIGINT AS placed FROM changed GROUP BY image_id""",
)
def p7_unsharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = t.pictures(spark, sf_dir).withColumn("unsharp_percent", F.lit(150))
    return with_byte_sums(apply_pixels(plan)).select("image_id", "bytes", "placed")


@query("p7_apply_pixels_all_steps")
def p7_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.struct(
        F.lit(1.2).alias("brightness"), F.lit(0.8).alias("contrast"), (0.5 + F.col("label") % 3).alias("sharpness"),
        F.lit(0).alias("crop_left_pct"), F.lit(0).alias("crop_right_pct"), F.lit(0).alias("crop_top_pct"), F.lit(0).alias("crop_bottom_pct"),
    )
    pictures = t.pictures(spark, sf_dir, repeat=4).withColumn("corrections", asked)
    plan = gm.resize(gm.auto_correct(pictures), 24, "pad")
    return with_byte_sums(apply_pixels(plan)).select("image_id", "width", "height", "bytes", "placed")
