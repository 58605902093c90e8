"""The inputs of the operators, derived from the given tables, and the same in SQL.

There are no pictures among the tables, so events play the frames of videos (a
user is a video, an hour of the clock a second of film), embeddings are small
pictures, documents give the answers of a model, and pages a file catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.functions.arith import floor_div
from imgcurate.operators.sampling import frame_name

# Microseconds of the clock in one second of film.
SECOND = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock(ts: str = "ts") -> Column:
    """Microseconds since the start of 2024."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.col("us")
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        table(spark, sf_dir, "events")
        .withColumn("us", clock())
        .select(
            F.col("event_id").alias("image_id"),
            F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video"),
            "user_id",
            "us",
            (us / F.lit(float(SECOND))).alias("ts"),
            floor_div(us, SECOND).alias("frame_no"),
            (F.col("value") / 1000.0).alias("scene_score"),
            (F.col("event_type") == "view").alias("is_keyframe"),
            (F.lit(128) + 8 * k).alias("width"),
            (F.lit(96) + 6 * (F.col("event_id") % 97)).cast("int").alias("height"),
            F.when(
                F.col("event_type") != "error", F.array(F.round(F.col("value") * 100).cast("bigint"))
            ).alias("words"),
            F.least(F.col("value") / 20.0, F.lit(12.0)).alias("score"),
        )
        .withColumn("filename", frame_name("video", "frame_no"))
    )


FRAMES = f"""
ticks AS (
  SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
), frames AS (
  SELECT event_id AS image_id, 'v' || user_id AS video, user_id, us,
         us / {SECOND}.0::DOUBLE AS ts, us // {SECOND} AS frame_no,
         value / 1000.0::DOUBLE AS scene_score, event_type = 'view' AS is_keyframe,
         128 + 8 * k AS width, CAST(96 + 6 * (event_id % 97) AS INTEGER) AS height,
         CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS word,
         least(value / 20.0::DOUBLE, 12.0::DOUBLE) AS score,
         printf('%s_frame_%06d.jpg', 'v' || user_id, us // {SECOND}) AS filename
  FROM ticks
)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One picture per user and day; its events are what was detected in it."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100 + floor_div(clock(), 86_400_000_000)).alias("image_id"),
        F.col("event_id").alias("det_no"),
        F.col("event_type").alias("class"),
        (F.least(F.col("value"), F.lit(100.0)) / 100.0).alias("score"),
    )


def detection_images(found: DataFrame) -> DataFrame:
    return found.groupBy("image_id").agg(F.count(F.lit(1)).alias("found")).withColumn(
        "filename", F.format_string("frame_%06d.jpg", "image_id")
    )


def weights(spark: SparkSession) -> DataFrame:
    """Weights a caller may bring; classes that are not listed weigh nothing."""
    return spark.createDataFrame(
        [("purchase", 3.0, True), ("signup", 1.0, True), ("click", 0.3, False)],
        "class string, weight double, report boolean",
    )


DETECTIONS = """
detections AS (
  SELECT user_id * 100 + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 AS image_id,
         event_id AS det_no, event_type AS class, least(value, 100.0::DOUBLE) / 100.0::DOUBLE AS score
  FROM events
), weights(class, weight, report) AS (
  VALUES ('purchase', 3.0::DOUBLE, true), ('signup', 1.0::DOUBLE, true), ('click', 0.3::DOUBLE, false)
)"""


def _level(x: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * x.cast("double")))).cast("int")


def _hex(levels: Column) -> Column:
    return F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, spread over all cores while they are narrow: pictures are made of them."""
    return table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism)


def pictures(spark: SparkSession, sf_dir: str, repeat: int = 1, channels: int = 3) -> DataFrame:
    """Colour pictures of 8 by 8 blocks, a block per number of the embedding.

    A block is ``repeat`` pixels wide and high. Green, red and, with four channels, alpha
    are the levels of the next blocks.
    """
    side = 8 * repeat
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.repeat(
            F.concat(*[F.get("levels", (i + c) % 64) for c in range(channels)]), F.lit(repeat)
        ),
    )
    lines = F.transform(
        F.sequence(F.lit(1), F.lit(57), F.lit(8)),
        lambda first: F.repeat(F.array_join(F.slice("blocks", first, F.lit(8)), ""), F.lit(repeat)),
    )
    return (
        _embeddings(spark, sf_dir)
        .withColumn("levels", _hex(F.transform("embedding", _level)))
        .withColumn("blocks", blocks)
        .select(
            F.col("vec_id").alias("image_id"),
            "label",
            F.lit(side).alias("height"),
            F.lit(side).alias("width"),
            F.lit(channels).alias("n_channels"),
            F.unhex(F.array_join(lines, "")).alias("data"),
            F.concat(F.lit("image_"), F.col("vec_id").cast("string")).alias("filename"),
        )
    )


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray pictures of all 64 numbers, 4 to 32 wide by label and as high as it takes."""
    width = F.expr("shiftleft(4, cast(label % 4 as int))")
    return _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("image_id"),
        (F.lit(64) / width).cast("int").alias("height"),
        width.alias("width"),
        F.lit(1).alias("n_channels"),
        F.unhex(F.array_join(_hex(F.transform("embedding", _level)), "")).alias("data"),
    )


PICTURES = """
levels AS (
  SELECT vec_id AS image_id, label,
         list_transform(embedding, lambda x: CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 128 + 400 * CAST(x AS DOUBLE)))) AS BIGINT)) AS v
  FROM embeddings
), blocks AS (
  SELECT image_id, label, v, CAST(i AS BIGINT) AS i, i // 8 AS y, i % 8 AS x,
         v[i + 1] AS b, v[(i + 1) % 64 + 1] AS g, v[(i + 2) % 64 + 1] AS r
  FROM levels, range(64) AS t(i)
), grays AS (
  SELECT image_id, i, y, x, (4899 * r + 9617 * g + 1868 * b + 8192) // 16384 AS l,
         (19595 * r + 38470 * g + 7471 * b + 32768) // 65536 AS h
  FROM blocks
)"""



def resampled_sql(source: str, repeat: int, size: int, half: str = "0.5") -> str:
    """CTEs from ``source(image_id, y, x, c, v)``, 8 by 8 blocks of ``repeat`` pixels, to ``resampled`` of a size.

    Lanczos weights of the pixels of a block are added up, rows and columns one after the other.
    Where levels may lie on exact halves, a ``half`` that is larger by ``EQUAL_LEVELS`` takes them
    up whatever the order of the sums, as ``resample`` does.
    """
    side = 8 * repeat
    widen = max(side / size, 1.0)
    place = f"(p + 0.5::DOUBLE - (d + 0.5::DOUBLE) * {side / size!r}::DOUBLE) / {widen!r}::DOUBLE"
    return f"""distances AS (
  SELECT d, p // {repeat} AS block, {place} AS x FROM range({size}) a(d), range({side}) b(p)
), plain_weights AS (
  SELECT d, block, CASE WHEN x = 0 THEN 1.0::DOUBLE WHEN abs(x) < 3 THEN sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) ELSE 0.0::DOUBLE END AS w
  FROM distances
), lanczos AS (
  SELECT d, block, sum(w) / any_value(total) AS w
  FROM plain_weights JOIN (SELECT d, sum(w) AS total FROM plain_weights GROUP BY d) USING (d) GROUP BY d, block
), tall AS (
  SELECT image_id, c, l.d AS y, s.x, sum(s.v * l.w) AS v FROM {source} s JOIN lanczos l ON l.block = s.y GROUP BY image_id, c, l.d, s.x
), resampled AS (
  SELECT image_id, c, y, l.d AS x, CAST(greatest(0, least(255, floor(sum(v * l.w) + {half}))) AS BIGINT) AS v
  FROM tall JOIN lanczos l ON l.block = tall.x GROUP BY image_id, c, y, l.d
)"""


# Population variance from exact sums, as in the kernels.
STATS = (
    PICTURES
    + """, gray_lists AS (
  SELECT image_id, list(l ORDER BY i) AS l FROM grays GROUP BY image_id
), edges AS (
  SELECT g.image_id, g.l AS l,
         n.l[abs(g.y - 1) * 8 + g.x + 1] + n.l[(7 - abs(6 - g.y)) * 8 + g.x + 1]
         + n.l[g.y * 8 + abs(g.x - 1) + 1] + n.l[g.y * 8 + (7 - abs(6 - g.x)) + 1] - 4 * g.l AS e
  FROM grays g JOIN gray_lists n USING (image_id)
), stats AS (
  SELECT image_id,
         CAST(sum(l) AS BIGINT) / 64.0::DOUBLE AS gray_mean,
         sqrt((64 * CAST(sum(l * l) AS BIGINT) - CAST(sum(l) AS BIGINT) * CAST(sum(l) AS BIGINT)) / 4096.0::DOUBLE) AS gray_std,
         (64 * CAST(sum(e * e) AS BIGINT) - CAST(sum(e) AS BIGINT) * CAST(sum(e) AS BIGINT)) / 4096.0::DOUBLE AS lap_var
  FROM edges GROUP BY image_id
)"""
)


def sign_word(bits: int) -> Column:
    """The signs of all 64 numbers of an embedding, of which each ``64 / bits`` make a bit, even or odd."""

    def bit(i: Column) -> Column:
        signs = F.transform(F.sequence(F.lit(0), F.lit(64 // bits - 1)), lambda j: F.get("embedding", i + j * bits) >= 0)
        return F.size(F.filter(signs, lambda s: s)).cast("bigint") % 2

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("bigint"), lambda total, i: total * 2 + bit(i)
    )


def sign_words(spark: SparkSession, sf_dir: str, bits: int = 32) -> DataFrame:
    """A hash per picture from the signs of its embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("label"), F.array(sign_word(bits)).alias("words")
    )


def sign_words_sql(bits: int = 32) -> str:
    return f"""
hashes AS (
  SELECT vec_id AS image_id, label,
         list_sum(list_transform(range({bits}), lambda i: len(list_filter(range({64 // bits}), lambda j: embedding[i + 1 + j * {bits}] >= 0)) % 2 << ({bits} - 1 - i)))::BIGINT AS word
  FROM embeddings
)"""


def order_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 60-bit hash per order: that of its customer with one bit turned, so orders of a customer are near."""
    digits = F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 15)
    turned = F.expr("shiftleft(1L, cast(o_orderkey % 60 as int))")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.array(F.conv(digits, 16, 10).cast("bigint").bitwiseXOR(turned)).alias("words"),
    )


ORDER_HASHES = """
order_hashes AS (
  SELECT o_orderkey AS image_id, xor(('0x' || md5(CAST(o_custkey AS VARCHAR))[1:15])::BIGINT, 1::BIGINT << (o_orderkey % 60)) AS word FROM orders
)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer per document, in the forms such answers come in.

    Form by number: plain, in prose, with trailing commas, empty object, nothing,
    plain text, two objects, fenced.
    """
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    has_box = n % 5 != 0
    record = F.to_json(
        F.struct(
            (F.col("toxic") == 0).alias("keep"),
            (n % 11).alias("quality"),
            F.concat(F.lit("from "), "source").alias("reason"),
            F.col("lang").alias("pose"),
            F.col("source").alias("camera_angle"),
            (n % 101).alias("quality_score"),
            F.array("lang", "source", F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")), F.lit("a"), F.lit("b"), F.lit("c")).alias("tags"),
            F.when(has_box, F.array(n % 40, n % 30, F.lit(50) + n % 50, F.lit(40) + n % 60)).alias("bbox"),
            F.when(has_box & (F.col("doc_id") % 2 == 0), F.lit(0.75)).alias("confidence"),
        )
    )
    form = F.col("doc_id") % 8
    response = (
        F.when(form == 0, record)
        .when(form == 1, F.concat(F.lit("Sure, here it is: "), record, F.lit(" Hope it helps.")))
        .when(form == 2, F.replace(F.replace(record, F.lit("]"), F.lit(",]")), F.lit("}"), F.lit(",}")))
        .when(form == 3, F.lit("{}"))
        .when(form == 4, F.lit(""))
        .when(form == 5, F.concat(F.lit("No object: "), F.translate("text", "{}[]", "()()")))
        .when(form == 6, F.concat(record, F.lit(" and "), record))
        .otherwise(F.concat(F.lit("```json\n"), record, F.lit("\n```")))
    )
    return labelled.select(
        F.col("doc_id").alias("image_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename"),
        "lang",
        "source",
        response.alias("response"),
    )


ANSWERS = """
answers AS (
  SELECT doc_id AS image_id, 'doc_' || doc_id || '.jpg' AS filename, d.text, d.lang, d.source, n_chars AS n,
         toxic, doc_id % 8 AS form, doc_id % 8 IN (0, 1, 2, 7) AS ok
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: a folder per host, and a name by page number."""
    extensions = F.array(*[F.lit(e) for e in (".png", ".jpg", ".JPEG", ".webp", ".gif", ".txt", ".tiff", ".mp4")])
    host = F.regexp_extract("url", r"://([^/]+)/", 1)
    name = F.concat(F.lit("P"), (F.col("page_id") * 37 % 1000).cast("string"), F.lit("_"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/data/"), host, F.lit("/"), name, F.get(extensions, (F.col("page_id") % 8).cast("int"))).alias("path"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 7919 % 1000 * 60).alias("modificationTime"),
        F.length("html").cast("bigint").alias("length"),
    )


CATALOG = """
catalog AS (
  SELECT '/data/' || regexp_extract(url, '://([^/]+)/', 1) || '/P' || (page_id * 37 % 1000) || '_' || page_id
           || (['.png', '.jpg', '.JPEG', '.webp', '.gif', '.txt', '.tiff', '.mp4'])[page_id % 8 + 1] AS path,
         'P' || (page_id * 37 % 1000) || '_' || page_id
           || (['.png', '.jpg', '.JPEG', '.webp', '.gif', '.txt', '.tiff', '.mp4'])[page_id % 8 + 1] AS name,
         lower((['.png', '.jpg', '.JPEG', '.webp', '.gif', '.txt', '.tiff', '.mp4'])[page_id % 8 + 1]) AS ext,
         regexp_extract(url, '://([^/]+)/', 1) AS host,
         page_id * 7919 % 1000 * 60 AS mtime, length(html)::BIGINT AS length, page_id
  FROM pages
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture sizes and percent boxes from order lines; some boxes have no area, some are missing."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    p = F.col("l_partkey")
    box = F.array(q - 1, d * 500, q - 1 + p % 60, d * 500 + t * 700)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.lit(40) + p % 1900).cast("int").alias("width"),
        (F.lit(40) + F.col("l_suppkey") * 13 % 1200).cast("int").alias("height"),
        F.when(F.col("l_returnflag") != "R", box).alias("bbox"),
    )


BOXES = """
boxes AS (
  SELECT l_orderkey, l_linenumber, CAST(40 + l_partkey % 1900 AS INTEGER) AS width,
         CAST(40 + l_suppkey * 13 % 1200 AS INTEGER) AS height, l_returnflag <> 'R' AS has_bbox,
         l_quantity - 1 AS bx1, l_discount * 500 AS by1,
         l_quantity - 1 + l_partkey % 60 AS bx2, l_discount * 500 + l_tax * 700 AS by2
  FROM lineitem
)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for corrections from order lines."""
    part = F.col("l_linenumber") % 3
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.lit(40) + F.col("l_partkey") % 1900).cast("int").alias("width"),
        (F.lit(40) + F.col("l_suppkey") * 13 % 1200).cast("int").alias("height"),
        F.struct(
            (F.col("l_quantity") / 25.0).alias("brightness"),
            F.when(part == 0, 1.0 + F.col("l_discount")).alias("contrast"),
            (F.col("l_quantity") * 0.0625).alias("sharpness"),
            (F.col("l_tax") * 100).alias("crop_left_pct"),
            F.when(part == 1, F.col("l_discount") * 100).alias("crop_right_pct"),
            F.lit(0.0).alias("crop_top_pct"),
            F.when(part == 2, F.lit(12.5)).alias("crop_bottom_pct"),
        ).alias("corrections"),
    )


CORRECTIONS = """
asked AS (
  SELECT l_orderkey, l_linenumber, CAST(40 + l_partkey % 1900 AS INTEGER) AS width,
         CAST(40 + l_suppkey * 13 % 1200 AS INTEGER) AS height,
         l_quantity / 25.0::DOUBLE AS b, CASE WHEN l_linenumber % 3 = 0 THEN 1.0::DOUBLE + l_discount ELSE 1.0::DOUBLE END AS c,
         l_quantity * 0.0625::DOUBLE AS s, l_tax * 100 AS pl,
         CASE WHEN l_linenumber % 3 = 1 THEN l_discount * 100 ELSE 0.0::DOUBLE END AS pr,
         CASE WHEN l_linenumber % 3 = 2 THEN 12.5::DOUBLE ELSE 0.0::DOUBLE END AS pb
  FROM lineitem
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs from orders: one a day of the order date, seconds from the first day on."""
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1990-01-01 00:00:00', o_orderdate)")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        start.alias("start_s"),
        (start + F.col("o_orderkey") % 600 + 1).alias("end_s"),
        (F.col("o_orderstatus") != "P").alias("ok"),
    )


RUNS = """
runs AS (
  SELECT o_orderkey AS image_id, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1990-01-01')) // 1000000 AS start_s,
         (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1990-01-01')) // 1000000 + o_orderkey % 600 + 1 AS end_s,
         o_orderstatus <> 'P' AS ok
  FROM orders
)"""
