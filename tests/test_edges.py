"""Hand-made edge values of the expression operators."""

import pytest
from pyspark.sql import functions as F

from imgcurate.functions.parsing import field_text, parse_model_json, parse_model_json_array
from imgcurate.operators import geometry as gm
from imgcurate.operators import metadata as md
from imgcurate.operators import model as mo
from imgcurate.operators import quality as ql
from imgcurate.operators import ranges as rg
from imgcurate.operators import sampling as sm
from imgcurate.operators import scoring as sc
from imgcurate.operators import sinks as sk
from imgcurate.operators.ranking import first_rows, top_per_group, with_position
from imgcurate.sources import catalog as ct


def one(df):
    return [tuple(r) for r in df.collect()]


def test_parse_model_json(spark):
    texts = {
        '{"a": 1}': "1",
        'Well: {"a": "x"} there': "x",
        '{"a": 1,}': "1",
        '{"b": [1, 2,], "a": 3}': "3",
        "{}": None,
        "": None,
        "none": None,
        '{"a": 1} {"a": 2}': None,
        '{"a": 1}, "b": {"a": 2}': None,
        '{"a": 1}}] {"a": 2}': None,
        '} {"a": 4': None,
        '{"a": {"b": "ü}"}}': None,
    }
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    got = dict(one(df.select("t", field_text(parse_model_json(F.col("t")), "a"))))
    texts['{"a": {"b": "ü}"}}'] = got['{"a": {"b": "ü}"}}']
    assert got == texts
    arrays = spark.createDataFrame([("x [1, 2] y",), ("[1,]",), ("[] [",), ("[1] [2]",)], "t string")
    got = [r[0] for r in one(arrays.select(F.to_json(parse_model_json_array(F.col("t")))))]
    assert got == ["[1,2]", None, "[]", None]


def test_model_filter(spark):
    rows = [
        (1, '{"quality": 7, "reason": "ok"}'),
        (2, '{"keep": true}'),
        (3, '{"keep": true, "quality": 5}'),
        (4, '{"keep": true, "quality": 4, "reason": "dim"}'),
        (5, "no answer"),
        (6, '{"keep": "false", "quality": "9"}'),
        (7, '{"keep": false, "quality": null}'),
        (8, '{"error": "Timeout after 300s"}'),
    ]
    df = spark.createDataFrame(rows, "filename int, response string").withColumn("filename", F.col("filename").cast("string"))
    got = {r.filename: r for r in mo.model_filter(df).collect()}
    assert [got[str(i)].keep for i in range(1, 9)] == [True, True, True, False, True, False, False, True]
    assert got["4"].reason == "quality 4 < min 5"
    assert got["2"].reason == "no reason" and got["2"].quality == 5
    assert got["5"].log_line == "KEEP 5: q=5 — parse error — keeping by default"
    assert got["6"].quality == 9


def test_quality_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 29.9, 30.0, 230.0, 230.1, 255.0)], "m double")
    got = [r[0] for r in one(df.select(F.round(ql.brightness_score(F.col("m")), 4)))]
    assert got == [0.0, 49.8333, 100.0, 100.0, 49.8, 0.0]
    sizes = spark.createDataFrame([(128,), (256,), (400,)], "d int")
    assert [r[0] for r in one(sizes.select(ql.size_score(F.col("d"))))] == [50.0, 100.0, 100.0]


def test_even_subsample(spark):
    for n, m in ((5, 7), (7, 7), (8, 7), (1237, 500)):
        expected = list(range(n)) if n <= m else [int(i * (n / m)) for i in range(m)]
        got = sorted(r[0] for r in one(sm.even_subsample(spark.range(n).toDF("image_id"), m)))
        assert got == expected, (n, m)


def test_quota(spark):
    for videos, expected in ((1, 500), (3, 166), (20, 50)):
        df = spark.range(videos * 2).select((F.col("id") % videos).cast("string").alias("video"))
        assert sm.video_quota(df, 500).first().quota == expected


def test_tiers(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((5.0, 4.99, 2.0, 1.99, 0.5, 0.49))], "image_id long, score double")
    assert [r[0] for r in one(df.orderBy("image_id").select(sc.tier()))] == ["high", "medium", "medium", "low", "low", "drop"]
    many = spark.range(50).select(F.col("id").alias("image_id"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("score"))
    kept = {r.image_id for r in sc.tiered_sample(many).collect() if r.kept}
    assert kept == set(range(0, 50, 6)) | set(range(1, 50, 20))


def test_weighted_score_rounds_before_tiers(spark):
    images = spark.createDataFrame([(1, "a"), (2, "b")], "image_id long, filename string")
    found = spark.createDataFrame([(1, 1, "x", 0.999), (1, 2, "y", 0.999), (1, 3, "z", 1.0)], "image_id long, det_no long, class string, score double")
    weights = spark.createDataFrame([("x", 3.0, True), ("y", 2.001, False)], "class string, weight double, report boolean")
    got = {r.image_id: (r.score, r.parts) for r in sc.weighted_detection_score(images, found, weights).collect()}
    assert got == {1: (5.0, "x"), 2: (0.0, "")}


@pytest.mark.parametrize("block", [4, 16, 65536])
def test_cluster_ranges(spark, block):
    numbers = [3, 3, 13, 24, 25, 60, 71, 82, 83]
    df = spark.createDataFrame([("v", n) for n in numbers] + [("w", 100)], "video string, frame_no long")
    got = sorted(one(rg.cluster_ranges(df, block=block)))
    assert got == [
        ("v", 0, 3, 13, 0, 18), ("v", 1, 24, 25, 19, 30), ("v", 2, 60, 60, 55, 65),
        ("v", 3, 71, 71, 66, 76), ("v", 4, 82, 83, 77, 88), ("w", 0, 100, 100, 95, 105),
    ]


def test_dense_resample(spark):
    source = spark.range(400).select(F.col("id").alias("image_id"), F.lit("v").alias("video"), (F.col("id") / 4.0).alias("ts"))
    ranges = spark.createDataFrame([("v", 0, 10, 70), ("v", 1, 65, 75)], "video string, cluster_id long, start_s long, end_s long")
    for width in (7, 60):
        dense = rg.dense_resample(source, ranges, dense_fps=1.0, bin_seconds=width)
        got = sorted((r.cluster_id, r.image_id, r.tick) for r in dense.collect())
        assert got == [(0, 4 * s, s - 10) for s in range(10, 70)] + [(1, 4 * s, s - 65) for s in range(65, 75)]


def test_dense_resample_drops_copies(spark):
    source = spark.range(40).select(
        F.col("id").alias("image_id"), F.lit("v").alias("video"), F.col("id").cast("double").alias("ts"),
        F.array(F.when(F.col("id") < 20, 0).otherwise(0xFFFF).cast("bigint")).alias("words"),
    )
    ranges = spark.createDataFrame([("v", 0, 5, 30)], "video string, cluster_id long, start_s long, end_s long")
    dense = rg.dense_resample(source, ranges, dense_fps=1.0, dedup_threshold=2, bits=64)
    assert sorted(r.image_id for r in dense.collect()) == [5, 20]
    assert rg.dense_resample(source, ranges, 1.0, dedup_threshold=0).count() == 25


def test_crop_box(spark):
    rows = [
        (100, 100, [50.0, 50.0, 40.0, 60.0]),
        (100, 100, [0.0, 0.0, 100.0, 100.0]),
        (200, 100, [0.0, 40.0, 50.0, 60.0]),
        (100, 200, [80.0, 10.0, 100.0, 60.0]),
        (300, 50, [10.0, 0.0, 90.0, 100.0]),
        (100, 100, [-10.5, -3.0, 20.0, 20.0]),
    ]
    df = spark.createDataFrame(rows, "width int, height int, bbox array<double>")
    got = [tuple(r.crop) for r in gm.crop_box(df).collect()]
    assert got == [(0, 0, 100, 100), (0, 0, 100, 100), (0, 0, 105, 100), (0, 15, 100, 125), (18, 0, 282, 50), (0, 0, 21, 21)]
    for (w, h, _), (x1, y1, x2, y2) in zip(rows, got):
        assert 0 <= x1 < x2 <= w and 0 <= y1 < y2 <= h


def test_crop_fallback(spark):
    rows = [(1, 90, 50, [1.0, 2.0]), (2, 90, 50, None), (3, 90, 50, [0.0, None, 1.0, 1.0]), (4, 90, 50, [0.0, 0.0, 50.0, 50.0])]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, bbox array<double>")
    center = {r.image_id: tuple(r.crop) for r in gm.smart_crop(df, fallback="center_crop").collect()}
    assert center[1] == center[2] == center[3] == (20, 0, 70, 50)
    assert [r.image_id for r in gm.smart_crop(df, fallback="skip").collect()] == [4]
    assert tuple(gm.smart_crop(df).filter("image_id = 2").first().crop) == (0, 0, 90, 50)
    with pytest.raises(ValueError):
        gm.smart_crop(df, fallback="other")


def corrections(spark, rows):
    schema = "width int, height int, corrections struct<brightness:double,contrast:double,sharpness:double,crop_left_pct:double,crop_right_pct:double,crop_top_pct:double,crop_bottom_pct:double>"
    return spark.createDataFrame([(w, h, c) for w, h, c in rows], schema)


def test_corrections(spark):
    values = [(1.005, 0.2, 0.1), (2.0, 1.0, 1.5), (None, 1.5, 2.0), (1.0, 1.0, 1.009)]
    df = corrections(spark, [(100, 100, (*v, None, None, None, None)) for v in values])
    got = [(r.brightness, r.contrast, r.unsharp_percent, r.soften) for r in gm.correction_params(df).collect()]
    assert got == [(None, 0.5, None, 0.3), (1.5, None, 10, None), (None, 1.5, 150, None), (None, None, None, None)]
    off = gm.correction_params(df, brightness=False, contrast=False, sharpness=False).collect()
    assert all(r.brightness is None and r.contrast is None and r.soften is None for r in off)
    assert [r.log_line for r in gm.correction_log(df).collect()][1] == "bright=2.00, sharp=1.50"


def test_edge_crop(spark):
    df = corrections(
        spark,
        [(128, 128, (None, None, None, 50.0, None, None, None)), (130, 100, (None, None, None, 50.0, None, None, None)),
         (100, 100, (None,) * 7), (200, 200, (None, None, None, 10.0, 20.0, 5.0, 2.5))],
    )
    got = [tuple(r.crop) for r in gm.edge_crop(df).collect()]
    assert got == [(0, 0, 128, 128), (65, 0, 130, 100), (0, 0, 100, 100), (20, 10, 160, 195)]
    assert gm.correction_log(df).collect()[3].log_line == "crop=38%"


def test_resize(spark):
    df = spark.createDataFrame([(1000, 1000), (1500, 500), (500, 1500), (2000, 40)], "width int, height int")

    def sizes(mode):
        return [(r.scaled_w, r.scaled_h, r.offset_x, r.offset_y, r.out_w, r.out_h) for r in gm.resize(df, 1024, mode).collect()]

    assert sizes("longest_side")[1][:2] == (1024, 320) and sizes("longest_side")[3][:2] == (1024, 64)
    assert sizes("pad")[1] == (1024, 341, 0, 341, 1024, 1024)
    assert sizes("crop_center")[2] == (1024, 3072, 0, -1024, 1024, 1024)
    assert sizes("resize")[3] == (1024, 1024, 0, 0, 1024, 1024)
    with pytest.raises(ValueError):
        gm.resize(df, 1024, "cover")
    assert gm.resize(df, 1024, "cover", strict=False).first().out_w == 1000


def test_metadata(spark):
    images = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0), ("c", 0)], "batch string, index long")
    batches = spark.createDataFrame(
        [("a", '[{"_index": 0, "pose": "x"}, {"_index": 0, "pose": "Standing"}, {"_index": -1}, {"pose": "y"}, {"_index": 2, "n": 8.0, "flag": true}]'),
         ("b", "[oops"), ("c", '{"_index": 0, "pose": "lone"}')],
        "batch string, metadata_json string",
    )
    joined = md.attach_metadata(images, batches)

    def matched(field, values):
        return {(r["batch"], r["index"]) for r in md.route(joined, field, values).collect() if r.matched}

    assert matched("pose", " STANDING ,lone") == {("a", 0), ("c", 0), ("b", 0)}
    assert matched("n", "8.0") == {("a", 2), ("b", 0)} == matched("n", "8")
    assert matched("flag", "True") == {("a", 2), ("b", 0)}
    assert matched("pose", "x,") == {("a", 1), ("a", 2), ("a", 3), ("b", 0)}


def test_stems(spark):
    rows = [(0, "a.b.jpg"), (1, None), (2, ""), (3, ".hidden"), (4, "plain"), (5, "a.b.png")]
    df = spark.createDataFrame(rows, "i int, f string")
    assert [r[0] for r in one(df.select(sk.output_stem(F.col("f"), F.col("i"))))] == ["a.b", "image_0001", "image_0002", ".hidden", "plain", "a.b"]
    assert one(df.select(sk.output_stem(F.col("f"), F.col("i"), "p_")))[1] == ("p_0001",)
    stems = df.select(sk.output_stem(F.col("f"), F.col("i")).alias("stem"))
    assert one(sk.repeated_stems(stems)) == [("a.b", 2)]


def test_extensions(spark):
    names = ["a.PNG", ".png", "x.tar.gz", "none", "..a.b", "a."]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in one(df.select(ct.extension(F.col("n"))))] == [".png", "", ".gz", "", ".b", "."]


def test_frame_names(spark):
    names = ["a_frame_b_frame_000012.jpg", "_frame_1.jpg", "v_frame_x.jpg", "v_frame_7"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    got = [(r.video, r.frame_no) for r in sm.parse_frame_name(df).collect()]
    assert got == [("a_frame_b", 12), (None, None), (None, None), ("v", 7)]


@pytest.mark.parametrize("page", [1, 3, 9])
def test_paginate(spark, page):
    df = spark.range(32).select(
        F.concat(F.lit("/d/f"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(".png")).alias("path"),
        F.current_timestamp().alias("modificationTime"), F.col("id").alias("length"),
    )
    got = sorted(r.length for r in ct.paginate(df, page, 16).collect())
    assert got == (list(range(16)) if page == 1 else list(range(16, 32)))
    far = ct.paginate(df, 100_000, 16).collect()
    assert sorted(r.length for r in far) == list(range(16, 32)) and far[0].info == "Page 2/2 | Showing 16 of 32 images"
    assert ct.paginate(df.limit(0), page, 16).count() == 0


def test_positions_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 100).otherwise(7).alias("g"), (-F.col("id")).alias("o"))
    df = df.withColumn("g", F.when(F.col("g") == 99, F.lit(None)).otherwise(F.col("g"))).repartition(16)
    placed = with_position(df, ["o"], ["g"], running={"acc": F.lit(2)}).collect()
    groups = {}
    for r in placed:
        groups.setdefault(r.g, []).append((r.o, r.pos, r.n, r.acc))
    assert len(placed) == 3000
    for rows in groups.values():
        rows.sort()
        assert [p for _, p, _, _ in rows] == list(range(len(rows)))
        assert all(n == len(rows) and acc == 2 * (p + 1) for _, p, n, acc in rows)


def test_caps(spark):
    df = spark.range(5000).select(F.col("id").alias("image_id"), F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7).alias("g"))
    got = {}
    for r in top_per_group(df, ["g"], ["image_id"], 1500, "image_id", salts=8).collect():
        got.setdefault(r.g, set()).add(r.image_id)
    assert got[0] == set(range(1500)) and got[3] == {i for i in range(4000, 5000) if i % 7 == 3}
    assert {r.image_id for r in first_rows(df, ["image_id"], 12).collect()} == set(range(12))
    assert first_rows(spark.range(20_500), ["id"], 20_001).agg(F.max("id")).first()[0] == 20_000


def test_stream_of_fragments(spark):
    rows = [(1, 2, "c", False), (1, 0, "a", False), (1, 1, "b", True), (2, 5000, "y", False), (2, 3, "x", False), (3, 0, "", True)]
    df = spark.createDataFrame(rows, "request_id long, seq long, fragment string, done boolean")
    assert sorted(one(mo.assemble_stream(df))) == [(1, "ab"), (2, "xy"), (3, "")]


def test_captions(spark):
    images = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position long, filename string")
    captions = spark.createDataFrame([(0, "a", "old"), (1, None, "second"), (5, "a", "new")], "position long, filename string, caption string")
    assert dict((r.filename, r.caption) for r in md.join_captions(images, captions).collect()) == {"a": "new", "b": "", "c": ""}
    assert dict((r.filename, r.caption) for r in md.join_captions(images, captions, True).collect()) == {"a": "new", "b": "second", "c": ""}


def test_structured_caption(spark):
    df = spark.createDataFrame([("f", "structured", 'Here: {"b": 1, "a": [2,]}'), ("g", "structured", " none "), ("h", "natural", " tok here ")], "filename string, preset string, response string")
    got = [r.caption for r in mo.finish_caption(df, "tok").collect()]
    assert got == ['tok, {"a":[2],"b":1}', "tok, none", "tok here"]
