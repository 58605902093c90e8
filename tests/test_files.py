"""Sources, sinks and streams over real files."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgcurate.functions.kernels import as_array, decode_png, encode_png, laplacian, phash, pixel_stats, resample
from imgcurate.operators import sinks as sk
from imgcurate.operators.pixels import alpha_mask, apply_pixels, with_phash, with_png
from imgcurate.session import path_exists, run_scope, written
from imgcurate.sources import catalog as ct
from imgcurate.streaming import streams as st


def picture(height, width, channels=3, seed=0):
    y, x, c = np.mgrid[0:height, 0:width, 0:channels]
    return ((x * 7 + y * 13 + c * 50 + seed * 29 + (x * y) % 31 * 5) % 256).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pictures")
    for i, (h, w, c) in enumerate([(40, 60, 3), (80, 90, 3), (100, 70, 4), (64, 64, 1), (20, 200, 3)]):
        (path / f"p{i}.png").write_bytes(encode_png(picture(h, w, c, i)))
    (path / "corrupt.png").write_bytes(b"not a picture")
    (path / "notes.txt").write_text("text")
    (path / "clip.MP4").write_bytes(b"film")
    return path


def test_scan(spark, folder):
    got = {r.filename: (r.width, r.height, r.n_channels) for r in ct.scan_images(spark, f"file:{folder}", 40).drop("data").collect()}
    assert got == {"p0.png": (60, 40, 3), "p1.png": (90, 80, 3), "p2.png": (70, 100, 3), "p3.png": (64, 64, 3)}
    raw = {r.path[-6:]: r for r in ct.read_pictures(spark, f"file:{folder}", alpha=True).collect()}
    colour = {r.path[-6:]: r for r in ct.read_pictures(spark, f"file:{folder}").collect()}
    assert [raw[p].n_channels for p in ("p2.png", "p3.png")] == [4, 1]
    assert as_array(colour["p2.png"].data, 100, 70, 3).tolist() == as_array(raw["p2.png"].data, 100, 70, 4)[:, :, :3].tolist()
    assert bytes(colour["p3.png"].data) == bytes(b for b in raw["p3.png"].data for _ in range(3))
    # The cut counts the corrupt file, which sorts first.
    few = ct.scan_images(spark, f"file:{folder}", 40, max_images=2)
    assert [r.filename for r in few.select("filename").collect()] == ["p0.png"]
    bad = ct.unreadable_images(spark, f"file:{folder}")
    assert [r.name for r in bad.collect()] == ["corrupt.png"]


def test_pixels_come_as_written(spark, folder):
    row = ct.load_one(spark, f"file:{folder}/p2.png").first()
    assert (as_array(row.data, row.height, row.width, row.n_channels) == picture(100, 70, 4, 2)).all()
    masked = alpha_mask(ct.load_one(spark, f"file:{folder}/p2.png")).first()
    assert masked.n_channels == 3 and masked.mask == picture(100, 70, 4, 2)[:, :, 3].tobytes()
    plain = alpha_mask(ct.load_one(spark, f"file:{folder}/p1.png")).first()
    assert set(plain.mask) == {0} and len(plain.mask) == 80 * 90
    assert ct.load_one(spark, f"file:{folder}/p9.png").count() == 0
    assert ct.load_one(spark, f"file:{folder}/none/p9.png").count() == 0
    assert ct.scan_images(spark, f"file:{folder}/none").count() == 0
    assert ct.scan_images(spark, f"file:{folder}/none", max_images=3).count() == 0


def test_ids_in_catalog_order(spark, folder):
    named = ct.with_ids(ct.read_catalog(spark, f"file:{folder}"), "name").collect()
    assert [r.name for r in sorted(named, key=lambda r: r.image_id)] == sorted(r.name for r in named)
    assert sorted(r.image_id for r in named) == list(range(len(named)))
    ids = ct.with_ids(ct.read_catalog(spark, f"file:{folder}"), "size").select("path", "image_id")
    assert ct.scan_images(spark, f"file:{folder}", 40).join(ids, "path").count() == 4


def test_listing(spark, folder):
    catalog = ct.read_catalog(spark, f"file:{folder}", recursive=True)
    names = [r.name for r in ct.list_folder(catalog, f"file:{folder}").collect()]
    assert names == ["corrupt.png", "p0.png", "p1.png", "p2.png", "p3.png", "p4.png"]
    assert [r.name for r in ct.list_videos(catalog).collect()] == ["clip.MP4"]
    assert ct.search_catalog(catalog, "P1").count() == 1


def test_kernels_agree_with_plain_loops():
    img = picture(9, 7)
    g = (img[:, :, 2].astype(int) * 4899 + img[:, :, 1].astype(int) * 9617 + img[:, :, 0].astype(int) * 1868 + 8192) >> 14
    mirror = lambda i, n: -i if i < 0 else (2 * n - 2 - i if i >= n else i)
    expected = np.array(
        [[sum(int(g[mirror(y + a, 9), mirror(x + b, 7)]) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4 * int(g[y, x]) for x in range(7)] for y in range(9)]
    )
    assert (laplacian(g.astype(np.int64)) == expected).all()
    mean, std, var = pixel_stats(img)
    assert np.allclose([mean, std, var], [g.mean(), g.std(), expected.var()])


def test_resample_keeps_flat_pictures_flat():
    flat = np.full((30, 50, 3), 77, dtype=np.uint8)
    assert (resample(flat, 13, 64) == 77).all()
    assert resample(picture(8, 8), 8, 8).shape == (8, 8, 3)


def test_phash_survives_scaling_and_brightness():
    def bits(img):
        return np.unpackbits(np.array(phash(img, 16), dtype="<i8").view(np.uint8))

    rough = np.random.default_rng(1).integers(40, 200, (32, 32, 3)).astype(np.uint8)
    base = resample(rough, 128, 128)
    assert bits(base).size == 256
    for changed in ((base * 0.9).astype(np.uint8), resample(base, 100, 100), resample(base, 200, 150)):
        assert (bits(base) != bits(changed)).sum() <= 12
    assert (bits(base) != bits(picture(128, 128))).sum() > 60


def test_ties_do_not_hang_on_the_order_of_sums():
    """A picture and its transpose have the same sums in another order, so the same levels, and bits of equal frequencies."""
    rng = np.random.default_rng(7)
    blocks = rng.integers(60, 64, (3000, 8, 8)).astype(np.uint8)
    for b in blocks:
        img = np.kron(b, np.ones((2, 2), dtype=np.uint8))[:, :, None]
        assert (resample(img, 20, 20) == resample(img.transpose(1, 0, 2), 20, 20).transpose(1, 0, 2)).all()
    # The frequencies 22 and 50 of this one are equal and in the middle: neither is above the median.
    tied = [91, 92, 137, 173, 183, 80, 126, 181, 72, 92, 155, 84, 147, 130, 111, 118, 69, 45, 75, 165, 212, 127, 180, 116, 166, 73, 255, 51, 205, 171, 109, 99]
    tied += [148, 80, 52, 210, 121, 102, 149, 124, 122, 206, 161, 184, 81, 53, 102, 44, 145, 154, 128, 160, 60, 71, 111, 168, 52, 173, 149, 130, 34, 137, 167, 54]
    levels = np.array(tied, dtype=np.uint8)
    img = np.kron(np.stack([np.roll(levels, -c).reshape(8, 8) for c in range(3)], axis=2), np.ones((4, 4, 1), dtype=np.uint8))
    word = phash(img, 8)[0]
    assert not word >> 22 & 1 and not word >> 50 & 1


def test_edits(spark, folder):
    pixels = ct.scan_images(spark, f"file:{folder}", 40).select(
        F.xxhash64("path").alias("image_id"), "height", "width", "n_channels", "data"
    )
    same = {r.image_id: r.data for r in apply_pixels(pixels).collect()}
    assert same == {r.image_id: r.data for r in pixels.collect()}
    half = apply_pixels(pixels, pixels.select("image_id", F.lit(0.5).alias("brightness")))
    bright = {r.image_id: sum(r.data) for r in half.collect()}
    assert all(bright[i] < sum(d) for i, d in same.items())
    assert with_phash(pixels, 8).filter("size(words) = 1").count() == 4


def test_write(spark, folder, tmp_path):
    pixels = ct.scan_images(spark, f"file:{folder}", 40).withColumn("image_id", F.xxhash64("path"))
    named = pixels.withColumn("stem", sk.output_stem(F.col("filename"), F.lit(0))).withColumn(
        "caption", F.when(F.col("filename") == "p0.png", "a caption")
    )
    sk.write_dataset(named, f"{tmp_path}/set")
    assert spark.read.parquet(f"{tmp_path}/set/data").count() == 4
    assert spark.read.json(f"{tmp_path}/set/manifest").filter("caption is not null").count() == 1
    with pytest.raises(ValueError):
        sk.write_dataset(named.withColumn("stem", F.lit("x")), f"{tmp_path}/other")
    assert not (tmp_path / "other" / "data").exists()
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(name):
        calls.add(1)
        return f"caption {random.random()}"

    made = named.drop("caption").withColumn("caption", model.asNondeterministic()("filename"))
    sk.write_dataset(made, f"{tmp_path}/model")
    assert calls.value == 4
    captions = {r.caption for r in spark.read.parquet(f"{tmp_path}/model/data").collect()}
    assert captions == {r.caption for r in spark.read.json(f"{tmp_path}/model/manifest").collect()}
    sk.export_files(with_png(named), f"{tmp_path}/files")
    files = sorted(p.name for p in (tmp_path / "files").iterdir())
    assert files == ["p0.png", "p0.txt", "p1.png", "p2.png", "p3.png"]
    again = ct.load_one(spark, f"file:{tmp_path}/files/p1.png").first()
    assert again.data == picture(80, 90, 3, 1).tobytes()


def test_export_publishes_whole_files_only(spark, tmp_path):
    folder = tmp_path / "files"
    left = folder / "_attempts" / "run" / "attempt"
    left.mkdir(parents=True)
    (left / "half.png").write_bytes(b"half")  # by an attempt that was lost
    rows = [(f"p{i}", bytes([i]) * 9, f"caption {i}" if i % 2 else None) for i in range(40)]
    made = spark.createDataFrame(rows, "stem string, encoded binary, caption string").repartition(6)
    sk.export_files(made, str(folder))
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {
        **{f"{s}.png": b for s, b, _ in rows}, **{f"{s}.txt": c.encode() for s, _, c in rows if c}
    }

    @F.udf("binary")
    def fails(stem, encoded):
        if stem == "p33":
            raise ValueError("no picture")
        return bytes(encoded) * 2

    with pytest.raises(Exception, match="no picture"):
        sk.export_files(made.withColumn("encoded", fails("stem", "encoded")), str(folder))
    assert all((folder / f"{s}.png").read_bytes() == b for s, b, _ in rows)
    # Exported once more, files are replaced and what failed has left is gone.
    sk.export_files(made.withColumn("encoded", F.lit(b"new")), f"file://{folder}")
    assert {p.read_bytes() for p in folder.glob("*.png")} == {b"new"} and not (folder / "_attempts").exists()
    sk.export_files(made.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("*"))


def test_scopes_delete_what_a_run_wrote(spark):
    with run_scope(spark) as outer:
        table = written(spark.range(5), "numbers")
        with run_scope(spark) as inner:
            assert written(table.withColumn("two", F.col("id") * 2), "doubles").count() == 5
            assert path_exists(spark, inner)
        assert not path_exists(spark, inner) and table.count() == 5
        with pytest.raises(ZeroDivisionError), run_scope(spark) as failed:
            written(table, "more")
            1 / 0
        assert not path_exists(spark, failed)
    assert not path_exists(spark, outer)


def test_incremental_scan(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()

    def run():
        stream = st.incremental_scan(spark, f"file:{source}", "*.png")
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(state))
        writer.trigger(availableNow=True).start(str(out)).awaitTermination()
        return spark.read.parquet(str(out)).count()

    (source / "a.png").write_bytes(b"1")
    (source / "b.txt").write_bytes(b"1")
    assert run() == 1
    (source / "c.png").write_bytes(b"2")
    assert run() == 2
    catalog = ct.read_catalog(spark, f"file:{source}")
    assert [r.path[-5:] for r in ct.changed_files(catalog, catalog.filter("path like '%a.png'")).orderBy("path").collect()] == ["b.txt", "c.png"]


def test_dedup_against_kept(spark, tmp_path):
    kept = tmp_path / "kept"
    words = [0, 1, 0xFF00, 0xFF01, 0, 0xF0F0F0, 0xFF03, 0xF0F0F1, 7 << 40]
    for n in range(3):
        rows = [(i, [words[i]]) for i in range(3 * n, 3 * n + 3)]
        batch = spark.createDataFrame(rows, "image_id long, words array<long>")
        old = spark.read.parquet(str(kept)).select("image_id", "words") if kept.exists() else batch.limit(0)
        st.dedup_against_kept(batch, old, 1, 64).write.parquet(f"{kept}/batch={n}")
    got = sorted(r.image_id for r in spark.read.parquet(str(kept)).collect())
    assert got == [0, 2, 5, 6, 8]


def test_dedup_stream(spark, tmp_path):
    source, kept, state = tmp_path / "in", tmp_path / "kept", tmp_path / "state"
    words = [0, 1, 0xFF00, 0xFF01, 0, 0xF0F0F0]

    def run(n):
        rows = [(i, [words[i]]) for i in range(3 * n, 3 * n + 3)]
        spark.createDataFrame(rows, "image_id long, words array<long>").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("image_id long, words array<long>").parquet(str(source))
        writer = st.dedup_stream(stream, str(kept), 1, 64).option("checkpointLocation", str(state))
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.image_id for r in spark.read.parquet(str(kept)).collect())

    assert run(0) == [0, 2]
    assert run(1) == [0, 2, 5]


def test_many_small_files_come_in_few_tasks(spark, tmp_path):
    """Eight tasks a core, however many files there are."""
    file = encode_png(picture(4, 4))
    for i in range(2_600):
        (tmp_path / f"{i}.png").write_bytes(file)
    tasks = 8 * spark.sparkContext.defaultParallelism
    for read in (ct.read_pictures(spark, f"file:{tmp_path}"), ct.read_catalog(spark, f"file:{tmp_path}")):
        assert read.rdd.getNumPartitions() <= tasks
        assert read.select("path").distinct().count() == 2_600


def test_files_are_listed_by_a_task(spark, folder, tmp_path):
    for name in ("a b.png", "p%20q.png", "c[1]{x}*?.png", "q+r.PNG", "_h.png", ".k.png", "_e=1.png", "x._COPYING_"):
        (tmp_path / name).write_bytes(encode_png(picture(20, 20)))
    (tmp_path / "below").mkdir()
    for path in (f"file:{folder}", f"file://{folder}", f"file://{tmp_path}", f"{tmp_path}/"):
        assert sorted(ct.list_files(spark, path).collect()) == sorted(ct.read_catalog(spark, path).collect())
    assert ct.list_files(spark, f"file://{tmp_path}/none").collect() == []


def test_folder_is_never_listed_whole(spark, folder, tmp_path, monkeypatch):
    """Spark is told of two files at a time, whatever their names, and of those that are kept once more."""
    import pandas as pd

    from imgcurate.operators.pixels import encode_for_model, with_model_file
    from imgcurate.plans import curation as cu

    source = tmp_path / "in"
    source.mkdir()
    names = ["a b.png", "c[1]{x}*?.png", "d.png", "e%20f.png", "q+r.PNG", "z.png"]
    for i, name in enumerate(names):
        (source / name).write_bytes(encode_png(picture(20 + 4 * (i % 5), 24, seed=i % 5)))
        if i != 2:
            # A file with a remark is left to the image source.
            data = (source / name).read_bytes()
            (source / name).write_bytes(data[:33] + b"\0\0\0\3tEXta\0b" + struct.pack(">I", zlib.crc32(b"tEXta\0b")) + data[33:])
    for i in range(5):
        (source / f"t{i}.txt").write_text("text")
    seen, plain = [], ct._decoded
    monkeypatch.setattr(ct, "_decoded", lambda spark, files: seen.append(files) or plain(spark, files))
    monkeypatch.setattr(ct, "read_catalog", lambda *a: 1 / 0)
    parts = ct.decode_in_parts
    monkeypatch.setattr(cu, "decode_in_parts", lambda *a: parts(*a, at_once=2))
    answer = lambda text: lambda batch: pd.Series([text] * len(batch))
    with run_scope(spark):
        made = cu.curate_folder(spark, f"file://{source}", f"file://{tmp_path}/out", answer("hm"), answer("a picture"), min_size=16, threshold=None)
        assert sorted(r.filename for r in made.collect()) == names[:5]
    assert all(isinstance(files, list) and len(files) <= 2 for files in seen)
    assert len({f for files in seen for f in files}) == 5 and sum(map(len, seen)) == 5 + 4
    out = {p.name for p in (tmp_path / "out/files").iterdir()}
    assert {f"{n[:-4]}.png" for n in names[:5]} <= out and len([n for n in out if not n.startswith(".")]) == 10
    for size in (1024, 30):
        pixels = ct.read_pictures(spark, f"file:{folder}").withColumn("image_id", F.xxhash64("path"))
        want = {r.image_id: r.encoded for r in encode_for_model(pixels, size).collect()}
        assert {r.image_id: r.encoded for r in with_model_file(pixels, size).collect()} == want


def test_plain_files_are_decoded_by_their_tasks(spark, folder, tmp_path, monkeypatch):
    """The same pictures as the image source gives; files that are not plain are left to it."""
    want = {r.path: r for r in ct.read_pictures(spark, f"file:{folder}").collect()}
    files = ct.with_ids(ct.list_files(spark, f"file:{folder}")).select("path", "image_id")
    flags = {r.path.rpartition("/")[2]: r._plain for r in ct._plain_files(files).collect()}
    assert {n for n, plain in flags.items() if plain} == {f"p{i}.png" for i in range(5)} and len(flags) == 8
    got = {r.path: r for r in ct.decode_in_parts(spark, files, lambda p: p.drop("image_id")).collect()}
    assert len(got) == 5 and all(r[c] == want[p][c] for p, r in got.items() for c in ("height", "width", "n_channels", "data"))
    good = encode_png(picture(4, 5))
    assert (decode_png(good) == picture(4, 5)).all()
    for i in range(len(good)):
        assert decode_png(good[:i]) is None and decode_png(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]) is None
    assert decode_png(good + b"x") is None
    # Without the image source there are plain files only.
    monkeypatch.setattr(ct, "_decoded", lambda *a: 1 / 0)
    some = files.filter("path like '%/p_.png'")
    assert ct.decode_in_parts(spark, some, lambda p: p.select("path")).count() == 5
    assert ct.decode_in_parts(spark, some.filter("false"), lambda p: p.select("path", "width")).collect() == []
