"""Pixel jobs unpack one picture at a time, and hold no more than what they hand on."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from imgcurate.operators import pixels as px
from imgcurate.operators import sinks as sk

COUNT, SIDE = 2000, 64


def columns():
    rng = np.random.default_rng(1)
    data = [rng.integers(0, 256, SIDE * SIDE * 3, dtype=np.uint8).tobytes() for _ in range(COUNT)]
    side = pa.array([SIDE] * COUNT, pa.int32())
    return {"height": side, "width": side, "n_channels": pa.array([3] * COUNT, pa.int32()), "data": pa.array(data, pa.binary())}


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def empty(spark):
    return spark.createDataFrame([], "image_id long, height int, width int, n_channels int, data binary")


@pytest.mark.parametrize("job", [px.with_byte_sums, px.with_pixel_stats])
def test_kernels_hold_a_picture_at_a_time(spark, monkeypatch, job):
    """24 MB of pictures; the kernel is run here as a worker would run it."""
    found = []
    monkeypatch.setattr(px, "_kernel", lambda fn, returns: found.append(fn) or (lambda *a: F.lit(None).cast(f"struct<{returns.replace(' ', ':').replace(',:', ',')}>")))
    job(empty(spark))
    made = columns()
    given = made["data"] if job is px.with_byte_sums else pa.StructArray.from_arrays(list(made.values()), names=list(made))
    assert peak_mb(lambda: found[0](given)) < 4


def test_edits_hold_what_they_hand_on(spark, monkeypatch):
    """24 MB of pictures come in, and a few MB at a time go out."""
    found, df = [], empty(spark)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: found.append((fn, self.columns)) or self)
    px.apply_pixels(df.withColumn("brightness", F.lit(None).cast("double")))
    run, names = found[0]
    side, none = pa.array([SIDE] * COUNT, pa.int64()), pa.array([None] * COUNT, pa.float64())
    zero = pa.array([0] * COUNT, pa.int64())
    given = columns() | {"image_id": pa.array(range(COUNT))} | dict.fromkeys(("x1", "y1", "offset_x", "offset_y"), zero)
    given |= dict.fromkeys(("x2", "y2", "scaled_w", "scaled_h", "out_w", "out_h"), side) | dict.fromkeys(px._FACTORS, none)
    batch, rows, most = pa.RecordBatch.from_pydict({c: given[c] for c in names}), [], [0]

    def work():
        for out in run(iter([batch])):
            rows.extend(out.column("image_id").to_pylist())
            most.append(out.nbytes)

    assert peak_mb(work) < 12
    assert rows == list(range(COUNT)) and max(most) < 6e6


def test_files_are_written_one_at_a_time(spark, monkeypatch, tmp_path):
    """24 MB of files, of which none but the one being written is unpacked."""
    found, df = [], spark.createDataFrame([], "stem string, encoded binary, caption string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: found.append(fn) or self)
    sk.export_files(df, f"file://{tmp_path}")
    data = columns()["data"]
    batch = pa.RecordBatch.from_pydict({"stem": [f"p{i}" for i in range(COUNT)], "encoded": data, "caption": pa.array(["a"] + [None] * (COUNT - 1))})
    assert peak_mb(lambda: list(found[0](iter([batch])))) < 4
    files = {f.name: f for f in tmp_path.rglob("*.*")}
    assert len(files) == COUNT + 1 and files["p7.png"].read_bytes() == data[7].as_py()
    assert files["p0.txt"].read_text() == "a"
