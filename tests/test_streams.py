"""Streams in many batches, with pauses and late rows, against the same rows at once."""

import random

from pyspark.sql import functions as F

from imgcurate.streaming import streams as st


def batches(spark, tmp_path, rows, schema, parts):
    """A stream of ``rows`` in ``parts`` batches, in their order."""
    folder = str(tmp_path / "in")
    for i in range(parts):
        some = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(writer, tmp_path):
    writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()


def test_fragments_with_long_pauses(spark, tmp_path):
    rng = random.Random(1)
    pieces = [(r, s, f"{r}.{s} ", s == 5 + r % 3) for r in range(20) for s in range(9)]
    pieces = [p for p in pieces if p[0] != 7 or p[1] < 3]  # request 7 never ends
    # A request's fragments may come in any batch; those before its end come before it.
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][1] + rng.random() * 0.9)
    rows = [pieces[i] for i in order]
    table = str(tmp_path / "requests")
    stream = batches(spark, tmp_path, rows, "request_id long, seq long, fragment string, done boolean", 6)
    drain(st.assemble_fragments_stream(stream, table), tmp_path)
    whole = lambda r, last: "".join(f"{r}.{s} " for s in range(last + 1))
    got = {r.request_id: r.response for r in st.responses(spark, table).collect()}
    assert got == {r: whole(r, 5 + r % 3) for r in range(20) if r != 7}
    assert [tuple(r) for r in st.open_requests(spark, table).select("request_id", "response").collect()] == [(7, whole(7, 2))]


def test_fragments_after_the_end(spark, tmp_path):
    """Fragments come in any order, also before and at the end in batches after the one that brought it."""
    rng = random.Random(4)
    ends = {r: (3 + r % 3, 6) for r in range(12)}  # a second end comes behind the first, or before it in time
    rows = [(r, s, f"{r}.{s} ", s in ends[r]) for r in ends for s in range(8)]
    rng.shuffle(rows)
    rows = [x for x in rows if x[3]] + [x for x in rows if not x[3]]
    table = str(tmp_path / "requests")
    stream = batches(spark, tmp_path, rows, "request_id long, seq long, fragment string, done boolean", 5)
    drain(st.assemble_fragments_stream(stream, table), tmp_path)
    got = sorted(tuple(r) for r in st.responses(spark, table).collect())
    assert got == [(r, "".join(f"{r}.{s} " for s in range(ends[r][0] + 1))) for r in ends]
    assert st.open_requests(spark, table).count() == 0


def test_late_frames_join_their_cluster(spark, tmp_path):
    rng = random.Random(2)
    times = {v: sorted({rng.randint(0, 4_000) for _ in range(200)}) for v in ("a", "b")}
    rows = [(v, t) for v, ts in times.items() for t in ts]
    rng.shuffle(rows)
    stream = batches(spark, tmp_path, rows, "video string, second long", 5)
    table = str(tmp_path / "clusters")
    frames = stream.select("video", F.timestamp_seconds("second").alias("ts"))
    drain(st.cluster_ranges_stream(frames, table, "10 seconds"), tmp_path)
    want = set()
    for v, ts in times.items():
        start = last = ts[0]
        n = 0
        for t in [*ts, 10**9]:
            if t - last > 10:
                want.add((v, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
    got = st.stored_clusters(spark, table).select("video", F.unix_seconds("start_ts"), F.unix_seconds("end_ts"), "frames")
    assert set(map(tuple, got.collect())) == want


def test_batches_cost_what_they_bring(spark, tmp_path):
    """Twenty-five batches, each of one new request and one old: two states change, and no batch reads an earlier one."""
    rows = [(r, s, f"{r}.{s} ", False) for n in range(25) for r, s in ((n, 0), (n // 2, n))]
    table = str(tmp_path / "requests")
    stream = batches(spark, tmp_path, rows, "request_id long, seq long, fragment string, done boolean", 25)
    query = st.assemble_fragments_stream(stream, table).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    brought = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(brought) == 25 and all(p["numInputRows"] == 2 and p["stateOperators"][0]["numRowsUpdated"] <= 2 for p in brought)
    assert all(len(p["sources"]) == 1 for p in brought)
    want = {}
    for r, s, text, _ in sorted(rows):
        want[r] = want.get(r, "") + text
    assert {r.request_id: r.response for r in st.open_requests(spark, table).collect()} == want


def test_long_videos_touch_their_blocks_only(spark, tmp_path):
    """One video of 40 blocks; the last batch brings a late frame that joins two clusters across a border."""
    span = st.BLOCK_GAPS * 10
    seconds = [b * span + k for b in range(40) for k in (0, 5, 500, span - 6)] + [span - 1]
    rows = [("v", t) for t in seconds]
    stream = batches(spark, tmp_path, rows, "video string, second long", 1)
    spark.createDataFrame([("v", 3 * span - 3)], "video string, second long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = str(tmp_path / "clusters")
    frames = stream.select("video", F.timestamp_seconds("second").alias("ts"))
    query = st.cluster_ranges_stream(frames, table, "10 seconds").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]) == [1, 40]
    times, want = sorted({*seconds, 3 * span - 3}), set()
    start = last = times[0]
    n = 0
    for t in [*times, 10**9]:
        if t - last > 10:
            want.add((start, last, n))
            start, n = t, 0
        last, n = t, n + 1
    got = st.stored_clusters(spark, table).select(F.unix_seconds("start_ts"), F.unix_seconds("end_ts"), "frames")
    assert set(map(tuple, got.collect())) == want


def test_copies_however_late(spark, tmp_path):
    rows = [(i, [i % 7]) for i in range(60)]
    table = str(tmp_path / "kept")
    stream = batches(spark, tmp_path, rows, "image_id long, words array<long>", 4)
    drain(st.dedup_stream(stream, table, threshold=0, bits=64), tmp_path)
    assert {r.image_id for r in spark.read.parquet(table).collect()} == set(range(7))


def test_tables_that_are_folders(spark, tmp_path):
    """A table may be one file or a folder of them, some of them without rows."""
    from imgcurate.plans import stream_queries as sq

    small = "/root/testdata/sf0.001"
    for name in ("embeddings", "conversations", "events"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in (sq.d3, sq.m5, sq.r2, sq.d4):
        rows = lambda folder: sorted(tuple(r) for r in query(spark, folder).collect())  # noqa: B023, E731
        want = rows(small)
        assert want and rows(str(tmp_path)) == want
    empty = str(tmp_path / "empty")
    for name in ("embeddings", "conversations"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert sq.d3(spark, empty).count() == 0 and sq.m5(spark, empty).count() == 0
