"""Bounded calls, one parse a row, mergeable sketches, and keepers of crowded buckets."""

import random

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from imgcurate.operators import dedup as dd
from imgcurate.operators.metadata import route_multi
from imgcurate.operators.model import map_model
from imgcurate.operators.quality import score_quantiles, score_sketches


def where_asked(batch: pd.DataFrame) -> pd.Series:
    return pd.Series([str(TaskContext.get().partitionId())] * len(batch))


def test_calls_of_a_server_are_bounded(spark):
    """Each server has two partitions of its own, and what comes before keeps its sixteen."""
    tasks = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def server(i):
        return [None, "http://a", "http://b", "http://c"][i % 4]

    def count(batches):
        tasks.add(1)
        yield from batches

    rows = spark.range(0, 400, 1, 16).mapInPandas(count, "id long").withColumn("server", server("id"))
    asked = map_model(rows, where_asked, ["id"], endpoint="server", calls=2).collect()
    places = {}
    for r in asked:
        places.setdefault(r.server, set()).add(r.response)
    assert len(asked) == 400 and set(places) == {None, "http://a", "http://b", "http://c"}
    assert all(len(p) == 2 for p in places.values())
    assert len(set.union(*places.values())) == 8
    # Once to learn the servers, once to ask them; never fewer tasks.
    assert tasks.value == 32
    few = map_model(rows, where_asked, ["id"], partitions=3).collect()
    assert len(few) == 400 and len({r.response for r in few}) <= 3
    none = map_model(rows.filter("id < 0"), where_asked, ["id"], endpoint="server")
    assert none.collect() == []


def test_metadata_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"a": "x", "b": 8.0}'), (2, '{"a": "x"}'), (3, "bad")], "image_id long, metadata string")
    routed = route_multi(rows, [("a", "x,y"), ("b", "8"), ("a", "x")])
    assert {r.image_id: r.matched for r in routed.collect()} == {1: True, 2: False, 3: False}
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1, plan


def test_sketches_merge(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice("ab"), rng.gauss(50, 20)) for d in range(10) for _ in range(2000)] + [(0, "c", None)]
    scores = spark.createDataFrame(rows, "day int, kind string, score double")
    found = score_quantiles(score_sketches(scores, ["kind", "day"]), ["kind"], (0.1, 0.5, 0.9)).collect()
    assert len(found) == 9
    for r in found:
        own = [s for _, k, s in rows if k == r.kind and s is not None]
        if not own:
            assert r.quantile is None
            continue
        assert abs(sum(s <= r.quantile for s in own) / len(own) - r.share) < 0.03


def test_keepers_of_a_crowded_bucket(spark):
    """Four rows in five share all but a few bits, far from each other: buckets stay full of kept and removed rows."""
    rng = random.Random(7)
    rows = []
    for i in range(700):
        w = rng.getrandbits(12) if i % 5 else rng.getrandbits(60)
        rows.append((i, [w]))
    kept, want = [], {}
    for i, (w,) in rows:
        near = [k for k, v in kept if bin(v ^ w).count("1") <= 2]
        if near:
            want[i] = min(near)
        else:
            kept.append((i, w))
    docs = spark.createDataFrame(rows, "image_id long, words array<long>")
    for pivots in (1, 64):
        unique = docs.select(F.col("image_id").alias("id"), F.lit(0).alias("scope"), "words")
        # Any near kept row bounds the search: here the largest one.
        some = {i: max(k for k, v in kept if k < i and bin(v ^ dict(rows)[i][0]).count("1") <= 2) for i in want}
        decided = spark.createDataFrame([(i, some.get(i, i)) for i, _ in rows], "id long, keeper long")
        got = dd._smallest_keepers(unique, decided, 64, 2, 1, 64, pivots).collect()
        assert {r.id: r.keeper for r in got} == {i: want.get(i, i) for i, _ in rows}
    marked = dd.dedup_first_wins(docs, 2, 64).collect()
    assert {r.image_id: r.duplicate_of for r in marked if r.is_duplicate} == want


def test_near_rows_need_no_sorted_pass(spark, monkeypatch):
    """Crowds around kept rows are decided by a join; only chains pass through Python."""
    calls = []
    monkeypatch.setattr(dd, "_in_order", lambda batches: batches)
    plain = dd.written
    monkeypatch.setattr(dd, "written", lambda df, name: calls.append(name) or plain(df, name))
    rng = random.Random(3)
    rows = [(100 * k + j, [rng.getrandbits(60)] if not j else None) for k in range(30) for j in range(10)]
    base, made = None, []
    for i, words in rows:
        base = words[0] if words else base
        made.append((i, [base if words else base ^ (1 << (i % 10))]))
    marked = dd.dedup_first_wins(spark.createDataFrame(made, "image_id long, words array<long>"), 2, 60).collect()
    assert {r.image_id: r.duplicate_of for r in marked} == {i: 100 * (i // 100) if i % 100 else None for i, _ in made}
    assert "passed" not in calls


def test_marks_alone_need_no_search_for_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(dd, "_smallest_keepers", lambda *a: 1 / 0)
    rng = random.Random(4)
    rows = [(i, [rng.getrandbits(10)]) for i in range(400)]
    kept = []
    for i, (w,) in rows:
        if not any((w ^ k).bit_count() <= 2 for k in kept):
            kept.append(w)
    marked = dd.dedup_first_wins(spark.createDataFrame(rows, "image_id long, words array<long>"), 2, 10, smallest=False)
    assert marked.filter("not is_duplicate").count() == len(kept)
    bad = [r for r in marked.collect() if r.is_duplicate and (r.words[0] ^ rows[r.duplicate_of][1][0]).bit_count() > 2]
    assert not bad and all(rows[r.duplicate_of][1][0] in kept for r in marked.collect() if r.is_duplicate)
