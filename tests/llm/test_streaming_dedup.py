"""Streaming deduplication against a brute-force version, over several batches, with colliding digests."""

import hashlib
import random
import string

import pytest

from imgcurate.llm.streaming_dedup import StreamingDedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        kept = [i == keep for i in ids]
        digest = hashlib.sha256(t.encode()).hexdigest()
        first = kept.index(True)
        out += [(i, keep, len(ids), k == first, digest) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def write(spark, rows, path, files=1, schema="doc_id long, text string", mode="append"):
    spark.createDataFrame(rows, schema).repartition(files).write.mode(mode).parquet(path)


def taken(dedup):
    dedup.advance()
    return sorted(map(tuple, dedup.result().collect()), key=repr)


@pytest.mark.parametrize("digits", [64, 1])
def test_batches_equal_brute_force(spark, tmp_path, digits):
    rng = random.Random(3)
    texts = [None, "", "A", "a", "Ä", "ä", "x y", "X Y", *("".join(rng.choice("abAB") for _ in range(rng.randint(0, 5))) for _ in range(40))]
    # A folder name with a space: locators must lead to its files.
    source, store = str(tmp_path / "some docs"), str(tmp_path / "store")
    rows = []
    for k in range(3):
        new = [(rng.choice([None, rng.randint(-5, 10**6)]), rng.choice(texts)) for _ in range(60)]
        write(spark, new, source, files=3)
        rows += new
        # A new object on the same folder goes on from the state on disk.
        assert taken(StreamingDedup(spark, source, store, digits=digits)) == brute(rows), k


def test_small_batches(spark, tmp_path):
    source = str(tmp_path / "docs")
    rows = [(i, f"text {i % 7}") for i in range(40)]
    write(spark, rows, source, files=4)
    assert taken(StreamingDedup(spark, source, batch_bytes=1)) == brute(rows)


def test_unequal_bytes_are_found_across_batches(spark, tmp_path):
    source, store = str(tmp_path / "docs"), str(tmp_path / "store")
    write(spark, [(1, "one")], source)
    dedup = StreamingDedup(spark, source, store, digits=0)
    dedup.advance()
    write(spark, [(2, "two")], source)
    assert taken(dedup) == brute([(1, "one"), (2, "two")])
    assert spark.read.parquet(f"{store}/unequal/*").count() == 1


def test_empty_repeated_and_clashing(spark, tmp_path):
    empty = str(tmp_path / "empty")
    write(spark, [], empty)
    assert taken(StreamingDedup(spark, empty)) == []
    source = str(tmp_path / "clash")
    rows = [(5, "same", "n", 1, "x"), (5, "SAME", "n", 1, "x"), (4, "same", None, 2, "y")]
    write(spark, rows, source, schema="doc_id long, text string, digest string, n int, _metadata string")
    assert taken(StreamingDedup(spark, source)) == brute([r[:2] for r in rows])


def test_very_long_texts(spark, tmp_path):
    source = str(tmp_path / "long")
    rows = [(1, "ab " * 3_000_000), (2, "AB " * 3_000_000), (3, "ab " * 3_000_000 + "c")]
    write(spark, rows, source)
    assert taken(StreamingDedup(spark, source)) == brute(rows)
