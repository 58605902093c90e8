"""The trie of conversations' beginnings against a brute-force version, and its edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from imgcurate.llm.prefix_trie import id_digests, prefix_trie, rebuilt, turns_of

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    held = {c: [t[1:] for t in sorted(turns)] for c, turns in held.items()}
    made = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(held.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, some in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(some) if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(some), len(node), parent, len(some), kids(node), sum(kids(n) == 0 for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, height=4, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, prefix_trie(*rebuilt(turns_of(docs)), height).select(COLUMNS).collect()), key=repr)


def conversations(seed, n=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 3 * n), n):
        for t in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else rng.choice([t, t, 0])
            rows.append((c, turn, rng.choice([None, "user", "user"]), rng.choice([None, "", "a b", "a\tb\x0bc", "é à"])))
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)] + rows[:7]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,height", [(1, 4), (2, 2)])
def test_equals_brute_force(spark, seed, height):
    rows = conversations(seed)
    assert found(spark, rows, height) == brute(rows)


def test_deep_conversations_cross_bands(spark):
    """Forty turns and bands of two depths: five levels of bands, each half as deep as the one below."""
    rows = [(c, t, "user", f"turn {t if t < split else (t, c)}") for c, split in ((40, 40), (60, 33), (80, 33), (100, 7)) for t in range(40)]
    assert found(spark, rows, 2) == brute(rows)


def test_hot_and_turnless(spark):
    # All share the first turns; a conversation of few turns without a base loses them all.
    rows = [(c, t, "user", "hello there") for c in range(200) for t in range(c % 3 + 1)]
    alone = [c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 4][:3]
    rows += [(c, 0, "user", "gone") for c in alone]
    assert found(spark, rows) == brute(rows)
    only = [(alone[0], 0, "user", "gone")]
    assert found(spark, only) == brute(only)


def test_empty_and_clashing(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []
    rows = [(20, 0, "a", "b c", 1, "k"), (21, None, None, None, 2, "l"), (21, None, None, None, 2, "l")]
    clash = SCHEMA + ", depth int, key string"
    assert found(spark, rows, schema=clash) == brute([r[:4] for r in rows])


def test_very_long_text(spark):
    rows = [(c, t, "user", "word " * 200_000) for c in (20, 40) for t in range(2)]
    assert found(spark, rows) == brute(rows)


def test_digests_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(-50, 300).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("key"), F.col("id").alias("conv"))
        got = {r.key: r.ends_sha256 for r in id_digests(ends.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, some in (("a", lambda i: i % 3 == 0), ("b", lambda i: i % 3 != 0)):
        assert got[key] == hashlib.sha256(",".join(str(i) for i in range(-50, 300) if some(i)).encode()).hexdigest()
