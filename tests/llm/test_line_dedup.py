"""Line dedup against a brute-force version, and its edge cases."""

import random
import time

import numpy as np
import pytest

from imgcurate.llm import line_dedup
from imgcurate.llm.line_dedup import dedup_lines, matched_runs

SCHEMA = "doc_id long, text string, lines string, n_lines string"


def brute(rows, min_words):
    """Each window against all earlier places, extended line by line."""
    rows = sorted({(d, t) for d, t in rows}, key=lambda r: r[0])
    lines = {r: r[1].split("\n") for r in rows}
    first, out = {}, {r: set() for r in rows}
    for r in rows:
        own = lines[r]
        for a in range(len(own)):
            total, b = 0, a
            while b < len(own) and total < min_words:
                total += len(own[b].split())
                b += 1
            if total < min_words:
                continue
            seen = first.setdefault(tuple(own[a:b]), (r, a))
            if seen == (r, a):
                continue
            other, k = lines[seen[0]], seen[1]
            low = 0
            while a - low > 0 and k - low > 0 and own[a - low - 1] == other[k - low - 1]:
                low += 1
            high = 0
            while a + high < len(own) and k + high < len(other) and own[a + high] == other[k + high]:
                high += 1
            out[r].update(range(a - low, a + high))
    return {r: "\n".join(x for i, x in enumerate(lines[r]) if i not in out[r]) for r in rows}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(25)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 8))] for _ in range(8)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(runs) if rng.random() < 0.5 else [rng.choice(pool)]
        rows.append((i, "\n".join(text)))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(7)
    for least in (1, 5, 12):
        want = brute(rows, least)
        got = dedup_lines(df, least).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.text for r in got} == {d: t for (d, _), t in want.items()}
        assert all(r.n_lines == len(dict(rows)[r.doc_id].split("\n")) for r in got)
        assert all(r.lines == "x" for r in got)


@pytest.mark.parametrize("few", [0, 1_000])
def test_runs_of_two_texts(monkeypatch, few):
    """Both ways of extending give all lines that a match from a start covers."""
    monkeypatch.setattr(line_dedup, "FEW_SHIFTS", few)
    rng = random.Random(8)
    for _ in range(300):
        x, y = ([rng.randint(0, rng.choice((0, 1, 3))) for _ in range(rng.randint(1, 40))] for _ in range(2))
        equal = [(i, j) for i in range(len(x)) for j in range(len(y)) if x[i] == y[j]]
        if not equal:
            continue
        seeds = rng.sample(equal, rng.randint(1, min(30, len(equal))))
        want = set()
        for i, j in seeds:
            low = high = 0
            while i - low > 0 and j - low > 0 and x[i - low - 1] == y[j - low - 1]:
                low += 1
            while i + high < len(x) and j + high < len(y) and x[i + high] == y[j + high]:
                high += 1
            want.update(range(i - low, i + high))
        runs = matched_runs(np.array(x, np.uint64).tobytes(), np.array(y, np.uint64).tobytes(), *(np.array(v) for v in zip(*seeds, strict=True)))
        got = [k for a, b in zip(*runs, strict=True) for k in range(a, b)]
        assert got == sorted(want)


def test_many_equal_lines(spark):
    """A text of 100,000 equal lines, and one of two lines in turn, within a minute."""
    rows = [(1, "\n".join(["one line of five words"] * 100_000)), (2, "\n".join(["a b c", "d e f"] * 20_000))]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    began = time.monotonic()
    got = {r.doc_id: (r.text, r.n_deleted) for r in dedup_lines(df).collect()}
    assert time.monotonic() - began < 60
    assert got == {1: ("one line of five words", 99_999), 2: ("a b c\nd e f", 39_998)}


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(f"line {i} of a long text" for i in range(20_000))
    rows = [
        (1, passage), (2, f"own\n{passage}\nend"), (2, f"own\n{passage}\nend"), (3, None), (None, passage), (4, ""), (5, long), (6, long + "\nmore"),
    ]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id or -1, r.text, r.n_deleted) for r in dedup_lines(df).collect()), key=str)
    want = [(-1, passage, 0), (1, "", 1), (2, "own\nend", 1), (2, "own\nend", 1), (3, None, 0), (4, "", 0), (5, long, 0), (6, "more", 20_000)]
    assert got == sorted(want, key=str)
    empty = dedup_lines(df.limit(0))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "text", "lines", "n_lines", "n_deleted"]


def test_a_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    df = spark.range(600).selectExpr("id as doc_id", f"if(id % 3 = 0, concat('a', id, '\n{passage}'), concat('b', id)) as text")
    got = dedup_lines(df).groupBy("n_deleted").count().collect()
    assert {r.n_deleted: r["count"] for r in got} == {0: 401, 1: 199}
