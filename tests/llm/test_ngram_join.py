"""The n-gram join against all pairs, on copies of many degrees."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from imgcurate.llm import ngram_join
from imgcurate.llm.components import components
from imgcurate.llm.groups import crossed
from imgcurate.llm.ngram_join import are_similar, list_blocks, one_of_each_group, reach, similar_groups

WHITE = "\t\n\x0b\x0c\r "


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in held[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def copies(rng, n):
    words = [f"w{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 8, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 30])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            own = own[: len(own) - rng.randint(0, len(own) // 6)]
            rows.append((len(rows) * 3 + 7, rng.choice([" ", "\n", "  ", "\t"]).join(rng.choice([w, w.upper()]) for w in own)))
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long").repartition(5)
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in similar_groups(df).collect())


@pytest.mark.parametrize("block", [3, 64])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "MAP_BLOCK", block)
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", block)
    monkeypatch.setattr(ngram_join, "MET_BLOCK", block)
    rows = copies(random.Random(block), 400)
    assert got(spark, rows) == brute(rows)


def test_documents(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (None, "a b c d e f"), (4, "A B\nC D E F"), (4, "a b c d e f"), (4, "a b c d e f"), (6, ""), (7, " \n"), (8, long), (9, long + " end"), (10, "one two"), (11, "One  Two")]
    assert got(spark, rows) == brute(rows)
    none = [(None, "x y"), (None, "x y")]
    assert got(spark, none) == [("None", 1, None)] * 2
    assert got(spark, [(1, None)]) == [("1", 0, 1)]
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", 1), (2, "A b c d e f", 2), (2, "A b c d e f", 2), (2, "other words", 3), (5, "", 4), (6, None, 5), (6, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(r.row for r in kept.collect()) == [2, 3, 4, 5, 5]


def test_blocks_skip_no_similar_pair():
    rng = np.random.default_rng(1)
    token = np.sort(rng.integers(0, 40, 3000))
    n = rng.integers(1, 400, 3000)
    place = (rng.random(3000) * (n - -(-75 * n // 100) + 1)).astype(int)
    far = reach(n, place, 75)
    order = np.lexsort((n, token))
    token, n, place, far = token[order], n[order], place[order], far[order]
    block, stays = list_blocks(token, n, far)
    least, most = np.minimum(n[:, None], n), np.minimum((n - place)[:, None], n - place)
    can = (token[:, None] == token) & (100 * np.minimum(most, least) >= 75 * (n[:, None] + n - np.minimum(most, least)))
    np.fill_diagonal(can, False)
    a, b = np.nonzero(can)
    assert len(a) > 1000
    assert (block[a] == block[b]).all()
    assert stays[a].all() and stays[b].all()
    assert len(np.unique(block)) > 40 and not stays.all()


def test_derived_answers_equal_counted_ones():
    rng = random.Random(4)
    texts = []
    for base in range(6):
        words = [f"b{base // 2}w{i}" for i in range(60)]
        for _ in range(9):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(60)] = f"x{rng.randrange(9)}"
            texts.append((base, " ".join(own)))
    rng.shuffle(texts)
    rows = pa.table({"text": [t for _, t in texts], "kind": pa.array([k for k, _ in texts], pa.int64())})
    sets = [shingle_set(t) for _, t in texts]
    want = [[k != m and 100 * len(s & u) >= 75 * len(s | u) for (m, _), u in zip(texts, sets, strict=True)] for (k, _), s in zip(texts, sets, strict=True)]
    assert np.array(want).any()
    assert (are_similar(rows, 5, 75) == np.array(want)).all()


def test_one_class_is_not_dealt_and_a_large_one_not_squared(spark):
    rows = [(1, i, 7) for i in range(5000)] + [(2, i, 7 if i < 5000 else i) for i in range(5003)]
    members = spark.createDataFrame(rows, "leader long, set_id long, kind long")
    dealt = crossed(members, "leader", "set_id", "kind", 100).toPandas()
    assert set(dealt.leader) == {2}
    assert len(dealt) < 5003 + 3 * 52
    units = dealt.groupby("set_id").unit.agg(set)
    assert all(units[i] & units[j] for i in range(0, 5003, 97) for j in (5000, 5001, 5002))


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (20, 10), (21, 10), (4, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 10, 20: 10, 21: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
