"""Decontamination against comparison at every shift, and planted passages."""

import itertools
import random
import re

import duckdb
import numpy as np

from imgcurate.llm.decontamination import LIGHT, LIGHT_MOST, MASKS, SHORTEST, overlaps, without_contaminated

DOCS = "doc_id long, text string, item_id string, matched string"
ITEMS = "item_id long, text string"


def tokens(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """Best stretch at every shift, whether a mask fits or not."""
    out = {}
    for d, text in docs:
        x = tokens(text)
        for i, item in items:
            y = tokens(item)
            if len(y) < 8:
                continue
            for shift in range(-len(y) + 1, len(x)):
                at = [k for k in range(len(y)) if 0 <= k + shift < len(x)]
                same = [x[k + shift] == y[k] for k in at]
                if sum(same) < min(13, 0.8 * len(y)):
                    continue
                best = max(
                    (sum(1 if s else -2 for s in same[a:b]), sum(same[a:b]), b - a)
                    for a in range(len(at))
                    for b in range(a + 1, len(at) + 1)
                )
                if best[1] >= min(13, 0.8 * len(y)) and best[1] >= 0.8 * best[2]:
                    out[d, i] = max(out.get((d, i), 0), best[1])
    return out


def lost(masks, length, replaced):
    """How many placements of replaced tokens no mask fits."""
    at = np.array(list(itertools.combinations(range(length), replaced)), np.int64)
    left = (np.int64(1) << at).sum(axis=1)
    for mask in masks:
        bits = sum(1 << k for k, b in enumerate(mask) if b == "1")
        for k in range(length - len(mask) + 1):
            left = left[(left & (bits << k)) != 0]
    return len(left)


def test_masks_fit_every_overlap():
    for length, replaced in ((13, 0), (14, 1), (15, 2), (16, 3), (20, 4), (25, 5), (30, 6)):
        assert lost(MASKS, length, replaced) == 0
    for item in range(SHORTEST, LIGHT_MOST + 1):
        for length in range(1, item + 1):
            for replaced in range(length // 5 + 1):
                if length - replaced >= 0.8 * item:
                    assert lost(LIGHT, length, replaced) == 0, (item, length, replaced)


def test_short_items_with_replaced_words(spark):
    """Every placement of as many replaced words as are allowed, in items of 8 to 16 words."""
    items, docs = [], []
    for n, replaced in ((8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 2), (15, 3), (16, 3)):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for at in itertools.combinations(range(n), replaced):
            text = ["so", "it", "goes", *("other" if k in at else w for k, w in enumerate(words)), "and", "on"]
            docs.append((len(docs), " ".join(text)))
    found = overlaps(spark.createDataFrame([(*r, "", "") for r in docs], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    # All that the rule for the best stretch accepts, and nothing else.
    assert got == set(brute(docs, items)) and len(got) > 600


def test_very_long_items(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    same = ["again"] * 3000
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(same))], ITEMS)
    rows = [(1, " ".join(long[7000:7100])), (2, " ".join(long)), (3, " ".join(same[:500])), (4, " ".join(long[::2]))]
    found = overlaps(spark.createDataFrame([(*r, "", "") for r in rows], DOCS), items).collect()
    assert sorted((r.doc_id, r.item_id, r.matched) for r in found) == [(1, 1, 100), (2, 1, 20_000), (3, 2, 500)]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 8, 11, 15, 30, 45])))) for i in range(14)]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if d % 2:
            y = tokens(rng.choice(items)[1])
            a = rng.randint(0, len(y) // 3)
            y = [w if rng.random() > 0.08 else "other" for w in y[a:]]
            k = rng.randint(0, len(text))
            text[k:k] = [w.upper() + rng.choice(["", ",", "."]) for w in y]
        docs.append((d, " ".join(text)))
    got = overlaps(spark.createDataFrame([(*r, "", "") for r in docs], DOCS).repartition(5), spark.createDataFrame(items, ITEMS))
    got = {(r.doc_id, r.item_id): r.matched for r in got.collect()}
    assert got == brute(docs, items)
    assert len(got) > 10


def test_documents_with_whole_items(spark):
    """Those that hold an item word for word are found, and nothing that shares under a fifth of one."""
    folder = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    items = [(i, tokens(t)) for i, t in duckdb.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = {i: grams(w) for i, w in items}
    got = overlaps(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    for d, text in docs:
        held = grams(tokens(text))
        for i, g in own.items():
            share = len(g & held) / len(g)
            assert share < 1 or (d, i) in got
            assert share > 0.2 or (d, i) not in got


def test_edges(spark):
    item = " ".join(f"x{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "too short")], ITEMS)
    long = " ".join(f"y{i}" for i in range(50_000)) + " " + item
    rows = [(1, None), (2, ""), (None, item), (3, item), (3, item), (4, long), (5, "too short")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS)
    got = sorted((str(r.doc_id), r.item_id, r.matched, r.low, r.high) for r in overlaps(docs, items).collect())
    assert got == [("3", 1, 20, 0, 20), ("4", 1, 20, 50_000, 50_020), ("None", 1, 20, 0, 20)]
    rest = without_contaminated(docs, items)
    assert rest.columns == docs.columns
    assert sorted(r.doc_id for r in rest.collect()) == [1, 2, 5]
    assert without_contaminated(docs, items.limit(0)).count() == len(rows)
    assert overlaps(docs.limit(0), items).count() == 0
