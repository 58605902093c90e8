"""Phrase mining against a brute-force version, and its edge cases."""

import random
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from imgcurate.llm.keys import document_key
from imgcurate.llm.phrase_mining import mined_phrases, phrases_with, top_phrases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, lang string, text string"


def grams(rows, most):
    f = Counter()
    for _, lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i : i + size])] += 1
    return f


def brute(rows, least, most, covered=50):
    f = grams(rows, most)
    n = Counter()
    for (lang, words), count in f.items():
        n[lang] += count * (len(words) == 1)
    out = set()
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        size = len(words)
        inside = [b for (g, w), b in candidates.items() if g == lang and len(w) > size and any(w[i : i + size] == words for i in range(len(w)))]
        if inside and 100 * max(inside) >= covered * a:
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, size)]
        score, k = min(cuts)
        out.add((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    return out


def corpus(seed=1, docs=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "c", "dé", "É", "é", "x y", "ß", "-"]
    joins = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "?", " ", " ", " "]
    text = lambda: "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randint(0, 30)))
    rows = [(rng.choice([None, k]), rng.choice(["en", "de", None, "und"]), rng.choice([None, "", " .. "]) if k % 9 == 0 else text()) for k in range(docs)]
    return rows + rows[:5]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, most, covered in ((10, 3, 50), (3, 4, 80), (1, 2, 50)):
        found = mined_phrases(docs, least, most, covered).collect()
        assert {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found} == brute(rows, least, most, covered)


def test_pointers_lead_to_the_phrase(spark):
    rows = [(i, "en", t) for i, (_, _, t) in enumerate(corpus(2))]
    texts = {i: (t or "").encode() for i, _, t in rows}
    found = mined_phrases(spark.createDataFrame(rows, SCHEMA), 5).collect()
    assert found
    for r in found:
        held = texts[r.doc_id][r.at :].decode().translate(LOWER)
        assert re.sub("[ \t]+", " ", held).startswith(r.phrase), r


def test_counts_do_not_depend_on_fingerprints(spark):
    """A filter that all pass puts every phrase together by its words."""
    rows = corpus(3, 40)
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", document_key()[0], "text")
    found = phrases_with(docs, np.full(1 << 13, 255, np.uint8), 3).where("words > 0").collect()
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found} == grams(rows, 3)


def test_large_counts_are_exact(spark):
    # Two words of 50,000 each, always together: 10**6 * a * a passes 2**51, and ties go to the phrase.
    rows = [(1, "en", "b a. " * 50_000), (2, "en", "d c. " * 50_000)]
    found = top_phrases(mined_phrases(spark.createDataFrame(rows, SCHEMA)), 5).orderBy("rank").collect()
    assert [(r.rank, r.phrase, r.a, r.n, r.score) for r in found] == [(1, "b a", 50_000, 200_000, 10**6), (2, "d c", 50_000, 200_000, 10**6)]


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_phrases(mined_phrases(empty)).collect() == []
    rows = [(k, None, None) for k in range(3)]
    assert mined_phrases(spark.createDataFrame(rows, SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "en", "A b. " * 10)], SCHEMA).withColumns({n: F.lit(1) for n in ("phrase", "f", "seed", "words", "id", "n")})
    assert [(r.phrase, r.a) for r in mined_phrases(clash).collect()] == [("a b", 10)]
