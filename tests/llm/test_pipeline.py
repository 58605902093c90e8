"""The pipeline against its stages done by brute force on the smallest tables."""

import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import sentencepiece
from imgcurate.llm.quality_classifier import Scorer, Shape, fit_quality
from imgcurate.llm.sentencepiece_codec import public_model

from . import test_decontamination, test_line_dedup, test_ngram_join

FOLDER = "/root/testdata/sf0.001"


def similar_first(rows):
    sets = {r: test_ngram_join.shingle_set(r[1]) for r in rows}
    root = {r: r for r in rows}

    def find(r):
        while root[r] != r:
            r = root[r]
        return r

    for i, a in enumerate(rows):
        for b in rows[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r) == r]


def test_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    odds = fit_quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = Scorer(odds, Shape()).score([t for _, t in docs])
    rows = [r for r, s in zip(docs, scores, strict=True) if s >= 0.3]
    assert len(docs) > len(rows) > len(docs) / 2
    cut = test_line_dedup.brute(rows, 50)
    rows = [(d, text) for (d, t), text in cut.items() if text == t or text.strip(" ")]
    rows = similar_first(rows)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = [grams(test_decontamination.tokens(t)) for _, t in items]
    clean = [r for r in rows if not any(len(g & grams(test_decontamination.tokens(r[1]))) > 0.2 * len(g) for g in own)]
    processor = sentencepiece.SentencePieceProcessor(model_file=public_model())
    want = []
    for d, t in clean:
        ids = processor.encode(t, add_bos=True, add_eos=True)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(processor.decode(ids).encode())))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_keep_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs.limit(0), odd):
            out = stage(spark, some, FOLDER)
            assert out.columns == docs.columns, name
            assert out.count() == some.count(), name
    assert corpus_pipeline.tokenize(spark, odd, FOLDER).count() == 3
