"""Encoding and decoding against the library, on hard texts and on those of the table."""

import hashlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from imgcurate.llm.queries import QUERIES
from imgcurate.llm.sentencepiece_codec import ChunkTable, decode, encode, public_model

PARTS = ["a", "b", " ", "  ", "▁", "\n", "é", "😀", "the", "\0", "\t", " ing", "<s>", "　", "<0x0A>", " ", "ﬁ", "   "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_model())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"])), st.lists(st.sampled_from(PARTS)).map("".join)), max_size=8))
def test_ids_are_the_library_s(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_model())
    for most in (3, 1_000):
        got = ChunkTable(public_model(), most).encode(texts, b"", b"")
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == library.encode(texts)


def test_table(spark, library):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        digest = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        want.append((d, len(ids), *digest))
    assert sorted(map(tuple, QUERIES["op2_sentencepiece"](spark, "/root/testdata/sf0.01").collect())) == sorted(want)


def test_edges(spark, library):
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "w" * 200_000, None), (3, " lead and trail ", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode(encode(df, public_model()), public_model())
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in got))) == sorted(map(str, ((d, t or "") for d, t, _ in rows)))
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.decoded == (r.text or "")
    plain = encode(df, public_model(), begin_end=False, keep_text=False)
    assert plain.columns == ["doc_id", "ids"] and {len(r.ids) for r in plain.where("doc_id = 1").collect()} == {0}
    assert encode(df.limit(0), public_model()).count() == 0
