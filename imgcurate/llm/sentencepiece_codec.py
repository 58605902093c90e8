"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the model may hold a white-space marker after another character. Then no merge
crosses the place before a run of markers, and the text falls into chunks (a run of markers
and what follows it) that are segmented on their own. Each task segments a chunk once,
keeps its ids in a table and joins them back by position.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import added, map_slices, with_arrays
from .registry import query, table

MARK = "▁"
#: Distinct chunks a task keeps; a full table is emptied, which costs time and changes nothing.
TABLE_CHUNKS = 100_000
#: Bytes of texts or ids worked on at once.
SLICE = 1 << 20


@lru_cache(maxsize=4)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_markers(processor) -> bool:
    """Whether chunks may be segmented on their own with this model."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    pieces = map(processor.id_to_piece, range(processor.get_piece_size()))
    # A probe shows whether white space is kept and marked before words, as chunking assumes.
    probe = f"{MARK}a{MARK}{MARK}b{MARK}"
    shown = "".join(p for p in processor.encode(" ".join(["a", "", "b", ""]), out_type=str))
    return shown == probe and not any(map(crossing.search, pieces))


class ChunkTable:
    """Ids of distinct chunks, packed as little-endian 32-bit numbers."""

    chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, path: str, most: int = TABLE_CHUNKS):
        self.processor, self.most, self.held = _processor(path), most, {}
        self.whole = not splits_at_markers(self.processor)

    def _add(self, chunks: set[str]) -> None:
        if len(self.held) + len(chunks) > self.most:
            self.held.clear()
        # The library puts a marker before the text; each chunk brings its own, so the first goes.
        alone = chunks & {MARK}
        if alone:
            self.held[MARK] = np.array([self.processor.piece_to_id(MARK)], "<u4").tobytes()
        many = sorted(chunks - alone)
        for text, ids in zip(many, self.processor.encode([c[1:] for c in many], num_threads=1), strict=True):
            self.held[text] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str], begin: bytes, end: bytes) -> list[bytes]:
        if self.whole:
            made = self.processor.encode(texts, num_threads=1)
            return [begin + np.array(ids, "<u4").tobytes() + end for ids in made]
        cut = [self.chunk.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        need = set().union(*cut)
        missing = {c for c in need if c not in self.held}
        if missing:
            if len(self.held) + len(missing) > self.most:
                missing = need
            self._add(missing)
        of = self.held.__getitem__
        return [begin + b"".join(map(of, chunks)) + end for chunks in cut]


def _pack(number: int) -> bytes:
    return np.array([number], "<u4").tobytes() if number >= 0 else b""


def _ends(processor) -> tuple[bytes, bytes]:
    """The begin and end ids, as far as the model has them."""
    return _pack(processor.bos_id()), _pack(processor.eos_id())


def encode(
    df: DataFrame, model: str, text: str = "text", out: str = "ids", begin_end: bool = True, keep_text: bool = True
) -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` as little-endian unsigned 32-bit numbers in a binary.

    A null or empty text has only the begin and end ids (none if ``begin_end`` is false). Rows
    are independent, so repeated rows and ids give repeated results; an empty table gives an
    empty one; other columns pass unchanged and a column named ``out`` is replaced.
    ``model`` is a path that exists on every machine.
    """
    schema = added(df, (out, T.BinaryType()), dropped=() if keep_text else (text,))
    names = schema.fieldNames()

    def make():
        held = ChunkTable(model)
        begin, end = _ends(held.processor) if begin_end else (b"", b"")

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in part.column(text).to_pylist()]
            return with_arrays(part, names, **{out: pa.array(held.encode(texts, begin, end), pa.binary())})

        return step

    return map_slices(df, make, schema, text, SLICE)


def _decoded(processor, packed: list[bytes | None]) -> list[str | None]:
    return [None if b is None else processor.decode(np.frombuffer(b, "<u4").tolist()) for b in packed]


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with ``out``: the text that the library decodes from ``ids``; a null binary gives null."""
    schema = added(df, (out, T.StringType()), dropped=() if keep_ids else (ids,))
    names = schema.fieldNames()

    def make():
        processor = _processor(model)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            return with_arrays(part, names, **{out: pa.array(_decoded(processor, part.column(ids).to_pylist()), pa.string())})

        return step

    return map_slices(df, make, schema, ids, SLICE)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, for each row of ``docs``.

    Encodes and decodes as ``encode`` and ``decode`` do, in one worker a task.
    """
    rows = docs.select("doc_id", "text")
    schema = added(rows, ("ids", T.BinaryType()), ("decoded", T.StringType()), dropped=("text",))
    names = schema.fieldNames()

    def make():
        held = ChunkTable(model)
        begin, end = _ends(held.processor)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = held.encode([t or "" for t in part.column("text").to_pylist()], begin, end)
            decoded = pa.array(_decoded(held.processor, ids), pa.string())
            return with_arrays(part, names, ids=pa.array(ids, pa.binary()), decoded=decoded)

        return step

    return map_slices(rows, make, schema, "text", SLICE).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_sentencepiece")
def op2_sentencepiece(spark, folder):
    return round_trip(table(spark, folder, "documents"), public_model())
