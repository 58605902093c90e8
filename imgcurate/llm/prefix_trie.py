"""The trie of conversations' beginnings, with sums over its subtrees.

A node of depth ``d`` stands for a sequence of ``d`` turns; its members are the conversations that
begin with it. Its key is made from sums, over the turns of the sequence, of hashes of place, role
and text, so it is read off running sums and a conversation may lie in any number of partitions.

Sums over subtrees go up in bands of ``height`` depths. A node sends its numbers to its ancestors
within its band only, so it is copied ``height`` times at most. What a band's top nodes then hold
is carried on in the same way, with bands ``height`` times as high, whose nodes are the tops; so a
trie of depth ``D`` takes ``log(D) / log(height)`` rounds. On the way back each completed total of a
top goes to its ancestors in the band above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgcurate.operators.ranking import with_position
from imgcurate.session import written

from .arrow import give_back
from .registry import query, table
from .salted import salted_lookup

HEIGHT = 4
PARTS = ("s0", "s1", "s2", "s3")
WORDS = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv, p, len, content, words)``: the turns of each conversation in order, ``p`` from 0.

    Turns are ordered by ``turn``, null first, then by role and text, so that ties have one order.
    Null roles and texts are empty; rows without a ``conv_id`` belong to no conversation.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))
    placed = with_position(rows, ["turn", "role", "text"], ["conv"], position="p", total="len")
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    return written(placed.select("conv", "p", "len", content.alias("content"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations, ``(conv)``, and their turns after rebuilding, ``(conv, d, content, words)``, ``d`` from 1.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % 20`` and goes on with its own
    turns after the first ``h``, where ``h = crc32(c) % 4``.
    """
    lengths = turns.where("p = 0").select("conv", "len")
    convs = lengths.select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    convs = convs.join(lengths.select(F.col("conv").alias("base"), F.col("len").alias("given")), "base", "left")
    convs = written(convs.select("conv", "base", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken")), "conversations")
    own = salted_lookup(turns, convs.select("conv", "h", "taken"), ["conv"], F.col("p")).where("p >= h")
    own = own.select("conv", (F.col("taken") + F.col("p") - F.col("h") + 1).alias("d"), "content", "words")
    # At most three turns of a base, and twenty conversations on it.
    heads = turns.where("p < 3").select(F.col("conv").alias("base"), "p", "content", "words")
    heads = convs.join(heads, "base").where("p < taken").select("conv", (F.col("p") + 1).alias("d"), "content", "words")
    return convs.select("conv"), own.unionByName(heads)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary"))


def paths_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv, depth, key, parent, words, last)``: the nodes that each conversation goes through, the root included."""
    place = F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), "content"))
    # Four numbers of 32 bits, so that sums over 2**31 turns fit.
    halves = [F.conv(F.substring(place, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    hashed = turns.select("conv", "d", "words", *[h.alias(f"h{k}") for k, h in enumerate(halves)])
    summed = with_position(hashed, ["d"], ["conv"], position="pos", total="len", running={s: F.col(f"h{k}") for k, s in enumerate(PARTS)})
    own = summed.select(
        "conv",
        F.col("d").cast("long").alias("depth"),
        _key(F.col("d"), [F.col(s) for s in PARTS]).alias("key"),
        _key(F.col("d") - 1, [F.col(s) - F.col(f"h{k}") for k, s in enumerate(PARTS)]).alias("parent"),
        "words",
        (F.col("d") == F.col("len")).alias("last"),
    )
    root = _key(F.lit(0), [F.lit(0)] * len(PARTS))
    some = summed.where("d = 1").select("conv", F.lit(True).alias("has"))
    roots = convs.join(some, "conv", "left").select(
        "conv", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"), F.col("has").isNull().alias("last")
    )
    return written(own.unionByName(roots), "paths")


def subtree_sums(nodes: DataFrame, paths: DataFrame, sums: list[str], height: int) -> DataFrame:
    """``(key, *sums)``: each node's numbers added up over its subtree. ``nodes``: ``(key, conv_id, depth, *sums)``."""
    if height < 2:
        raise ValueError("bands hold two depths and more")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    steps = [1]
    while steps[-1] * height <= deepest:
        steps.append(steps[-1] * height)
    told = paths.join(nodes.select(F.col("conv_id").alias("conv")).distinct(), "conv", "left_semi").select("conv", "depth", "key")

    def bands(step: int) -> DataFrame:
        """What of each path lies in a band, ``height`` nodes at most."""
        some = told.where(F.col("depth") % step == 0).groupBy("conv", F.floor(F.col("depth") / (step * height)).alias("band"))
        return some.agg(F.collect_list(F.struct("depth", "key")).alias("path"))

    def sent(rows: DataFrame, step: int, band: Column, reach: Column) -> DataFrame:
        met = rows.withColumn("band", band).join(held[step], ["conv_id", "band"])
        met = met.select("depth", *sums, F.explode("path").alias("to")).where(reach)
        return met.groupBy(F.col("to.key").alias("key")).agg(*[F.sum(s).alias(s) for s in sums])

    held = {step: written(bands(step), "bands").withColumnRenamed("conv", "conv_id") for step in steps}
    places = nodes.select("key", "conv_id", "depth")
    within, rows = {}, nodes.select("key", "conv_id", "depth", *sums)
    for step in steps:
        here = sent(rows, step, F.floor(F.col("depth") / (step * height)), F.col("to.depth") <= F.col("depth"))
        within[step] = written(here.join(places, "key"), "within")
        rows = within[step].where(F.col("depth") % (step * height) == 0)
    total = within[steps[-1]]
    for step in reversed(steps[:-1]):
        tops = total.where(f"depth > 0 and depth % {step * height} = 0")
        more = sent(tops, step, F.floor(F.col("depth") / (step * height)) - 1, F.lit(True))
        added = within[step].join(more.select("key", *[F.col(s).alias(f"more_{s}") for s in sums]), "key", "left")
        total = written(added.select("key", "conv_id", "depth", *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums]), "totals")
    return total.select("key", *sums)


def id_digests(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: SHA-256 of the comma-joined ids ``conv`` of each key, ascending.

    Ids are sorted over all partitions and joined in stretches, so the task that hashes the
    stretches of a key, which must be one, has a few thousandths of its rows, one batch at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column("key").to_numpy(zero_copy_only=False), batch.column("conv").to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            text = [",".join(map(str, ids[a:b])) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(keys[cuts[:-1]], pa.string()), pa.array([ids[a] for a, _ in pairs], pa.int64()), pa.array(text, pa.string())], names=["key", "low", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == last:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])
        give_back()

    stretches = ends.select("key", "conv").orderBy("key", "conv").mapInArrow(joined, "key string, low long, ids string")
    return stretches.repartition("key").sortWithinPartitions("key", "low").mapInArrow(hashed, "key string, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row a node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``n_leaves`` and ``saved_tokens`` are over the subtree, the node included; a node saves the words
    of its last turn once for each member but one. ``ends_sha256`` is that of the ids of the
    conversations that end at the node. Conversations without turns end at the root; without
    conversations there is no root. ``convs`` has one row ``conv`` a conversation, and ``turns`` has
    ``(conv, d, content, words)``, ``d`` counting from 1 without gaps, ``content`` being equal for equal turns.
    """
    paths = paths_of(convs, turns)
    nodes = paths.groupBy("key", "parent", "depth", "words").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    sums = subtree_sums(nodes, paths, ["leaf", "saved"], height).select("key", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    digests = id_digests(paths.where("last"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # Many children may share a parent; the root, which has none, is kept.
    out = salted_lookup(nodes.drop("leaf", "saved"), parents, ["parent"], F.col("key"), "left")
    out = out.join(sums, "key").join(digests, "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


@query(
    "op12_prefix_trie",
    r"""
    WITH t AS (
      SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
      FROM conversations WHERE conv_id IS NOT NULL),
    c AS (
      SELECT c, count(*) AS len, c - c % 20 AS base,
             xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
               lambda a, x: list_reduce(
                 list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                 lambda q, z: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384::BIGINT) ELSE q >> 1 END)), 4294967295::BIGINT) % 4 AS h
      FROM t GROUP BY c),
    b AS (SELECT c.*, least(c.h, coalesce(x.len, 0)) AS taken FROM c LEFT JOIN c x ON x.c = c.base),
    r AS (
      SELECT b.c, t.p + 1 AS d, role, text FROM b JOIN t ON t.c = b.base AND t.p < b.taken
      UNION ALL SELECT b.c, taken + p - h + 1, role, text FROM b JOIN t ON t.c = b.c AND t.p >= h),
    k AS (
      SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d) AS key
      FROM r
      UNION ALL SELECT c, 0, 0, '' FROM c),
    node AS (SELECT key, d, any_value(words) AS words, min(c) AS conv_id, count(*) AS n_convs FROM k GROUP BY key, d),
    up AS (SELECT n.key, a.key AS parent FROM node n JOIN k a ON a.c = n.conv_id AND a.d = n.d - 1),
    kids AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY parent),
    full_node AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids USING (key)),
    sums AS (
      SELECT a.key, sum((n.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
      FROM full_node n JOIN k a ON a.c = n.conv_id AND a.d <= n.d GROUP BY a.key),
    ends AS (
      SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256
      FROM (SELECT * FROM k QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY key)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens,
           coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM full_node n LEFT JOIN up USING (key) LEFT JOIN node p ON p.key = up.parent
    JOIN sums ON sums.key = n.key LEFT JOIN ends ON ends.key = n.key
    """,
)
def op12_prefix_trie(spark, folder):
    return prefix_trie(*rebuilt(turns_of(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))))
