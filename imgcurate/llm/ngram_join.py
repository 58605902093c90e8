"""Exact Jaccard join of documents on sets of word n-grams, and the groups that its links make.

1. Equal sets are one set from here on.
2. Shingles are ordered, frequent ones last, by counters of fixed number over all documents.
   Sets that are similar enough share one of their first shingles (prefix filter), so these
   are indexed with the set's size and the place of the shingle in the set. A list is sorted by
   size. Size and place bound the sizes that a set can be similar to by this shingle; the list is
   cut into blocks that no bound reaches across, and places that bound a set below its block
   are skipped. A block is not compared pair by pair: its sets all point to its smallest one, and
   sets with a common pointer may be similar.
3. Each set is compared with one representative, the set it points to most often. Those that
   link make classes, in work that grows with the number of sets.
4. A list or cluster of one class is skipped. In others only sets of different classes meet,
   first by a bitmap that bounds the difference of two sets from below, then by their
   shingles. There a set is counted against one member of a class; its overlaps with the others
   follow from that answer and from the shingles in which they differ from that member.

Every step is exact; hashes are of 60 bits and more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgcurate.session import written

from .arrow import give_back, slices, text_bytes
from .components import components
from .groups import crossed, linked, runs_of
from .hashing import hashes, mix, shingles, spans
from .keys import KEY, document_key
from .registry import query, table

SIZE = 5
PERCENT = 75
#: Counters that tell frequent shingles from others; more of them tell them apart better.
COUNTERS_LOG2 = 20
#: Blocks of sets that are compared at once, as bitmaps and as whole texts; sets that one representative meets at once.
MAP_BLOCK = 1024
TEXT_BLOCK = 256
MET_BLOCK = 64
BITS_MOST = 1 << 16


def hashed_sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice, and the offsets of its rows."""
    data, offsets = text_bytes(part.column("text"))
    starts, ends, rows = spans(data, offsets)
    value, rows = shingles(hashes(data, starts, ends, fold=True), rows, size)
    return value, np.searchsorted(rows, np.arange(part.num_rows + 1))


def shingle_counters(docs: DataFrame, size: int, log2: int = COUNTERS_LOG2) -> np.ndarray:
    """How many shingles of all documents fall on each of ``2**log2`` counters."""
    width = 1 << max(0, log2 - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << log2, np.int64)  # of one task, so four bytes do below
        for batch in batches:
            for part in slices(batch, "text"):
                value, _ = hashed_sets(part, size)
                held += np.bincount((value >> np.uint64(64 - log2)).astype(np.int64), minlength=len(held))
        give_back()
        parts = [held[a : a + width] for a in range(0, len(held), width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())], names=["part", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"]
        )

    kind = "part int, counts binary"
    rows = docs.select("text").mapInArrow(run, kind).repartition("part").mapInArrow(add, kind).toArrow()
    out = np.zeros(1 << log2, np.int64)
    for part, counts in zip(rows["part"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        out[part * width : (part + 1) * width] = np.frombuffer(counts, np.int64)
    return out


def frequency_classes(counters: np.ndarray) -> np.ndarray:
    """0 to 15: twice as many shingles as usual on a counter make its shingles a class later."""
    usual = counters.mean() + 1
    return np.clip(np.floor(np.log2(np.maximum(counters / usual, 1))), 0, 15).astype(np.uint64)


def bitmap(keys: np.ndarray) -> bytes:
    """Bits toggled by the shingles. The bits in which two maps differ are no more than the shingles that do."""
    bits = min(BITS_MOST, max(64, 1 << int(2 * len(keys) - 1).bit_length()))
    odd = np.bincount((mix(keys) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def document_sets(docs: DataFrame, classes: np.ndarray, size: int, percent: int) -> DataFrame:
    """A row for each document with its set's id and size, and, once a task, the set's bitmap and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))
    log2 = int(len(classes)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, told = shared.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                value, offsets = hashed_sets(part, size)
                keys = (value >> np.uint64(4)) | (classes[(value >> np.uint64(64 - log2)).astype(np.int64)].astype(np.uint64) << np.uint64(60))
                ids, sizes, maps, prefixes = [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.unique(keys[a:b])
                    n = len(own)
                    key = int(mix(mix(own).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64)[0]) if n else None
                    ids.append(key)
                    sizes.append(n)
                    new = n > 0 and key not in told
                    if new:
                        told.add(key)
                    maps.append(bitmap(own) if new else None)
                    prefixes.append(own[: n - -(-percent * n // 100) + 1].tobytes() if new else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("id"),
                        part.column("tie"),
                        pa.array(ids, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(maps, pa.binary()),
                        pa.array(prefixes, pa.binary()),
                    ],
                    names=["doc_id", "id", "tie", "set_id", "n", "map", "prefix"],
                )
        give_back()

    return docs.select("doc_id", *KEY, "text").mapInArrow(run, "doc_id long, id long, tie long, set_id long, n long, map binary, prefix binary")


def reach(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The largest size of a similar set whose first common shingle with a set of ``n`` is at ``place``.

    No more than ``n - place`` shingles are common then.
    """
    return ((100 + percent) * (n - place) - percent * n) // percent


def list_blocks(token: np.ndarray, n: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of lists sorted by token and size, of which no set reaches across; and the places that are not skipped.

    Two sets of sizes ``n <= m`` meet only where ``m`` is within the first one's reach and ``n`` within the second one's.
    """
    first = np.concatenate([[True], token[1:] != token[:-1]])
    rank = np.cumsum(first)
    width = np.int64(max(int(n.max()), int(far.max())) + 2)
    most = np.maximum.accumulate(np.maximum(far, 0) + rank * width) - rank * width
    cut = first.copy()
    cut[1:] |= most[:-1] < n[1:]
    block = np.cumsum(cut) - 1
    return block, far >= n[np.flatnonzero(cut)][block]


def pointers(sets: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``(leader, set_id, times)``: a set points to the smallest set of each block of a list that holds it and another."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "prefix", 1 << 20):
                tokens = [np.frombuffer(b, np.uint64) for b in part.column("prefix").to_pylist()]
                lengths = np.array([len(t) for t in tokens])
                owner = np.repeat(part.column("set_id").to_numpy(), lengths)
                n = np.repeat(part.column("n").to_numpy(), lengths)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                far = reach(n, place, percent)
                token = np.concatenate(tokens)
                bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                token, owner, bucket = token[order], owner[order], bucket[order]
                sizes = np.stack([n, far], axis=1)[order].astype(np.int32)
                cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
                pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts[:-1]].astype(np.int32)),
                        pa.array([token[a:b].tobytes() for a, b in pairs], pa.binary()),
                        pa.array([owner[a:b].tobytes() for a, b in pairs], pa.binary()),
                        pa.array([sizes[a:b].tobytes() for a, b in pairs], pa.binary()),
                    ],
                    names=["bucket", "tokens", "owners", "sizes"],
                )

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "bucket"):
            token = np.concatenate([np.frombuffer(b, np.uint64) for b in rows.column("tokens").to_pylist()])
            owner = np.concatenate([np.frombuffer(b, np.int64) for b in rows.column("owners").to_pylist()])
            n, far = np.concatenate([np.frombuffer(b, np.int32) for b in rows.column("sizes").to_pylist()]).reshape(-1, 2).T.astype(np.int64)
            order = np.lexsort((n, token))
            token, owner, n, far = token[order], owner[order], n[order], far[order]
            block, stays = list_blocks(token, n, far)
            block, owner = block[stays], owner[stays]
            if not len(owner):
                continue
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            leader = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(block))))
            some = np.flatnonzero(owner != leader)
            if not len(some):
                continue
            pairs, times = np.unique(np.stack([leader[some], owner[some]], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(times)], names=["leader", "set_id", "times"])

    dealt = sets.select("set_id", "n", "prefix").mapInArrow(deal, "bucket int, tokens binary, owners binary, sizes binary")
    found = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lists, "leader long, set_id long, times long")
    return written(found.groupBy("leader", "set_id").agg(F.sum("times").alias("times")), "pointers")


def set_keys(part: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The set of each row of a slice, sorted."""
    value, cuts = hashed_sets(part, size)
    value = value >> np.uint64(4)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield np.unique(value[a:b])


def met(found: DataFrame) -> DataFrame:
    """``(unit, set_id, led)``: each set with the one it points to most often, of equal ones the smallest, in bounded units.

    A representative comes into each of its units once, with ``led`` false.
    """
    best = found.groupBy("set_id").agg(F.min_by("leader", F.struct(-F.col("times"), "leader")).alias("leader"))
    best = written(best, "representatives")
    counts = best.groupBy("leader").agg(F.ceil(F.count("*") / MET_BLOCK).alias("blocks"))
    own = best.join(counts, "leader").select("leader", "set_id", F.pmod(F.xxhash64("set_id"), "blocks").alias("block"))
    lead = counts.select("leader", F.col("leader").alias("set_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    both = own.withColumn("led", F.lit(True)).unionByName(lead.withColumn("led", F.lit(False)))
    return both.select(F.xxhash64("leader", "block").alias("unit"), "set_id", "led")


def linked_with_representatives(units: DataFrame, size: int, percent: int) -> DataFrame:
    """``(a, b)``: sets that are similar to their representatives. Of a unit, only the representative's set is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, lead, held = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                a, b = [], []
                names = zip(part.column("unit").to_pylist(), part.column("set_id").to_pylist(), part.column("led").to_pylist(), set_keys(part, size), strict=True)
                for at, name, led, own in names:
                    if not led:
                        unit, lead, held = at, name, own
                        continue
                    if at != unit:
                        raise ValueError("a representative's text is missing")
                    common = int(np.count_nonzero(own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held))
                    if 100 * common >= percent * (len(own) + len(held) - common):
                        a.append(name)
                        b.append(lead)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    return units.repartition("unit").sortWithinPartitions("unit", "led").mapInArrow(run, "a long, b long")


def other_kinds(rows: pa.Table) -> np.ndarray:
    kind = rows.column("kind").to_numpy()
    return kind[:, None] != kind[None, :]


def may_be_similar(rows: pa.Table, percent: int) -> np.ndarray:
    """Which sets of different classes in a unit their sizes and bitmaps leave to be similar."""
    n = rows.column("n").to_numpy()
    maps = [np.frombuffer(b, np.uint8) for b in rows.column("map").to_pylist()]
    bits = 8 * np.array([len(m) for m in maps])
    out = np.zeros((len(n), len(n)), bool)
    least, most = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    near = 100 * least >= percent * most
    for b in np.unique(bits):
        some = np.flatnonzero((bits >= b) & (bits <= 2 * b if b < BITS_MOST else bits >= b))
        folded = np.stack([np.bitwise_xor.reduce(maps[k].reshape(-1, b // 8), axis=0) for k in some])
        differ = np.zeros((len(some), len(some)), np.float32)
        for low in range(0, b // 8, 512):
            held = np.unpackbits(folded[:, low : low + 512], axis=1).astype(np.float32)
            ones = held.sum(axis=1)
            differ += ones[:, None] + ones[None, :] - 2 * (held @ held.T)
        total = n[some][:, None] + n[some][None, :]
        # An overlap of percent of the union leaves this many shingles in one set only.
        fits = (100 + percent) * differ <= (100 - percent) * total
        pair = np.minimum(bits[some][:, None], bits[some][None, :]) == b
        out[np.ix_(some, some)] |= fits & pair
    return out & near & other_kinds(rows)


def are_similar(rows: pa.Table, size: int, percent: int) -> np.ndarray:
    """Which sets of different classes in a unit are similar, exactly.

    A class is told by its first member and by what the others lack of it and have besides. A
    set is counted against the first members; its overlap with another member is that answer
    less what this one lacks, and more by what it has besides. Members whose additions
    cannot make up for the first one's answer are skipped.
    """
    keys = [own for batch in rows.select(["text"]).combine_chunks().to_batches() for part in slices(batch, "text") for own in set_keys(part, size)]
    n = np.array([len(k) for k in keys])
    _, kind, members = np.unique(rows.column("kind").to_numpy(), return_inverse=True, return_counts=True)
    shingles_, at = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.split(at, np.cumsum(n)[:-1])
    first = np.full(len(members), -1)
    first[kind[::-1]] = np.arange(len(kind))[::-1]
    changed, sign, more = [], [], np.zeros(len(keys), np.int64)
    for z, c in enumerate(kind.tolist()):
        lacks, has = (np.setdiff1d(x, y, assume_unique=True) for x, y in ((own[first[c]], own[z]), (own[z], own[first[c]])))
        changed += [lacks, has]
        sign.append(np.concatenate([np.full(len(lacks), -1), np.ones(len(has), np.int64)]))
        more[z] = len(has)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sign])])
    changed, sign = np.concatenate(changed), np.concatenate(sign)
    answers = np.concatenate([own[z] for z in first])
    answer_begins = np.concatenate([[0], np.cumsum(n[first])])
    out = np.zeros((len(keys), len(keys)), bool)
    there = np.zeros(len(shingles_), bool)
    for y in np.flatnonzero(kind != members.argmax()).tolist():
        there[own[y]] = True
        with_first = np.diff(np.concatenate([[0], np.cumsum(there[answers])])[answer_begins])[kind]
        most = np.minimum(with_first + more, np.minimum(n, n[y]))
        some = np.flatnonzero(((100 + percent) * most >= percent * (n + n[y])) & (kind != kind[y]))
        if len(some):
            lengths = begins[some + 1] - begins[some]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1]) + np.repeat(begins[some] - ends + lengths, lengths)
            sums = np.concatenate([[0], np.cumsum(np.where(there[changed[places]], sign[places], 0))])
            overlap = with_first[some] + sums[ends] - sums[ends - lengths]
            similar = some[(100 + percent) * overlap >= percent * (n[some] + n[y])]
            out[y, similar] = out[similar, y] = True
        there[own[y]] = False
    return out


def similar_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, id, tie, n_shingles, group_id, component_id)`` for each row of ``docs``.

    Two documents link when ``100 * overlap >= percent * union`` of their sets; a component is
    named by its smallest id, and ``group_id`` tells components apart even if ids repeat. A text of fewer than ``size`` words is one shingle; one without
    words has an empty set (null ``group_id``), links with nothing and has its own id. Rows with a
    null id link too, but name a component only where it has no other id. Repeated rows come
    out as often as they are there. An empty table gives an empty one. Other columns are not
    needed, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *document_key(), "text")
    own = written(document_sets(rows, frequency_classes(shingle_counters(rows, size)), size, percent), "document-sets")
    first = own.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct(*KEY)).alias("first"), F.min("doc_id").alias("least"))
    first = written(first.select("set_id", "first.*", "least"), "sets")
    told = own.where("map is not null").select("set_id", "n", "map", "prefix")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = pointers(told, buckets, percent)

    def with_texts(units: DataFrame) -> DataFrame:
        units = written(units.join(first.select("set_id", *KEY), "set_id"), "dealt")
        needed = rows.join(units.select(*KEY).distinct(), KEY, "left_semi")
        return needed.groupBy(*KEY).agg(F.first("text").alias("text")).join(units, KEY).drop(*KEY)

    classes = components(linked_with_representatives(with_texts(met(found)), size, percent))
    classes = written(classes.select(F.col("node").alias("set_id"), F.col("component").alias("kind")), "classes")
    kinds = found.select("leader", "set_id").unionByName(found.select("leader", F.col("leader").alias("set_id")).distinct())
    kinds = written(kinds.join(classes, "set_id", "left").withColumn("kind", F.coalesce("kind", "set_id")), "lists")
    units = written(crossed(kinds, "leader", "set_id", "kind", MAP_BLOCK).select("unit", "set_id", "kind"), "units")
    # Tasks may have told of one set several times; a copy of its bitmap is as good as another.
    maps = told.select("set_id", "n", "map").join(units.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.first("n").alias("n"), F.first("map").alias("map"))
    near = linked(units.join(written(maps, "bitmaps"), "set_id"), lambda t: may_be_similar(t, percent), "set_id")
    clusters = components(near).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    clusters = written(clusters.join(units.select("set_id", "kind").distinct(), "set_id"), "clusters")
    dealt = written(crossed(clusters, "cluster", "set_id", "kind", TEXT_BLOCK).select("unit", "set_id", "kind"), "units")
    links = written(linked(with_texts(dealt), lambda t: are_similar(t, size, percent), "set_id"), "class-links")
    kind_of = dealt.select("set_id", "kind").distinct()
    for end in ("a", "b"):
        links = links.join(kind_of.select(F.col("set_id").alias(end), F.col("kind").alias(f"{end}_kind")), end)
    joined = written(components(links, "a_kind", "b_kind"), "joined-classes").withColumnRenamed("node", "kind")
    alone = joined.join(classes.select(F.col("set_id").alias("kind")), "kind", "left_anti").select(F.col("kind").alias("set_id"), "component")
    groups = classes.join(joined, "kind", "left").select("set_id", F.coalesce("component", "kind").alias("component")).unionByName(alone)
    groups = written(groups.join(first.select("set_id", "least"), "set_id"), "groups")
    names = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(groups.select("set_id", "component").join(written(names, "names"), "component"), "named")
    least = first.select("set_id", "least").join(named, "set_id", "left")
    least = written(least.select("set_id", F.coalesce("component", "set_id").alias("group_id"), F.coalesce("component_id", "least").alias("component_id")), "components")
    out = own.select("doc_id", *KEY, F.col("n").alias("n_shingles"), "set_id").join(least, "set_id", "left")
    return out.select("doc_id", *KEY, "n_shingles", "group_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of which only the smallest id stays of each group of similar texts.

    Of equal rows one stays. Texts without words link with nothing and all stay.
    """
    groups = similar_groups(docs.select("doc_id", "text"), size, percent).where("group_id is not null")
    kept = written(groups.groupBy("group_id").agg(F.min(F.struct(*KEY)).alias("kept")).select("kept.*"), "kept")
    rows = docs.select(F.struct("*").alias("row"), *document_key(), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"))
    one = rows.where("words").join(kept, KEY, "left_semi").groupBy(*KEY).agg(F.first("row").alias("row"))
    return one.select("row.*").unionByName(rows.where("not words").select("row.*"))


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark, folder):
    return similar_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
