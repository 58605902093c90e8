"""Secrets in texts, told apart by who else has them.

Candidates are found by patterns. Their hashes are counted over the whole corpus by distinct
repositories and owners: a value that several owners have is an example that was copied
around, one that a single owner has may be live. Values of no known form are reported only if
they look random and belong to so few owners. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imgcurate.session import written

from .registry import query, table

#: Patterns of the fixed kinds, in their order, and the least length of the group that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "(AKIA[A-Z0-9]{16,})"
HEX = "([0-9a-f]{24,})"
#: Values of no known form: whole words of 20 and more characters with a digit, of which 10 differ.
GENERIC = "((?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,})"
DIFFERENT = 10
KINDS = ("assign", "access", "hex", "generic")
#: A value with more owners than this was copied around.
OWNERS = 2


def pieces(text: Column, pattern: str, kind: str, least: int) -> Column:
    """Array of ``(rank, place, gap, own, counts, hash)``: what lies before each match and how long it is itself.

    Matches are leftmost ones that do not overlap, lengths in code points. Those too short, or
    too orderly for a generic value, do not count, but what follows them needs their lengths.
    Null where there is no match.
    """
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1))
    random = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= DIFFERENT
    # A text is its matches and what lies between them; the last piece has no match behind it.
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    made = F.transform(
        F.arrays_zip(whole.alias("w"), value.alias("v"), between.alias("b")),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"),
            i.alias("place"),
            F.length(x["b"]).alias("gap"),
            F.length(x["w"]).alias("own"),
            ((F.length(x["v"]) >= least) & (random(x["v"]) if kind == "generic" else F.lit(True))).alias("counts"),
            F.xxhash64(x["v"]).alias("hash"),
        ),
    )
    return F.when(text.rlike(pattern), made)


def candidates(docs: DataFrame, text: str, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """``docs`` without its text as ``(row_id, row)``, and ``(row_id, owner, repository, start, rank, kind, end, hash)`` for each span.

    Places are running sums over the pieces of a text, and generic spans that overlap one of
    the fixed kinds are told by the running maximum of their ends, so a text of very many matches
    takes time in proportion, in windows that spill.
    """
    col = F.coalesce(F.col(text), F.lit(""))
    kinds = [(ASSIGN, "assign", 6), (ACCESS, "access", 20), (HEX, "hex", 24), (GENERIC, "generic", 20)]
    names = [c for c in docs.columns if c != text]
    held = F.array(*[pieces(col, *k) for k in kinds])
    rows = docs.select(F.struct(*names).alias("row"), owner.alias("owner"), repository.alias("repository"), held.alias("held"))
    # Written, so that the row numbers hold.
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "candidates")
    each = rows.select("row_id", "owner", "repository", F.explode("held").alias("own")).select("row_id", "owner", "repository", F.inline("own")).repartition("row_id")
    before = Window.partitionBy("row_id", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("own")).over(before).cast("int")).where("counts")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    spans = each.select("row_id", "owner", "repository", (F.col("end") - F.col("own")).alias("start"), "rank", kind.alias("kind"), "end", "hash")
    # A span of a fixed kind enters at its start, a generic one at its end, before those that start there.
    fixed = F.col("kind") != "generic"
    entered = Window.partitionBy("row_id").orderBy(F.when(fixed, F.col("start")).otherwise(F.col("end")), fixed).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(fixed, F.col("end"))).over(entered)
    spans = spans.withColumn("reach", reach).where(fixed | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")
    return rows.select("row_id", "row"), written(spans, "spans")


def ownership(spans: DataFrame) -> DataFrame:
    """``(hash, owners, repositories)`` from rows of ``hash``, ``owner`` and ``repository``; nulls count as one owner each."""
    name = lambda c: F.coalesce(F.xxhash64(c, F.col(c).isNull()), F.lit(0))
    once = spans.select("hash", name("owner").alias("owner"), name("repository").alias("repository")).distinct()
    per_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, owner: Column, repository: Column, text: str = "text", owners: int = OWNERS) -> DataFrame:
    """``docs`` without ``text``, with ``base`` and ``found``: arrays of ``(start, rank, kind, end, owners, repositories, live)``.

    ``base`` has the spans of the fixed kinds; ``found`` has these and the random-looking values
    that at most ``owners`` owners have. ``live`` is true where that holds. Both are ordered by
    start and kind. A null or empty text has none. Every row comes out once, repeated ones
    alike; nulls count as an owner and a repository. An empty table gives an empty one. Columns
    of ``docs`` named as the new ones are replaced.
    """
    rows, each = candidates(docs.drop("base", "found"), text, owner, repository)
    owned = written(ownership(each), "ownership")
    told = each.join(owned, "hash").withColumn("live", F.col("owners") <= owners).where((F.col("kind") != "generic") | F.col("live"))
    fields = ("start", "rank", "kind", "end", "owners", "repositories", "live")
    spans = written(told.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("found")), "found")
    empty = F.array().cast(spans.schema["found"].dataType)
    out = rows.select("row_id", "row").join(spans, "row_id", "left").withColumn("found", F.coalesce("found", empty))
    base = F.filter("found", lambda x: x["kind"] != "generic").alias("base")
    return out.select("row.*", base, "found")


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query("op3_secret_scan")
def op3_secret_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    spans = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    many = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        many("assign"),
        many("access"),
        many("hex"),
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )
