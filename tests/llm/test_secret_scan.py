"""The secret scan against regular expressions in Python and counts by hand."""

import hashlib
import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from imgcurate.llm.queries import QUERIES
from imgcurate.llm.secret_scan import scan

BASE = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 6),
    "access": (re.compile("(AKIA[A-Z0-9]+)"), 20),
    "hex": (re.compile("([0-9a-f]+)"), 24),
}
GENERIC = re.compile("(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")
ORDER = [*BASE, "generic"]


def spans_of(text):
    text = text or ""
    base = [(m.start(), ORDER.index(k), m.end(), m[1]) for k, (p, least) in BASE.items() for m in p.finditer(text) if len(m[1]) >= least]
    more = [(m.start(), 3, m.end(), m[0]) for m in GENERIC.finditer(text) if len(set(m[0])) >= 10]
    more = [x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
    return sorted(base), sorted(more)


def brute(rows):
    owners = {}
    for _, text, source in rows:
        for x in sum(spans_of(text), []):
            owners.setdefault(x[3], set()).add(source)
    out = []
    for d, text, _ in rows:
        base, more = spans_of(text)
        every = sorted(base + [x for x in more if len(owners[x[3]]) <= 2])
        tell = lambda s: ",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b, _ in s)
        counts = [sum(x[1] == k for x in base) for k in range(3)]
        live = sum(len(owners[x[3]]) <= 2 for x in every)
        out.append((d, *counts, hashlib.sha256(tell(base).encode()).hexdigest(), tell(every), live, len(every) - live))
    return sorted(out, key=str)


def test_table(spark):
    rows = duckdb.sql("select doc_id, text, source from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = sorted(map(tuple, QUERIES["op3_secret_scan"](spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 0


def test_hard_texts(spark, tmp_path):
    rng = random.Random(4)
    parts = ["password", "PASSWD", "api_key", "apikey", "Secret", "token", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "😀", "x", "\n", "aB3dE5fG7hJ9kL1mN3pQ5", "/+", "secret=token:abcdefgh"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), f"s{rng.randint(0, 4)}") for i in range(600)]
    rows += [(None, None, None), (None, None, None), (7, "", "s"), (7, "password=abcdefg " * 3_000, None), (8, "a" * 2_000_000, "s1")]
    df = spark.createDataFrame([(d, t, s, "en") for d, t, s in rows], "doc_id long, text string, source string, lang string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op3_secret_scan"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_a_hot_value_and_empty_table(spark):
    df = spark.range(900).selectExpr("id as doc_id", "concat('key ', if(id % 3 = 0, 'aB3dE5fG7hJ9kL1mN3pQ5', concat('zY3dE5fG7hJ9kL1m', id + 10000))) as text", "concat('o', id % 7) as owner", "id as found")
    out = scan(df, F.col("owner"), F.col("owner"))
    assert out.columns == ["doc_id", "owner", "base", "found"]
    assert {r.n: r["count"] for r in out.groupBy(F.size("found").alias("n")).count().collect()} == {0: 300, 1: 600}
    assert scan(df.limit(0), F.col("owner"), F.col("owner")).count() == 0


def test_very_many_matches_in_one_text(spark):
    """200,000 matches, some of them under generic values, within a minute."""
    word = "0123456789abcdef01234567 "
    text = word * 200_000 + "zY3dE5fG7hJ9kL1m/0123456789abcdef01234567 zY3dE5fG7hJ9kL1m0qR2"
    df = spark.createDataFrame([(1, text, "o"), (2, "", "o")], "doc_id long, text string, owner string")
    began = time.monotonic()
    out = {r.doc_id: (r.spans, r.last) for r in scan(df, F.col("owner"), F.col("owner")).select("doc_id", F.size("found").alias("spans"), F.try_element_at("found", F.lit(-1)).alias("last")).collect()}
    assert time.monotonic() - began < 60
    at = len(word) * 200_000
    assert out[2] == (0, None)
    assert out[1][0] == 200_002 and (out[1][1].kind, out[1][1].start, out[1][1].end) == ("generic", at + 42, at + 62)


def test_no_python_runs(spark):
    plan = QUERIES["op3_secret_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
