import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ragloom.llm import periodic_runs


def literal_runs(w):
    """Every run, straight from its definition."""
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if len(x) >= max(24, 3 * q) and not any(q % d == 0 and x[d:] == x[:-d] for d in range(1, q)):
                found.append((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def rewritten(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def literal_row(doc_id, text):
    w = rewritten(doc_id, [x.decode() for x in (text or "").encode().split()])
    runs = literal_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)), len(w), len(drop),
    )


def some_words(rng):
    kinds, n = rng.choice([1, 2, 3, 10, 50]), rng.randrange(0, 180)
    if rng.random() < 0.3:
        return [f"w{rng.randrange(kinds)}" for _ in range(n)]
    w = []
    while len(w) < n:
        unit = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 30))]
        w += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
    return w


def test_rows_equal_the_definition(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "A a " * 12, "a b " * 12, "ü é 漢 " * 9, "x\x0by\x0c" * 20, "a b " * 30]
    texts += [" ".join(some_words(rng)) for _ in range(250)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    texts += [" ".join(fib[-1]), " ".join("ab"[bin(i).count("1") & 1] for i in range(256))]
    rows = [*enumerate(texts), (None, "b " * 30), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n_runs", F.lit("x")).withColumn("start", F.lit(None).cast("int"))
    got = sorted((tuple(r) for r in periodic_runs.find_runs(docs).collect()), key=repr)
    assert got == sorted((literal_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 1 for r in got) > 40


def test_whole_table(spark):
    from ragloom.llm.registry import queries

    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in queries()["op12_periodic_runs"](spark, d).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    short = [r for r in rows if len((r[1] or "").split()) <= 1500]
    assert len(short) > 100
    for r in short:
        assert got[r[0]] == literal_row(*r), r[0]


def test_empty_table_and_very_long_text(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 5000, 60_000)
    w = [f"w{i}" for i in (*rng.integers(0, 5000, 50_000), *unit, *unit, *unit, *unit[:100])]
    r = periodic_runs.find_runs(spark.createDataFrame([(3, " ".join(w))], "doc_id long, text string"), rewrite=None).first()
    assert (r["n_runs"], r["period"]) == (1, 60_000) and r["length"] >= 180_100 and r["n_dropped"] == r["length"] - r["period"]
