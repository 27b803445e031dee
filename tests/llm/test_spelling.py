import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ragloom.llm import spelling
from ragloom.llm.registry import oracle_sql, queries


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def literal(rows, rewrite=True):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if rewrite and h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def edited(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abcdxyzéÿ÷")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, c + w])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 14))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "Ünïcodé", "ÀÉÎÕÜßñ", "bananana", "z" * 60]
    texts = [None, "", "short 1234567 漢字漢字漢字漢", "Spelling-spelling_SPELLING spelling"]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 25, 400])
        for _ in range(8):
            v = edited(rng, w)
            words += [v] * rng.choice([1, 2, 2, 3, 30])
            words += [edited(rng, v)] * 2
    rng.shuffle(words)
    texts += [" ".join(words[i : i + 37]) for i in range(0, len(words), 37)]
    out = [*enumerate(texts), (None, "spelling variants variants"), (9, texts[9]), (9, texts[9])]
    return out


@pytest.mark.parametrize("rewrite", [True, False])
def test_rows_equal_brute_force(spark, rows, rewrite):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    got = spelling.group_variants(docs, spelling.misspelt if rewrite else None)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = literal(rows, rewrite)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
    assert sum(r[1] is not None for r in want) > 40 and any(r[1] not in (None, r[2]) for r in want)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(4)
    for _ in range(300):
        at = sorted(rng.sample(range(12), rng.randrange(3, 7)))
        weight = {p: rng.randrange(1, 30) for p in at}
        a, b = spelling.pivots([(p, weight[p]) for p in at])
        assert b - a >= 2 and weight[a] + weight[b] == min(weight[x] + weight[y] for x in at for y in at if y - x >= 2)


def test_empty_tables(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "few words here")], "doc_id long, text string")).count() == 0


def test_twin(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    r = con.execute(oracle_sql()["op11_spelling_variants"])
    got = queries()["op11_spelling_variants"](spark, d)
    assert sorted(tuple(x) for x in got.select(*[c[0] for c in r.description]).collect()) == sorted(r.fetchall())
