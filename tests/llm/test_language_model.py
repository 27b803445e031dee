import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import language_model as lm
from ragloom.llm.registry import queries

D = "/root/testdata/sf0.01"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def literal(rows):
    """Every column but score, straight from the contract."""
    c, docs = Counter(), 0
    for doc_id, text in rows:
        if not is_held_out(doc_id):
            docs += 1
            c.update(words(text))
    n, v = sum(c.values()) + docs, len(c) + (docs > 0)
    out = []
    for doc_id, text in rows:
        counts = [c[w] for w in words(text)] + [docs]
        base = sum(math.log10((k + 1) / (n + v + 1)) for k in counts)
        out.append((doc_id, is_held_out(doc_id), len(counts), sum(k > 0 for k in counts), n, base))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def scored(spark):
    df = queries()["op13_lm_scoring"](spark, D)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return df.collect()


def test_counts_and_base_equal_the_contract(spark, scored):
    same([tuple(r)[:6] for r in scored], literal([tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]))


def test_held_out_texts_score_above_the_base(scored):
    out = [r for r in scored if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in out)
    gain = (sum(r["score"] for r in out) - sum(r["base_score"] for r in out)) / tokens
    assert len(out) > 50 and gain > 0.03
    assert all(r["score"] < 0 for r in scored)
    assert np.mean([r["score"] > r["base_score"] for r in out if r["n_tokens"] > 100]) > 0.9


def test_shuffled_words_score_lower(spark):
    """The model has learned an order: sentences score above their words in reverse."""
    rows = [(i, "the cat sat on the mat and the dog lay by the door of the old house") for i in range(3000)]
    back = [(5000 + i, " ".join(reversed(t.split()))) for i, (_, t) in enumerate(rows[:40])]
    learned = [r for r in back if is_held_out(r[0])]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(rows + learned, "doc_id long, text string")).collect()}
    assert max(got[i] for i, _ in learned) < min(got[i] for i, _ in rows)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(3)
    share = rng.random(30)
    share /= share.sum()
    t = lm.Trainer(lm.Model.fresh(share), share, 1)
    for _ in range(50):
        t.step(*rng.integers(0, 30, (3, 200)))
    m = lm.Model.from_rows(t.m.rows())
    a, b, z = lm.token_scores(m, m.normalisers(np.arange(30)))
    p = 10.0 ** (a[:, None, :] + b[None, :, :] - z[:, :, None])
    np.testing.assert_allclose(p.sum(2), 1, rtol=1e-4)
    q = m.c[0] * m.r[4] + m.c[1] * m.r[7]
    s = np.exp(q @ m.t.T + m.b)
    np.testing.assert_allclose(p[4, 7], s / s.sum(), rtol=1e-4)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b a B c"), (4, "A b a B c"), (None, "a new word ü 漢"), (5, "x " * 40_000), *((i, f"a b {i} d e") for i in range(6, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("ids", F.lit("x")).repartition(3)
    same([tuple(r)[:6] for r in lm.score_texts(docs).collect()], literal(rows))


def test_words_beyond_the_head_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 8)
    monkeypatch.setattr(lm, "SHORT", 5)
    rows = [(i, " ".join(f"w{j % (1 + i % 17)}" for j in range(60))) for i in range(80)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([tuple(r)[:6] for r in got], literal(rows))


def test_empty_and_unlearned_tables(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(i, "only held out") for i in range(200) if is_held_out(i)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([tuple(r)[:6] for r in got], literal(rows))
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in got)
