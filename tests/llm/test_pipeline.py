import re
from collections import defaultdict

import corpus_pipeline
import pytest
from ragloom.llm import mixing, quality
from ragloom.llm.common import table
from test_ops import brute_components, shingle_set

SF = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def good(t, labels):
    """The verdict of the rules, from the words and the labels of the lines with words."""
    w = words(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = [i for i, x in enumerate(windows) if windows.count(x) > 1] if len(set(windows)) < len(windows) else []
    repeated = {j for i in twice for j in range(i, i + 8)}
    if len(w) < 20 or 100 * len(repeated) > 30 * len(w):
        return False
    sizes = [len(words(x)) for x in t.split("\n") if words(x)]
    assert len(sizes) == len(labels)
    return sum(n for n, x in zip(sizes, labels) if x == "C") >= quality.MIN_SHARE * len(w)


def cut(rows):
    sites = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            sites[line.strip(" \t\r")].add(r["source"])
    common = {x for x, s in sites.items() if x and len(s - {None}) >= 10}
    out = []
    for r in rows:
        t = r["text"]
        rest = t and "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in common)
        out.append({**r, "text": t if t and len(rest) < len(t) / 2 else rest})
    return out


def without_copies(rows):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    component = brute_components(sets, list(sets))
    return [r for r in rows if component[r["doc_id"]] == r["doc_id"]]


def without_items(rows, items):
    wanted = [s for s in (shingle_set(t) for t in items) if s]
    return [r for r in rows if not any(len(s & shingle_set(r["text"])) >= 0.8 * len(s) - 1e-9 for s in wanted)]


def told(df):
    return sorted(map(repr, (sorted(r.items()) for r in (x.asDict() if hasattr(x, "asDict") else x for x in df))))


def test_stages_equal_brute_force(spark):
    """Every stage against brute force on its own input, over the whole table."""
    docs = table(spark, SF, "documents")
    columns, expected = docs.columns, None
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [r.asDict() for r in docs.collect()]
        if k == 0:
            labels = {r["doc_id"]: r["line_labels"] for r in quality.judge(docs, table(spark, SF, "labels")).collect()}
            expected = [r for r in before if good(r["text"], labels[r["doc_id"]])]
        else:
            expected = (cut, without_copies, lambda rows: without_items(rows, items))[k - 1](before)
        docs = corpus_pipeline.keep(stage(spark, docs, SF), "t")
        assert docs.columns == columns and told(docs.collect()) == told(expected), name
        assert expected, name
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    size = {r["doc_id"]: len(words(r["text"])) for r in expected}
    assert {r["doc_id"]: r["size"] for r in mix} == size and all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in mix)
    taken, target = defaultdict(int), {}
    for r in mix:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(min(mixing.SHARE, 2) * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in target)


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_take_nulls_and_repeats(spark):
    """Null ids, texts and sources, repeated rows and columns of clashing names go through every stage."""
    text = " ".join(f"plain{i} word, and more of it." for i in range(12))
    rows = [(1, text, None, 7), (1, text, None, 7), (None, text + " but other words stand here at the end of it all", "s", 8), (None, None, "s", 9), (2, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int").selectExpr("*", "'x' AS row", "1 AS node", "2 AS key")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        texts = [r["text"] for r in out.collect()]
        assert texts.count(text) == (1 if name.startswith("n-gram") else 2) and None in texts and "" in texts, name
    mix = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert len(mix) == 5 and all(r["taken"] <= 2 * r["size"] for r in mix)
