import base64
import gzip
import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import decontaminate, html_extract, language_id, line_dedup, mixing, ngram_join, pii, quality, substring_dedup, warc
from ragloom.llm.common import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts, extra=False):
    """doc_id from the place in the list; ``extra`` adds columns whose names an operator might use itself."""
    df = spark.createDataFrame([(i, t, "en", f"src{i % 12}", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumn("n_lines", F.lit("x")).withColumn("key", F.lit(1)).withColumn("node", F.lit(None).cast("string")) if extra else df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(rng, t, edits):
    w = t.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "one", "One", "a b c d", "ü ß é ñ 漢 字 words here", "x" * 20000]
    for _ in range(25):
        base = prose(rng, rng.randrange(20, 160))
        texts += [base, base, *(near(rng, base, rng.randrange(1, 6)) for _ in range(4))]
    shared = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(6)]
    texts += [prose(rng, 4000)]
    return texts


def shingle_set(t, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(sets, ids):
    up = {i: i for i in ids}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_words_break_at_texts_and_chunks():
    data = np.frombuffer("Ab cdé fg".encode(), np.uint8)
    h, s, e, at = words_of(data, np.array([0, 2, 5, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["Ab", "cd", "é", "fg"]
    assert list(at) == [0, 1, 2, 2] and h[0] == words_of(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))[0][0]


def test_ngram_join_equals_brute_force(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(docs_of(spark, corpus, extra=True)).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(corpus)}
    top = brute_components(sets, range(len(corpus)))
    assert got == {i: (len(sets[i]), top[i]) for i in sets}


def test_ngram_join_empty(spark):
    assert ngram_join.shingle_components(empty_docs(spark)).collect() == []


def test_ngram_join_near_group_with_slots(spark, monkeypatch):
    """A large group of near copies whose members differ, dealt out in many small slots."""
    from ragloom.llm import setjoin

    monkeypatch.setattr(setjoin, "SLOT", 7)
    monkeypatch.setattr(setjoin, "BLOCK", 5)
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [near(rng, base, rng.randrange(0, 4)) for _ in range(60)] + [near(rng, base, 30) for _ in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.shingle_components(docs_of(spark, texts)).collect()}
    assert got == brute_components({i: shingle_set(t) for i, t in enumerate(texts)}, range(len(texts)))


def test_one_per_component_keeps_columns(spark, corpus):
    d = docs_of(spark, corpus, extra=True)
    out = ngram_join.one_per_component(d)
    assert out.columns == d.columns and out.count() == len(set(brute_components({i: shingle_set(t) for i, t in enumerate(corpus)}, range(len(corpus))).values()))


def test_one_per_component_without_or_with_repeated_ids(spark):
    rng = random.Random(14)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    rows = [(None, a), (None, b), (None, near(rng, b, 1)), (4, c), (None, near(rng, c, 1)), (7, d), (7, d), (7, d), (8, e), (8, near(rng, e, 1)), (8, a[::-1]), (None, None), (None, " "), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], DOCS)
    out = Counter(r["source"] for r in ngram_join.one_per_component(docs).collect())
    groups = [{"s0"}, {"s1", "s2"}, {"s3"}, {"s5", "s6", "s7"}, {"s8", "s9"}, {"s10"}, {"s11"}, {"s12"}, {"s13"}, {"s14"}]
    assert [sum(out[x] for x in g) for g in groups] == [1] * len(groups) and sum(out.values()) == len(groups)


def test_one_per_component_shuffles_few_texts(spark):
    """Rows that stay are told by filters of ids: their texts are not shuffled to be joined."""
    rng = random.Random(41)
    texts = [" ".join(rng.randbytes(1500).hex() for _ in range(6)) for _ in range(400)]
    docs = docs_of(spark, texts + texts[:10]).repartition(4)
    docs = ngram_join.keep(docs, "t")
    summary = spark.sparkContext._jsc.sc()

    def shuffled():
        summary.listenerBus().waitUntilEmpty()
        return summary.statusStore().executorSummary("driver").totalShuffleWrite()

    was, name = shuffled(), "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as if the ids were many
    try:
        got = sorted(r["doc_id"] for r in ngram_join.one_per_component(docs).collect())
    finally:
        spark.conf.set(name, usual)
    assert got == list(range(400))
    assert shuffled() - was < 0.2 * sum(map(len, texts))


def test_one_per_component_with_full_filters(spark, corpus, monkeypatch):
    """Filters that admit every id cost a join of the texts, not rows."""
    rng = random.Random(42)
    a, b = prose(rng, 70), prose(rng, 90)
    texts = [*corpus, None, " "]
    d = docs_of(spark, texts, extra=True)
    d = d.unionByName(d.where("doc_id in (3, 8)")).unionByName(docs_of(spark, [a, near(rng, b, 1), b, a], extra=True).withColumn("doc_id", F.col("doc_id") + 1000))
    usual = Counter(map(repr, ngram_join.one_per_component(d).collect()))
    monkeypatch.setattr(ngram_join, "member", lambda bits, ids: np.ones(len(ids), bool))
    assert Counter(map(repr, ngram_join.one_per_component(d).collect())) == usual
    sets = {i: shingle_set(t) for i, t in enumerate(corpus)}
    assert sum(usual.values()) == len(set(brute_components(sets, range(len(corpus))).values())) + 4


def test_decontamination_equals_brute_force(spark, corpus):
    rng = random.Random(9)
    items = [None, " ", "tiny", prose(rng, 12), prose(rng, 40), prose(rng, 58)]
    leaks = [f"{prose(rng, 300)} {t} {prose(rng, 500)}" for t in items[3:]] + [f"{prose(rng, 9)}\n{near(rng, items[5], 1).upper()}\n", "a tiny thing", "TINY"]
    texts = corpus + leaks
    d = docs_of(spark, texts, extra=True)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_hit"]) for r in decontaminate.find_items(d, b).collect()}
    want = {}
    for j, t in enumerate(items):
        s = shingle_set(t)
        for i, x in enumerate(texts):
            hit = len(s & shingle_set(x))
            if s and hit >= 0.8 * len(s):
                want[i, j] = (len(s), hit)
    assert got == want and len(want) >= 5
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.find_items(empty_docs(spark), b).count() == 0 and decontaminate.find_items(d, b.limit(0)).count() == 0


def test_decontamination_of_rows_without_or_with_repeated_ids(spark):
    rng = random.Random(21)
    item, rest = prose(rng, 30), [prose(rng, 50) for _ in range(4)]
    texts = [(None, f"{rest[0]} {item} {rest[1]}"), (None, rest[0]), (None, None), (1, rest[1]), (1, f"{item} {rest[2]}"), (1, rest[1]), (2, " ".join(item.split()[:15])), (2, " ".join(item.split()[15:]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in decontaminate.clean(docs, items).collect()]
    assert sorted(left, key=str) == sorted((t for t in texts if item not in (t[1] or "")), key=str)
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, items).collect() if r["doc_id"] == 1] == [(1, 7)]


def test_native_plans_run_no_python(spark, corpus):
    d = docs_of(spark, corpus[:20])
    b = spark.createDataFrame([(0, corpus[8])], "item_id long, text string")
    for df in (decontaminate.find_items(d, b), pii.digest(pii.find(d))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_paragraph_clusters_equal_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 60) for _ in range(6)]
    texts = [None, "", "short line\n" * 3]
    for _ in range(12):
        texts.append("\n".join([prose(rng, 35), near(rng, rng.choice(base), rng.randrange(2)), "", prose(rng, 3)]))
    passage = prose(rng, 55)
    texts += [f"{prose(rng, 70)} {passage} {prose(rng, 70)}" for _ in range(3)]
    rows = [r.asDict() for r in substring_dedup.repeated_passages(docs_of(spark, texts, extra=True)).collect()]
    par = {(i, k): shingle_set(line) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= substring_dedup.MIN_WORDS}
    top = brute_components(par, sorted(par))
    size = Counter(top.values())
    want = {(*k, *top[k]) for k in par if size[top[k]] > 1}
    assert {(r["doc_id"], r["no"], r["first_doc"], r["first_no"]) for r in rows if r["kind"] == "paragraph"} == want and want
    inline = {r["doc_id"] for r in rows if r["kind"] == "window"}
    assert {len(texts) - 3, len(texts) - 2, len(texts) - 1} <= inline
    assert substring_dedup.repeated_passages(empty_docs(spark)).count() == 0


def spans_removed(rows, texts):
    """Word numbers that the rows remove, by document."""
    gone = defaultdict(set)
    for r in rows:
        if not r["removed"]:
            continue
        if r["kind"] == "window":
            gone[r["doc_id"]] |= set(range(r["start"], r["end"]))
        else:
            before = len(texts[r["doc_id"]][: r["start"]].split())
            gone[r["doc_id"]] |= set(range(before, before + r["words"]))
    return gone


def test_every_repeated_passage_keeps_one_copy(spark):
    rng = random.Random(12)
    a, b, c = prose(rng, 120), prose(rng, 120), prose(rng, 120)
    # b and c follow a without a break: in document 1 a is a later occurrence, b and c are first ones
    texts = [f"{prose(rng, 90)} {a} {prose(rng, 90)}", f"{a} {b} {c} {prose(rng, 300)}", f"{prose(rng, 300)} {a} {b}", f"{prose(rng, 400)} {b} {c}"]
    p = prose(rng, 100)
    q = f"{p} {prose(rng, 60)}"
    # the first holder of the end of document 5 is a removed near copy
    tail = prose(rng, 60)
    base = prose(rng, 600)
    texts += [base, f"{base} {tail}", f"{prose(rng, 300)} {tail} {q}", f"{q} {prose(rng, 500)}"]
    rows = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    gone = spans_removed(rows, texts)
    for passage in (a, b, c, p, tail):
        w, stay, some = passage.split(), 0, 0
        for i, t in enumerate(texts):
            x = t.split()
            for k in range(len(x) - len(w) + 1):
                if x[k : k + len(w)] == w:
                    kept = [n not in gone[i] for n in range(k, k + len(w))]
                    stay += all(kept)
                    some += sum(kept) > len(w) // 2
        assert stay == some == 1, passage


def test_short_lines_and_repeats_inside_a_document(spark):
    rng = random.Random(13)
    ten, four, near_line = prose(rng, 10), prose(rng, 4), prose(rng, 25)
    twice = prose(rng, 70)
    texts = [
        f"{prose(rng, 12)}\n{ten}\n{prose(rng, 12)}", f"{prose(rng, 9)}\n{ten}\n{four}", f"{four}\n{prose(rng, 6)}",
        f"{prose(rng, 20)}\n{near_line}", f"{near_line} {rng.choice(WORDS)}\n{prose(rng, 7)}",
        f"{prose(rng, 80)} {twice} {prose(rng, 80)}\n{prose(rng, 90)} {twice} {prose(rng, 50)}",
    ]
    rows = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {(r["doc_id"], r["no"], r["removed"]) for r in rows if r["kind"] == "paragraph"} == {(0, 1, False), (1, 1, True), (1, 2, False), (2, 0, True), (3, 1, False), (4, 0, True)}
    inside = [r for r in rows if r["kind"] == "window" and r["doc_id"] == 5]
    assert {r["removed"] for r in inside} == {True, False} and all(r["start"] >= 150 for r in inside if r["removed"])


def test_banding_is_tuned_for_recall():
    b, r = substring_dedup.tune(0.8)
    assert 1 - (1 - 0.8**r) ** b >= 0.9995


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def pii_ok(kind, m):
    n = sum(c.isdigit() for c in m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else False, "card": 16 <= n <= 19 and luhn(m), "phone": 8 <= n <= 15}[kind]


def test_pii_spans_equal_brute_force(spark):
    texts = [
        None, "", "mail é a.b@c-d.org, x@y.z.w_q@r.st and @no.de", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3 99999999999999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111222233334444",
        "+49 (30) 123456-78 +1234567 + 12 +1-------------9", "9" * 3000, "a" * 20000 + "@" + "b" * 50, ("+4930 12345678 x@y.org 4111111111111111 10.0.0.1 " * 40), "漢字 q@w.de 漢字 8.8.8.8",
    ]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs_of(spark, texts, extra=True))).collect()}
    for i, t in enumerate(texts):
        spans, counts = [], []
        for kind, p in PII.items():
            found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if pii_ok(kind, m[0])]
            counts.append(len(found))
            spans += found
        assert [got[i][f"n_{k}"] for k in PII] == counts, (i, counts)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i]["spans"].startswith(",".join(spans))
    assert pii.digest(pii.find(empty_docs(spark))).count() == 0


def test_revealing_terms_and_sanitising(spark):
    texts = [f"line {i} about the project\nagent Zorgblat writes to z@secret.org about item{i}\nthe end of {i}" for i in range(6)] + ["Zorgblat was seen.", *(f"about the item{i} and the writes to agent" for i in range(40))]
    found = pii.find(docs_of(spark, texts)).cache()
    rows = {r["doc_id"]: r for r in pii.digest(found).collect()}
    assert rows[6]["n_term"] == 1 and rows[6]["spans"] == "term:0:8"
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(found).collect()}
    assert clean[6] == "[TERM] was seen." and "[EMAIL]" in clean[0] and "Zorgblat" not in clean[0]
    assert clean[10] == texts[10]


def test_entities_seen_once_are_scored(spark):
    common = [f"the note of day {i} for the report" for i in range(80)]
    texts = ["the note of Brunhilda for b.h@first.org", "the report of note", "for the note call +49 30 1234567 of Kasimir", "the report of day and note", *common]
    rows = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(docs_of(spark, texts))).collect()}
    assert "term:12:21" in rows[0] and "term:36:43" in rows[2] and rows[3] == "" and all(rows[4 + i] == "" for i in range(80))


def test_disclosure_equals_brute_force(spark):
    rng = random.Random(12)
    names = ["Ada", "Bob", "Cleo", "Dora", "Emil"]
    def line():
        words = [rng.choice(["note", "report", "visit", "of", "the", "to", *names]) for _ in range(rng.randrange(1, 7))]
        if rng.random() < 0.4:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["a@x.org", "b@x.org", "c@y.net", "11.2.3.44", "1.2.3.4", "+49 30 1234567"]))
        return " ".join(words)

    texts = ["\n".join(line() for _ in range(rng.randrange(1, 5))) for _ in range(60)] + [None, "", "1.2.3.4 1.2.3.4 twice\n11.2.3.44 once"]
    docs = docs_of(spark, texts)
    got = {r["term"]: r["disclosure"] for r in pii.revealing_terms(docs, pii.base_spans(docs), -100.0).collect()}
    held, uses, n = [], Counter(), 0
    for l in "\n".join(t or "" for t in texts).split("\n"):
        n += 1
        terms = {w for w in re.findall(r"[^\W_](?:[\w'-]*[^\W_])", l.lower()) if len(w) >= 3}
        uses.update(terms)
        found = {f"{k}:{m[0].lower()}" for k, p in PII.items() for m in re.finditer(p, l) if pii_ok(k, m[0])}
        held += [(e, re.sub(r"^email:[^@]*", "", e) if e.startswith("email") else e.split(":")[0], terms) for e in found]
    n_entity, n_pool = Counter(e for e, _, _ in held), Counter(p for _, p, _ in held)
    both, pool_both = Counter((e, p, t) for e, p, ts in held for t in ts), Counter((p, t) for _, p, ts in held for t in ts)
    want = defaultdict(lambda: -1e9)
    for (e, p, t), c in both.items():
        if not t.isdigit():
            q = min((pool_both[p, t] + 0.5 * n_pool[p] / n) / (uses[t] + 0.5), 1)
            q = min((c + 0.5 * q * n_entity[e] / n_pool[p]) / (uses[t] + 0.5), 1)
            want[t] = max(want[t], 1 + np.log(q) / np.log(n / n_entity[e]))
    assert got == pytest.approx(dict(want))


def test_pii_many_spans_and_secrets(spark):
    hexes = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = ["x@y.org é 10.0.0.1, " * 6_000, f'set token = "{hexes}" now', "token = short", "", None, "mixed a@b.cd"]
    rows = {r["doc_id"]: r for r in pii.digest(pii.find(docs_of(spark, texts))).collect()}
    assert rows[0]["n_email"] == rows[0]["n_ip"] == 6_000
    want = [f"{k}:{m.start()}:{m.end()}" for k in PII for m in re.finditer(PII[k], texts[0]) if pii_ok(k, m[0])]
    assert rows[0]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert rows[0]["sanitised"] == "[EMAIL] é [IP], " * 6_000
    assert rows[1]["n_secret"] == 1 and rows[1]["n_email"] == 0 and "[SECRET]" in rows[1]["sanitised"] and hexes not in rows[1]["sanitised"]
    assert rows[2]["n_secret"] == 0 and rows[2]["sanitised"] == texts[2] and rows[4]["sanitised"] == ""


def archive(pages):
    return [warc.record(i, f"http://h/{i}", p) for i, p in pages]


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 500, "é" * 500]
    pages = spark.createDataFrame([(10 + i, None if i == 2 else f"http://h/{i} x", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    first = {}
    for i, h in enumerate(html):
        p = (h or "").encode()
        f = first.setdefault(p, 10 + i)
        r = got[10 + i]
        want = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if f == 10 + i else "revisit", None if f == 10 + i else f)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_later_records(packed):
    recs = [gzip.compress(r, mtime=0) if packed else r for r in archive([(i, f"<p>{i}</p>".encode() * 50) for i in range(6)])]
    broken = bytearray(recs[2])
    broken[len(broken) // 2] ^= 0xFF
    junk = b"garbage\r\nnot a record"
    data = recs[0] + recs[1] + bytes(broken) + recs[3] + junk + recs[4] + recs[5][: len(recs[5]) // 2]
    out = list(warc.salvage(data))
    ids = [r.headers["warc-record-id"] for r in out if isinstance(r, warc.Record)]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
    gaps = [(g.offset, g.length) for g in out if isinstance(g, warc.Gap)]
    at = len(recs[0]) + len(recs[1])
    assert gaps[0] == (at, len(broken)) and gaps[1] == (at + len(broken) + len(recs[3]), len(junk))
    covered = sum(r.length for r in out)
    assert covered == len(data)
    assert list(warc.salvage(b"")) == [] and isinstance(next(warc.salvage(b"\x00" * 10)), warc.Gap)


def test_salvage_of_members_with_several_records():
    recs = archive([(i, f"<p>{i}</p>".encode() * 50) for i in range(5)])
    whole = gzip.compress(b"".join(recs), mtime=0)
    out = list(warc.salvage(whole))
    assert [r.headers["warc-record-id"] for r in out] == [f"<urn:page:{i}>" for i in range(5)] and sum(r.length for r in out) == len(whole)
    # a bad first record hides none of those behind it, and leaves a gap inside the member
    bad = recs[0].replace(b"<p>0</p>", b"<p>X</p>", 1)
    out = list(warc.salvage(gzip.compress(bad + b"junk" + b"".join(recs[1:]), mtime=0) + gzip.compress(recs[0], mtime=0)))
    assert [r.headers["warc-record-id"] for r in out if isinstance(r, warc.Record)] == [f"<urn:page:{i}>" for i in (1, 2, 3, 4, 0)]
    assert [(g.offset, g.inner, g.length) for g in out if isinstance(g, warc.Gap)] == [(0, 0, len(bad) + 4)]
    # what a member held before it broke off is kept; the member is a gap
    rng = random.Random(2)
    long = archive([(i, rng.randbytes(300_000)) for i in range(4)])
    cut = gzip.compress(b"".join(long), mtime=0)[:800_000]
    out = list(warc.salvage(cut + gzip.compress(recs[4], mtime=0)))
    assert [r.headers["warc-record-id"] for r in out if isinstance(r, warc.Record)] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:4>"]
    assert [(g.offset, g.length) for g in out if isinstance(g, warc.Gap)] == [(0, len(cut))]


def test_salvage_time_is_linear():
    import time

    rng = random.Random(3)
    rec = gzip.compress(archive([(1, rng.randbytes(34_000))])[0], 1, mtime=0)
    data = rec * 2000
    began = time.process_time()
    assert sum(isinstance(r, warc.Record) for r in warc.salvage(data)) == 2000
    assert time.process_time() - began < 8


def test_warc_repeated_page_ids(spark):
    rows = [(3, "A"), (4, "B"), (5, "A"), (5, "B"), (5, "C"), (None, "A"), (7, "D"), (7, "D")]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    sha = {h: warc.digest(h.encode()) for h in "ABCD"}
    want = [(3, "A", "response", None), (4, "B", "response", None), (5, "A", "revisit", 3), (5, "B", "revisit", 4), (5, "C", "response", None), (None, "A", "response", None), (7, "D", "response", None), (7, "D", "response", None)]
    assert got == Counter((i, sha[h], k, f) for i, h, k, f in want)


def repeat_words(w):
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    return len({j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_quality_counts_equal_brute_force(spark, corpus):
    texts = corpus + ["a b\n\na b\n \n x\na b", "dup words " * 30, "#*$%&|<> é#\n#", "\n\n", "end\n", "W w W w W w W w W w W w W w W w"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts, extra=True), labels).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat_words(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 20 or 100 * want[4] > 30 * len(w)) and r["kept"] == (not r["base_failed"])
    assert quality.judge(empty_docs(spark), labels).count() == 0


def test_crf_separates_held_out_documents(spark):
    rng = random.Random(4)
    good = ["\n".join(f"{prose(rng, rng.randrange(8, 30)).capitalize()}." for _ in range(rng.randrange(2, 6))) for _ in range(120)]
    bad = [" ".join(f"{w}###" for w in prose(rng, 60).split()) for _ in range(40)] + [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(40)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(texts)) if i % 2], "doc_id long, quality int, toxic int")
    d = docs_of(spark, texts)
    kept = {r["doc_id"] for r in quality.judge(d, labels).where("kept").collect()}
    held = [i for i in range(len(texts)) if i % 2 == 0]
    assert all((i in kept) == (i < len(good)) for i in held)
    rows = quality.keep_good(d, labels)
    assert rows.columns == d.columns and {r["doc_id"] for r in rows.collect()} == kept


def test_crf_labels_lines_within_texts(spark):
    """Common lines inside good texts are boilerplate, their neighbours content; copies of a text do not make its lines common."""
    rng = random.Random(17)
    common = [f"{prose(rng, n).capitalize()}." for n in (9, 14, 20)]
    good, marks = [], []
    for i in range(90):
        lines = [(f"{prose(rng, rng.randrange(8, 30)).capitalize()}.", "C") for _ in range(rng.randrange(3, 7))]
        if i < 60:
            lines.insert(rng.randrange(len(lines) + 1), (common[i % 3], "B"))
        good.append("\n".join(x for x, _ in lines))
        marks.append("".join(m for _, m in lines))
    bad = [" ".join(f"{w}###" for w in prose(rng, 60).split()) for _ in range(40)]
    texts = good + bad + [good[70]] * 30
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good) + len(bad)) if i % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts), labels).collect()}
    assert all(got[i]["line_labels"] == marks[i] for i in range(len(good)))
    assert all(got[i]["line_labels"] == "B" and not got[i]["kept"] for i in range(len(good), len(good) + len(bad)))
    for i, t in enumerate(texts):
        n = [len(x.split()) for x in t.split("\n")]
        share = sum(k for k, m in zip(n, got[i]["line_labels"]) if m == "C") / sum(n)
        assert abs(got[i]["content_share"] - share) < 1e-9 and got[i]["kept"] == (not got[i]["base_failed"] and share >= quality.MIN_SHARE)
    own = Counter(x for t in good[:60] for x in t.split("\n"))
    assert len(quality.common_lines(docs_of(spark, texts))) == sum(n >= 10 for n in own.values()) == 3


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        s, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        best = max(range(2**n), key=lambda m: sum(s[i, m >> i & 1] for i in range(n)) + sum(t[m >> i & 1, m >> (i + 1) & 1] for i in range(n - 1)))
        assert list(quality.viterbi(s, t)) == [best >> i & 1 for i in range(n)]


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, None if i % 10 == 9 else prose(rng, rng.randrange(1, 60)), "en", [None, "a", "b", "ü", "Z"][i % 5], 1) for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS)
    out = [r.asDict() for r in mixing.mix_sources(d.withColumn("rank", F.lit("x"))).collect()]
    assert sorted(map(str, out)) == sorted(str(r.asDict()) for r in mixing.mix_sources(d.repartition(7)).collect())
    size, target, taken = Counter(), {}, Counter()
    for r in out:
        assert r["size"] == len((rows[r["doc_id"]][1] or "").split()) and r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, want, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 2 * size[s]]
        if not over:
            want |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
            open_.discard(s)
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - target[s]) <= 60
    assert mixing.mix_sources(empty_docs(spark)).count() == 0
    # without ids, and with rows that are all alike
    odd = [(None, prose(rng, 20), "en", "a", 1) for _ in range(50)] + [(5, "same words here", "en", "b", 1)] * 40
    got = mixing.mix_sources(spark.createDataFrame(odd, DOCS)).collect()
    assert len(got) == 90 and all(abs(sum(r["taken"] for r in got if r["source"] == s) - next(r["target"] for r in got if r["source"] == s)) <= 20 for s in "ab")
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(spark.createDataFrame(odd[::-1], DOCS)).collect()))


def test_line_dedup(spark):
    texts = [f"Cookie notice here\nbody {i} is long enough to stay as it is, and longer than both notices\n  Cookie notice here\t" for i in range(24)] + [None, "", "\n\n", "Cookie notice here", "only on\none site"]
    d = docs_of(spark, texts, extra=True)
    out = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(d, min_sites=12).collect()}
    assert out[3]["text"] == "body 3 is long enough to stay as it is, and longer than both notices" and out[3]["n_removed"] == 2
    assert [out[i]["text"] for i in (24, 25, 26, 28)] == [None, "", "\n\n", "only on\none site"] and out[24]["n_lines"] == 0
    assert (out[27]["text"], out[27]["n_removed"]) == ("", 1)
    left = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(d, min_sites=12, max_share=0.5).collect()}
    assert (left[27]["text"], left[27]["n_removed"]) == (texts[27], 0) and left[3]["text"] == out[3]["text"]
    assert all(r["n_removed"] == 0 for r in line_dedup.remove_boilerplate(d, min_sites=13).collect())
    lone = d.withColumn("source", F.lit(None).cast("string"))
    assert all(r["n_removed"] == 0 for r in line_dedup.remove_boilerplate(lone).collect())
    assert line_dedup.remove_boilerplate(empty_docs(spark)).count() == 0


def test_line_dedup_removes_large_shares_and_takes_any_column(spark):
    """Six shared lines of seven on 40 sites all go; names of ours as extra columns, repeated rows and ties do no harm."""
    shared = [f"Shared line {k} of all sites" for k in range(6)]
    rows = [(i, "\n".join([*shared, f"own {i}"]), f"s{i}", 1, "x", "y", None) for i in range(40)]
    rows += [rows[0], *((100 + i, "exactly ten sites", f"s{i}", 1, "x", "y", None) for i in range(10)), *((200 + i, "only nine sites", f"s{i}", 1, "x", "y", None) for i in range(9))]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, gone string, stay string, rest int")
    out = line_dedup.remove_boilerplate(d)
    assert out.columns == [*d.columns, "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["row"] == 1 and r["gone"] == "x" and r["stay"] == "y" and r["rest"] is None for r in got)
    assert all((r["text"], r["n_removed"]) == (f"own {r['doc_id']}", 6) for r in got if r["doc_id"] < 100)
    assert all(r["text"] == ("" if r["doc_id"] < 200 else "only nine sites") for r in got if r["doc_id"] >= 100)


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site name</a></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now. Very cheap, really.</div>
<div class="cookie-notice"><p>We use cookies. They are good.</p></div><article><h1>A &amp; B</h1><p><b>First  paragraph, with
 text.<br><p>Second &eacute;, one.<ul><li>Item one<li>Item two</ul></p><form><input value=x><button>Send</button></form><aside>Side story here.</aside></article>
<section id="comments"><p>First! A reader says, something.</p></section><footer>&copy; me</footer></body></html>"""


def test_html_extraction(spark):
    assert html_extract.extract(PAGE) == "A & B\nFirst paragraph, with text.\nSecond é, one.\nItem one\nItem two"
    plain = "<html><body><div class=menu><a>x</a></div><div id=c><p>Long text, with marks. And more of it, yes.</p><p>Another long text, with marks.</p></div><div class=footer>foot</div>"
    assert html_extract.extract(plain) == "Long text, with marks. And more of it, yes.\nAnother long text, with marks."
    odd = [None, "", "no tags at all", "<", "<script>x", "<!-- open", "<p>a<p", "<b>" * 3000 + "deep", "<div>" * 3000 + "deep"]
    pages = spark.createDataFrame([(i, None, h, 1) for i, h in enumerate([*odd, PAGE, PAGE])], "page_id long, url string, html string, text int")
    rows = {r["page_id"]: r for r in html_extract.main_text(pages).collect()}
    assert rows[0]["text"] == rows[1]["text"] == rows[4]["text"] == rows[5]["text"] == "" and rows[2]["text"] == "no tags at all"
    assert rows[9]["text"] == rows[10]["text"] and rows[9]["n_chars"] == len(rows[9]["text"])
    assert html_extract.main_text(pages.limit(0)).count() == 0


BODY = "".join(f"<p>Paragraph {i} of the text, long enough to be read. It says more, and then it ends.</p>" for i in range(6))


def test_html_names_only_weigh():
    for attrs in ("class='content has-sidebar'", "class=no-sidebar", 'class="overflow-hidden"', "style='overflow:hidden'", 'data-x="a class=menu hidden"', "id=comments"):
        got = html_extract.extract(f"<body><div {attrs}>{BODY}</div><footer>foot</footer></body>")
        assert got.count("Paragraph") == 6 and "foot" not in got, attrs
    work = "<p class=related-work>Others did the same, years before. They had less data, though.</p>"
    assert "Others did" in html_extract.extract(f"<article>{BODY}{work}</article>")
    inside = html_extract.extract(f"<div class='wrap sidebar'><article><h1>Head</h1>{BODY}</article></div>")
    assert inside.startswith("Head") and inside.count("Paragraph") == 6
    talk = "".join("<p>A reader says this, and that. Then more, of course.</p>" for _ in range(60))
    assert "reader" not in html_extract.extract(f"<article>{BODY}</article><section class=comments>{talk}</section>")
    assert "no" == html_extract.extract("<p>no</p><div hidden>gone</div>")


def test_html_compound_names_mean_their_last_word():
    talk = "<p>I think, as a reader, that this is quite wrong. It should say more, and better.</p>"
    gone = "reader-comments user-comments comment-thread google-ad ad-slot sticky-ads related-posts subscribe-prompt cookie-policy cookie-message copyright-footer"
    for name in gone.split():
        for page in (f"<article>{BODY}<div class='{name}'>{talk}</div></article>", f"<div>{BODY}<div class='{name}'>{talk}</div></div>", f"<article>{BODY}</article><div class='{name}'>{talk}</div>"):
            assert "reader" not in html_extract.extract(page), (name, page)
    for name in ("side-effects", "advert-law", "comment-of-the-editor"):
        for page in (f"<article>{BODY}<div class='{name}'>{talk}</div></article>", f"<div>{BODY}<div class='{name}'>{talk}</div></div>"):
            assert "reader" in html_extract.extract(page), (name, page)
    for style in ("display:none", "color: red; DISPLAY : none;", "visibility:hidden"):
        assert "reader" not in html_extract.extract(f'<article>{BODY}<div style="{style}">{talk}</div></article>')
    assert "reader" in html_extract.extract(f'<article>{BODY}<div style="display:block">{talk}</div></article>')


def test_html_returns_all_that_is_selected():
    teaser = "<article><p>A teaser of the next story, with marks. It goes on, and on, and on, for a while. It is long, too, and has more, as teasers do.</p></article>"
    got = html_extract.extract(f"<body><div id=lead><p>The lead of the story, with marks. It says what follows, in short.</p></div><div id=c>{BODY}</div>{teaser * 3}</body>")
    assert got.count("Paragraph") == 6 and "The lead" in got


def test_html_words_of_names_and_odd_markup():
    for attrs in ('class="side-effects"', 'id="comment-on-budget"', 'id="search-algorithms"', 'class="social-history"', 'id="related-work"', 'class="menu-of-the-day"'):
        part = f"<div {attrs}><h2>Sub</h2><p>Inner words, here.</p><ul><li>x</ul></div>{BODY}<p {attrs}>Short.</p>"
        got = html_extract.extract(f"<article><h1>T</h1>{BODY}{part}</article>").split("\n")
        assert len(got) == 17 and {"Sub", "Inner words, here.", "x", "Short."} <= set(got), attrs
    cases = {
        '<p title="x < y">Text.</p>': "Text.",
        "<p data-x=it's>Text.</p>": "Text.",
        '<p title="a>b" class=\'c>d\'>Text.</p>': "Text.",
        "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math>, then.</p>": "So x=2, then.",
        "<xmp><b>raw & kept</b></xmp>": "<b>raw & kept</b>",
        "<script>a</scripty></script foo><p>Text.</p>": "Text.",
        "<p>a<!-->b<!-- c --!>d.</p>": "abd.",
        "<p>1 &lt; 2 &amp;amp; &#x41;.</p>": "1 < 2 &amp; A.",
    }
    for page, text in cases.items():
        assert html_extract.extract(page) == text, page
    links = '<h3>Read more</h3><ul><li>Link list</li><li><a href="/x">Other thing</a></li></ul>'
    for page in (f"<div>{BODY}{links}</div>", f"<article>{BODY}<ul><li><a href=/y>Another, thing.</a></li></ul></article>"):
        assert html_extract.extract(page).count("\n") == 5
    assert html_extract.extract(f"<form>{BODY}</form>").count("\n") == 5


def test_html_path_scores_equal_brute_force():
    rng = random.Random(8)
    for _ in range(20):
        page = "".join(rng.choice(["<div class=a>", "<div>", "</div>", "<p>", "<ul><li>", "</ul>", "<h2>", "</h2>", "Some words, and more. ", "short ", "<a href=x>A link. </a>", "<p class=menu>"]) for _ in range(80))
        _, blocks = html_extract.parse(page)
        weights = [b.node.weight for b in blocks]
        got = html_extract.path_scores(blocks, weights)

        def path(n):
            return (*path(n.parent), n.path) if n.parent else (n.path,)

        paths = [path(b.node) for b in blocks]
        ratio = []
        for p in paths:
            mine = [b for q, b in zip(paths, blocks) if q == p]
            marks = sum(len(re.findall("[.,;:!?]", b.text)) for b in mine if b.linked < b.size)
            ratio.append((sum(b.size - b.linked for b in mine) / len(mine), (marks + 0.1) / len(mine)))
        for i, b in enumerate(blocks):
            total, of = 0.0, [j for j, p in enumerate(paths) if p == paths[i]]
            for j in of:
                near = [(np.exp(-((j - k) ** 2) / 2), *ratio[k]) for k in range(len(blocks)) if abs(j - k) <= html_extract.REACH]
                mass = sum(x[0] for x in near)
                total += np.sqrt(sum(x[0] * x[1] for x in near) / mass * sum(x[0] * x[2] for x in near) / mass) * weights[j]
            assert got[b.node.path] == pytest.approx(total / len(of))


def test_html_time_is_linear():
    n = 50_000
    for page in ("<div>" * n + "deep", "<center>" * n + "<ul>" + "<li>a" * n, "<article>" * n + "x, y.", "<article><p>a, b.</p></article>" * n, '<p a="' * n, "<!--" * n):
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 10


def test_language_evidence(spark):
    rng = random.Random(6)
    vocab = {"en": "the of and with this that from have were which".split(), "de": "der die und mit nicht auch werden eine sich über".split(), "fr": "le les des est dans pour avec une être où".split()}
    docs = [(i, " ".join(rng.choice(vocab[x]) for _ in range(60)), x, "s", 1) for i, x in enumerate(["en", "de", "fr"] * 30)]
    d = spark.createDataFrame(docs, DOCS)
    pages = [(0, "https://a.example/de/x", '<html lang="de"><p>der die und mit</p>'), (1, "https://b.example.fr/", None), (2, None, ""), (3, "https://a.example/de/y", "<p></p>")]
    pages += [(10 + i, f"https://h{i % 2}.example/{x}/p", f'<html lang="{x}"><p>{t}</p>') for i, (_, t, x, *_) in enumerate(docs)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = language_id.identify(p, d, d).collect()
    by_doc, by_page = {r["doc_id"]: r for r in rows if r["kind"] == "document"}, {r["page_id"]: r for r in rows if r["kind"] == "page"}
    assert all(by_doc[i]["lang"] == x for i, _, x, *_ in docs)
    assert by_page[0]["lang"] == "de" and by_page[3]["lang"] == "de" and by_page[2]["lang"] in vocab and 0 < by_page[2]["prob"] < 0.6
    none = language_id.identify(p, d, d.limit(0)).collect()
    assert {r["lang"] for r in none} == {"und"}
    assert language_id.identify(p.limit(0), d.limit(0), d).count() == 0


def test_language_fusion_equals_brute_force(spark):
    """Text scores are the model's; priors, likelihoods and their fusion are worked out anew from the rows."""
    rng = random.Random(16)
    vocab = {"en": "the of and with this that from".split(), "de": "der die und mit nicht auch".split(), "fr": "le les des est dans pour".split()}
    prose_in = lambda x, n: " ".join(rng.choice(vocab[x]) for _ in range(n))
    docs = [(i, None if i == 7 else prose_in(x, 30), x, [None, "s1", "s2"][i % 3], 1) for i, x in enumerate(["en", "de", "fr"] * 8)]
    d = spark.createDataFrame([*docs, docs[0], docs[0]], DOCS)
    hosts = ["a.one.co.uk", "b.one.co.uk", "www.two.co.uk", "x.three.de", "y.three.de", None]
    pages = []
    for i in range(40):
        x, h = rng.choice(list(vocab)), hosts[i % 6]
        lang = rng.choice(["", f' lang="{x}"', ' lang="zz"'])
        body = prose_in(x, rng.choice([0, 1, 12]))
        pages.append((i, None if h is None else f"http://{h}/{rng.choice(['', 'de/', 'en-us/x', 'page/'])}", f"<html{lang}><p>{body}</p></html>" if i % 9 else None, i, "k"))
    p = spark.createDataFrame([*pages, pages[1]], "page_id long, url string, html string, score int, lang string")
    langs, logp = language_id.train(d)
    rows = []
    for page, url, html, *_ in [*pages, pages[1]]:
        host = re.match(r"http://([^/]+)", url)[1] if url else None
        seg = re.match(r"http://[^/]+/([a-z]{2})(?:-[a-z]{2})?(?:/|$)", url or "")
        labels = host.split(".") if host else []
        domain = ".".join(labels[-3:] if labels[-2:] == ["co", "uk"] else labels[-2:]) if host else None
        tag = re.match(r'<html lang="(\w+)"', html or "")
        text = re.sub("<[^>]*>", " ", html) if html else None
        rows.append((("page", page), host, domain, tag and tag[1], seg[1] if seg else language_id.SUFFIX_LANG.get(labels[-1]) if host else None, text))
    rows += [(("document", i), s and f"source:{s}", "source:", None, None, t) for i, t, _, s, _ in [*docs, docs[0], docs[0]]]

    def loglik(t):
        b = np.frombuffer((t or "").encode(), np.uint8)
        return logp[language_id._classes(b)].sum(0, dtype=float) if len(b) > 2 else np.zeros(len(langs))

    scored = [(*r[:5], loglik(r[5])) for r in rows]
    best = [langs[int(v.argmax())] if v.any() else None for *_, v in scored]
    every = np.array([best.count(x) for x in langs], float)
    k = language_id.STRENGTH
    top = (every + k / len(langs)) / (every.sum() + k)

    def tally(col, value):
        return np.array([sum(b == x for r, b in zip(scored, best) if r[col] == value) for x in langs], float)

    want = {}
    for key, host, domain, declared, address, v in scored:
        prior = top
        if host is not None:
            n = tally(2, domain)
            up = (n + k * top) / (n.sum() + k)
            n = tally(1, host)
            prior = (n + k * up) / (n.sum() + k)
        score = v * language_id.TEMPER + np.log(prior)
        for col, value in ((3, declared), (4, address)):
            if value is not None and tally(col, value).sum():
                score = score + np.log((tally(col, value) + 0.5) / (every + 0.5 * len(langs)))
        want[key] = (langs[int(score.argmax())], 1 / np.exp(score - score.max()).sum())
    got = language_id.identify(p, d, d).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, prob = want[r["kind"], r["page_id"] if r["kind"] == "page" else r["doc_id"]]
        assert r["lang"] == lang and abs(r["prob"] - prob) < 1e-6


def test_language_beyond_a_prefix_and_many_languages(spark):
    codes = [f"{a}{b}" for a in "abcdefghz" for b in "abcdefghi"] + ["zzh"]
    d = spark.createDataFrame([(i, " ".join(f"{x}{x}{k}q{x}" for k in "abcdefgh") * 3, x, "s", 1) for i, x in enumerate(codes * 2)], DOCS)
    long = "<!-- " + "<html lang=xx> " * 600 + "-->"
    p = spark.createDataFrame([(0, None, f'{long}<script>var a = "<html lang=yy>";</script><html class=a lang="zzh"><p></p>')], "page_id long, url string, html string")
    rows = language_id.identify(p, d, d).collect()
    assert len(codes) > 64 and {r["doc_id"]: r["lang"] for r in rows if r["kind"] == "document"} == dict(enumerate(codes * 2))
    assert [r["declared"] for r in rows if r["kind"] == "page"] == ["zzh"]


def test_header_search_is_linear():
    for lines in (8_000, 80_000):
        data = b"WARC/1.0\r\n" * lines + b"\r\n"
        began = time.time()
        assert [type(x).__name__ for x in warc.salvage(data)] == ["Gap"]
        assert time.time() - began < 5
