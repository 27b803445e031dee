import datetime as dt
import random
import re

from pyspark.sql import functions as F

from ragloom.operators import access, admission, chunking, containers, history, index, lifecycle, retrieval, trees, usage
from ragloom.params import ContainerLimits, Retrieval, UsageLimits
from ragloom.sources import sinks
from ragloom.streaming import streams


def test_rrf_ties_keep_lexical_order(spark):
    lex = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query_id int, chunk_uid string, rank int")
    vec = spark.createDataFrame([(1, "c", 0), (1, "b", 1)], "query_id int, chunk_uid string, rank int")
    got = [r["chunk_uid"] for r in retrieval.rrf_fuse(lex, vec).orderBy("rank").collect()]
    assert got == ["b", "a", "c"]


def test_context_stops_at_the_first_line_that_does_not_fit(spark):
    rows = [(1, 0, "f", 1, "text", 0.5, "x" * 1900), (1, 1, "f", None, "text", 0.0625, "y" * 1900), (1, 2, "f", 1, "text", 0.1, "z"), (2, 0, "f", 1, "text", 1.0, "w" * 2000)]
    df = spark.createDataFrame(rows, "query_id int, rank int, file_name string, page_number int, source_type string, score double, content string")
    got = {r["query_id"]: r for r in retrieval.pack_context(df, 100).collect()}
    assert got[1]["n_chunks"] == 1 and got[1]["context"].startswith("[doc:f page:1 source:text score:0.500] xxx")
    assert got[2]["context"] == retrieval.NO_CONTEXT


def test_hybrid_falls_back(spark):
    q = spark.createDataFrame([(1, "zz", ["zz"], None), (2, "  ", None, None), (3, "cats", ["cats"], [1.0, 0.0])], "query_id int, query_text string, keywords array<string>, query_vector array<float>")
    ix = spark.createDataFrame([("u", "a zzz b", ["other"], [1.0, 0.0]), ("v", "dogs and cats", ["cats"], [0.0, 1.0])], "chunk_uid string, text string, keywords array<string>, embedding array<float>")
    got = {(r["query_id"], r["chunk_uid"]): r["score"] for r in retrieval.hybrid_retrieve(q, ix, Retrieval()).collect()}
    assert got[(1, "u")] == 1.25 and not any(k[0] == 2 for k in got) and {k[1] for k in got if k[0] == 3} == {"u", "v"}


def test_quotas_block_counts_at_and_storage_above(spark):
    g = 1024**3
    rows = [("user", 1, "tenants", 1), ("workspace", 1, "documents", 199), ("workspace", 2, "documents", 200), ("workspace", 1, "storage_bytes", 2 * g - 1), ("workspace", 2, "storage_bytes", 2 * g), ("project", 1, "temporary_hours", 720), ("project", 2, "temporary_hours", 1440)]
    df = spark.createDataFrame(rows, "scope string, key long, metric string, used long")
    got = [r["blocked"] for r in usage.quota_report(df, UsageLimits(), 1).collect()]
    assert got == [True, False, True, False, True, False, True]
    assert not any(r["blocked"] for r in usage.quota_report(df, UsageLimits(*[None] * 9), 1).collect())


def _entries(spark, rows):
    return spark.createDataFrame(
        [(1, 1, 1, "", 0, i, p, s, e, 0, 0, []) for i, (p, s, e) in enumerate(rows)],
        "root_id long, container_id long, container_order long, container_path string, container_level int, ordinal long, path string, size_bytes long, is_encrypted boolean, root_files long, root_bytes long, stored_paths array<string>",
    )


def test_container_admission(spark):
    got = {r["ordinal"]: r for r in containers.admit_container_entries(_entries(spark, [("malware.exe", 2, False), ("docs/readme.txt", 5, False), ("DOCS/README.txt", 5, False), ("x.zip", 5, True)])).collect()}
    assert (got[0]["state"], got[0]["extraction_state"]) == (index.COMPLETED, index.UNSUPPORTED)
    assert (got[1]["state"], got[1]["file_name"], got[1]["nesting_level"], got[1]["content_type"]) == (index.QUEUED, "readme.txt", 1, "text/plain")
    assert got[2]["container_path"] == "DOCS/README (2).txt"
    assert got[3]["state"] == index.REJECTED and got[3]["has_warnings"]


def test_container_limits_stop(spark):
    lim = ContainerLimits(max_files=2)
    assert containers.admit_container_entries(_entries(spark, [("a.txt", 1, False)] * 4), lim).count() == 2
    big = ContainerLimits(max_total_bytes=25 * 1024**2)
    rows = [("a.txt", 20 * 1024**2, False), ("b.txt", 6 * 1024**2, False), ("c.txt", 1, False)]
    assert [r["container_path"] for r in containers.admit_container_entries(_entries(spark, rows), big).collect()] == ["a.txt"]


def test_container_admission_equals_a_literal_fold(spark):
    rng, mb = random.Random(9), 1024**2
    rows = []
    for root in range(6):
        for c in range(3):
            stored = rng.sample(["a.txt", "B.zip", "sub/c.eml"], rng.randrange(3))
            for i in range(25):
                path = rng.choice(["a.txt", "A.TXT", "b.zip", "c.eml", "d/e.exe", "\\d\\e.exe", " ", None, "x.pdf"])
                rows.append((root, 10 * root + c, c, rng.choice(["", "sub"]) if c == 1 else "", rng.randrange(4), i, path, rng.choice([1, 5 * mb, 12 * mb, 101 * mb]), rng.random() < 0.1, 3, 2 * mb, stored))
    types = "root_id long, container_id long, container_order long, container_path string, container_level int, ordinal long, path string, size_bytes long, is_encrypted boolean, root_files long, root_bytes long, stored_paths array<string>"
    limits = ContainerLimits(max_files=20, max_total_bytes=90 * mb)
    df = spark.createDataFrame(rows, types)
    got = sorted((r["root_id"], r["container_id"], r["ordinal"], r["container_path"], r["size_bytes"], r["state"], r["has_warnings"]) for r in containers.admit_container_entries(df, limits).collect())
    want = []
    for root in range(6):
        files, total, warn, out, names, stopped = 3, 2 * mb, False, [], {}, set()
        for _, c, _, folder, level, i, path, size, locked, _, _, stored in sorted((r for r in rows if r[0] == root), key=lambda r: (r[2], r[5])):
            path = (path or "").replace("\\", "/").strip().lstrip("/")
            if c in stopped:
                continue
            if files >= 20 or total >= 90 * mb:  # tested before the entry is looked at
                stopped.add(c)
                warn = True
                continue
            if not path:
                continue
            path = f"{folder}/{path}" if folder else path
            if path.lower() in {x.lower() for x in stored}:
                continue
            taken = names.setdefault(c, {x.lower() for x in stored})
            blocked = level + 1 > 3 or locked or size > 100 * mb
            if not blocked and size > 90 * mb - total:
                warn = True
                stopped.add(c)
                continue
            stem, dot, ext = path.rpartition(".")
            n, q = 1, path
            while q.lower() in taken:
                n += 1
                q = f"{stem} ({n}){dot}{ext}"
            taken.add(q.lower())
            files += 1
            warn |= blocked
            total += 0 if blocked else size
            state = index.REJECTED if blocked else index.COMPLETED if q.lower().endswith(".exe") else index.QUEUED
            out.append((root, c, i, q, 0 if blocked else size, state))
        want += [(*o, warn) for o in out]
    assert got == sorted(want)


def test_unique_paths_equal_a_literal_fold(spark):
    rng = random.Random(4)
    names = ["a.txt", "A.TXT", "a (2).txt", "a (2) (2).txt", "a", "a.", "A (3)", "b/a.txt", "B\\a.txt", "/b/a (2).txt", " ", None, ".x", "a (2)"]
    dotted = ["a.b (2)", "a.b.", "a.b", "a (2).b", "a (2).b.", "a..", "a. (2)", "a (2)..", "...", " (2)", "x. (2).b (3)"]
    rows = [(c, i, rng.choice(names if c < 4 else dotted)) for c in range(8) for i in range(40)]
    rows += [(8, i, p) for i, p in enumerate(["a.b (2)", "a.b.", "a.b."])]
    got = {(r["container_id"], r["ordinal"]): r["unique_path"] for r in containers.unique_paths(spark.createDataFrame(rows, "container_id long, ordinal long, path string")).collect()}
    want, known = {}, {c: set() for c in range(9)}
    for c, i, p in rows:
        p = (p or "").replace("\\", "/").strip().lstrip("/")
        if not p:
            continue
        folder, name = p.rsplit("/", 1) if "/" in p else ("", p)
        base, dot, ext = name.rpartition(".")
        base, ext = (base, dot + ext if ext else "") if dot else (name, "")
        q, n = p, 1
        while q.lower() in known[c]:
            n += 1
            q = f"{folder}/{base} ({n}){ext}" if folder else f"{base} ({n}){ext}"
        known[c].add(q.lower())
        want[c, i] = q
    assert got == want
    assert [got[8, i] for i in range(3)] == ["a.b (2)", "a.b.", "a.b (3)"]
    assert len({(c, q.lower()) for (c, _), q in got.items()}) == len(got)


def one_container(spark, paths, stored, limit):
    types = "root_id long, container_id long, container_order long, container_path string, container_level int, ordinal long, path string, size_bytes long, is_encrypted boolean, root_files long, root_bytes long, stored_paths array<string>"
    rows = [(1, 1, 1, "", 0, i, p, 1, False, 0, 0, stored) for i, p in enumerate(paths)]
    return [(r["container_path"], r["has_warnings"]) for r in containers.admit_container_entries(spark.createDataFrame(rows, types), ContainerLimits(max_files=limit)).collect()]


def test_skipped_entries_hide_no_later_one_and_warn_past_the_limit(spark):
    for n in (30, 60):
        assert one_container(spark, ["a.txt"] * n + ["b.txt"], ["a.txt"], 40) == [("b.txt", False)]
    assert one_container(spark, ["a.txt", " "], [], 1) == [("a.txt", True)]
    assert one_container(spark, ["a.txt", "old.txt"], ["old.txt"], 1) == [("a.txt", True)]
    assert one_container(spark, [" ", "a.txt"], [], 1) == [("a.txt", False)]


def test_upload_outcomes(spark):
    m = spark.createDataFrame([(1, "a.txt", "text/plain", 5, bytearray(b"hello")), (2, "a.exe", "", 5, bytearray(b"MZ")), (3, "a.zip", "application/zip", 4, bytearray(b"PK\x03\x04")), (4, "m.msg", None, 8, bytearray(bytes.fromhex("D0CF11E0A1B11AE1")))], "document_id long, file_name string, content_type string, size_bytes long, header binary")
    scans = spark.createDataFrame([(1, "infected"), (3, "clean"), (4, "clean")], "document_id long, verdict string")
    out = {r["document_id"]: r for r in admission.upload_outcomes(admission.upload_gate(m), scans).collect()}
    assert [out[i]["state"] for i in (1, 2, 3, 4)] == [index.QUARANTINED, index.REJECTED, index.QUEUED, index.QUEUED]
    assert [out[i]["container"] for i in (3, 4)] == ["archive", "email"]
    off = {r["document_id"]: r for r in admission.upload_outcomes(admission.upload_gate(m), scans, quarantine=False).collect()}
    assert off[1]["state"] == index.REJECTED and not off[1]["is_stored"]


def test_prompts(spark):
    p = spark.createDataFrame([(1, 1, 0, "a", True, 1, 1), (2, 1, 0, "b", False, 4, 1), (3, 1, 0, "c", False, 3, 1), (4, 1, 0, "d", False, 2, 1)], "prompt_id long, project_id long, prompt_type int, content string, is_favorite boolean, last_used_at long, created_at long")
    kept, gone = history.prune_prompts(p, {0: 2})
    assert sorted(r["prompt_id"] for r in kept.collect()) == [1, 2, 3] and [r["prompt_id"] for r in gone.collect()] == [4]
    u = spark.createDataFrame([(1, 0, " b\n", 9), (1, 0, "  ", 9), (1, 0, "new", 9)], "project_id long, prompt_type int, content string, used_at long")
    merged = {r["content"]: r for r in history.merge_prompt_usage(p, u).collect()}
    assert len(merged) == 5 and merged["b"]["last_used_at"] == 9 and merged["b"]["created_at"] == 1


def test_lifetime_event_at_expiry_does_not_extend(spark):
    t = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    p = spark.createDataFrame([(1, t, 2), (2, t, 2), (3, t, None)], "project_id long, created_at timestamp, hours int")
    a = spark.createDataFrame([(1, t + 2 * h), (1, t + 3 * h), (2, t + h), (2, t + 2.5 * h), (2, t + 9 * h)], "project_id long, ts timestamp")
    got = {r["project_id"]: r["lifetime_expires_at"] for r in lifecycle.project_lifetimes(p, a).collect()}
    assert got == {1: t + 2 * h, 2: t + 4.5 * h}


def test_lifetime_sessions_have_the_same_boundary(spark):
    t, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    a = spark.createDataFrame([(1, t, 2), (1, t + h, 2), (1, t + 3 * h, 2), (2, t, 1)], "project_id long, ts timestamp, hours int")
    got = {(r["project_id"], r["session_start"]): (r["session_end"], r["events"]) for r in streams.lifetime_sessions(a).collect()}
    assert got == {(1, t): (t + 3 * h, 2), (1, t + 3 * h): (t + 5 * h, 1), (2, t): (t + h, 1)}


def test_revoke_closure_ends_on_cycles(spark):
    g = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 4), (2, 5, 1)], "tenant_id long, user_id long, granted_by long")
    s = spark.createDataFrame([(1, 1)], "tenant_id long, user_id long")
    assert sorted(r["user_id"] for r in trees.revoke_closure(g, s).collect()) == [1, 2, 3]


def test_revoke_closure_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    cut = trees._cut
    monkeypatch.setattr(trees, "_cut", lambda df: rounds.append(1) or cut(df))
    chain = [(1, i, i - 1 if i else None) for i in range(2000)] + [(2, i, i - 1 if i else None) for i in range(50)]
    g = spark.createDataFrame(chain, "tenant_id long, user_id long, granted_by long")
    s = spark.createDataFrame([(1, 3), (2, 40), (3, 7)], "tenant_id long, user_id long")
    got = {tuple(r) for r in trees.revoke_closure(g, s).collect()}
    assert got == {(1, i) for i in range(3, 2000)} | {(2, i) for i in range(40, 50)} | {(3, 7)} and len(rounds) <= 13


def test_revoke_closure_with_several_granters(spark):
    rng = random.Random(6)
    g = [(t, rng.randrange(40), rng.randrange(40)) for t in range(2) for _ in range(60)]
    start = [(0, 1), (0, 2), (1, 5)]
    want = set(start)
    while more := {(t, u) for t, u, by in g if (t, by) in want} - want:
        want |= more
    got = trees.revoke_closure(spark.createDataFrame(g, "tenant_id long, user_id long, granted_by long"), spark.createDataFrame(start, "tenant_id long, user_id long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_tree_order(spark):
    t = spark.createDataFrame([(1, 1, None, "b"), (1, 2, 1, "z"), (1, 3, None, "a"), (1, 4, 1, "y"), (1, 5, 4, "x"), (1, 6, 99, "c")], "project_id long, document_id long, parent_id long, file_name string")
    assert [r["document_id"] for r in trees.tree_order(t).orderBy("project_id", "path").collect()] == [3, 1, 4, 5, 2, 6]
    sub = trees.descendants(t, t.where("document_id = 1").select("document_id"))
    assert {(r["document_id"], r["depth"]) for r in sub.collect()} == {(1, 0), (2, 1), (4, 1), (5, 2)}


def test_replace_and_upsert(spark):
    old = spark.createDataFrame([("d", 0, 1), ("e", 0, 1)], "document_id string, chunk_index int, version int")
    new = spark.createDataFrame([("d", 0, 2)], "document_id string, chunk_index int, version int")
    assert {tuple(r) for r in sinks.replace_chunks(old, new).collect()} == {("e", 0, 1), ("d", 0, 2)}
    ix = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "chunk_uid string, v int, updated_at int")
    up = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 1)], "chunk_uid string, v int, updated_at int")
    assert {tuple(r) for r in sinks.upsert_index(ix, up).collect()} == {("b", 1, 0), ("a", 3, 2), ("c", 4, 1)}


def test_vector_counts_fail_a_document(spark):
    c = spark.createDataFrame([("a:0", "a"), ("a:1", "a"), ("b:0", "b")], "chunk_uid string, document_id string")
    v = spark.createDataFrame([("a:0", [1.0]), ("b:0", [1.0])], "chunk_uid string, embedding array<float>")
    good, failed = chunking.attach_vectors(c, v)
    assert [r["document_id"] for r in good.collect()] == ["b"] and [r["document_id"] for r in failed.collect()] == ["a"]


def test_accessible_tenants(spark):
    u = spark.createDataFrame([(1, True), (2, False), (3, False)], "user_id long, is_admin boolean")
    m = spark.createDataFrame([(2, 10)], "user_id long, tenant_id long")
    t = spark.createDataFrame([(10, False), (11, True)], "tenant_id long, is_visible_to_all boolean")
    assert {tuple(r) for r in access.accessible_tenants(u, m, t).collect()} == {(1, 10), (1, 11), (2, 10), (3, 11)}


def test_streams_equal_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "parse", "failed" if i % 3 else "completed", t + dt.timedelta(minutes=7 * i)) for i in range(30)]
    jobs = spark.createDataFrame(rows, "document_id long, job_type string, result string, ts timestamp")
    jobs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in"))
    q = streams.job_outcome_stream(stream).writeStream.outputMode("complete").format("memory").queryName("outcomes").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = streams.job_outcome_stream(jobs)
    assert {tuple(r) for r in spark.table("outcomes").collect()} == {tuple(r) for r in batch.collect()}
    q = streams.idempotent_stream(stream.withColumn("k", F.col("document_id") % 4), "k").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 4


def test_ingest_stream_and_router(spark, tmp_path):
    docs = spark.createDataFrame([(1, 0, 1, 1), (2, index.REJECTED, 1, 1), (3, 0, 1, 1)], "document_id long, state int, version int, index_version int")
    ledger = docs.where("document_id = 3")
    queue = spark.createDataFrame([(1,), (1,), (2,), (3,)], "document_id long")
    work, jobs = streams.ingest_batch(queue, docs, ledger)  # the stream form: test_stateful
    assert [r["document_id"] for r in work.collect()] == [1]
    assert {(r["document_id"], r["result"]) for r in jobs.collect()} == {(1, "completed"), (2, "skipped_security"), (3, "completed")}
    f = spark.createDataFrame([(1, 0), (2, 3), (None, 0)], "document_id long, retry int")
    assert [r["route"] for r in streams.retry_route(f).collect()] == ["retry", "dead_letter", "drop"]


def test_chat(spark):
    m = spark.createDataFrame([(i, 1, "user" if i % 2 else "system", f"m{i}", dt.datetime(2024, 1, 1, 0, i), dt.datetime(2024, 1, 1)) for i in range(5)], "message_id long, project_id long, role string, content string, message_timestamp timestamp, created_at timestamp")
    assert [r["message_id"] for r in history.recent_chat(m, 2).orderBy("no").collect()] == [3, 4]
    kept, gone = history.prune_chat(m, 2)
    assert kept.count() == 2 and gone.count() == 3 and history.prune_chat(m, 0)[0].count() == 5
    assert chunking.transcript(m).first()["transcript"].split("\n")[1] == "[User - 2024-01-01 00:01]: m1"
