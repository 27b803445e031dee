import datetime as dt

import pytest
from pyspark.sql import functions as F

from ragloom.operators import lifecycle
from ragloom.shared import fresh_path
from ragloom.streaming import stateful, streams


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_ledger_across_batches_failures_and_restarts(spark):
    docs = spark.createDataFrame(
        [(1, 1, 1, 1, "one two three"), (2, 1, 1, 5, "held back"), (3, 1, 1, 6, "no"), (4, 1, 1, 1, None), (5, 1, 1, 1, "no vector"), (6, 2, 1, 1, "six")],
        "document_id long, version int, index_version int, state int, text string",
    )
    vectors = spark.createDataFrame([("1:1:0", [1.0, 2.0]), ("6:1:0", [1.0, 0.0])], "chunk_uid string, embedding array<float>")
    queue, out, checkpoint = fresh_path(spark, "queue"), fresh_path(spark, "out"), fresh_path(spark, "checkpoint")
    schema = "document_id long, release boolean"
    known = {}

    def go(have):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(queue)
        run(stateful.ingest_stream(stream, docs, lambda w: stateful.ingest_documents(w, have), out, checkpoint, f"{queue}/released"))
        rows = [tuple(r) for r in spark.read.parquet(f"{out}/jobs").select("batch", "document_id", "result", "error", "state").collect()]
        fresh = sorted(r[1:] for r in rows if r[0] not in known)
        known.update({r[0]: 1 for r in rows})
        return fresh

    write(spark, [(i, False) for i in (1, 2, 3, 4, 5, 99)], schema, queue)
    assert go(vectors) == [
        (1, "completed", None, 3), (2, "skipped_security", "state bars it", 4), (3, "skipped_security", "state bars it", 4),
        (4, "failed", "no text", 4), (5, "failed", "chunks without a vector", 4), (99, "not_found", "document not found", 4),
    ]
    assert [r["chunk_uid"] for r in spark.read.parquet(f"{out}/chunks").collect()] == ["1:1:0"]
    # a second run goes on from the state: 1 is in the ledger, 5 was released and is tried again, now with its vector
    write(spark, [(1, False), (6, False), (6, False), (5, False)], schema, queue)
    more = vectors.unionByName(spark.createDataFrame([("5:1:0", [3.0, 1.0])], vectors.schema))
    got = [r[:2] for r in go(more)]
    assert sorted(got) == [(1, "already_ingested"), (5, "completed"), (6, "already_ingested"), (6, "completed")]
    assert sorted(r["chunk_uid"] for r in spark.read.parquet(f"{out}/chunks").collect()) == ["1:1:0", "5:1:0", "6:1:0"]


def test_lifetimes_fire_timers_and_take_late_events(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    projects = spark.createDataFrame([(1, t0, 10), (2, t0, 10), (3, t0, None), (4, t0, 2)], "project_id long, created_at timestamp, hours int")
    # 1: the event of hour 15 comes before that of hour 8, which makes it count; 2: an event exactly at the end; 4: ends at once
    batches = [[(1, at(0)), (2, at(0)), (3, at(0)), (4, at(0))], [(1, at(15)), (2, at(10))], [(1, at(8)), (4, at(5))], [(9, at(60))], [(9, at(61))]]
    source, out, checkpoint = fresh_path(spark, "activity"), fresh_path(spark, "expired"), fresh_path(spark, "checkpoint")
    schema = "project_id long, ts timestamp"
    for b in batches:
        write(spark, b, schema, source)
        stream = spark.readStream.schema(schema).parquet(source)
        run(stateful.sweep_stream(stateful.expiry_stream(stream, projects, "20 hours"), lambda p: {"projects": p}, out, checkpoint))
    got = {r["project_id"]: r["expires_at"] for r in spark.read.parquet(f"{out}/expired").collect()}
    events = spark.createDataFrame([x for b in batches for x in b], schema)
    want = {r["project_id"]: r["us"] for r in lifecycle.project_lifetimes(projects, events).select("project_id", F.unix_micros("lifetime_expires_at").alias("us")).collect()}
    assert got == want and set(got) == {1, 2, 4}
    assert sorted(r["project_id"] for r in spark.read.parquet(f"{out}/projects").collect()) == [1, 2, 4]


def test_a_key_of_before_is_skipped_after_a_restart(spark):
    """Idempotence on the RocksDB store survives the end of the query."""
    stateful.rocksdb(spark)
    source, out = fresh_path(spark, "keys"), fresh_path(spark, "seen")
    schema = "ts timestamp, job_key string"
    day = dt.datetime(2024, 1, 1)
    for batch in ([(day, "a"), (day, "b"), (day, "a")], [(day, "a"), (day + dt.timedelta(days=2), "c")], [(day + dt.timedelta(days=3), "b"), (day, "d")]):
        write(spark, batch, schema, source)
        rows = streams.idempotent_stream(spark.readStream.schema(schema).parquet(source), "job_key").select("job_key")
        run(rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state"))
    assert sorted(r["job_key"] for r in spark.read.parquet(f"{out}/rows").collect()) == ["a", "b", "c", "d"]
