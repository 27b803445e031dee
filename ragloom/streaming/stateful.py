"""Streams with state of their own: the ingest ledger, and project lifetimes with timers.

Both use arbitrary state on the RocksDB state store with changelog checkpoints (``rocksdb``), so a
restarted query goes on from its state, and a batch that is run again after a failure starts
from the state before it and overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators import chunking, keywords
from ..operators.index import COMPLETED, EXTRACTED, EXTRACTION_FAILED, FAILED, QUARANTINED, REJECTED
from ..shared import keep

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on lies on disk, and checkpoints hold its changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Ledger(StatefulProcessor):
    """By document: the versions that are ingested or being ingested."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "version int, index_version int", "taken boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a release in the same batch comes before what is queued again
        for r in sorted(rows, key=lambda r: not r.release):
            what = (r.version, r.index_version)
            if r.release:
                if r.version is not None and self.held.containsKey(what):
                    self.held.removeKey(what)
                continue
            if r.state is None:
                decision = "not_found"
            elif r.state in (QUARANTINED, REJECTED):
                decision = "skipped_security"
            elif self.held.containsKey(what):
                decision = "already_ingested"
            else:
                self.held.updateValue(what, (True,))
                decision = "work"
            yield Row(document_id=key[0], version=r.version, index_version=r.index_version, decision=decision)

    def close(self) -> None:
        pass


def decide(queue: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, version, index_version, decision of every queued row: work, already_ingested,
    skipped_security or not_found. queue: a stream of (document_id, release); a release tells that the
    ingest of that document failed and it may be queued again."""
    kind = dict(documents.dtypes)["document_id"]
    known = documents.select("document_id", F.col("version").cast("int"), F.col("index_version").cast("int"), F.col("state").cast("int"))
    rows = queue.select("document_id", F.coalesce("release", F.lit(False)).alias("release")).join(known, "document_id", "left")
    schema = f"document_id {kind}, version int, index_version int, decision string"
    return rows.groupBy("document_id").transformWithState(_Ledger(), schema, "append", "none")


def ingest_documents(work: DataFrame, vectors: DataFrame, size: int = 1400, overlap: int = 250) -> tuple[DataFrame, DataFrame]:
    """(chunks with keywords and vectors, failures) of documents (document_id, version, index_version, text).

    failures: (document_id, error) of documents without text, and of those whose chunks do not all have a vector
    (vectors: chunk_uid, embedding); none of their chunks is returned."""
    from ..functions.text import chunk_uid, is_blank

    blank = is_blank(F.coalesce("text", F.lit("")))
    chunks = chunking.chunk_single_pages(work.where(~blank).withColumn("page_number", F.lit(1)), size, overlap)
    chunks = chunks.select(chunk_uid(F.col("document_id"), F.col("index_version"), F.col("chunk_index")).alias("chunk_uid"), "document_id", "version", "index_version", "chunk_index", "content")
    # failures first, from ids alone: keywords are found for the chunks that stay only
    _, failed = chunking.attach_vectors(chunks.select("chunk_uid", "document_id"), vectors)
    errors = work.where(blank).select("document_id", F.lit("no text").alias("error")).unionByName(failed.select("document_id", F.lit("chunks without a vector").alias("error")))
    errors = keep(errors, "errors")
    good = keywords.with_keywords(chunks.join(errors.select("document_id"), "document_id", "left_anti"), "content")
    good = good.join(vectors.select("chunk_uid", "embedding"), "chunk_uid")
    return good.select("chunk_uid", "document_id", "version", "index_version", "chunk_index", "content", "keywords", "embedding"), errors


def ingest_stream(queue: DataFrame, documents: DataFrame, ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, releases: str | None = None) -> DataStreamWriter:
    """A stream of queued document ids to chunks and job rows below ``out``.

    The ledger's state decides; ``ingest`` takes the documents to work on and returns their chunks and the
    failures, so a bad document is a failed job and the rest go on. A document is completed when its chunks are written. With
    ``releases`` (a folder that the queue reads too) failures are told to the ledger. Batches write to folders of their own number."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            work = df.where("decision = 'work'").select("document_id", "version", "index_version").distinct()
            good, errors = ingest(work.join(documents.drop("version", "index_version"), "document_id"))
            good.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
            errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
            errors = df.sparkSession.read.schema(errors.schema).parquet(f"{out}/errors/batch={number}")
            jobs = df.join(errors, "document_id", "left")
            failed = (F.col("decision") == "work") & F.col("error").isNotNull()
            result = F.when(failed, "failed").when(F.col("decision") == "work", "completed").otherwise(F.col("decision"))
            ok = result.isin("completed", "already_ingested")
            missing = F.when(F.col("decision") == "not_found", "document not found").when(F.col("decision") == "skipped_security", "state bars it")
            jobs = jobs.select(
                "document_id", "version", "index_version", F.lit("parse").alias("job_type"), result.alias("result"), F.when(failed, F.col("error")).otherwise(missing).alias("error"),
                F.when(ok, COMPLETED).otherwise(FAILED).alias("state"),
                F.when(result == "completed", EXTRACTED).when(result == "failed", EXTRACTION_FAILED).alias("extraction_state"),
            )
            jobs.write.mode("overwrite").parquet(f"{out}/jobs/batch={number}")
            if releases:
                errors.select("document_id", F.lit(True).alias("release")).write.mode("overwrite").parquet(f"{releases}/batch={number}")
        finally:
            df.unpersist()

    rocksdb(queue.sparkSession)
    return decide(queue, documents).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


class _Lifetimes(StatefulProcessor):
    """By project: the expiry so far, and events at or after it that an event still to come may bring to life."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "expiry long, span long, over boolean")
        self.later = handle.getListState("later", "ts long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        if not self.life.exists():
            span = rows[0].hours * 3_600_000_000
            expiry, over = rows[0].created_us + span, False
        else:
            expiry, span, over = self.life.get()
        if over:
            return iter(())
        waiting = sorted([*(x[0] for x in self.later.get()), *(r.us for r in rows if r.us >= rows[0].created_us)])
        before, n = expiry, 0
        while n < len(waiting) and waiting[n] < expiry:
            expiry = max(expiry, waiting[n] + span)
            n += 1
        rest = waiting[n:]
        self.later.put([(x,) for x in rest]) if rest else self.later.clear()
        if not self.life.exists() or expiry != before:
            if self.life.exists():
                self.handle.deleteTimer(-(-before // 1000))
            self.handle.registerTimer(-(-expiry // 1000))
        self.life.update((expiry, span, False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expiry, span, over = self.life.get()
        if not over and -(-expiry // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.life.update((expiry, span, True))
            self.later.clear()
            yield Row(project_id=key[0], expires_at=expiry)

    def close(self) -> None:
        pass


def expiry_stream(activity: DataFrame, projects: DataFrame, delay: str = "1 hour") -> DataFrame:
    """project_id, expires_at (microseconds) of each project when the watermark has reached its expiry: from
    then on no event can move it. activity: a stream of (project_id, ts), which names a project's creation too;
    projects: (project_id, created_at, hours). Events that come later than ``delay`` are dropped; earlier ones
    count in the order of their times, however they arrive."""
    kind = dict(projects.dtypes)["project_id"]
    known = projects.where("hours is not null").select("project_id", F.unix_micros("created_at").alias("created_us"), F.col("hours").cast("long").alias("hours"))
    rows = activity.withWatermark("ts", delay).join(known, "project_id").select("project_id", "ts", F.unix_micros("ts").alias("us"), "created_us", "hours")
    rocksdb(projects.sparkSession)
    return rows.groupBy("project_id").transformWithState(_Lifetimes(), f"project_id {kind}, expires_at long", "append", "eventTime")


def sweep_stream(expired: DataFrame, plan: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str) -> DataStreamWriter:
    """A stream of expired projects into the clean-up: plan(projects of the batch) names tables of what goes,
    each written below ``out``."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            df.write.mode("overwrite").parquet(f"{out}/expired/batch={number}")
            for name, rows in plan(df.select("project_id").distinct()).items():
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            df.unpersist()

    return expired.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
