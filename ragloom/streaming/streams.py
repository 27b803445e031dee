"""Structured Streaming forms of outcomes, idempotence and routing of failures; the batch form of ingest.
Streams with state of their own (ingest, lifetimes) are in ``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.index import COMPLETED, FAILED, QUARANTINED, REJECTED
from ..params import IDEMPOTENCY_DAYS, MAX_RETRIES


def ingest_batch(queued: DataFrame, documents: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work, jobs) of a batch of queued (document_id): quarantined and rejected documents are not
    ingested (job failed, skipped_security); what the ledger holds is done already."""
    j = queued.select("document_id").distinct().join(documents, "document_id")
    barred = F.col("state").isin(QUARANTINED, REJECTED)
    on = ["document_id", "version", "index_version"]
    work = j.where(~barred).join(ledger.select(on), on, "left_anti")
    jobs = j.select("document_id", F.lit("parse").alias("job_type"), F.when(barred, "skipped_security").otherwise("completed").alias("result"), F.when(barred, FAILED).otherwise(COMPLETED).alias("state"))
    return work, jobs


def job_outcome_stream(jobs: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """window_start, job_type, result, jobs: tumbling counts; works on streams and on tables."""
    return jobs.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "job_type", "result").agg(F.count("*").alias("jobs")).select(F.col("w.start").alias("window_start"), "job_type", "result", "jobs")


def idempotent_stream(events: DataFrame, key: str, days: int = IDEMPOTENCY_DAYS) -> DataFrame:
    """The first event of each key within the days."""
    return events.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark([key])


def context_request_dedupe(requests: DataFrame, key: str = "cache_key", ttl_seconds: int = 300) -> DataFrame:
    """Requests that no equal one within the time to live (5 seconds at least) has answered."""
    return requests.withWatermark("ts", f"{max(5, ttl_seconds)} seconds").dropDuplicatesWithinWatermark([key])


def retry_route(failures: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failures with route and next_retry: 'drop' without a readable id, 'retry' below the maximum, else 'dead_letter'."""
    route = F.when(F.col("document_id").isNull(), "drop").when(F.coalesce("retry", F.lit(0)) < max_retries, "retry").otherwise("dead_letter")
    return failures.withColumn("route", route).withColumn("next_retry", F.when(F.col("route") == "retry", F.coalesce("retry", F.lit(0)) + 1))


def retry_router(failures: DataFrame, out: str, checkpoint: str, max_retries: int = MAX_RETRIES) -> DataStreamWriter:
    """A stream of failures to the two sinks ``out``/retry and ``out``/dead_letter."""

    def batch(df: DataFrame, number: int) -> None:
        routed = retry_route(df, max_retries)
        for to in ("retry", "dead_letter"):
            routed.where(F.col("route") == to).write.mode("overwrite").parquet(f"{out}/{to}/batch={number}")

    return failures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def lifetime_sessions(activity: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(project_id, ts, hours) to sessions: session_end is the expiry that auto-extension reaches. An
    event exactly at the end does not extend a life, so the gap is a microsecond short."""
    gap = F.concat(F.col("hours") * 3600 - 1, F.lit(" seconds 999999 microseconds"))
    s = activity.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "project_id").agg(F.count("*").alias("events"))
    return s.select("project_id", F.col("w.start").alias("session_start"), F.timestamp_add("MICROSECOND", F.lit(1), F.col("w.end")).alias("session_end"), "events")
