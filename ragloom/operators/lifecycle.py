"""Lifetimes, expiry, re-indexing and deletion plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import DISABLED, ENABLED
from .index import selectable_documents


def lifetime_expiry(preset_hours: Column, start: Column) -> Column:
    return F.timestamp_add("HOUR", preset_hours, start)


def expired_projects(projects: DataFrame, now, take: int = 50) -> DataFrame:
    """The oldest expired projects, ``take`` at most (no positive number: 50)."""
    due = projects.where(F.col("lifetime_preset").isNotNull() & (F.col("lifetime_expires_at") <= now))
    return due.orderBy("lifetime_expires_at", "project_id").limit(take if take > 0 else 50)


def project_lifetimes(projects: DataFrame, activity: DataFrame) -> DataFrame:
    """project_id, lifetime_expires_at under auto-extension.

    projects: (project_id, created_at, hours); activity: (project_id, ts). An event strictly before
    the expiry moves it to the later of itself and event + hours; an event at or after it changes
    nothing any more. So the life is the first island of events whose gaps are shorter than the
    lifetime, counted from the creation.
    """
    rows = activity.join(projects, "project_id").where("hours is not null and ts >= created_at").select("project_id", "created_at", "hours", "ts")
    order = Window.partitionBy("project_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.lag("ts").over(Window.partitionBy("project_id").orderBy("ts")), F.col("created_at"))
    late = (F.col("ts") >= F.timestamp_add("HOUR", F.col("hours"), before)).cast("int")
    alive = rows.withColumn("late", late).withColumn("lost", F.max("late").over(order)).where("lost = 0")
    last = alive.groupBy("project_id").agg(F.max("ts").alias("last"))
    j = projects.where("hours is not null").join(last, "project_id", "left")
    return j.select("project_id", F.timestamp_add("HOUR", F.col("hours"), F.coalesce("last", "created_at")).alias("lifetime_expires_at"))


def project_delete_plan(projects: DataFrame, documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """documents, chunks and storage keys (not blank) to remove with the projects."""
    ids = projects.select("project_id").distinct()
    docs = documents.join(ids, "project_id", "left_semi")
    return {
        "documents": docs.select("project_id", "document_id"),
        "chunks": chunks.join(docs.select("document_id"), "document_id", "left_semi"),
        "storage_keys": docs.where(F.trim(F.coalesce("storage_key", F.lit(""))) != "").select("project_id", "storage_key"),
    }


def expiry_sweep(projects: DataFrame, documents: DataFrame, chunks: DataFrame, now) -> dict[str, DataFrame]:
    """What all projects expired by now leave to remove: one set, not batch after batch."""
    due = projects.where(F.col("lifetime_preset").isNotNull() & (F.col("lifetime_expires_at") <= now))
    return {"projects": due.select("project_id"), **project_delete_plan(due, documents, chunks)}


def reindex_plan(projects: DataFrame, old_models: DataFrame, new_models: DataFrame, documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """For projects whose effective model changes: the new index version, the chunks to drop and the
    documents to queue again. models: (project_id, model_id) before and after."""
    old = old_models.select("project_id", F.col("model_id").alias("old_model"))
    changed = projects.join(old, "project_id", "left").join(new_models.select("project_id", F.col("model_id").alias("new_model")), "project_id", "left").where("not (old_model <=> new_model)")
    ids = changed.select("project_id")
    docs = documents.join(ids, "project_id", "left_semi")
    return {
        "projects": changed.select("project_id", (F.col("index_version") + 1).alias("index_version"), "old_model", "new_model"),
        "chunks": chunks.join(docs.select("document_id"), "document_id", "left_semi"),
        "requeue": selectable_documents(docs).select("project_id", "document_id"),
    }


def without_model(projects: DataFrame, removed: DataFrame) -> DataFrame:
    """Projects after models are removed: one that named a removed model loses it and its override."""
    gone = removed.select(F.col("model_id").alias("rag_model_id")).distinct().withColumn("gone", F.lit(True))
    j = projects.join(gone, "rag_model_id", "left")
    hit = F.coalesce("gone", F.lit(False))
    return j.select(
        *[c for c in projects.columns if c not in ("rag_model_id", "rag_override")],
        F.when(~hit, F.col("rag_model_id")).alias("rag_model_id"),
        F.when(hit & (F.col("rag_override") == ENABLED), DISABLED).otherwise(F.col("rag_override")).cast("int").alias("rag_override"),
    )
