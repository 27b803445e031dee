"""Index rows: the hierarchy joined to chunks, scopes, the ingest ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_uid
from ..functions.vectors import pad_vector

#: Document states, fixed values.
UPLOADED, QUEUED, PROCESSING, COMPLETED, FAILED, QUARANTINED, REJECTED = range(7)
#: Extraction states, fixed values.
PENDING, EXTRACTING, EXTRACTED, WARNINGS, EXTRACTION_FAILED, UNSUPPORTED, BLOCKED = range(7)


def chunks_with_hierarchy(chunks: DataFrame, documents: DataFrame, projects: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Chunks with document, project, workspace and tenant ids and the document's file name and state.
    Sizes decide how each join runs: Spark broadcasts a side under its threshold."""
    d = documents.select("document_id", "project_id", "file_name", F.col("state").alias("document_state"))
    p = projects.select("project_id", "workspace_id", F.col("index_version").alias("project_index_version"))
    w = workspaces.select("workspace_id", "tenant_id")
    return chunks.join(d, "document_id").join(p, "project_id").join(w, "workspace_id")


def build_index_rows(chunks: DataFrame, documents: DataFrame, projects: DataFrame, workspaces: DataFrame, keywords: DataFrame | None, vectors: DataFrame, dims: int) -> DataFrame:
    """One row per chunk for the index: ids of the hierarchy, keywords, padded vector, version, state. Without
    ``keywords`` (chunk_uid, keywords) the chunks hold their own."""
    if keywords is not None:
        chunks = chunks.drop("keywords")
    rows = chunks_with_hierarchy(chunks, documents, projects, workspaces)
    rows = rows.withColumn("index_version", F.col("project_index_version")).withColumn("chunk_uid", chunk_uid(F.col("document_id"), F.col("index_version"), F.col("chunk_index")))
    if keywords is not None:
        rows = rows.join(keywords, "chunk_uid", "left")
    rows = rows.join(vectors, "chunk_uid", "left")
    return rows.select(
        "chunk_uid", "tenant_id", "workspace_id", "project_id", "document_id", "file_name", "chunk_index", "page_number", "source_type",
        F.col("content").alias("text"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.when(F.col("embedding").isNotNull(), pad_vector(F.col("embedding"), dims)).alias("embedding"), "index_version", F.lit(COMPLETED).alias("document_state"),
    )


def scope_filter(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, chunk_uid) that a query may see: its tenant, workspace, project and version, and a
    document of its list. An equi-join on all keys; each query's ids are exploded."""
    q = queries.select("query_id", "tenant_id", "workspace_id", "project_id", "index_version", F.explode(F.array_distinct("document_ids")).alias("document_id"))
    return index.join(q, ["tenant_id", "workspace_id", "project_id", "index_version", "document_id"]).select("query_id", "chunk_uid")


def selectable_documents(documents: DataFrame) -> DataFrame:
    return documents.where(~F.col("state").isin(QUARANTINED, REJECTED))


def already_ingested(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """The work whose (document_id, version, index_version) is not in the ledger yet."""
    on = ["document_id", "version", "index_version"]
    return work.join(ledger.select(on), on, "left_anti")


def invalid_selection(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """request_id, n_selected, outcome. requests: (request_id, project_id, document_ids).

    'invalid' if a requested id is not selectable in the project; without ids all selectable
    documents count; 'empty' if none is left, else 'ok'.
    """
    good = selectable_documents(documents).select("project_id", "document_id")
    asked = requests.select("request_id", "project_id", F.explode(F.array_distinct("document_ids")).alias("document_id"))
    seen = asked.join(good.withColumn("ok", F.lit(1)), ["project_id", "document_id"], "left").groupBy("request_id").agg(F.count("*").alias("n"), F.count("ok").alias("n_ok"))
    every = good.groupBy("project_id").agg(F.count("*").alias("n_all"))
    j = requests.select("request_id", "project_id").join(seen, "request_id", "left").join(every, "project_id", "left")
    n = F.coalesce(F.col("n_ok"), F.col("n_all"), F.lit(0))
    return j.select("request_id", n.cast("long").alias("n_selected"), F.when(F.col("n") > F.col("n_ok"), "invalid").when(n == 0, "empty").otherwise("ok").alias("outcome"))


def selection_intersect(selected: DataFrame, documents: DataFrame) -> DataFrame:
    """The (project_id, document_id) of the selection that can be selected still."""
    return selected.join(selectable_documents(documents).select("project_id", "document_id"), ["project_id", "document_id"], "left_semi")
