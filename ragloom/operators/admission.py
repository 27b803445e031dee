"""Screening of uploads: the gate's first failing reason, and what becomes of each upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.files import ALLOWED_EXTENSIONS, ALLOWED_TYPES, ALSO_TYPES, CONTENT_TYPES, ZIP_BACKED, compatible_types, container_kind, declared_type, effective_extension, sniff_content_type
from ..functions.text import is_blank, trim_space
from ..params import MAX_FILE_BYTES
from .index import BLOCKED, PENDING, QUARANTINED, QUEUED, REJECTED

_OCTETS = "application/octet-stream"


def upload_gate(manifest: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """manifest (document_id, file_name, content_type, size_bytes, header, ...) with accepted, reason
    (the first that fails, else null) and normalized_type."""
    own = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() if kv[0] != ".gz" for x in kv])
    every = F.create_map(*[x for e, t in CONTENT_TYPES.items() if e != ".gz" for x in (F.lit(e), F.array(*[F.lit(v) for v in (t, *ALSO_TYPES.get(e, []))]))])
    rows = manifest.withColumn("__ext", effective_extension(trim_space(F.coalesce("file_name", F.lit(""))))).withColumn("__declared", declared_type(F.col("content_type"))).withColumn("__sniffed", sniff_content_type(F.col("header")))
    ext, declared, sniffed = F.col("__ext"), F.col("__declared"), F.col("__sniffed")
    known = F.coalesce(sniffed, F.when((declared != "") & (declared != _OCTETS), declared), F.try_element_at(own, ext), F.lit(_OCTETS))
    rows = rows.withColumn("__type", F.when((known == "application/zip") & ext.isin(ZIP_BACKED), F.try_element_at(own, ext)).otherwise(known))
    kind = F.col("__type")
    reason = (
        F.when(is_blank(F.col("file_name")), "file name is required")
        .when(F.coalesce("size_bytes", F.lit(0)) <= 0, "file is empty")
        .when(F.col("size_bytes") > max_bytes, "file is too large")
        .when(ext == "", "extension is missing")
        .when(~ext.isin(ALLOWED_EXTENSIONS), "extension is not allowed")
        .when((declared != "") & ~declared.isin(ALLOWED_TYPES), "declared type is not allowed")
        .when(~kind.isin(ALLOWED_TYPES), "detected type is not allowed")
        .when(~F.array_contains(F.try_element_at(every, ext), kind), "extension does not match the detected type")
        .when(sniffed.isNotNull() & (declared != "") & ~compatible_types(declared, sniffed), "declared type does not match the detected type")
    )
    rows = rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    return rows.withColumn("normalized_type", F.when(F.col("accepted"), kind).otherwise(_OCTETS)).drop("__ext", "__declared", "__sniffed", "__type")


def upload_outcomes(gated: DataFrame, scans: DataFrame, quarantine: bool = True) -> DataFrame:
    """Gated uploads joined with scan verdicts ('clean', 'infected', 'error'): state, extraction_state,
    is_stored, is_queued, container, originating_upload_id and the audit event of each."""
    j = gated.join(scans.select("document_id", "verdict"), "document_id", "left")
    bad = F.coalesce("verdict", F.lit("error")) != "clean"
    refused = ~F.col("accepted")
    state = F.when(refused, REJECTED).when(bad, QUARANTINED if quarantine else REJECTED).otherwise(QUEUED)
    stored = ~refused & (~bad | F.lit(quarantine))
    event = F.when(refused, "upload_rejected").when(bad, "upload_quarantined" if quarantine else "upload_rejected").otherwise("upload_accepted")
    return j.select(
        "document_id", state.cast("int").alias("state"), F.when(refused | bad, BLOCKED).otherwise(PENDING).cast("int").alias("extraction_state"),
        stored.alias("is_stored"), (~refused & ~bad).alias("is_queued"),
        F.when(~refused & ~bad, container_kind(F.col("file_name"), F.col("normalized_type"))).otherwise("none").alias("container"),
        F.col("document_id").alias("originating_upload_id"), event.alias("audit_event"),
    )


def audit_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(F.col("audit_event").alias("event_type"), "document_id", "state")
