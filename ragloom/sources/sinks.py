"""Writers and table maintenance of the chunk table and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of a newly ingested document go, whatever their version; the new ones come."""
    return existing.join(new.select("document_id").distinct(), "document_id", "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def write_chunks(chunks: DataFrame, path: str, by: str = "project_id") -> None:
    """Parquet by project; only the partitions of the rows given are replaced."""
    chunks.repartition(F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete_index_rows(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows of the (project_id, document_id, index_version) given."""
    on = ["project_id", "document_id", "index_version"]
    return index.join(keys.select(on).distinct(), on, "left_anti").select(index.columns)


def upsert_index(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The last write of each chunk_uid: a new row replaces the old; of new rows the latest counts."""
    latest = chunks.groupBy("chunk_uid").agg(F.max_by(F.struct(*[c for c in index.columns if c != "chunk_uid"]), "updated_at").alias("r")).select("chunk_uid", "r.*")
    return index.join(latest.select("chunk_uid"), "chunk_uid", "left_anti").select(index.columns).unionByName(latest.select(index.columns))


def bulk_lines(chunks: DataFrame, index_name: str = "chunks") -> DataFrame:
    """chunk_uid, line_no, value: two JSON lines for each chunk, the action and the document. Names
    are camel case, nulls left out, keywordsText is the keywords joined by blanks."""

    def camel(name: str) -> str:
        first, *rest = name.split("_")
        return first + "".join(r.capitalize() for r in rest)

    action = F.to_json(F.struct(F.struct(F.lit(index_name).alias("_index"), F.col("chunk_uid").alias("_id")).alias("index")))
    fields = [F.col(c).alias(camel(c)) for c in chunks.columns]
    if "keywords" in chunks.columns:
        fields.append(F.array_join("keywords", " ").alias("keywordsText"))
    return chunks.select("chunk_uid", F.posexplode(F.array(action, F.to_json(F.struct(*fields)))).alias("line_no", "value"))


def export_bulk_index(chunks: DataFrame, path: str, index_name: str = "chunks") -> None:
    """Newline-delimited JSON for a search engine's bulk load; the two lines of a chunk stay together."""
    bulk_lines(chunks, index_name).select(F.col("value")).write.mode("overwrite").text(path)
