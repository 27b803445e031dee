"""Readers: text-like files, HTML pages, and the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_title, is_blank, normalize_structured, strip_html


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id (the path), page_number, text, source_type of whole text files (txt, md, csv, json,
    xml): one page each, normalised; files without text are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document_id"), F.col("value").alias("text"))
    return pages_of(rows)


def pages_of(rows: DataFrame) -> DataFrame:
    """(document_id, text) to normalised one-page documents."""
    text = normalize_structured(F.col("text"))
    return rows.select("document_id", F.lit(1).alias("page_number"), text.alias("text"), F.lit("text").alias("source_type")).where(~is_blank(F.col("text")))


def read_html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to page texts with titles; pages without text are left out."""
    rows = pages.select(F.col("page_id").alias("document_id"), "url", html_title(F.col("html")).alias("title"), F.lit(1).alias("page_number"), strip_html(F.col("html")).alias("text"), F.lit("text").alias("source_type"))
    return rows.where(~is_blank(F.col("text")))


def read_catalog(spark: SparkSession, kind: str, path: str, split_by: str | None = None, parts: int = 8, **jdbc: str) -> DataFrame:
    """A hierarchy table from Parquet (``path``/``kind``.parquet) or, with a url among the options, by JDBC.

    ``split_by``: a numeric column by whose range, asked of the database first, a table is read in ``parts``
    partitions. Filters and columns are pushed to the database."""
    if "url" not in jdbc:
        return spark.read.parquet(f"{path.rstrip('/')}/{kind}.parquet")
    reader = spark.read.format("jdbc").options(**jdbc)
    if split_by is None:
        return reader.option("dbtable", kind).load()
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc["url"]).quoteIdentifier(split_by)
    ends = reader.option("query", f"SELECT MIN({column}) AS a, MAX({column}) AS b FROM {kind}").load().first()
    if ends is None or ends[0] is None:
        return spark.read.format("jdbc").options(**jdbc).option("dbtable", kind).load()
    bounds = {"partitionColumn": split_by, "lowerBound": str(int(ends[0])), "upperBound": str(int(ends[1]) + 1), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**jdbc, dbtable=kind, **bounds).load()
