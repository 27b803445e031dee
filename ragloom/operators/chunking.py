"""Pages to overlapping chunks, and what belongs to a chunk on its way to the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_space


def _windows(size: int, overlap: int):
    """The windows of the text in order, blank ones too. The text is cut once into pieces of a stride; a window is
    made of a piece and what it needs of the next ones, so the work is linear in the text's length."""
    stride = max(1, size - overlap)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    more = -(-overlap // stride)
    n = F.expr(f"greatest(0, length(text) - {overlap} - 1) div {stride} + 1").cast("int")
    window = lambda i: F.array_join(F.slice("pieces", i + 1, more + 1), "").substr(1, size)
    return pieces, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * stride).alias("start"), trim_space(window(i)).alias("content")))


def chunk_pages(pages: DataFrame, size: int = 1400, overlap: int = 250) -> DataFrame:
    """(document_id, page_number, text, ...) to one row per chunk.

    Windows start every size - overlap characters; none starts after one has reached the
    page's end. Windows are trimmed, blank ones dropped; chunk_index counts the kept ones
    across a document's pages. Other columns ride along; the page's text does not.
    """
    size = max(200, size)
    overlap = max(0, min(overlap, size - 1))
    pieces, windows = _windows(size, overlap)
    rest = [c for c in pages.columns if c not in ("text", "content", "start", "chunk_index")]
    split = pages.where(~is_blank(F.col("text"))).withColumn("pieces", pieces)
    cut = split.select(*rest, F.explode(F.filter(windows, lambda w: w["content"] != "")).alias("w")).select(*rest, F.col("w.start").alias("start"), F.col("w.content").alias("content"))
    order = Window.partitionBy("document_id").orderBy("page_number", "start")
    return cut.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("character_count", F.length("content"))


def chunk_single_pages(documents: DataFrame, size: int = 1400, overlap: int = 250) -> DataFrame:
    """chunk_pages where each row is a whole document of one page: the index is the window's
    place in its own row, so nothing is shuffled."""
    size = max(200, size)
    overlap = max(0, min(overlap, size - 1))
    pieces, windows = _windows(size, overlap)
    rest = [c for c in documents.columns if c not in ("text", "content", "chunk_index")]
    split = documents.where(~is_blank(F.col("text"))).withColumn("pieces", pieces)
    return split.select(*rest, F.posexplode(F.filter(windows, lambda w: w["content"] != "")).alias("chunk_index", "w")).select(*rest, "chunk_index", F.col("w.content").alias("content")).withColumn("character_count", F.length("content"))


def embedding_batches(chunks: DataFrame, size: int = 32) -> DataFrame:
    """Request batches: consecutive chunks of a document."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with embedding, failed documents): a document whose chunks do not all have a vector fails."""
    joined = chunks.join(vectors.select("chunk_uid", "embedding"), "chunk_uid", "left")
    counts = joined.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))
    failed = counts.where("chunks <> vectors")
    return joined.join(failed.select("document_id"), "document_id", "left_anti"), failed


def ocr_needed(pages: DataFrame, allow_ocr: bool = True, threshold: int = 200) -> DataFrame:
    """document_id, visible_chars, route: 'text' from the threshold on, below it 'ocr' if allowed, else
    'text' if any page has text, else 'failed'."""
    visible = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", ""))
    total = pages.groupBy("document_id").agg(F.sum(visible).alias("visible_chars"))
    route = F.when(F.col("visible_chars") >= threshold, "text").when(F.lit(allow_ocr), "ocr").when(F.col("visible_chars") > 0, "text").otherwise("failed")
    return total.withColumn("route", route)


def transcript(messages: DataFrame) -> DataFrame:
    """project_id, transcript: '[User - yyyy-MM-dd HH:mm]: content' lines in time order."""
    who = F.when(F.lower("role") == "user", "User").otherwise("Assistant")
    line = F.concat(F.lit("["), who, F.lit(" - "), F.date_format("message_timestamp", "yyyy-MM-dd HH:mm"), F.lit("]: "), F.col("content"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("message_timestamp"), F.col("message_id"), line.alias("line"))))
    return messages.groupBy("project_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
