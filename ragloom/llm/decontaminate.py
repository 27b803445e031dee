"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Method: items are partitioned by size (number of five-word shingles). Of each item the k
shingles with the smallest hashes form its MinHash sketch; k depends on the size partition
and is so large that any document with the sought containment must hold one of them
(k > size - needed), so the search loses nothing however long the document is. Documents
that meet a sketch become candidates; the containment of each candidate item is then
counted exactly over all its shingles.

DataFrame functions only: no Python runs on the executors.

Defined results: texts are compared lower-cased by words (runs without blanks); null or
blank items and items shorter than one shingle's five words are one shingle of what they
have, blank ones match nothing; a document is reported once an item, whatever the number of
copies of the passage; repeated document rows count once, and rows that share a doc_id are
parts of one document, whose shingles count together; rows without doc_id are not reported
(``clean`` judges every row by itself, whatever its id); a containment
that equals the least one is enough; texts of any length are read whole; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

SHINGLE, CONTAINMENT = 5, 0.8
#: Rows of a sketch or candidate table up to which it is broadcast (some 40 bytes each).
BROADCAST_ROWS = 200_000


def shingles(df: DataFrame, key: str, size: int = SHINGLE) -> DataFrame:
    """(key, h): a row for each run of ``size`` words of ``text``; shorter texts are one run.
    The runs are zipped from shifted copies of the word array, so a row holds its words only."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # words are compared with ASCII letters lower-cased, as in the other word operators
    words = df.select(key, F.split(F.regexp_replace(low, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+").alias("w")).where("w[0] <> ''")
    count = F.greatest(F.size("w") - (size - 1), F.lit(1))
    runs = F.arrays_zip(*[F.slice("w", i + 1, count).alias(f"w{i}") for i in range(size)])
    return words.select(key, F.inline(runs)).select(key, F.xxhash64(*[F.coalesce(F.col(f"w{i}"), F.lit("\x00")) for i in range(size)]).alias("h"))


def find_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_hit, containment of the items of which a document holds
    ``containment`` of the shingles at least. docs: (doc_id, text); items: (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = keep(shingles(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id").distinct(), "items")
    n = parts.groupBy("item_id").agg(F.count("*").alias("n_item"))
    sized = parts.join(n, "item_id")
    # size partitions (powers of two) share a sketch size: that of their largest item
    bound = F.pow(F.lit(2.0), F.ceil(F.log2("n_item")))
    needed = F.floor(bound - F.ceil(bound * containment - 1e-9) + 1)
    # the k smallest hashes of an item by a grouped minimum of arrays: an item is one row's text
    least = sized.groupBy("item_id").agg(F.first(needed.cast("int")).alias("k"), F.array_sort(F.collect_set("h")).alias("hs"))
    sketch = keep(least.select("item_id", F.explode(F.slice("hs", 1, F.col("k"))).alias("h")), "sketch")
    probe = sketch.select("item_id", "h")
    if sketch.count() <= BROADCAST_ROWS:
        probe = F.broadcast(probe)
    met = keep(shingles(docs, "doc_id").join(probe, "h").select("doc_id", "item_id").distinct(), "met")
    few = met.count() <= BROADCAST_ROWS
    among = met.select("doc_id").distinct()
    small = F.broadcast if few else (lambda x: x)
    held = shingles(docs.join(small(among), "doc_id", "left_semi"), "doc_id").distinct()
    whole = met.join(small(sized) if few and sized.count() <= BROADCAST_ROWS else sized, "item_id")  # every shingle of every candidate
    hits = whole.join(held, ["doc_id", "h"]).groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_hit"))
    return hits.where(F.col("n_hit") >= containment * F.col("n_item") - 1e-9).select("doc_id", "item_id", "n_item", "n_hit", (F.col("n_hit") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no item; each is judged by its own text."""
    keyed = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string")))
    found = keep(find_items(keyed.select(F.col("__text").alias("doc_id"), "text"), items, containment).select(F.col("doc_id").alias("__text")).distinct(), "leaks")
    small = F.broadcast if found.count() <= BROADCAST_ROWS else (lambda x: x)
    return keyed.join(small(found), "__text", "left_anti").select(docs.columns)
