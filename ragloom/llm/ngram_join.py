"""Exact Jaccard join of word-shingle sets (set-relation skipping).

Method: prefix index lists ordered by shingle rarity; lists are read in blocks
by size and position, skipping blocks that the bounds rule out; and the answer
of a set is derived from that of a highly similar set, so only pairs that are
not yet connected are ever looked at again (see ``setjoin``).

Defined results: null or blank text has no shingles and is linked with nothing
(its own component); a text of fewer than five words is one shingle; copies
share one set and one component; a similarity that equals the least one links; rows that
share a doc_id are documents of their own, with one result each; rows without doc_id link
like others, and a component of such rows alone has a null id; texts of any length are
read whole; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, fingerprint, keep, member, membership, mix, signed, text_shingles
from .setjoin import connect, parity_bitmap

#: Counters of the rarity sketch (4 bytes each): its size does not depend on the data.
COUNTERS = 1 << 19


def _counter(h: np.ndarray) -> np.ndarray:
    return (mix(h + U64(991)) & U64(COUNTERS - 1)).astype(np.int64)


def _scan(batches):
    """(doc_id, row, n, fp, bitmap) of each document, and at the end (slot, uses) of the task's shingle
    counts; a set counts once per task however many copies the task reads."""
    count, seen = np.zeros(COUNTERS, np.int64), set()
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bm", pa.binary()), ("slot", pa.int32()), ("uses", pa.int64())])
    for b in batches:
        ids, keys, n, fp, bm = b.column(0), b.column(2), [], [], []
        for _, h in text_shingles(b):
            f = fingerprint(h)
            n.append(len(h))
            fp.append(f)
            new = len(h) > 0 and f not in seen
            bm.append(parity_bitmap(h) if new else None)
            if new:
                seen.add(f)
                np.add.at(count, _counter(h), 1)
        none = pa.nulls(len(n))
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(bm, pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
    used = np.flatnonzero(count)
    for i in range(0, len(used), 50_000):
        u = used[i : i + 50_000]
        none = pa.nulls(len(u))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(u, pa.int32()), pa.array(count[u])], schema=schema)


def _prefixes(uses, num: int, den: int):
    """The rarest shingles of each set, as many as make two linked sets share one."""

    def run(batches):
        rank, seen = uses.value, set()
        for b in batches:
            cols = [[], [], [], []]
            for _, h in text_shingles(b):
                f = fingerprint(h)
                if not len(h) or f in seen:
                    continue
                seen.add(f)
                k = len(h) - -(-num * len(h) // den) + 1
                r = rank[_counter(h)]
                few = np.flatnonzero(r <= np.partition(r, k - 1)[k - 1])  # the k rarest and their equals
                top = few[np.lexsort((h[few], r[few]))[:k]]
                for c, x in zip(cols, (signed(h[top]), np.full(k, f), np.full(k, len(h), np.int32), np.arange(k, dtype=np.int32))):
                    c.append(x)
            for i in range(0, len(cols[0]), 1000):
                part = [np.concatenate(c[i : i + 1000]) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["key", "node", "n", "pos"])

    return run


def _sets(bits):
    def run(batches):
        wanted, seen = np.frombuffer(bits.value, np.uint8), set()
        for b in batches:
            b = b.filter(pa.array(member(wanted, b.column(2).to_numpy(zero_copy_only=False))))
            rows = {}
            for _, h in text_shingles(b):
                f = fingerprint(h)
                if len(h) and f not in seen:
                    seen.add(f)
                    rows[f] = signed(h).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], ["node", "hs"])

    return run


def _row() -> Column:
    """64 bits of id and text that stand for a row; nulls have bits of their own."""
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.xxhash64(key.isNull(), F.coalesce(key, F.lit(0)), text.isNull(), F.coalesce(text, F.lit("")))


def _components(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n, fp) of every row of ``docs``, and (fp, label, first, row) of every set of
    shingles: its component, smallest doc_id, and one row that has it."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row().alias("row"))
    found = keep(docs.mapInArrow(_scan, "doc_id long, row long, n int, fp long, bm binary, slot int, uses long"), "scan")
    facts = found.where("slot is null").select("doc_id", "row", "n", "fp", "bm")
    uses = np.zeros(COUNTERS, np.int64)
    got = found.where("slot is not null").groupBy("slot").agg(F.sum("uses").alias("uses")).toArrow()  # COUNTERS rows at most
    uses[got.column(0).to_numpy()] = got.column(1).to_numpy()
    uses = sc.broadcast(np.minimum(uses, 2**31 - 1).astype(np.int32))

    classes = facts.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"))
    bitmaps = facts.where("bm is not null").select(F.col("fp").alias("node"), "n", "bm")

    def bitmaps_of(nodes: DataFrame) -> DataFrame:
        return bitmaps.join(nodes, "node", "left_semi")

    postings = docs.mapInArrow(_prefixes(uses, num, den), "key long, node long, n int, pos int")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = keep(classes.join(nodes, F.col("fp") == F.col("node"), "left_semi").select("row"), "wanted")
        bits = sc.broadcast(membership(wanted, "row"))
        return docs.mapInArrow(_sets(bits), "node long, hs binary")

    label = connect(postings, bitmaps_of, sets_of, num, den, positions=True)
    return facts, classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def shingle_components(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Documents link when den * intersection >= num * union of their five-word shingles;
    component_id is the smallest doc_id reachable by links (null if no row there has one).
    """
    facts, named = _components(docs, num, den)
    lowest = named.groupBy("label").agg(F.min("first").alias("lowest"))
    group = named.join(lowest, "label").select("fp", "lowest")
    return facts.join(group, "fp", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _told(kept, gone):
    """Of a row's 64 bits: 1 stays, 0 goes, 2 may do either, as it is in both filters."""

    @F.pandas_udf("int")
    def run(row: pd.Series) -> pd.Series:
        ids = row.to_numpy()
        stays, goes = (member(np.frombuffer(x.value, np.uint8), ids) for x in (kept, gone))
        return pd.Series(np.where(goes, np.where(stays, 2, 0), 1).astype(np.int32))

    return run


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, that with the
    smallest doc_id (of several the first by a hash of the text; rows without doc_id come last).
    Rows without words are like no other and stay.

    Every row with words is in one of two tables of ids, the rows that stay and those that go. A row
    that is not in the filter of the latter stays, so of the texts only those in both filters (false
    positives) are joined with the ids.
    """
    sc = docs.sparkSession.sparkContext
    facts, named = _components(docs, 80, 100)
    rows = facts.where("n > 0").groupBy("fp", "doc_id", "row").agg(F.count("*").alias("uses")).join(named.select("fp", "label"), "fp")
    rows = keep(rows.select("label", "doc_id", "row", "uses"), "rows")
    lowest = rows.groupBy("label").agg(F.min("doc_id").alias("lowest"))
    able = rows.join(lowest, "label").where("doc_id <=> lowest")
    first = keep(able.groupBy("label").agg(F.min_by(F.struct("row", "uses"), "row").alias("x")).select(F.col("x.row").alias("__row"), F.col("x.uses").alias("uses")), "firsts")
    once, again = (first.where(x).select("__row") for x in ("uses = 1", "uses > 1"))
    gone = keep(rows.select(F.col("row").alias("__row")).join(once, "__row", "left_anti"), "gone")
    told = _told(*(sc.broadcast(membership(x, "__row")) for x in (once, gone)))
    blank = ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named_rows = docs.withColumn("__row", _row())
    marked = named_rows.withColumn("__told", F.when(blank, 1).otherwise(told("__row")))
    out = marked.where("__told = 1").select(docs.columns)
    out = out.unionByName(marked.where("__told = 2").join(once, "__row", "left_semi").select(docs.columns))
    if again.isEmpty():
        return out
    # rows that repeat both id and text
    likely = named_rows.where(_told(sc.broadcast(membership(gone, "__row")), sc.broadcast(membership(again, "__row")))("__row") != 1)
    return out.unionByName(likely.join(again, "__row", "left_semi").dropDuplicates(["__row"]).select(docs.columns))
