"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets a fractional number of copies (its source's target over its
source's size). The whole part is taken; the fractions are rounded in pairs: words are
moved at random from one document to the other, so that expectations stay, until one
of the two is integral; the other meets the next document. Each bucket of documents
leaves one fraction at most; those meet in a tree of groups until one is left for a
source, which is drawn. So the words taken differ from a source's target by less than
one document.

Defined results: null text has size 0 and takes 0; a null source is a source, the last;
repeated rows are documents of their own; a null doc_id is an id like others, and rows that
share an id are dealt and drawn by their texts; draws depend on doc_id, text and the seed
alone, so reruns agree whatever the partitions (of rows that are all alike, which one is
drawn cannot be told); a fraction of 0 or 1 is never drawn; texts of any length are counted
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WORD, keep, mix

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED = 1.5, 2.0, 20
#: Documents of a bucket, and residuals of a group of the tree.
BUCKET, FAN = 4096, 64


def source_ranks(sources: DataFrame) -> DataFrame:
    """source, size, rank: the place of each source by code point, null last. Ranges are
    ranked apart and shifted by the numbers of sources before them."""
    spark = sources.sparkSession
    cut = keep(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    shift, before = [], 0
    for p in sorted(counts):
        shift.append((p, before))
        before += counts[p]
    if not shift:
        return cut.select("source", "size", F.lit(0).cast("long").alias("rank"))
    w = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return cut.join(F.broadcast(spark.createDataFrame(shift, "part int, shift long")), "part").select("source", "size", (F.row_number().over(w) - 1 + F.col("shift")).alias("rank"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, rank. Targets share ``share`` of all words by weight; none
    exceeds ``cap`` times its source's size, and what is cut off is reshared by weight."""
    ranked = keep(source_ranks(sizes.groupBy("source").agg(F.sum("size").alias("size"))), "ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("size") * cap)
    total = ranked.agg(F.sum("size")).first()[0] or 0
    level = 0.0
    while True:  # the level only rises, and each round caps one more source at least
        full = F.col("most") < F.col("weight") * level
        got = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = (share * total - (got[0] or 0.0)) / got[1] if got[1] else level
        if now <= level:
            break
        level = now
    return ranked.select("source", F.col("size").alias("source_size"), F.least("most", F.col("weight") * level).alias("target"), "rank")


def _pivot(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """p of the rows after rounding: 0 or 1, but for one row at most."""
        # large documents first: what is left open at the end is then a small one
        rows = rows.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        size, p = rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64).copy()
        draw = mix(rows["key"].to_numpy(np.int64).view(U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)) + rows["level"].to_numpy(np.int64).view(U64))
        draw = (draw >> U64(11)).astype(np.float64) / 2.0**53
        a = -1
        for b in range(len(p)):
            if not 0 < p[b] < 1:
                continue
            if size[b] == 0:
                p[b] = 0.0
                continue
            if a < 0:
                a = b
                continue
            ab, ba = min(size[a] * p[a], size[b] * (1 - p[b])), min(size[b] * p[b], size[a] * (1 - p[a]))
            if draw[b] * (ab + ba) < ba:  # a gives to b
                gives, gets, m = a, b, ab
            else:
                gives, gets, m = b, a, ba
            emptied = m >= size[gives] * p[gives]
            filled = m >= size[gets] * (1 - p[gets])
            p[gives] = 0.0 if emptied else p[gives] - m / size[gives]
            p[gets] = 1.0 if filled else p[gets] + m / size[gets]
            open_ = [x for x in (a, b) if 0 < p[x] < 1]
            a = open_[0] if open_ else -1
        return rows.assign(p=p)

    return run


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs``."""
    spark = docs.sparkSession
    sizes = keep(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("mark")),
        "sizes",
    )
    targets = keep(source_targets(sizes, weights, share, cap), "targets")
    n = sizes.groupBy("source").agg(F.count("*").alias("n"))
    plan = targets.join(n, targets["source"].eqNullSafe(n["source"])).select(
        targets["source"],
        "source_size",
        "target",
        "rank",
        F.ceil(F.col("n") / BUCKET).cast("long").alias("buckets"),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).select(
        "doc_id",
        sizes["source"],
        "size",
        "source_size",
        "target",
        "rank",
        rate.alias("rate"),
        F.xxhash64(F.lit(seed), "doc_id", "mark").alias("key"),
        "buckets",
    )
    whole = F.floor("rate")
    rows = dealt.select(
        "doc_id", "source", "size", "source_size", "target", "rank", "key",
        F.pmod(F.xxhash64("key"), F.col("buckets")).alias("bucket"),
        whole.cast("long").alias("whole"),
        (F.col("rate") - whole).alias("p"),
        F.lit(0).cast("long").alias("level"),
    )
    done = None
    most = plan.agg(F.max("buckets")).first()[0] or 1
    level = 0
    while True:
        rows = keep(rows.groupBy("rank", "bucket").applyInPandas(_pivot(seed), rows.schema), "pivot")
        last = most <= 1
        settled = rows if last else rows.where("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        level += 1
        most = -(-most // FAN)
        rows = rows.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long")).withColumn("level", F.lit(level).cast("long"))
    # one fraction of a source is left; it is drawn
    drawn = F.when(F.col("p") >= 1, 1).when(F.col("p") <= 0, 0).otherwise((F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(1 << 30)) < F.col("p") * (1 << 30)).cast("int"))
    copies = F.col("whole") + drawn
    return done.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
