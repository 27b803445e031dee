"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog sketches.

Method: a sketch of the sites of each line hash, merged by aggregation; lines whose
estimate lies near the threshold get an exact distinct count; lines seen on
``min_sites`` sites or more go.

Defined results: a line is compared without blanks, tabs and carriage returns at its
ends, case-sensitively; blank lines are never boilerplate; a null site is no site; a
null text stays null; a text that is all boilerplate becomes empty; rows that repeat
count once a site, and are cut alike; a count that equals ``min_sites`` goes; an empty
table gives no rows. Extra columns are kept as they are, whatever their names, but
n_lines and n_removed are replaced. With ``max_share`` (off by default) a text of which
more than that share of the characters would go is taken for one of many copies and left
whole, for a near-copy removal that comes later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

MIN_SITES = 10
#: Registers of a sketch as a power of two, its relative standard error, and the width of
#: the band around the threshold, in errors, in which exact counts decide.
LG_K, ERROR, WIDTH = 10, 1.04 / 32, 5.0
#: Boilerplate lines (16 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(row, no, h1, h2, site): 128 bits of hash stand for a line, 64 bits of id and text for a row."""
    text = F.expr(r"trim(BOTH ' \t\r' FROM line)")
    return (
        docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
        .withColumn("line", text)
        .where("line <> ''")
        .select("row", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that occur on min_sites sites or more."""
    low, high = min_sites * (1 - WIDTH * ERROR), min_sites * (1 + WIDTH * ERROR)
    # lines with fewer occurrences than min_sites cannot qualify and need no sketch
    often = lines.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    spread = lines.join(often, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = keep(spread.where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") <= high).select("h1", "h2")
    exact = (
        lines.where("site is not null")
        .join(near, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return spread.where(F.col("sites") > high).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, max_share: float | None = None) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``, and n_lines and n_removed
    (columns of these names in ``docs`` are replaced)."""
    lines = keep(_lines(docs, site), "lines")
    common = keep(boilerplate(lines, min_sites), "boilerplate")
    few = F.broadcast if common.count() <= BROADCAST_ROWS else (lambda x: x)
    gone = lines.join(few(common), ["h1", "h2"], "left_semi").groupBy("row").agg(F.collect_set("no").alias("gone"))
    # the columns of ``docs`` travel in a struct, where no name of ours can clash with theirs
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    text, parts = F.col("d.text"), F.split("d.text", "\n", -1)
    cut = (
        rows.join(gone, "row", "left")
        .withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
        .withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone"))
        .withColumn("rest", F.when(F.size("gone") == 0, text).otherwise(F.array_join(F.transform("stay", lambda i: F.element_at(parts, i + 1)), "\n")))
    )
    if max_share is not None:
        cut = cut.withColumn("whole", F.length("rest") < F.length(text) * (1 - max_share))
        cut = cut.withColumn("rest", F.when(F.col("whole"), text).otherwise(F.col("rest"))).withColumn("gone", F.when(F.col("whole"), F.array().cast("array<int>")).otherwise(F.col("gone")))
    return cut.select(
        *[F.col("rest").alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
    )
