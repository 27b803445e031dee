"""Rows and questions of the same scope, dealt to groups of bounded size on both sides.

A scope's rows are salted into segments and its questions into slots; every segment meets every
slot of its own scope only, in one co-grouped task each, so pairs of two scopes are never formed,
and a scope that holds a third of all rows is as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scopes up to which their sizes are broadcast.
BROADCAST_SCOPES = 100_000


def scope_of(same: tuple[str, ...]) -> Column:
    """One string of the scope's columns; null if any is null; '' for no columns."""
    texts = [F.col(c).cast("string") for c in same]
    return F.when(~F.exists(F.array(*texts), lambda v: v.isNull()), F.concat_ws("\x00", *texts)) if same else F.lit("")


def salted(rows: DataFrame, key: str, size: int, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with a scope, and the salt of each: about ``size`` rows a salt. ``counted``: a frame with the same
    scopes that is cheaper to count."""
    sizes = (rows if counted is None else counted).where("scope is not null").groupBy("scope").agg(F.ceil(F.count("*") / size).cast("int").alias("salts"))
    few = F.broadcast(sizes) if sizes.limit(BROADCAST_SCOPES + 1).count() <= BROADCAST_SCOPES else sizes
    return rows.join(few, "scope").withColumn("salt", F.pmod(F.xxhash64(key), F.col("salts")).cast("int")).drop("salts")


def meet(rows: DataFrame, queries: DataFrame, segments: DataFrame, block: int, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """score(rows of a segment, questions of a slot) for each pair of one scope. rows: (scope, salt, ...),
    segments: the distinct (scope, salt); queries: (scope, query_id, ...), ``block`` to a slot."""
    asked = salted(queries, "query_id", block).withColumnRenamed("salt", "slot")
    slots = asked.select("scope", "slot").distinct()
    # fresh columns on each side: both may stem from the same tables
    left = rows.join(slots, "scope").select(*[F.col(c).alias(c) for c in [*rows.columns, "slot"]])
    right = asked.join(segments, "scope").select(*[F.col(c).alias(c) for c in [*asked.columns, "salt"]])
    by = ["scope", "salt", "slot"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, schema)
