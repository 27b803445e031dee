"""Trees and closures: rounds of equi-joins over a frontier, each round written down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import keep


def _cut(df: DataFrame) -> DataFrame:
    """Write a round to the shared folder; reads of it need no lineage."""
    return keep(df, "round")


def descendants(documents: DataFrame, roots: DataFrame, max_depth: int = 64) -> DataFrame:
    """root_id, document_id, depth of the whole subtree of each root, itself included (depth 0);
    children go before their parents when read by falling depth."""
    edges = documents.where("parent_id is not null").select(F.col("parent_id").alias("p"), F.col("document_id").alias("c"))
    front = roots.select(F.col("document_id").alias("root_id"), "document_id", F.lit(0).alias("depth"))
    out = front
    for depth in range(1, max_depth + 1):
        front = _cut(front.join(edges, front["document_id"] == edges["p"]).select("root_id", F.col("c").alias("document_id"), F.lit(depth).alias("depth")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise RuntimeError(f"tree deeper than {max_depth}")


def tree_order(documents: DataFrame, max_depth: int = 64) -> DataFrame:
    """project_id, document_id, depth, path: depth-first order within a project is that of path, an
    array of names (with ids for equal names) from the root down. A missing parent makes a root."""
    docs = documents.select("project_id", "document_id", "parent_id", F.struct(F.col("file_name").alias("name"), F.col("document_id").alias("id")).alias("step"))
    known = docs.select(F.col("document_id").alias("parent_id"))
    rest = docs.where("parent_id is not null").join(known, "parent_id", "left_semi")
    front = docs.join(rest.select("document_id"), "document_id", "left_anti").select("project_id", "document_id", F.lit(0).alias("depth"), F.array("step").alias("path"))
    out = front
    child = rest.select("document_id", F.col("parent_id").alias("p"), "step")
    for depth in range(1, max_depth + 1):
        up = front.select("project_id", F.col("document_id").alias("p"), "path")
        front = _cut(child.join(up, "p").select("project_id", "document_id", F.lit(depth).alias("depth"), F.concat("path", F.array("step")).alias("path")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise RuntimeError(f"tree deeper than {max_depth}")


def revoke_closure(grants: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(tenant_id, user_id) of the users to revoke: those of ``start`` and all that they granted, directly
    or not, inside the tenant. grants: (tenant_id, user_id, granted_by); cycles end by themselves.

    Where every user has one granter in a tenant, each user jumps to its granter's granter and so on, twice as far
    every round, so the rounds grow with the logarithm of the longest chain. Where some have several, the users
    reached last are joined with their grants round by round; a round is written once and never again."""
    edges = grants.where("granted_by is not null").select("tenant_id", F.col("granted_by").alias("by"), "user_id").distinct()
    first = start.select("tenant_id", "user_id").distinct()
    if not edges.groupBy("tenant_id", "user_id").count().where("count > 1").isEmpty():
        return _reached(edges, first, max_rounds)
    on = ["tenant_id", "user_id"]
    state = _cut(edges.join(first.withColumn("hit", F.lit(True)), on, "full").select(*on, F.when(F.col("hit").isNull(), F.col("by")).alias("jump"), F.coalesce("hit", F.lit(False)).alias("hit")))
    for _ in range(max(1, state.count().bit_length()) + 1):
        if state.where("jump is not null").isEmpty():
            break
        far = state.select("tenant_id", F.col("user_id").alias("jump"), F.col("jump").alias("further"), F.col("hit").alias("found"))
        hit = F.col("hit") | F.coalesce("found", F.lit(False))
        state = _cut(state.join(far, ["tenant_id", "jump"], "left").select(*on, F.when(~hit, F.col("further")).alias("jump"), hit.alias("hit")))
    return state.where("hit").select(*on)


def _reached(edges: DataFrame, first: DataFrame, max_rounds: int) -> DataFrame:
    rounds = [_cut(first)]
    for _ in range(max_rounds):
        reach = edges.join(rounds[-1].withColumnRenamed("user_id", "by"), ["tenant_id", "by"]).select("tenant_id", "user_id").distinct()
        for seen in rounds:
            reach = reach.join(seen, ["tenant_id", "user_id"], "left_anti")
        front = _cut(reach)
        if front.isEmpty():
            break
        rounds.append(front)
        if len(rounds) > 16:  # keep the plan short
            rounds = [_cut(reduce(DataFrame.unionByName, rounds[:-1])), rounds[-1]]
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return reduce(DataFrame.unionByName, rounds)
