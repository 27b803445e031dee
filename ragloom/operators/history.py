"""Chat and prompt history, invitations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, trim_space


def _newest(messages: DataFrame) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(F.desc("message_timestamp"), F.desc("created_at"), F.desc("message_id"))
    return messages.withColumn("age", F.row_number().over(order))


def recent_chat(messages: DataFrame, limit: int = 30) -> DataFrame:
    """The last messages of each project with their place in time order (no); limit <= 0: all."""
    recent = messages if limit <= 0 else _newest(messages).where(F.col("age") <= limit).drop("age")
    up = Window.partitionBy("project_id").orderBy("message_timestamp", "created_at", "message_id")
    return recent.withColumn("no", F.row_number().over(up))


def prune_chat(messages: DataFrame, limit: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the newest ``limit`` messages of each project stay; limit <= 0: all."""
    aged = _newest(messages)
    keep = F.lit(True) if limit <= 0 else F.col("age") <= limit
    return aged.where(keep).drop("age"), aged.where(~keep).drop("age")


def _limit_of(limits: dict[int, int]):
    out = F.lit(20)
    for t, n in limits.items():
        out = F.when(F.col("prompt_type") == t, n).otherwise(out)
    return out


def _prompt_age(prompts: DataFrame) -> DataFrame:
    order = Window.partitionBy("project_id", "prompt_type", "is_favorite").orderBy(F.desc("last_used_at"), F.desc("created_at"), "prompt_id")
    return prompts.withColumn("age", F.row_number().over(order))


def prompt_library(prompts: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Prompts with section: all favourites, and the most recently used others up to the type's limit."""
    aged = _prompt_age(prompts)
    return aged.where(F.col("is_favorite") | (F.col("age") <= _limit_of(limits))).withColumn("section", F.when(F.col("is_favorite"), "favorite").otherwise("history"))


def prune_prompts(prompts: DataFrame, limits: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): non-favourites past the type's limit go."""
    aged = _prompt_age(prompts)
    gone = ~F.col("is_favorite") & (F.col("age") > _limit_of(limits))
    return aged.where(~gone).drop("age"), aged.where(gone).drop("age")


def last_used_prompt(prompts: DataFrame) -> DataFrame:
    """The newest prompt of each project and type."""
    order = Window.partitionBy("project_id", "prompt_type").orderBy(F.desc("last_used_at"), F.desc("created_at"), "prompt_id")
    return prompts.withColumn("age", F.row_number().over(order)).where("age = 1").drop("age")


def merge_prompt_usage(prompts: DataFrame, usage: DataFrame, max_chars: int = 16_000) -> DataFrame:
    """project_id, prompt_type, content, content_hash, is_favorite, last_used_at, created_at after the
    uses: trimmed, blank and over-long ones left out; equal content is one prompt, touched by each use."""
    text = trim_space(F.col("content"))
    used = usage.select("project_id", "prompt_type", text.alias("content"), F.col("used_at").alias("last_used_at"), F.col("used_at").alias("created_at"), F.lit(False).alias("is_favorite"))
    used = used.where((F.length("content") > 0) & (F.length("content") <= max_chars))
    every = prompts.select(used.columns).unionByName(used)
    return every.groupBy("project_id", "prompt_type", content_hash(F.col("content")).alias("content_hash"), "content").agg(
        F.bool_or("is_favorite").alias("is_favorite"), F.max("last_used_at").alias("last_used_at"), F.min("created_at").alias("created_at")
    )


def merge_prompt_collection(prompts: DataFrame, limits: dict[int, int]) -> DataFrame:
    """The library as one list per project and type: favourites, then history (place: no)."""
    lib = prompt_library(prompts, limits)
    order = Window.partitionBy("project_id", "prompt_type").orderBy("section", "age")
    return lib.withColumn("no", F.row_number().over(order)).drop("age")


#: Invitation states, fixed values.
PENDING, ACCEPTED, REVOKED, EXPIRED = range(4)


def latest_pending_invitation(invitations: DataFrame, now) -> DataFrame:
    """The newest pending invitation, not yet expired, of each address (case aside)."""
    order = Window.partitionBy(F.lower("email")).orderBy(F.desc("created_at"), "invitation_id")
    return invitations.where((F.col("status") == PENDING) & (F.col("expires_at") > now)).withColumn("age", F.row_number().over(order)).where("age = 1").drop("age")


def invitation_status(invitations: DataFrame, now) -> DataFrame:
    return invitations.withColumn("effective_status", F.when((F.col("status") == PENDING) & (F.col("expires_at") <= now), EXPIRED).otherwise(F.col("status")))
