"""Usage, quotas and dashboards: one grouped pass each, aggregated before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import GIB, UsageLimits
from .index import COMPLETED, FAILED, PROCESSING, QUEUED, UPLOADED


def tenants_per_user(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("user_id").agg(F.count_distinct("tenant_id").alias("used"))


def workspaces_per_user(memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Workspaces in any of a user's tenants."""
    per_tenant = workspaces.groupBy("tenant_id").agg(F.count("*").alias("n"))
    return memberships.select("user_id", "tenant_id").distinct().join(per_tenant, "tenant_id").groupBy("user_id").agg(F.sum("n").alias("used"))


def projects_per_workspace(projects: DataFrame, excluded: int | None = None) -> DataFrame:
    """workspace_id, projects, permanent_projects (``excluded``: a project the latter leaves out)."""
    permanent = F.col("lifetime_preset").isNull()
    if excluded is not None:
        permanent &= F.col("project_id") != excluded
    return projects.groupBy("workspace_id").agg(F.count("*").alias("projects"), F.count_if(permanent).alias("permanent_projects"))


def documents_per_workspace(documents: DataFrame, projects: DataFrame) -> DataFrame:
    per_project = documents.groupBy("project_id").agg(F.count("*").alias("n"))
    return per_project.join(projects.select("project_id", "workspace_id"), "project_id").groupBy("workspace_id").agg(F.sum("n").alias("used"))


def storage_by(level: str, documents: DataFrame, projects: DataFrame, workspaces: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """key, used (bytes) by 'workspace', 'tenant' or 'user' (all documents in any of a user's tenants,
    each once). Sizes are summed by project, then by tenant, before memberships fan out."""
    sizes = documents.groupBy("project_id").agg(F.sum("size_bytes").alias("b")).join(projects.select("project_id", "workspace_id"), "project_id")
    by_workspace = sizes.groupBy("workspace_id").agg(F.sum("b").alias("b"))
    every = workspaces.select("workspace_id", "tenant_id").join(by_workspace, "workspace_id", "left")
    if level == "workspace":
        return every.select(F.col("workspace_id").alias("key"), F.coalesce("b", F.lit(0)).alias("used"))
    by_tenant = every.groupBy("tenant_id").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("used"))
    if level == "tenant":
        return by_tenant.withColumnRenamed("tenant_id", "key")
    return memberships.select("user_id", "tenant_id").distinct().join(by_tenant, "tenant_id", "left").groupBy(F.col("user_id").alias("key")).agg(F.coalesce(F.sum("used"), F.lit(0)).alias("used"))


def quota_report(usage: DataFrame, limits: UsageLimits, upload_bytes: int = 0) -> DataFrame:
    """scope, key, metric, used, quota, blocked. usage: (scope, key, metric, used).

    Counts block at the quota; storage blocks when used and the upload exceed it (an upload of
    no bytes never does); temporary hours block above the maximum; no quota never blocks.
    """
    counts = {
        "tenants": limits.tenants_per_user, "workspaces": limits.workspaces_per_user, "documents": limits.documents_per_workspace,
        "projects": limits.projects_per_workspace, "permanent_projects": limits.permanent_projects_per_workspace,
    }
    storage = {"user": limits.storage_per_user_gb, "tenant": limits.storage_per_tenant_gb, "workspace": limits.storage_per_workspace_gb}
    quota = F.lit(None).cast("long")
    for metric, n in counts.items():
        quota = F.when(F.col("metric") == metric, F.lit(n).cast("long")).otherwise(quota)
    for scope, gb in storage.items():
        quota = F.when((F.col("metric") == "storage_bytes") & (F.col("scope") == scope), F.lit(None if gb is None else gb * GIB).cast("long")).otherwise(quota)
    quota = F.when(F.col("metric") == "temporary_hours", F.lit(limits.max_temporary_hours).cast("long")).otherwise(quota)
    over = (
        F.when(F.col("metric") == "storage_bytes", F.lit(upload_bytes > 0) & (F.col("used") + upload_bytes > F.col("quota")))
        .when(F.col("metric") == "temporary_hours", F.col("used") > F.col("quota"))
        .otherwise(F.col("used") >= F.col("quota"))
    )
    return usage.select("scope", "key", "metric", "used").withColumn("quota", quota).withColumn("blocked", F.coalesce(over, F.lit(False)))


def extraction_stats_by_root(documents: DataFrame) -> DataFrame:
    """root_container_id, files, bytes of what was taken out of each root container."""
    return documents.where("root_container_id is not null").groupBy("root_container_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def project_dashboard(projects: DataFrame, workspaces: DataFrame, tenants: DataFrame, documents: DataFrame, messages: DataFrame, history_limit: int = 30) -> DataFrame:
    """A row per project: document counts by outcome, chat count (capped at the history kept), time of
    the last message, names, and a status, the first that holds."""

    def among(*states):
        return F.count_if(F.col("state").isin(*states))

    docs = documents.groupBy("project_id").agg(F.count("*").alias("total"), among(COMPLETED).alias("indexed"), among(FAILED).alias("failed"), among(UPLOADED, QUEUED, PROCESSING).alias("processing"))
    chat = messages.groupBy("project_id").agg(F.least(F.count("*"), F.lit(history_limit)).alias("chats"), F.max("message_timestamp").alias("last_message"))
    names = workspaces.select("workspace_id", "tenant_id", F.col("name").alias("workspace_name")).join(tenants.select("tenant_id", F.col("name").alias("tenant_name")), "tenant_id", "left")
    j = projects.select("project_id", "workspace_id", "name").join(docs, "project_id", "left").join(chat, "project_id", "left").join(names, "workspace_id", "left").na.fill(0, ["total", "indexed", "failed", "processing", "chats"])
    status = F.when(F.col("total") == 0, "Empty").when(F.col("failed") > 0, "Has failures").when(F.col("processing") > 0, "Processing").when(F.col("indexed") == F.col("total"), "All indexed").otherwise("Partial")
    return j.select("project_id", "name", F.coalesce("workspace_name", F.lit("-")).alias("workspace_name"), F.coalesce("tenant_name", F.lit("-")).alias("tenant_name"), "total", "indexed", "failed", "processing", "chats", "last_message", status.alias("status"))


#: Sort orders of the dashboard; the name, then the id, settle ties.
DASHBOARD_ORDERS = {
    "name": ["name"],
    "documents": ["-total", "name"],
    "failures": ["-failed", "name"],
    "status": ["status", "name"],
    "recent": ["-last_message", "name"],
}


def sort_dashboard(dashboard: DataFrame, order: str = "name") -> DataFrame:
    keys = [F.desc_nulls_last(k[1:]) if k[0] == "-" else F.asc(k) for k in DASHBOARD_ORDERS[order]]
    return dashboard.orderBy(*keys, "project_id")


def workspace_dashboard(workspaces: DataFrame, projects: DataFrame, documents: DataFrame) -> DataFrame:
    """workspace_id, name, projects, documents, documents_per_project (the most of a project)."""
    docs = documents.groupBy("project_id").agg(F.count("*").alias("n"))
    per = projects.select("project_id", "workspace_id").join(docs, "project_id", "left").groupBy("workspace_id").agg(F.count("*").alias("projects"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_project"))
    return workspaces.select("workspace_id", "name").join(per, "workspace_id", "left").na.fill(0, ["projects", "documents", "largest_project"])


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """job_type, result, jobs. Results: completed, failed, skipped_security."""
    return jobs.groupBy("job_type", "result").agg(F.count("*").alias("jobs"))


def audit_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
