"""Tenants, memberships, roles and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles, fixed values; a lower number is the stronger role.
OWNER, MANAGER, WORKSPACE_MANAGER, CONTRIBUTOR, REVIEWER, VIEWER = range(6)
#: Feature overrides of a project, fixed values.
DEFAULT, ENABLED, DISABLED = range(3)


def tenant_filter(tenants: DataFrame, ids: list | None = None, include_visible: bool = False, is_active: bool | None = None) -> DataFrame:
    """Ids given: those, and with include_visible the visible ones too; no ids: with include_visible
    the visible ones only."""
    out = tenants
    if ids is not None:
        hit = F.col("tenant_id").isin(list(ids)) if ids else F.lit(False)
        out = out.where(hit | F.col("is_visible_to_all") if include_visible else hit)
    elif include_visible:
        out = out.where("is_visible_to_all")
    return out if is_active is None else out.where(F.col("is_active") == is_active)


def accessible_tenants(users: DataFrame, memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """(user_id, tenant_id): all tenants for admins, else a user's own, else those visible to all."""
    admin = users.where("is_admin").select("user_id")
    plain = users.where("not is_admin").select("user_id")
    own = memberships.join(plain, "user_id", "left_semi").select("user_id", "tenant_id").distinct()
    none = plain.join(own, "user_id", "left_anti")
    # every pair of admin (or member of nothing) and tenant is the result itself; both meet on a constant key
    every = admin.withColumn("k", F.lit(1)).join(tenants.select("tenant_id", F.lit(1).alias("k")), "k").select("user_id", "tenant_id")
    seen = none.withColumn("k", F.lit(1)).join(tenants.where("is_visible_to_all").select("tenant_id", F.lit(1).alias("k")), "k").select("user_id", "tenant_id")
    return every.unionByName(own).unionByName(seen)


def role_permissions(scope: DataFrame) -> DataFrame:
    """Flags for each (user_id, tenant_id, is_admin, role, can_grant) in scope."""

    def upto(role: int) -> Column:
        return F.col("is_admin") | F.coalesce(F.col("role") <= role, F.lit(False))

    return scope.select(
        "user_id", "tenant_id",
        (F.col("is_admin") | (F.coalesce(F.col("role") <= MANAGER, F.lit(False)) & F.coalesce("can_grant", F.lit(False)))).alias("manage_members"),
        upto(WORKSPACE_MANAGER).alias("manage_workspaces"), upto(CONTRIBUTOR).alias("edit_projects"), upto(REVIEWER).alias("chat"),
    )


def members_report(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Members of each tenant with the granting user, if any; to be read by role, then email."""
    who = users.select("user_id", "email")
    by = users.select(F.col("user_id").alias("granted_by"), F.col("email").alias("granted_by_email"))
    return memberships.join(who, "user_id").join(by, "granted_by", "left").select("tenant_id", "user_id", "email", "role", "can_grant", "granted_by_email")


def owned_personal_tenants(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """(user_id, tenant_id) of personal tenants whose only member is the user."""
    one = memberships.groupBy("tenant_id").agg(F.count("*").alias("n"), F.min("user_id").alias("user_id")).where("n = 1")
    return one.join(tenants.where("is_personal").select("tenant_id"), "tenant_id", "left_semi").select("user_id", "tenant_id")


def members_by_role(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("tenant_id", "role").agg(F.count("*").alias("members"))


def last_owner_guard(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """tenant_id, owners of the tenants with one owner or none."""
    owners = memberships.where(F.col("role") == OWNER).groupBy("tenant_id").agg(F.count("*").alias("n"))
    return tenants.select("tenant_id").join(owners, "tenant_id", "left").select("tenant_id", F.coalesce("n", F.lit(0)).cast("long").alias("owners")).where("owners <= 1")


def membership_diff(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """user_id, tenant_id, change, role, can_grant: what is to be added (as viewers without grant) and removed."""
    on = ["user_id", "tenant_id"]
    add = desired.select(on).distinct().join(existing.select(on), on, "left_anti").select(*on, F.lit("add").alias("change"), F.lit(VIEWER).alias("role"), F.lit(False).alias("can_grant"))
    gone = existing.select(on).distinct().join(desired.select(on), on, "left_anti").select(*on, F.lit("remove").alias("change"), F.lit(None).cast("int").alias("role"), F.lit(None).cast("boolean").alias("can_grant"))
    return add.unionByName(gone)


def model_is_configured(models: DataFrame, connections: DataFrame) -> DataFrame:
    """Models with ``is_configured``: enabled, on an enabled connection with a provider, published if
    hosted, with a key if personal."""
    c = connections.select("connection_id", "scope", "provider", "has_key", F.col("is_enabled").alias("connection_enabled"))
    ok = F.col("is_enabled") & F.col("connection_enabled") & (F.col("provider") != 0) & F.when(F.col("scope") == "hosted", F.col("is_published")).otherwise(F.col("has_key"))
    return models.join(c, "connection_id", "left").withColumn("is_configured", F.coalesce(ok, F.lit(False))).select(*models.columns, "is_configured")


def effective_model(projects: DataFrame, workspaces: DataFrame, models: DataFrame, check: bool = True) -> DataFrame:
    """project_id, model_id: the project's own model if its override is Enabled, none if Disabled,
    else the workspace's if that has the feature. With ``check`` a model must be configured."""
    good = models.where("is_configured").select("model_id")
    w = workspaces.select("workspace_id", F.when(F.col("is_rag_enabled"), F.col("rag_model_id")).alias("workspace_model"))
    j = projects.join(w, "workspace_id", "left")
    own = j.join(good.withColumnRenamed("model_id", "rag_model_id").withColumn("own_ok", F.lit(True)), "rag_model_id", "left")
    both = own.join(good.withColumnRenamed("model_id", "workspace_model").withColumn("workspace_ok", F.lit(True)), "workspace_model", "left")
    mine = F.when(F.col("own_ok"), F.col("rag_model_id")) if check else F.col("rag_model_id")
    theirs = F.when(F.col("workspace_ok"), F.col("workspace_model"))
    model = F.when(F.col("rag_override") == ENABLED, mine).when(F.col("rag_override") == DISABLED, F.lit(None).cast("long")).otherwise(theirs)
    return both.select("project_id", model.alias("model_id"))


def model_usage(projects: DataFrame) -> DataFrame:
    """model_id, rag_override, projects that name the model."""
    return projects.where("rag_model_id is not null").groupBy(F.col("rag_model_id").alias("model_id"), "rag_override").agg(F.count("*").alias("projects"))
