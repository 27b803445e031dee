"""Named queries on the hierarchy: access, usage, history, lifecycle, admission, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import access, admission, chunking, containers, history, index, lifecycle, trees, usage
from ..params import ContainerLimits, UsageLimits
from ..shared import fresh_path, keep
from ..streaming import stateful, streams
from .tables import ctes, raw, view

LIMITS = {0: 1, 1: 3}


def _now(spark, d):
    """The middle of the events' time."""
    return F.lit(raw(spark, d, "events").agg((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))).alias("n")).first()[0] // 2)


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def f2_selectable_documents(spark, d):
    return index.selectable_documents(view(spark, d, "documents")).select("document_id", "state")


def f3_tenant_filter(spark, d):
    t = view(spark, d, "tenants")
    a = access.tenant_filter(t, [1, 3], True).select("tenant_id", F.lit("ids or visible").alias("ask"))
    b = access.tenant_filter(t, [1, 3, 4], False, True).select("tenant_id", F.lit("active ids").alias("ask"))
    return a.unionByName(b).unionByName(access.tenant_filter(t, None, True).select("tenant_id", F.lit("visible").alias("ask")))


def _dated_projects(spark, d):
    """Projects with an expiry in microseconds: their preset after their first order (or none)."""
    first = view(spark, d, "documents").groupBy("project_id").agg(F.min(_micros("created_at")).alias("start"))
    return view(spark, d, "projects").join(first, "project_id").withColumn("lifetime_expires_at", F.col("start") + F.col("lifetime_preset") * F.lit(3_600_000_000))


def f4_expired_projects(spark, d):
    now = _dated_projects(spark, d).agg(F.avg("lifetime_expires_at").cast("long")).first()[0]
    return lifecycle.expired_projects(_dated_projects(spark, d), F.lit(now)).select("project_id", "lifetime_expires_at")


def f5_role_permissions(spark, d):
    scope = view(spark, d, "memberships").join(view(spark, d, "users").select("user_id", "is_admin"), "user_id")
    return access.role_permissions(scope)


def f6_model_is_configured(spark, d):
    return access.model_is_configured(view(spark, d, "models"), view(spark, d, "connections")).select("model_id", "is_configured")


def _manifest(spark, d):
    from .text_queries import headers_of

    h = headers_of(spark, d)
    return view(spark, d, "documents").join(h.select((F.col("doc_id")).alias("document_id"), "header"), "document_id").withColumn("size_bytes", F.when(F.col("document_id") % 17 == 0, 0).otherwise(F.col("size_bytes") * 100))


def f7_upload_gate(spark, d):
    return admission.upload_gate(_manifest(spark, d)).select("document_id", "accepted", "reason", "normalized_type")


def f8_ocr_needed(spark, d):
    return chunking.ocr_needed(view(spark, d, "pages_text").select(F.col("document_id").alias("n"), F.col("document_id").alias("document_id"), "text"))


def j1_hierarchy(spark, d):
    rows = index.chunks_with_hierarchy(view(spark, d, "chunks").drop("tag"), view(spark, d, "documents"), view(spark, d, "projects"), view(spark, d, "workspaces"))
    return rows.groupBy("tenant_id", "workspace_id").agg(F.count("*").alias("chunks"), F.count_distinct("project_id").alias("projects"))


def _models(spark, d):
    return access.model_is_configured(view(spark, d, "models"), view(spark, d, "connections"))


def j2_effective_model(spark, d):
    return access.effective_model(view(spark, d, "projects"), view(spark, d, "workspaces"), _models(spark, d))


def j3_accessible_tenants(spark, d):
    return access.accessible_tenants(view(spark, d, "users"), view(spark, d, "memberships"), view(spark, d, "tenants"))


def j4_already_ingested(spark, d):
    work = view(spark, d, "documents").select("document_id", "version", (F.col("project_id") % 3).alias("index_version"))
    ledger = work.where("document_id % 4 = 0").unionByName(work.where("document_id % 4 = 1").withColumn("version", F.col("version") + 1))
    return index.already_ingested(work, ledger).groupBy("index_version").agg(F.count("*").alias("n"), F.sum("document_id").alias("ids"))


def _requests(spark, d):
    ids = view(spark, d, "documents").where("project_id % 3 <> 0 and document_id % 5 = 0").groupBy("project_id").agg(F.collect_list("document_id").alias("document_ids"))
    return view(spark, d, "projects").select(F.col("project_id").alias("request_id"), "project_id").join(ids, "project_id", "left")


def j5_invalid_selection(spark, d):
    return index.invalid_selection(_requests(spark, d), view(spark, d, "documents"))


def j6_members_report(spark, d):
    return access.members_report(view(spark, d, "memberships"), view(spark, d, "users"))


def j7_owned_personal_tenants(spark, d):
    m = view(spark, d, "projects").select((F.col("project_id") % 500).alias("tenant_id"), F.col("project_id").alias("user_id"))
    t = view(spark, d, "projects").select((F.col("project_id") % 700).alias("tenant_id"), (F.col("project_id") % 2 == 0).alias("is_personal")).where("is_personal").distinct()
    return access.owned_personal_tenants(m, t)


def a1_tenants_per_user(spark, d):
    return usage.tenants_per_user(view(spark, d, "memberships"))


def a2_workspaces_per_user(spark, d):
    return usage.workspaces_per_user(view(spark, d, "memberships"), view(spark, d, "workspaces"))


def a3_projects_per_workspace(spark, d):
    return usage.projects_per_workspace(view(spark, d, "projects"), 2)


def a4_documents_per_workspace(spark, d):
    return usage.documents_per_workspace(view(spark, d, "documents"), view(spark, d, "projects"))


def _storage(spark, d):
    t = [view(spark, d, n) for n in ("documents", "projects", "workspaces", "memberships")]
    out = None
    for level in ("workspace", "tenant", "user"):
        one = usage.storage_by(level, *t).select(F.lit(level).alias("scope"), "key", "used")
        out = one if out is None else out.unionByName(one)
    return out


def a5_storage(spark, d):
    return _storage(spark, d)


def a6_quota_report(spark, d):
    m, w, p = view(spark, d, "memberships"), view(spark, d, "workspaces"), view(spark, d, "projects")
    per = usage.projects_per_workspace(p)
    rows = [
        usage.tenants_per_user(m).select(F.lit("user").alias("scope"), F.col("user_id").alias("key"), F.lit("tenants").alias("metric"), "used"),
        usage.workspaces_per_user(m, w).select(F.lit("user").alias("scope"), F.col("user_id").alias("key"), F.lit("workspaces").alias("metric"), "used"),
        usage.documents_per_workspace(view(spark, d, "documents"), p).select(F.lit("workspace").alias("scope"), F.col("workspace_id").alias("key"), F.lit("documents").alias("metric"), "used"),
        per.select(F.lit("workspace").alias("scope"), F.col("workspace_id").alias("key"), F.lit("projects").alias("metric"), F.col("projects").alias("used")),
        per.select(F.lit("workspace").alias("scope"), F.col("workspace_id").alias("key"), F.lit("permanent_projects").alias("metric"), F.col("permanent_projects").alias("used")),
        p.where("lifetime_preset is not null").select(F.lit("project").alias("scope"), F.col("project_id").alias("key"), F.lit("temporary_hours").alias("metric"), F.col("lifetime_preset").cast("long").alias("used")),
        _storage(spark, d).select("scope", "key", F.lit("storage_bytes").alias("metric"), F.col("used") * 10),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return usage.quota_report(out, UsageLimits(), upload_bytes=1000)


def a7_extraction_stats(spark, d):
    return usage.extraction_stats_by_root(view(spark, d, "tree"))


def a8_project_dashboard(spark, d):
    b = usage.project_dashboard(view(spark, d, "projects"), view(spark, d, "workspaces"), view(spark, d, "tenants"), view(spark, d, "documents"), view(spark, d, "messages"))
    return usage.sort_dashboard(b.withColumn("last_message", _micros("last_message")), "recent")


def a9_workspace_dashboard(spark, d):
    return usage.workspace_dashboard(view(spark, d, "workspaces"), view(spark, d, "projects"), view(spark, d, "documents"))


def a10_members_by_role(spark, d):
    return access.members_by_role(view(spark, d, "memberships"))


def a10_last_owner_guard(spark, d):
    return access.last_owner_guard(view(spark, d, "memberships").where("tenant_id <> 4 or user_id = 1"), view(spark, d, "tenants"))


def a11_job_outcomes(spark, d):
    return usage.job_outcomes(view(spark, d, "jobs"))


def a12_audit_summary(spark, d):
    rows = usage.audit_summary(raw(spark, d, "events").withColumn("created_at", _micros("ts")))
    return rows


def a13_model_usage(spark, d):
    return access.model_usage(view(spark, d, "projects"))


def k1_recent_chat(spark, d):
    return history.recent_chat(view(spark, d, "messages"), 10).select("project_id", "message_id", "no")


def k2_prune_chat(spark, d):
    kept, gone = history.prune_chat(view(spark, d, "messages"), 30)
    return kept.select("message_id", F.lit(True).alias("kept")).unionByName(gone.select("message_id", F.lit(False).alias("kept")))


def k3_prompt_library(spark, d):
    return history.prompt_library(view(spark, d, "prompts"), LIMITS).select("prompt_id", "section", "age")


def k4_prune_prompts(spark, d):
    kept, gone = history.prune_prompts(view(spark, d, "prompts"), LIMITS)
    return kept.select("prompt_id", F.lit(True).alias("kept")).unionByName(gone.select("prompt_id", F.lit(False).alias("kept")))


def k5_last_used_prompt(spark, d):
    return history.last_used_prompt(view(spark, d, "prompts")).select("project_id", "prompt_type", "prompt_id")


def k6_merge_prompt_usage(spark, d):
    p = view(spark, d, "prompts")
    uses = p.where("prompt_id % 3 = 0").select("project_id", "prompt_type", F.concat(F.lit("  "), F.col("content"), F.lit("\n")).alias("content"), (F.col("last_used_at") + 5).alias("used_at"))
    more = p.where("prompt_id % 7 = 0").select("project_id", F.lit(2).alias("prompt_type"), "content", F.col("last_used_at").alias("used_at"))
    return history.merge_prompt_usage(p, uses.unionByName(more), 2000).select("project_id", "prompt_type", "content_hash", "is_favorite", "last_used_at", "created_at")


def _invitations(spark, d):
    i = view(spark, d, "invitations").withColumn("created_at", _micros("created_at"))
    return i.withColumn("expires_at", F.col("created_at") + F.col("invitation_id") % 20 * F.lit(86_400_000_000))


def k7_latest_invitation(spark, d):
    return history.latest_pending_invitation(_invitations(spark, d), _now(spark, d)).select("invitation_id", "email")


def k7_invitation_status(spark, d):
    return history.invitation_status(_invitations(spark, d), _now(spark, d)).groupBy("status", "effective_status").agg(F.count("*").alias("n"))


def k8_tree_order(spark, d):
    t = trees.tree_order(view(spark, d, "tree"))
    return t.select("project_id", "document_id", "depth", F.array_join(F.transform("path", lambda s: s["name"]), "/").alias("path"))


def u1_prompt_collection(spark, d):
    return history.merge_prompt_collection(view(spark, d, "prompts"), LIMITS).select("project_id", "prompt_type", "prompt_id", "no")


def u2_membership_diff(spark, d):
    m = view(spark, d, "memberships")
    desired = m.where("user_id % 3 <> 0").select("user_id", "tenant_id").unionByName(m.where("user_id % 4 = 0").select("user_id", ((F.col("tenant_id") + 1) % 5).alias("tenant_id")))
    return access.membership_diff(m, desired)


def u3_selection_intersect(spark, d):
    picked = view(spark, d, "documents").where("document_id % 2 = 0").select("project_id", "document_id")
    return index.selection_intersect(picked, view(spark, d, "documents"))


def u4_descendants(spark, d):
    t = view(spark, d, "tree")
    return trees.descendants(t, t.where("document_id % 64 in (1, 5) or document_id % 640 = 0").select("document_id"))


def _grants(spark, d):
    return raw(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("tenant_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 10 != 0, F.floor(F.col("c_custkey") / 2).cast("long")).alias("granted_by"))


def u5_revoke_closure(spark, d):
    g = _grants(spark, d).withColumn("tenant_id", F.col("tenant_id") % 2)
    return trees.revoke_closure(g, g.where("user_id % 50 = 0").select("tenant_id", "user_id"))


def u6_reindex_plan(spark, d):
    p, w, m = view(spark, d, "projects"), view(spark, d, "workspaces"), _models(spark, d)
    old, new = access.effective_model(p, w, m, check=False), access.effective_model(p, w.withColumn("rag_model_id", F.col("rag_model_id") + 1), m, check=False)
    plan = lifecycle.reindex_plan(p, old, new, view(spark, d, "documents"), view(spark, d, "chunks"))
    drop = plan["chunks"].join(view(spark, d, "documents").select("document_id", "project_id"), "document_id").groupBy("project_id").agg(F.count("*").alias("chunks"))
    again = plan["requeue"].groupBy("project_id").agg(F.count("*").alias("requeue"))
    return plan["projects"].select("project_id", "index_version").join(drop, "project_id", "left").join(again, "project_id", "left")


def u6_without_model(spark, d):
    gone = view(spark, d, "models").where("model_id % 10 = 1").select("model_id")
    return lifecycle.without_model(view(spark, d, "projects"), gone).select("project_id", "rag_model_id", "rag_override")


def _plan_rows(plan):
    return plan["documents"].groupBy("project_id").agg(F.count("*").alias("documents")).join(plan["storage_keys"].groupBy("project_id").agg(F.count("*").alias("keys")), "project_id", "left")


def u7_project_delete_plan(spark, d):
    p = view(spark, d, "projects").where("project_id % 7 = 0")
    plan = lifecycle.project_delete_plan(p, view(spark, d, "documents"), view(spark, d, "chunks"))
    chunks = plan["chunks"].join(view(spark, d, "documents").select("document_id", "project_id"), "document_id").groupBy("project_id").agg(F.count("*").alias("chunks"))
    return _plan_rows(plan).join(chunks, "project_id", "left")


def w7_expiry_sweep(spark, d):
    now = _dated_projects(spark, d).agg(F.avg("lifetime_expires_at").cast("long")).first()[0]
    return _plan_rows(lifecycle.expiry_sweep(_dated_projects(spark, d), view(spark, d, "documents"), view(spark, d, "chunks"), F.lit(now)))


ENTRY = """SELECT CAST(l_orderkey % 500 AS BIGINT) AS root_id, CAST(l_orderkey AS BIGINT) AS container_id, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS ordinal,
  CASE l_partkey % 6 WHEN 0 THEN '/docs/readme.txt' WHEN 1 THEN 'tool.exe' WHEN 2 THEN 'in\\\\side.zip' WHEN 3 THEN ' ' WHEN 4 THEN 'a.pdf' ELSE 'mail.eml' END AS path,
  CAST(l_quantity AS BIGINT) * 300000 AS size_bytes, l_suppkey % 25 = 0 AS is_encrypted, CAST(l_orderkey % 4 AS INT) AS container_level FROM {lineitem}"""


def q1_admit_entries(spark, d):
    e = spark.sql(ENTRY, lineitem=raw(spark, d, "lineitem"))
    stats = e.select("root_id").distinct().select("root_id", (F.col("root_id") % 3).alias("root_files"), F.lit(0).cast("long").alias("root_bytes"))
    e = e.join(stats, "root_id").withColumn("container_order", F.col("container_id")).withColumn("container_path", F.lit("")).withColumn("stored_paths", F.array().cast("array<string>"))
    return containers.admit_container_entries(e, ContainerLimits(max_depth=3, max_files=40)).select("root_id", "container_id", "ordinal", "container_path", "size_bytes", "state", "extraction_state", "has_warnings")


def q2_free_path(spark, d):
    """Line items as entries of their order's container, with few names in changing case."""
    e = raw(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("container_id"), F.expr("CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey").alias("ordinal"),
        F.expr("concat(CASE WHEN l_partkey % 2 = 0 THEN '/in' ELSE 'in\\\\in' END, CASE WHEN l_suppkey % 2 = 0 THEN '/Doc' ELSE '/doc' END, CASE l_suppkey % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' ELSE '' END)").alias("path"),
    )
    return containers.unique_paths(e).select("container_id", "ordinal", "unique_path")


def q3_upload_outcomes(spark, d):
    gated = admission.upload_gate(_manifest(spark, d))
    scans = raw(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "infected").otherwise("clean").alias("verdict"))
    return admission.upload_outcomes(gated, scans)


def q3_audit_rows(spark, d):
    return admission.audit_rows(q3_upload_outcomes(spark, d)).groupBy("event_type", "state").agg(F.count("*").alias("n"))


def w1_ingest_batch(spark, d):
    docs = view(spark, d, "documents").withColumn("index_version", F.lit(1))
    queued = raw(spark, d, "events").select(F.col("event_id").alias("document_id"))
    ledger = docs.where("document_id % 3 = 0").select("document_id", "version", "index_version")
    work, jobs = streams.ingest_batch(queued, docs, ledger)
    return jobs.join(work.select("document_id", F.lit(True).alias("ingest")), "document_id", "left").select("document_id", "result", "state", F.coalesce("ingest", F.lit(False)).alias("ingest"))


def _ingest_documents(spark, d):
    """Documents of the stand-in catalog with their texts: some barred, some without text."""
    n = F.col("document_id")
    state = F.when(n % 11 == 0, index.QUARANTINED).when(n % 13 == 0, index.REJECTED).otherwise(index.QUEUED)
    return view(spark, d, "pages_text").select("document_id", F.lit(1).alias("version"), F.lit(1).alias("index_version"), state.alias("state"), F.when(n % 17 != 0, F.col("text")).alias("text"))


def w1_ingest_stream(spark, d):
    """Two runs of the stream, the second from the first one's state: documents of even number are queued
    first, then all of them and some unknown ones. What failed is released and tried again."""
    docs = keep(_ingest_documents(spark, d), "documents")
    chunks = chunking.chunk_single_pages(docs.withColumn("page_number", F.lit(1)))
    uid = text.chunk_uid(F.col("document_id"), F.lit(1), F.col("chunk_index"))
    vectors = keep(chunks.where("document_id % 19 <> 0 or chunk_index <> 0").select(uid.alias("chunk_uid"), F.array(F.lit(1.0).cast("float"), F.length("content").cast("float")).alias("embedding")), "vectors")
    queue, out, checkpoint = fresh_path(spark, "queue"), fresh_path(spark, "ingested"), fresh_path(spark, "progress")
    ids = docs.select("document_id", F.lit(False).alias("release"))
    unknown = ids.where("document_id % 23 = 0").withColumn("document_id", F.col("document_id") + 1_000_000_000)
    for queued in (ids.where("document_id % 2 = 0"), ids.unionByName(unknown)):
        queued.write.mode("append").parquet(queue)
        stream = spark.readStream.schema(ids.schema).option("recursiveFileLookup", "true").parquet(queue)
        writer = stateful.ingest_stream(stream, docs, lambda w: stateful.ingest_documents(w, vectors), out, checkpoint, f"{queue}/released")
        writer.trigger(availableNow=True).start().awaitTermination()
    jobs = spark.read.parquet(f"{out}/jobs").groupBy("document_id", "result", "state").agg(F.count("*").alias("jobs"))
    made = spark.read.parquet(f"{out}/chunks").groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.sum(F.length("content")).alias("characters"))
    return jobs.join(made, "document_id", "left")


def _folder(df):
    """Where a kept table lies."""
    return df.inputFiles()[0].rpartition("/")[0]


def w2_job_outcome_windows(spark, d):
    rows = streams.job_outcome_stream(view(spark, d, "jobs").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return rows.select(F.unix_micros("window_start").alias("window_start"), "job_type", "result", "jobs")


def w5_retry_route(spark, d):
    f = raw(spark, d, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("document_id"), (F.col("user_id") % 6).cast("int").alias("retry"))
    return streams.retry_route(f).groupBy("route", "next_retry").agg(F.count("*").alias("n"))


def w5_retry_router(spark, d):
    """The stream form with its two sinks."""
    f = keep(raw(spark, d, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("document_id"), (F.col("user_id") % 6).cast("int").alias("retry")), "failures")
    out, checkpoint = fresh_path(spark, "routed"), fresh_path(spark, "progress")
    streams.retry_router(spark.readStream.schema(f.schema).parquet(_folder(f)), out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    both = spark.read.parquet(f"{out}/retry").unionByName(spark.read.parquet(f"{out}/dead_letter"))
    return both.groupBy("route", "next_retry").agg(F.count("*").alias("n"))


def _lives(activity):
    """Projects that begin with their first event and live for 12 to 48 hours, or have no lifetime."""
    hours = (F.col("project_id") % 5 * 12).cast("int")
    return activity.groupBy("project_id").agg(F.min("ts").alias("created_at")).withColumn("hours", F.when(hours > 0, hours))


def w6_project_lifetimes(spark, d):
    a = raw(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("ts").cast("timestamp").alias("ts"))
    return lifecycle.project_lifetimes(_lives(a), a).select("project_id", F.unix_micros("lifetime_expires_at").alias("expires_at"))


#: Hours by which some events of the lifetime stream come too late, and for which it waits.
LATE, WAIT = 24, 72


def w6_expiry_stream(spark, d):
    """The stream form with timers: events arrive in three parts, a third of them a day late. Lives that end
    before the last watermark are reported."""
    events = raw(spark, d, "events").select("event_id", F.col("user_id").alias("project_id"), F.col("ts").cast("timestamp").alias("ts"))
    projects = keep(_lives(events), "projects")
    ends = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    hour = 3_600_000_000
    part = F.floor((F.unix_micros("ts") + F.when(F.col("event_id") % 3 == 0, LATE * hour).otherwise(0) - ends["a"]) * 3 / (ends["b"] - ends["a"] + LATE * hour + 1))
    source, out, checkpoint = fresh_path(spark, "activity"), fresh_path(spark, "expired"), fresh_path(spark, "progress")
    for k in range(3):
        events.where(part == k).select("project_id", "ts").write.mode("append").parquet(source)
        stream = spark.readStream.schema("project_id long, ts timestamp").parquet(source)
        expired = stateful.expiry_stream(stream, projects, f"{WAIT} hours")
        stateful.sweep_stream(expired, lambda p: {"projects": p}, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/expired").select("project_id", "expires_at")


def _streamed(spark, d, transform, schema_of):
    """The rows that a stream over the events (all that is there, then it ends) appends."""
    out = fresh_path(spark, "stream")
    stateful.rocksdb(spark)
    events = spark.readStream.schema(raw(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = transform(events.withColumn("ts", F.col("ts").cast("timestamp")))
    q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema_of).parquet(f"{out}/rows")


def w3_idempotent_stream(spark, d):
    """The keys that are processed: each job key once, however often it comes."""
    key = F.concat_ws(":", F.col("user_id") % 40, "event_type")
    return _streamed(spark, d, lambda e: streams.idempotent_stream(e.select("ts", key.alias("job_key")), "job_key").select("job_key"), "job_key string")


def w4_context_dedupe(spark, d):
    """Requests that are not answered from the cache, by their key; all come within one batch."""
    return _streamed(spark, d, lambda e: streams.context_request_dedupe(e.select("ts", F.sha2(F.col("props"), 256).alias("cache_key"))).select("cache_key"), "cache_key string")


QUERIES = {f.__name__: f for f in (
    f2_selectable_documents, f3_tenant_filter, f4_expired_projects, f5_role_permissions, f6_model_is_configured, f7_upload_gate, f8_ocr_needed, j1_hierarchy, j2_effective_model,
    j3_accessible_tenants, j4_already_ingested, j5_invalid_selection, j6_members_report, j7_owned_personal_tenants, a1_tenants_per_user, a2_workspaces_per_user,
    a3_projects_per_workspace, a4_documents_per_workspace, a5_storage, a6_quota_report, a7_extraction_stats, a8_project_dashboard, a9_workspace_dashboard, a10_members_by_role,
    a10_last_owner_guard, a11_job_outcomes, a12_audit_summary, a13_model_usage, k1_recent_chat, k2_prune_chat, k3_prompt_library, k4_prune_prompts, k5_last_used_prompt,
    k6_merge_prompt_usage, k7_latest_invitation, k7_invitation_status, k8_tree_order, u1_prompt_collection, u2_membership_diff, u3_selection_intersect, u4_descendants,
    u5_revoke_closure, u6_reindex_plan, u6_without_model, u7_project_delete_plan, w7_expiry_sweep, q1_admit_entries, q2_free_path, q3_upload_outcomes, q3_audit_rows, w1_ingest_batch,
    w1_ingest_stream, w2_job_outcome_windows, w3_idempotent_stream, w4_context_dedupe, w5_retry_route, w5_retry_router, w6_project_lifetimes, w6_expiry_stream,
)}
