"""The catalog tables as views of the given star schema, in SQL that both engines read.

Tenants are regions, workspaces nations, projects customers, documents orders, chunks and
container entries line items, users suppliers, models parts, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAND_INS = {
    "tenants": "SELECT CAST(r_regionkey AS BIGINT) AS tenant_id, r_name AS name, r_regionkey <> 4 AS is_active, r_regionkey % 2 = 0 AS is_visible_to_all, r_regionkey >= 3 AS is_personal FROM {region}",
    "workspaces": "SELECT CAST(n_nationkey AS BIGINT) AS workspace_id, CAST(n_regionkey AS BIGINT) AS tenant_id, n_name AS name, n_nationkey % 2 = 0 AS is_rag_enabled, CAST(n_nationkey * 7 % 200 AS BIGINT) AS rag_model_id FROM {nation}",
    "projects": """SELECT c_custkey AS project_id, CAST(c_nationkey AS BIGINT) AS workspace_id, c_name AS name,
        CASE c_mktsegment WHEN 'BUILDING' THEN 24 WHEN 'AUTOMOBILE' THEN 168 WHEN 'MACHINERY' THEN 720 WHEN 'HOUSEHOLD' THEN 2160 END AS lifetime_preset,
        CAST(c_custkey % 3 AS INT) AS rag_override, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 200 END AS rag_model_id,
        CAST(1 + c_custkey % 3 AS INT) AS index_version FROM {customer}""",
    "documents": """SELECT o_orderkey AS document_id, o_custkey AS project_id,
        concat('file', CAST(o_orderkey AS STRING), CASE o_orderkey % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.EML' WHEN 4 THEN '.docx' WHEN 5 THEN '.exe' WHEN 6 THEN '' ELSE '.html' END) AS file_name,
        CASE o_orderkey % 7 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'Text/Plain; charset=utf-8' WHEN 2 THEN 'application/zip' WHEN 3 THEN 'image/png' WHEN 4 THEN '' WHEN 5 THEN 'application/x-unknown' END AS content_type,
        CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
        CAST(CASE WHEN o_orderkey % 11 = 0 THEN 5 WHEN o_orderkey % 13 = 0 THEN 6 WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'P' THEN 2 WHEN o_orderkey % 3 = 0 THEN 4 ELSE 1 END AS INT) AS state,
        CASE WHEN o_orderkey % 9 <> 0 THEN concat('blob/', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 2 = 0 THEN ' ' END AS storage_key,
        CAST(1 AS INT) AS version, o_orderdate AS created_at FROM {orders}""",
    "tree": """SELECT o_orderkey AS document_id, o_orderkey - o_orderkey % 64 AS project_id,
        CASE WHEN o_orderkey % 64 > 0 THEN o_orderkey - o_orderkey % 64 + CAST(floor(o_orderkey % 64 / 4) AS BIGINT) END AS parent_id,
        concat('f', CAST(o_orderkey * 7919 % 10 AS STRING)) AS file_name, o_orderkey - o_orderkey % 64 AS root_container_id, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM {orders}""",
    "chunks": "SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, l_partkey AS tag, CAST(l_suppkey % 3 AS INT) AS index_version FROM {lineitem}",
    "users": "SELECT s_suppkey AS user_id, concat(lower(replace(s_name, '#', '')), '@example.org') AS email, s_suppkey % 10 = 0 AS is_admin FROM {supplier}",
    "memberships": """SELECT s_suppkey AS user_id, CAST(s_nationkey % 4 AS BIGINT) AS tenant_id, CAST(s_suppkey % 6 AS INT) AS role, s_suppkey % 2 = 0 AS can_grant,
        CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey - 1 END AS granted_by FROM {supplier} WHERE s_suppkey % 9 <> 0
        UNION ALL SELECT s_suppkey, CAST(4 AS BIGINT), CAST(0 AS INT), true, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END FROM {supplier} WHERE s_suppkey % 9 <> 0 AND s_suppkey % 5 = 1""",
    "models": """SELECT p_partkey AS model_id, p_brand AS connection_id, p_size % 4 <> 0 AS is_enabled, p_size % 3 <> 0 AS is_published FROM {part}""",
    "connections": """SELECT DISTINCT p_brand AS connection_id, CASE WHEN p_brand LIKE '%1' OR p_brand LIKE '%2' THEN 'hosted' ELSE 'personal' END AS scope,
        CASE WHEN p_brand LIKE '%5' THEN 0 ELSE 1 END AS provider, p_brand NOT LIKE '%7' AS has_key, p_brand NOT LIKE '%9' AS is_enabled FROM {part}""",
    "messages": """SELECT event_id AS message_id, user_id AS project_id, event_type AS role, props AS content, ts AS message_timestamp, ts AS created_at FROM {events}""",
    "prompts": """SELECT conv_id * 100 + turn AS prompt_id, conv_id % 20 AS project_id, CAST(CASE WHEN role = 'system' THEN 0 ELSE 1 END AS INT) AS prompt_type, text AS content,
        turn % 5 = 0 AS is_favorite, conv_id * 100 + turn AS last_used_at, conv_id AS created_at FROM {conversations}""",
    "invitations": """SELECT event_id AS invitation_id, concat(CASE WHEN event_id % 2 = 0 THEN 'User' ELSE 'user' END, CAST(user_id AS STRING), '@example.org') AS email,
        CAST(event_id % 4 AS INT) AS status, ts AS created_at, ts AS expires_at FROM {events}""",
    "jobs": """SELECT event_id AS document_id, CASE WHEN event_id % 3 = 0 THEN 'index' ELSE 'parse' END AS job_type,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped_security' ELSE 'completed' END AS result, ts FROM {events}""",
    "questions": "SELECT item_id AS query_id, text AS query_text FROM {benchmark}",
    "pages_text": "SELECT doc_id AS document_id, CAST(1 AS INT) AS page_number, text, source AS project, lang FROM {documents_raw}",
}
RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names(name: str) -> dict[str, str]:
    return {t: ("documents" if t == "documents_raw" else t) for t in (*RAW, "documents_raw") if "{" + t + "}" in STAND_INS[name]}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table for Spark."""
    return spark.sql(STAND_INS[name], **{k: raw(spark, sf_dir, t) for k, t in _names(name).items()})


def ctes(*names: str) -> str:
    """The stand-in tables as common table expressions for the SQL twins; the names get a 't_' in front."""
    parts = []
    for n in names:
        sql = STAND_INS[n]
        for k, t in _names(n).items():
            sql = sql.replace("{" + k + "}", t)
        parts.append(f"t_{n} AS ({sql})")
    return "WITH " + ",\n".join(parts)
