"""SQL twins of the catalog queries."""

from __future__ import annotations

from ..functions import files
from .tables import STAND_INS, ctes
from .text_queries import CHUNK_SQL, DECLARED, EXT, MAGIC_HEX, SQL as TEXT_SQL, TRIM, _in

US = "CAST(epoch_us({}) AS BIGINT)"
DATED = "dp AS (SELECT p.*, s.start, s.start + CAST(lifetime_preset AS BIGINT) * 3600000000 AS lifetime_expires_at FROM t_projects p JOIN (SELECT project_id, min(epoch_us(created_at)) AS start FROM t_documents GROUP BY 1) s USING (project_id))"
DUE = "CAST(floor((SELECT avg(lifetime_expires_at) FROM dp)) AS BIGINT)"
CONF = "conf AS (SELECT m.model_id, coalesce(m.is_enabled AND c.is_enabled AND c.provider <> 0 AND CASE WHEN c.scope = 'hosted' THEN m.is_published ELSE c.has_key END, false) AS is_configured FROM t_models m LEFT JOIN t_connections c USING (connection_id))"
NOW = "(SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)"
INV = f"inv AS (SELECT invitation_id, email, status, {US.format('created_at')} AS created_at, {US.format('created_at')} + invitation_id % 20 * 86400000000 AS expires_at FROM t_invitations)"

_SNIFF = TEXT_SQL["t13_sniff"]
SNIFFED = f"sn AS ({_SNIFF})"
OWN = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in files.CONTENT_TYPES.items() if e != ".gz") + " END"
FITS = "CASE ext " + " ".join(f"WHEN '{e}' THEN kind IN {_in([t, *files.ALSO_TYPES.get(e, [])])}" for e, t in files.CONTENT_TYPES.items() if e != ".gz") + " ELSE false END"
GATE = f"""{SNIFFED},
m AS (SELECT d.*, CASE WHEN d.document_id % 17 = 0 THEN 0 ELSE d.size_bytes * 100 END AS size, sn.content_type AS sniffed FROM t_documents d JOIN sn ON sn.doc_id = d.document_id),
m1 AS (SELECT *, {EXT} AS ext, {DECLARED} AS declared FROM m),
m2 AS (SELECT *, coalesce(sniffed, CASE WHEN declared NOT IN ('', 'application/octet-stream') THEN declared END, {OWN}, 'application/octet-stream') AS known FROM m1),
m3 AS (SELECT *, CASE WHEN known = 'application/zip' AND ext IN {_in(files.ZIP_BACKED)} THEN {OWN} ELSE known END AS kind FROM m2),
m4 AS (SELECT *, CASE WHEN {TRIM.format("coalesce(file_name, '')")} = '' THEN 'file name is required' WHEN size <= 0 THEN 'file is empty' WHEN size > {25 * 1024**2} THEN 'file is too large'
  WHEN ext = '' THEN 'extension is missing' WHEN ext NOT IN {_in(files.ALLOWED_EXTENSIONS)} THEN 'extension is not allowed'
  WHEN declared <> '' AND declared NOT IN {_in(files.ALLOWED_TYPES)} THEN 'declared type is not allowed'
  WHEN kind NOT IN {_in(files.ALLOWED_TYPES)} THEN 'detected type is not allowed' WHEN NOT {FITS} THEN 'extension does not match the detected type'
  WHEN sniffed IS NOT NULL AND declared <> '' AND NOT (declared = sniffed OR declared = 'application/octet-stream' OR (declared LIKE 'text/%' AND sniffed LIKE 'text/%')
    OR (declared || '>' || sniffed) IN ('application/xml>text/xml', 'text/xml>application/xml', 'image/jpg>image/jpeg', 'image/jpeg>image/jpg')
    OR (sniffed = 'application/zip' AND (declared LIKE '%openxmlformats-officedocument%' OR declared LIKE '%oasis.opendocument%' OR declared = 'application/epub+zip'))) THEN 'declared type does not match the detected type'
  END AS reason FROM m3),
gate AS (SELECT document_id, file_name, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN kind ELSE 'application/octet-stream' END AS normalized_type FROM m4)"""
KIND = f"CASE WHEN ({EXT}) IN {_in(files.ARCHIVE_EXTENSIONS)} OR normalized_type IN {_in(files.ARCHIVE_TYPES)} THEN 'archive' WHEN ({EXT}) IN {_in(files.MAIL_EXTENSIONS)} OR normalized_type IN {_in(files.MAIL_TYPES)} THEN 'email' ELSE 'none' END"
OUTCOMES = f"""{GATE}, vd AS (SELECT g.*, coalesce(CASE WHEN l.toxic = 1 THEN 'infected' WHEN l.doc_id IS NOT NULL THEN 'clean' END, 'error') <> 'clean' AS bad FROM gate g LEFT JOIN labels l ON l.doc_id = g.document_id),
oc AS (SELECT document_id, CAST(CASE WHEN NOT accepted THEN 6 WHEN bad THEN 5 ELSE 1 END AS INT) AS state, CAST(CASE WHEN NOT accepted OR bad THEN 6 ELSE 0 END AS INT) AS extraction_state, accepted AS is_stored, accepted AND NOT bad AS is_queued,
  CASE WHEN accepted AND NOT bad THEN {KIND} ELSE 'none' END AS container, document_id AS originating_upload_id, CASE WHEN NOT accepted THEN 'upload_rejected' WHEN bad THEN 'upload_quarantined' ELSE 'upload_accepted' END AS audit_event FROM vd)"""
STORAGE = """pw AS (SELECT workspace_id, sum(size_bytes) AS b FROM t_documents JOIN t_projects USING (project_id) GROUP BY 1),
sw AS (SELECT w.workspace_id AS key, w.tenant_id, coalesce(b, 0) AS used FROM t_workspaces w LEFT JOIN pw USING (workspace_id)),
st AS (SELECT tenant_id AS key, sum(used) AS used FROM sw GROUP BY 1),
su AS (SELECT user_id AS key, coalesce(sum(used), 0) AS used FROM (SELECT DISTINCT user_id, tenant_id FROM t_memberships) LEFT JOIN st ON st.key = tenant_id GROUP BY 1),
sa AS (SELECT 'workspace' AS scope, key, CAST(used AS BIGINT) AS used FROM sw UNION ALL SELECT 'tenant', key, CAST(used AS BIGINT) FROM st UNION ALL SELECT 'user', key, CAST(used AS BIGINT) FROM su)"""
AGE = "row_number() OVER (PARTITION BY project_id, prompt_type, is_favorite ORDER BY last_used_at DESC, created_at DESC, prompt_id)"
LIMIT = "CASE prompt_type WHEN 0 THEN 1 ELSE 3 END"
CHAT_AGE = "row_number() OVER (PARTITION BY project_id ORDER BY message_timestamp DESC, created_at DESC, message_id DESC)"
DOC_PLAN = "coalesce(count(*) FILTER (trim(coalesce(storage_key, '')) <> ''), 0)"


def _model(workspace_model: str) -> str:
    return f"CASE rag_override WHEN 1 THEN p.rag_model_id WHEN 2 THEN NULL ELSE CASE WHEN w.is_rag_enabled AND {workspace_model} IN (SELECT model_id FROM conf WHERE is_configured) THEN {workspace_model} END END"


SQL = {
    "f2_selectable_documents": f"{ctes('documents')} SELECT document_id, state FROM t_documents WHERE state NOT IN (5, 6)",
    "f3_tenant_filter": f"{ctes('tenants')} SELECT tenant_id, 'ids or visible' AS ask FROM t_tenants WHERE tenant_id IN (1, 3) OR is_visible_to_all UNION ALL SELECT tenant_id, 'active ids' FROM t_tenants WHERE tenant_id IN (1, 3, 4) AND is_active UNION ALL SELECT tenant_id, 'visible' FROM t_tenants WHERE is_visible_to_all",
    "f4_expired_projects": f"{ctes('documents', 'projects')}, {DATED} SELECT project_id, lifetime_expires_at FROM dp WHERE lifetime_expires_at <= {DUE} ORDER BY lifetime_expires_at, project_id LIMIT 50",
    "f5_role_permissions": f"{ctes('memberships', 'users')} SELECT m.user_id, tenant_id, is_admin OR (role <= 1 AND can_grant) AS manage_members, is_admin OR role <= 2 AS manage_workspaces, is_admin OR role <= 3 AS edit_projects, is_admin OR role <= 4 AS chat FROM t_memberships m JOIN t_users USING (user_id)",
    "f6_model_is_configured": f"{ctes('models', 'connections')}, {CONF} SELECT * FROM conf",
    "f7_upload_gate": f"{ctes('documents')}, {GATE} SELECT document_id, accepted, reason, normalized_type FROM gate",
    "f8_ocr_needed": f"{ctes('pages_text')} SELECT document_id, CAST(sum(length(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g'))) AS BIGINT) AS visible_chars, CASE WHEN visible_chars >= 200 THEN 'text' ELSE 'ocr' END AS route FROM t_pages_text GROUP BY 1".replace("{{", "{").replace("}}", "}"),
    "j1_hierarchy": f"{ctes('chunks', 'documents', 'projects', 'workspaces')} SELECT tenant_id, workspace_id, count(*) AS chunks, count(DISTINCT project_id) AS projects FROM t_chunks JOIN t_documents USING (document_id) JOIN t_projects USING (project_id) JOIN t_workspaces USING (workspace_id) GROUP BY 1, 2",
    "j2_effective_model": f"{ctes('projects', 'workspaces', 'models', 'connections')}, {CONF} SELECT project_id, CASE rag_override WHEN 1 THEN CASE WHEN p.rag_model_id IN (SELECT model_id FROM conf WHERE is_configured) THEN p.rag_model_id END WHEN 2 THEN NULL ELSE CASE WHEN w.is_rag_enabled AND w.rag_model_id IN (SELECT model_id FROM conf WHERE is_configured) THEN w.rag_model_id END END AS model_id FROM t_projects p LEFT JOIN t_workspaces w USING (workspace_id)",
    "j3_accessible_tenants": f"{ctes('users', 'memberships', 'tenants')} SELECT user_id, tenant_id FROM t_users, t_tenants WHERE is_admin UNION ALL SELECT DISTINCT m.user_id, m.tenant_id FROM t_memberships m JOIN t_users u USING (user_id) WHERE NOT is_admin UNION ALL SELECT user_id, tenant_id FROM t_users u, t_tenants t WHERE NOT is_admin AND is_visible_to_all AND user_id NOT IN (SELECT user_id FROM t_memberships)",
    "j4_already_ingested": f"{ctes('documents')} SELECT project_id % 3 AS index_version, count(*) AS n, CAST(sum(document_id) AS BIGINT) AS ids FROM t_documents WHERE document_id % 4 <> 0 GROUP BY 1",
    "j5_invalid_selection": f"""{ctes('documents', 'projects')}, a AS (SELECT project_id, count(*) AS n, count(*) FILTER (state NOT IN (5, 6)) AS ok FROM t_documents WHERE project_id % 3 <> 0 AND document_id % 5 = 0 GROUP BY 1),
e AS (SELECT project_id, count(*) AS n_all FROM t_documents WHERE state NOT IN (5, 6) GROUP BY 1)
SELECT p.project_id AS request_id, CAST(coalesce(ok, n_all, 0) AS BIGINT) AS n_selected, CASE WHEN n > ok THEN 'invalid' WHEN coalesce(ok, n_all, 0) = 0 THEN 'empty' ELSE 'ok' END AS outcome FROM t_projects p LEFT JOIN a USING (project_id) LEFT JOIN e USING (project_id)""",
    "j6_members_report": f"{ctes('memberships', 'users')} SELECT tenant_id, m.user_id, u.email, role, can_grant, g.email AS granted_by_email FROM t_memberships m JOIN t_users u ON u.user_id = m.user_id LEFT JOIN t_users g ON g.user_id = m.granted_by",
    "j7_owned_personal_tenants": "WITH m AS (SELECT c_custkey % 500 AS tenant_id, c_custkey AS user_id FROM customer), t AS (SELECT DISTINCT c_custkey % 700 AS tenant_id FROM customer WHERE c_custkey % 2 = 0) SELECT min(user_id) AS user_id, tenant_id FROM m WHERE tenant_id IN (SELECT tenant_id FROM t) GROUP BY tenant_id HAVING count(*) = 1",
    "a1_tenants_per_user": f"{ctes('memberships')} SELECT user_id, count(DISTINCT tenant_id) AS used FROM t_memberships GROUP BY 1",
    "a2_workspaces_per_user": f"{ctes('memberships', 'workspaces')} SELECT user_id, count(DISTINCT workspace_id) AS used FROM t_memberships JOIN t_workspaces USING (tenant_id) GROUP BY 1",
    "a3_projects_per_workspace": f"{ctes('projects')} SELECT workspace_id, count(*) AS projects, count(*) FILTER (lifetime_preset IS NULL AND project_id <> 2) AS permanent_projects FROM t_projects GROUP BY 1",
    "a4_documents_per_workspace": f"{ctes('documents', 'projects')} SELECT workspace_id, count(*) AS used FROM t_documents JOIN t_projects USING (project_id) GROUP BY 1",
    "a5_storage": f"{ctes('documents', 'projects', 'workspaces', 'memberships')}, {STORAGE} SELECT * FROM sa",
    "a6_quota_report": f"""{ctes('documents', 'projects', 'workspaces', 'memberships')}, {STORAGE},
us AS (SELECT 'user' AS scope, user_id AS key, 'tenants' AS metric, count(DISTINCT tenant_id) AS used FROM t_memberships GROUP BY user_id
  UNION ALL SELECT 'user', user_id, 'workspaces', count(DISTINCT workspace_id) FROM t_memberships JOIN t_workspaces USING (tenant_id) GROUP BY user_id
  UNION ALL SELECT 'workspace', workspace_id, 'documents', count(*) FROM t_documents JOIN t_projects USING (project_id) GROUP BY workspace_id
  UNION ALL SELECT 'workspace', workspace_id, 'projects', count(*) FROM t_projects GROUP BY workspace_id
  UNION ALL SELECT 'workspace', workspace_id, 'permanent_projects', count(*) FILTER (lifetime_preset IS NULL) FROM t_projects GROUP BY workspace_id
  UNION ALL SELECT 'project', project_id, 'temporary_hours', CAST(lifetime_preset AS BIGINT) FROM t_projects WHERE lifetime_preset IS NOT NULL
  UNION ALL SELECT scope, key, 'storage_bytes', used * 10 FROM sa),
q AS (SELECT *, CAST(CASE metric WHEN 'tenants' THEN 1 WHEN 'workspaces' THEN 3 WHEN 'documents' THEN 200 WHEN 'projects' THEN 10 WHEN 'permanent_projects' THEN 3 WHEN 'temporary_hours' THEN 720 ELSE CAST(CASE scope WHEN 'tenant' THEN 5 ELSE 2 END AS BIGINT) * 1073741824 END AS BIGINT) AS quota FROM us)
SELECT *, CASE metric WHEN 'storage_bytes' THEN used + 1000 > quota WHEN 'temporary_hours' THEN used > quota ELSE used >= quota END AS blocked FROM q""",
    "a7_extraction_stats": f"{ctes('tree')} SELECT root_container_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM t_tree GROUP BY 1",
    "a8_project_dashboard": f"""{ctes('documents', 'projects', 'workspaces', 'tenants', 'messages')},
d AS (SELECT project_id, count(*) AS total, count(*) FILTER (state = 3) AS indexed, count(*) FILTER (state = 4) AS failed, count(*) FILTER (state IN (0, 1, 2)) AS processing FROM t_documents GROUP BY 1),
c AS (SELECT project_id, least(count(*), 30) AS chats, {US.format('max(message_timestamp)')} AS last_message FROM t_messages GROUP BY 1),
j AS (SELECT p.project_id, p.name, coalesce(w.name, '-') AS workspace_name, coalesce(t.name, '-') AS tenant_name, coalesce(total, 0) AS total, coalesce(indexed, 0) AS indexed, coalesce(failed, 0) AS failed, coalesce(processing, 0) AS processing, coalesce(chats, 0) AS chats, last_message
  FROM t_projects p LEFT JOIN d USING (project_id) LEFT JOIN c USING (project_id) LEFT JOIN t_workspaces w USING (workspace_id) LEFT JOIN t_tenants t USING (tenant_id))
SELECT *, CASE WHEN total = 0 THEN 'Empty' WHEN failed > 0 THEN 'Has failures' WHEN processing > 0 THEN 'Processing' WHEN indexed = total THEN 'All indexed' ELSE 'Partial' END AS status FROM j""",
    "a9_workspace_dashboard": f"""{ctes('documents', 'projects', 'workspaces')}, d AS (SELECT project_id, count(*) AS n FROM t_documents GROUP BY 1),
p AS (SELECT workspace_id, count(*) AS projects, sum(n) AS documents, max(n) AS largest FROM t_projects LEFT JOIN d USING (project_id) GROUP BY 1)
SELECT workspace_id, name, coalesce(projects, 0) AS projects, CAST(coalesce(documents, 0) AS BIGINT) AS documents, coalesce(largest, 0) AS largest_project FROM t_workspaces LEFT JOIN p USING (workspace_id)""",
    "a10_members_by_role": f"{ctes('memberships')} SELECT tenant_id, role, count(*) AS members FROM t_memberships GROUP BY 1, 2",
    "a10_last_owner_guard": f"{ctes('memberships', 'tenants')} SELECT tenant_id, count(m.user_id) AS owners FROM t_tenants LEFT JOIN (SELECT * FROM t_memberships WHERE role = 0 AND (tenant_id <> 4 OR user_id = 1)) m USING (tenant_id) GROUP BY 1 HAVING count(m.user_id) <= 1",
    "a11_job_outcomes": f"{ctes('jobs')} SELECT job_type, result, count(*) AS jobs FROM t_jobs GROUP BY 1, 2",
    "a12_audit_summary": f"SELECT event_type, count(*) AS n, {US.format('min(ts)')} AS first_at, {US.format('max(ts)')} AS last_at FROM events GROUP BY 1",
    "a13_model_usage": f"{ctes('projects')} SELECT rag_model_id AS model_id, rag_override, count(*) AS projects FROM t_projects WHERE rag_model_id IS NOT NULL GROUP BY 1, 2",
    "k1_recent_chat": f"{ctes('messages')}, a AS (SELECT *, {CHAT_AGE} AS age FROM t_messages) SELECT project_id, message_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY message_timestamp, created_at, message_id) AS INT) AS no FROM a WHERE age <= 10",
    "k2_prune_chat": f"{ctes('messages')} SELECT message_id, {CHAT_AGE} <= 30 AS kept FROM t_messages",
    "k3_prompt_library": f"{ctes('prompts')}, a AS (SELECT *, {AGE} AS age FROM t_prompts) SELECT prompt_id, CASE WHEN is_favorite THEN 'favorite' ELSE 'history' END AS section, CAST(age AS INT) AS age FROM a WHERE is_favorite OR age <= {LIMIT}",
    "k4_prune_prompts": f"{ctes('prompts')}, a AS (SELECT *, {AGE} AS age FROM t_prompts) SELECT prompt_id, is_favorite OR age <= {LIMIT} AS kept FROM a",
    "k5_last_used_prompt": f"{ctes('prompts')} SELECT project_id, prompt_type, prompt_id FROM t_prompts QUALIFY row_number() OVER (PARTITION BY project_id, prompt_type ORDER BY last_used_at DESC, created_at DESC, prompt_id) = 1",
    "k6_merge_prompt_usage": f"""{ctes('prompts')}, n AS (SELECT project_id, prompt_type, {TRIM.format("'  ' || content || chr(10)")} AS content, last_used_at + 5 AS used_at FROM t_prompts WHERE prompt_id % 3 = 0
  UNION ALL SELECT project_id, 2, {TRIM.format('content')}, last_used_at FROM t_prompts WHERE prompt_id % 7 = 0),
e AS (SELECT project_id, prompt_type, content, is_favorite, last_used_at, created_at FROM t_prompts UNION ALL SELECT project_id, prompt_type, content, false, used_at, used_at FROM n WHERE length(content) BETWEEN 1 AND 2000)
SELECT project_id, prompt_type, upper(sha256({TRIM.format('content')})) AS content_hash, bool_or(is_favorite) AS is_favorite, max(last_used_at) AS last_used_at, min(created_at) AS created_at FROM e GROUP BY project_id, prompt_type, content""",
    "k7_latest_invitation": f"{ctes('invitations')}, {INV} SELECT invitation_id, email FROM inv WHERE status = 0 AND expires_at > {NOW} QUALIFY row_number() OVER (PARTITION BY lower(email) ORDER BY created_at DESC, invitation_id) = 1",
    "k7_invitation_status": f"{ctes('invitations')}, {INV} SELECT status, CAST(CASE WHEN status = 0 AND expires_at <= {NOW} THEN 3 ELSE status END AS INT) AS effective_status, count(*) AS n FROM inv GROUP BY 1, 2",
    "k8_tree_order": f"""WITH RECURSIVE t_tree AS ({STAND_INS['tree'].replace('{orders}', 'orders')}),
r AS (SELECT project_id, document_id, 0 AS depth, file_name AS path FROM t_tree WHERE parent_id IS NULL UNION ALL SELECT t.project_id, t.document_id, r.depth + 1, r.path || '/' || t.file_name FROM t_tree t JOIN r ON t.parent_id = r.document_id)
SELECT * FROM r""",
    "u1_prompt_collection": f"""{ctes('prompts')}, a AS (SELECT *, {AGE} AS age FROM t_prompts)
SELECT project_id, prompt_type, prompt_id, CAST(row_number() OVER (PARTITION BY project_id, prompt_type ORDER BY CASE WHEN is_favorite THEN 0 ELSE 1 END, age) AS INT) AS no FROM a WHERE is_favorite OR age <= {LIMIT}""",
    "u2_membership_diff": f"""{ctes('memberships')}, d AS (SELECT user_id, tenant_id FROM t_memberships WHERE user_id % 3 <> 0 UNION SELECT user_id, (tenant_id + 1) % 5 FROM t_memberships WHERE user_id % 4 = 0), e AS (SELECT DISTINCT user_id, tenant_id FROM t_memberships)
SELECT user_id, tenant_id, 'add' AS change, CAST(5 AS INT) AS role, false AS can_grant FROM (SELECT * FROM d EXCEPT SELECT * FROM e) UNION ALL SELECT user_id, tenant_id, 'remove', NULL, NULL FROM (SELECT * FROM e EXCEPT SELECT * FROM d)""",
    "u3_selection_intersect": f"{ctes('documents')} SELECT project_id, document_id FROM t_documents WHERE document_id % 2 = 0 AND state NOT IN (5, 6)",
    "u4_descendants": f"""WITH RECURSIVE t_tree AS ({STAND_INS['tree'].replace('{orders}', 'orders')}),
r AS (SELECT document_id AS root_id, document_id, 0 AS depth FROM t_tree WHERE document_id % 64 IN (1, 5) OR document_id % 640 = 0 UNION ALL SELECT r.root_id, t.document_id, r.depth + 1 FROM t_tree t JOIN r ON t.parent_id = r.document_id)
SELECT * FROM r""",
    "u5_revoke_closure": """WITH RECURSIVE g AS (SELECT CAST(c_nationkey % 2 AS BIGINT) AS tenant_id, c_custkey AS user_id, CASE WHEN c_custkey % 10 <> 0 THEN CAST(floor(c_custkey / 2) AS BIGINT) END AS granted_by FROM customer),
r AS (SELECT tenant_id, user_id FROM g WHERE user_id % 50 = 0 UNION SELECT g.tenant_id, g.user_id FROM g JOIN r ON g.granted_by = r.user_id AND g.tenant_id = r.tenant_id)
SELECT DISTINCT tenant_id, user_id FROM r""",
    "u6_reindex_plan": f"""{ctes('projects', 'workspaces', 'models', 'connections', 'documents', 'chunks')}, {CONF},
m AS (SELECT p.project_id, p.index_version, {_model('w.rag_model_id')} AS a, {_model('(w.rag_model_id + 1)')} AS b FROM t_projects p LEFT JOIN t_workspaces w USING (workspace_id)),
c AS (SELECT project_id, count(*) AS chunks FROM t_chunks JOIN t_documents USING (document_id) GROUP BY 1), q AS (SELECT project_id, count(*) AS requeue FROM t_documents WHERE state NOT IN (5, 6) GROUP BY 1)
SELECT project_id, CAST(index_version + 1 AS INT) AS index_version, chunks, requeue FROM m LEFT JOIN c USING (project_id) LEFT JOIN q USING (project_id) WHERE a IS DISTINCT FROM b""",
    "u6_without_model": f"{ctes('projects')}, g AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 = 1) SELECT project_id, CASE WHEN rag_model_id IN (SELECT id FROM g) THEN NULL ELSE rag_model_id END AS rag_model_id, CAST(CASE WHEN rag_model_id IN (SELECT id FROM g) AND rag_override = 1 THEN 2 ELSE rag_override END AS INT) AS rag_override FROM t_projects",
    "u7_project_delete_plan": f"""{ctes('documents', 'chunks')}, c AS (SELECT project_id, count(*) AS chunks FROM t_chunks JOIN t_documents USING (document_id) GROUP BY 1)
SELECT project_id, count(*) AS documents, nullif({DOC_PLAN}, 0) AS keys, any_value(chunks) AS chunks FROM t_documents LEFT JOIN c USING (project_id) WHERE project_id % 7 = 0 GROUP BY 1""",
    "w7_expiry_sweep": f"{ctes('documents', 'projects')}, {DATED} SELECT project_id, count(*) AS documents, nullif({DOC_PLAN}, 0) AS keys FROM t_documents WHERE project_id IN (SELECT project_id FROM dp WHERE lifetime_expires_at <= {DUE}) GROUP BY 1",
    "q3_upload_outcomes": f"{ctes('documents')}, {OUTCOMES} SELECT * FROM oc",
    "q3_audit_rows": f"{ctes('documents')}, {OUTCOMES} SELECT audit_event AS event_type, state, count(*) AS n FROM oc GROUP BY 1, 2",
    "w1_ingest_batch": f"{ctes('documents')} SELECT document_id, CASE WHEN state IN (5, 6) THEN 'skipped_security' ELSE 'completed' END AS result, CAST(CASE WHEN state IN (5, 6) THEN 4 ELSE 3 END AS INT) AS state, state NOT IN (5, 6) AND document_id % 3 <> 0 AS ingest FROM t_documents WHERE document_id IN (SELECT event_id FROM events)",
    "w2_job_outcome_windows": f"{ctes('jobs')} SELECT {US.format('time_bucket(INTERVAL 1 HOUR, ts)')} AS window_start, job_type, result, count(*) AS jobs FROM t_jobs GROUP BY 1, 2, 3",
    "w3_idempotent_stream": "SELECT DISTINCT concat_ws(':', user_id % 40, event_type) AS job_key FROM events",
    "w4_context_dedupe": "SELECT DISTINCT sha256(props) AS cache_key FROM events",
    "w5_retry_route": "WITH f AS (SELECT CASE WHEN event_id % 10 <> 0 THEN event_id END AS id, user_id % 6 AS retry FROM events) SELECT CASE WHEN id IS NULL THEN 'drop' WHEN retry < 3 THEN 'retry' ELSE 'dead_letter' END AS route, CAST(CASE WHEN id IS NOT NULL AND retry < 3 THEN retry + 1 END AS INT) AS next_retry, count(*) AS n FROM f GROUP BY 1, 2",
    "w6_project_lifetimes": """WITH a AS (SELECT user_id AS p, epoch_us(ts) AS t, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS c, (user_id % 5) * 43200000000 AS h FROM events),
b AS (SELECT *, t >= coalesce(lag(t) OVER (PARTITION BY p ORDER BY t), c) + h AS late FROM a WHERE h > 0), l AS (SELECT *, bool_or(late) OVER (PARTITION BY p ORDER BY t) AS lost FROM b)
SELECT p AS project_id, CAST(coalesce(max(t) FILTER (NOT lost), any_value(c)) + any_value(h) AS BIGINT) AS expires_at FROM l GROUP BY 1""",
}
SQL["w1_ingest_stream"] = f"""{ctes('pages_text')}, p AS (SELECT * FROM t_pages_text WHERE document_id % 17 <> 0), {CHUNK_SQL.replace('t_pages_text', 'p')},
made AS (SELECT document_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS characters FROM chunks GROUP BY 1),
k AS (SELECT t.document_id, made.chunks, made.characters, CASE WHEN t.document_id % 11 = 0 OR t.document_id % 13 = 0 THEN 'skipped_security' WHEN chunks IS NULL OR t.document_id % 19 = 0 THEN 'failed' ELSE 'completed' END AS result FROM t_pages_text t LEFT JOIN made USING (document_id)),
j AS (SELECT document_id, result FROM k WHERE document_id % 2 = 0
  UNION ALL SELECT document_id, CASE WHEN result = 'completed' AND document_id % 2 = 0 THEN 'already_ingested' ELSE result END FROM k
  UNION ALL SELECT document_id + 1000000000, 'not_found' FROM k WHERE document_id % 23 = 0)
SELECT j.document_id, j.result, CAST(CASE WHEN j.result IN ('completed', 'already_ingested') THEN 3 ELSE 4 END AS INT) AS state, count(*) AS jobs, any_value(k.chunks) AS chunks, any_value(k.chunks) AS vectors, any_value(k.characters) AS characters
FROM j LEFT JOIN (SELECT * FROM k WHERE result = 'completed') k USING (document_id) GROUP BY 1, 2, 3"""
SQL["w6_expiry_stream"] = f"SELECT * FROM ({SQL['w6_project_lifetimes']}) WHERE expires_at <= (SELECT max(epoch_us(ts)) FROM events) - CAST(72 AS BIGINT) * 3600000000"
SQL["w5_retry_router"] = f"SELECT * FROM ({SQL['w5_retry_route']}) WHERE route <> 'drop'"
SQL["q2_free_path"] = """WITH e AS (SELECT CAST(l_orderkey AS BIGINT) AS container_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS ordinal, CASE WHEN l_partkey % 2 = 0 THEN 'in' ELSE 'in/in' END AS folder,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Doc' ELSE 'doc' END AS base, CASE l_suppkey % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' ELSE '' END AS ext FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY container_id, lower(folder || '/' || base || ext) ORDER BY ordinal) AS k FROM e)
SELECT container_id, ordinal, folder || '/' || base || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || ext AS unique_path FROM n"""
