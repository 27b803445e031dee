"""Named queries on texts, files and chunks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files, text, vectors
from ..operators import chunking, keywords
from ..shared import fresh_path, keep
from ..sources import bucketed, readers, sinks
from .tables import ctes, raw, view

W, WL = text.SPACE, text.SPACE_IN_LINE
STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"


class _Sql(str):
    """SQL with one place for an argument; braces elsewhere are plain text."""

    def format(self, x: str) -> str:
        return self.replace("@", x)


TRIM = _Sql(f"regexp_replace(@, '^{W}+|{W}+$', '', 'g')")
INLINE = _Sql(TRIM.format(f"regexp_replace(@, '{W}+', ' ', 'g')"))


def _structured(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '{WL}+\\n', chr(10), 'g')"
    return TRIM.format(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _decoded(x: str) -> str:
    """The character references that the pages hold."""
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return x


def _stripped(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)<\\s*br\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)</\\s*(?:p|div|li|h1|h2|h3|h4|h5|h6|tr)\\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return _structured(_decoded(x))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


EXT = "CASE WHEN lower(file_name) LIKE '%.tar.gz' THEN '.tar.gz' ELSE lower(regexp_extract(coalesce(file_name, ''), '(\\.[^./\\\\]+)$', 1)) END"
DECLARED = "lower(trim(split_part(coalesce(content_type, ''), ';', 1)))"
GUESSED = f"CASE WHEN {DECLARED} NOT IN ('', 'application/octet-stream') THEN {DECLARED} ELSE CASE {EXT} " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in files.CONTENT_TYPES.items()) + " ELSE 'application/octet-stream' END END"
RAW_TYPE = "lower(coalesce(content_type, ''))"
ROUTE = "CASE " + " ".join(
    f"WHEN ({EXT}) IN {_in(e)} OR " + (f"{RAW_TYPE} LIKE 'image/%'" if t == ["image/*"] else f"{RAW_TYPE} IN {_in(t)}") + f" THEN '{label}'" for label, t, e in files.ROUTES
) + " ELSE 'unsupported' END"
CHUNK_SQL = f"""c AS (
  SELECT document_id, project, s AS start, {TRIM.format("substring(text, CAST(s AS INT) + 1, 1400)")} AS content
  FROM (SELECT document_id, project, text, unnest(generate_series(0, greatest(0, length(text) - 251), 1150)) AS s FROM t_pages_text WHERE {TRIM.format("text")} <> '')
),
chunks AS (
  SELECT document_id, project, start, content, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start) - 1 AS INT) AS chunk_index, CAST(length(content) AS INT) AS character_count
  FROM c WHERE content <> ''
)"""
TOKENS = _Sql("list_transform(regexp_extract_all(@, '[\\p{L}\\p{Nd}][\\p{L}\\p{Nd}_-]+'), lambda t: lower(t))")
BREAK = text.SENTENCE_BREAK.replace("'", "''")


def chunks_of(spark, d):
    return chunking.chunk_single_pages(view(spark, d, "pages_text"))


def t1_normalize_inline(spark, d):
    return raw(spark, d, "documents").select("doc_id", text.normalize_inline(F.col("text")).alias("text"))


def t2_normalize_structured(spark, d):
    return raw(spark, d, "documents").select("doc_id", text.normalize_structured(F.col("text")).alias("text"))


def t3_strip_html(spark, d):
    return raw(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


def t4_html_title(spark, d):
    return raw(spark, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


def t5_chunk_uid(spark, d):
    return view(spark, d, "chunks").select(text.chunk_uid(F.col("document_id"), F.col("index_version"), F.col("chunk_index")).alias("chunk_uid")).groupBy("chunk_uid").agg(F.count("*").alias("n"))


def t6_content_hash(spark, d):
    return raw(spark, d, "conversations").select("conv_id", "turn", text.content_hash(F.col("text")).alias("content_hash"))


def t7_context_cache_key(spark, d):
    docs = view(spark, d, "documents").groupBy("project_id").agg(F.collect_list(F.col("document_id").cast("string")).alias("ids"))
    rows = view(spark, d, "projects").join(docs, "project_id").join(view(spark, d, "questions"), F.expr("query_id = project_id % 40"))
    key = text.context_cache_key(F.col("project_id"), F.col("index_version"), F.col("rag_model_id"), F.col("project_id") % 2 == 0, F.col("ids"), F.col("query_text"))
    return rows.select("project_id", key.alias("cache_key"))


def t8_preview(spark, d):
    return raw(spark, d, "conversations").select("conv_id", "turn", text.preview(F.col("text")).alias("preview"))


def t9_content_type(spark, d):
    n, t = F.col("file_name"), F.col("content_type")
    return view(spark, d, "documents").select("document_id", files.effective_extension(n).alias("extension"), files.guess_content_type(n, t).alias("guessed"))


def t10_container_kind(spark, d):
    return view(spark, d, "documents").select("document_id", files.container_kind(F.col("file_name"), F.col("content_type")).alias("kind"))


def t11_supported(spark, d):
    return view(spark, d, "documents").select("document_id", files.supported_for_pipeline(F.col("file_name"), F.col("content_type")).alias("supported"))


def t12_route_extractor(spark, d):
    return view(spark, d, "documents").select("document_id", files.route_extractor(F.col("file_name"), F.col("content_type")).alias("route"))


#: Headers made of the texts: by document id, a magic number goes before the first bytes.
MAGIC_HEX = ["377ABCAF271C", "526172211A0701", "504B0304", "D0CF11E0A1B11AE1", "1F8B08", "255044462D31", "89504E470D0A1A0A", "FFD8FFE0", "4D4D002A", "424D", "", "00"]


def headers_of(spark, d):
    pick = F.element_at(F.array(*[F.lit(h) for h in MAGIC_HEX]), (F.col("doc_id") % len(MAGIC_HEX) + 1).cast("int"))
    return raw(spark, d, "documents").select("doc_id", F.unhex(F.concat(pick, F.hex(F.encode(F.left("text", F.lit(100)), "UTF-8")))).alias("header"))


def t13_sniff(spark, d):
    return headers_of(spark, d).select("doc_id", files.sniff_content_type(F.col("header")).alias("content_type"))


def _urls(spark, d):
    host = F.element_at(F.array(*[F.lit(h) for h in URL_HOSTS]), (F.col("page_id") % len(URL_HOSTS) + 1).cast("int"))
    return raw(spark, d, "pages").select("page_id", F.when(host == "", F.col("url")).otherwise(F.regexp_replace("url", r"//[^/]+", F.concat(F.lit("//"), host))).alias("url"))


URL_HOSTS = ["", "", "localhost", "printer.local", "db.internal:8080", "10.1.2.3", "172.16.0.9", "172.32.0.9", "192.168.1.1", "127.0.0.1", "169.254.169.254", "0.0.0.0", "8.8.8.8", "[::1]", "[0:0:0:0:0:0:0:1]:8443", "[fe80::1%25eth0]", "[fec0::7]", "[fd12:3456::2]", "[::ffff:10.1.2.3]", "[::ffff:8.8.8.8]", "[2001:db8::1]:443", "[fe80]"]


def t14_url_gate(spark, d):
    return _urls(spark, d).select("page_id", files.url_gate(F.col("url")).alias("outcome"), files.url_document_name(F.col("url")).alias("name"))


def t15_pad_vector(spark, d):
    return raw(spark, d, "embeddings").select("vec_id", *[F.transform(vectors.pad_vector(F.col("embedding"), n), lambda x: vectors.rounded(x.cast("double"), 5)).alias(f"v{n}") for n in (4, 80)])


def t16_vector_bytes(spark, d):
    v = raw(spark, d, "embeddings").select("vec_id", "embedding", vectors.encode_vector("embedding").alias("bytes"))
    return v.select("vec_id", F.length("bytes").cast("long").alias("n_bytes"), (vectors.decode_vector("bytes") == F.col("embedding")).alias("same"))


def t17_lifetime_expiry(spark, d):
    from ..operators.lifecycle import lifetime_expiry

    docs = view(spark, d, "documents").join(view(spark, d, "projects").where("lifetime_preset is not null"), "project_id")
    return docs.select("document_id", F.date_format(lifetime_expiry(F.col("lifetime_preset"), F.col("created_at")), "yyyy-MM-dd HH:mm").alias("expires_at"))


def g1_chunk_pages(spark, d):
    pages = view(spark, d, "pages_text").drop("lang")
    return chunking.chunk_pages(pages).select("document_id", F.col("start").cast("long").alias("start"), "chunk_index", "character_count", F.md5("content").alias("content_md5"))


def g2_tokenize(spark, d):
    c = text.candidate_tokens(F.col("text"))
    return raw(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("tokens"), F.size(c).cast("long").alias("candidates"), F.array_join(F.slice(c, 1, 5), " ").alias("first"))


def g3_keywords_frequency(spark, d):
    return keywords.keywords_frequency_rows(raw(spark, d, "documents"), "doc_id", "text").select("doc_id", F.array_join("keywords", "|").alias("keywords"))


def g4_keywords_rake(spark, d):
    return keywords.keywords_rake(raw(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), "id", "text").select("id", F.array_join("keywords", "|").alias("keywords"))


def g4_keywords_rake_rows(spark, d):
    return keywords.keywords_rake_rows(raw(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), "id", "text").select("id", F.array_join("keywords", "|").alias("keywords"))


def g6_attach_vectors(spark, d):
    chunks = chunks_of(spark, d).withColumn("chunk_uid", text.chunk_uid(F.col("document_id"), F.lit(1), F.col("chunk_index")))
    chunks = keep(chunks.select("document_id", "chunk_uid"), "chunk_ids")  # the texts are cut once
    vecs = raw(spark, d, "embeddings").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(text.chunk_uid(F.col("vec_id"), F.lit(1), F.col("n")).alias("chunk_uid"), "embedding")
    good, failed = chunking.attach_vectors(chunks, vecs)
    ok = good.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors")).withColumn("failed", F.lit(False))
    return ok.unionByName(failed.withColumn("failed", F.lit(True)))


def g7_embedding_batches(spark, d):
    return chunking.embedding_batches(chunks_of(spark, d), 4).groupBy("document_id", "batch").agg(F.count("*").alias("chunks"), F.min("chunk_index").alias("first_chunk"))


def g8_transcript(spark, d):
    return chunking.transcript(view(spark, d, "messages")).select("project_id", F.md5("transcript").alias("transcript_md5"), F.length("transcript").cast("long").alias("chars"))


def s1_read_documents(spark, d):
    pages = readers.pages_of(raw(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"))
    return pages.select("document_id", "page_number", "source_type", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def s1_read_files(spark, d):
    """The texts as whole files, twenty documents a file, written and read back."""
    path = fresh_path(spark, "files")
    docs = raw(spark, d, "documents").where("text is not null").groupBy(F.floor(F.col("doc_id") / 20).alias("part"))
    one = docs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    # a part is one row and so one file; tasks put their files in place themselves
    one.write.partitionBy("part").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    pages = readers.read_documents(spark, f"{path}/*")
    return pages.select(F.regexp_extract("document_id", "part=(-?[0-9]+)", 1).cast("long").alias("part"), "page_number", "source_type", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def s2_read_html_pages(spark, d):
    return readers.read_html_pages(raw(spark, d, "pages")).select("document_id", "title", "page_number", "source_type", F.md5("text").alias("text_md5"))


def s3_read_catalog(spark, d):
    return readers.read_catalog(spark, "nation", d).join(readers.read_catalog(spark, "region", d), F.expr("n_regionkey = r_regionkey")).select("n_name", "r_name")


def s4_replace_chunks(spark, d):
    old = view(spark, d, "chunks")
    new = old.where("document_id % 5 = 0").select("document_id", "chunk_index", (F.col("tag") + 1).alias("tag"), F.lit(9).alias("index_version"))
    return sinks.replace_chunks(old, new).groupBy("index_version").agg(F.count("*").alias("n"), F.sum("tag").alias("tags"))


def _bulk_rows(spark, d):
    return chunks_of(spark, d).select(text.chunk_uid(F.col("document_id"), F.lit(1), F.col("chunk_index")).alias("chunk_uid"), "document_id", "chunk_index", F.when(F.col("document_id") % 2 == 0, F.col("project")).alias("project_id"), F.array(F.col("lang"), F.lit("x")).alias("keywords"))


def s5_export_bulk(spark, d):
    return sinks.bulk_lines(_bulk_rows(spark, d)).select("chunk_uid", "line_no", "value")


def s5_export_files(spark, d):
    """The written export, read back."""
    path = fresh_path(spark, "bulk")
    sinks.export_bulk_index(_bulk_rows(spark, d), path)
    return spark.read.text(path)


def s6_delete_index_rows(spark, d):
    rows = view(spark, d, "chunks").join(view(spark, d, "documents").select("document_id", "project_id"), "document_id").select("project_id", "document_id", "index_version", "chunk_index")
    keys = rows.where("document_id % 3 = 0 and index_version = 1").select("project_id", "document_id", "index_version")
    return sinks.delete_index_rows(rows, keys).groupBy("index_version").agg(F.count("*").alias("n"), F.sum("document_id").alias("ids"))


def s7_upsert_index(spark, d):
    uid = text.chunk_uid(F.col("document_id"), F.lit(1), F.col("chunk_index")).alias("chunk_uid")
    old = view(spark, d, "chunks").groupBy(uid).agg(F.max("tag").alias("tag"), F.lit(0).cast("long").alias("updated_at"))
    new = view(spark, d, "chunks").where("document_id % 4 = 0").select(uid, (-F.col("tag")).alias("tag"), (F.col("tag") + 1).alias("updated_at"))
    return sinks.upsert_index(old, new).groupBy((F.col("tag") < 0).alias("replaced")).agg(F.count("*").alias("n"), F.sum("tag").alias("tags"))


def _bucketed(spark, rows, key):
    table = bucketed.BucketTable(fresh_path(spark, "buckets"), key, 32, ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes))
    table.create(rows)
    return table


def s4_replace_buckets(spark, d):
    """s4 in a table of buckets by document."""
    old = view(spark, d, "chunks").select("document_id", "chunk_index", F.col("tag").cast("long").alias("tag"), "index_version")
    table = _bucketed(spark, old, "document_id")
    table.replace(old.where("document_id % 5 = 0").withColumn("tag", F.col("tag") + 1).withColumn("index_version", F.lit(9)))
    return table.read(spark).groupBy("index_version").agg(F.count("*").alias("n"), F.sum("tag").alias("tags"))


def s6_delete_buckets(spark, d):
    """s6 in a table of buckets by document."""
    rows = view(spark, d, "chunks").join(view(spark, d, "documents").select("document_id", "project_id"), "document_id").select("project_id", "document_id", "index_version", "chunk_index")
    table = _bucketed(spark, rows, "document_id")
    table.delete(rows.where("document_id % 3 = 0 and index_version = 1").select("project_id", "document_id", "index_version"))
    return table.read(spark).groupBy("index_version").agg(F.count("*").alias("n"), F.sum("document_id").alias("ids"))


def s7_upsert_buckets(spark, d):
    """s7 in a table of buckets by chunk."""
    uid, tag = text.chunk_uid(F.col("document_id"), F.lit(1), F.col("chunk_index")).alias("chunk_uid"), F.col("tag").cast("long")
    old = view(spark, d, "chunks").groupBy(uid).agg(F.max(tag).alias("tag"), F.lit(0).cast("long").alias("updated_at"))
    table = _bucketed(spark, old, "chunk_uid")
    table.upsert(view(spark, d, "chunks").where("document_id % 4 = 0").select(uid, (-tag).alias("tag"), (tag + 1).alias("updated_at")))
    return table.read(spark).groupBy((F.col("tag") < 0).alias("replaced")).agg(F.count("*").alias("n"), F.sum("tag").alias("tags"))


TITLE = TRIM.format(_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
_C = ctes("chunks")
_P = ctes("pages_text")
SQL = {
    "t1_normalize_inline": f"SELECT doc_id, {INLINE.format('text')} AS text FROM documents",
    "t2_normalize_structured": f"SELECT doc_id, {_structured('text')} AS text FROM documents",
    "t3_strip_html": f"SELECT page_id, {_stripped('html')} AS text FROM pages",
    "t4_html_title": f"SELECT page_id, nullif({TITLE}, '') AS title FROM pages",
    "t5_chunk_uid": f"{_C} SELECT concat_ws(':', document_id, index_version, chunk_index) AS chunk_uid, count(*) AS n FROM t_chunks GROUP BY 1",
    "t6_content_hash": f"SELECT conv_id, turn, upper(sha256({TRIM.format('text')})) AS content_hash FROM conversations",
    "t7_context_cache_key": f"""{ctes('documents', 'projects', 'questions')},
i AS (SELECT project_id, list_sort(list(CAST(document_id AS VARCHAR))) AS ids FROM t_documents GROUP BY 1)
SELECT project_id, 'context:' || upper(sha256(concat_ws('|', project_id, index_version, coalesce(CAST(rag_model_id AS VARCHAR), 'none'), CASE WHEN project_id % 2 = 0 THEN 'os' ELSE 'sql' END, array_to_string(ids, ','), {TRIM.format('query_text')}))) AS cache_key
FROM t_projects JOIN i USING (project_id) JOIN t_questions ON query_id = project_id % 40""",
    "t8_preview": f"SELECT conv_id, turn, CASE WHEN length(p) > 96 THEN left(p, 96) || '...' ELSE p END AS preview FROM (SELECT conv_id, turn, {INLINE.format('text')} AS p FROM conversations)",
    "t9_content_type": f"{ctes('documents')} SELECT document_id, {EXT} AS extension, {GUESSED} AS guessed FROM t_documents",
    "t10_container_kind": f"{ctes('documents')} SELECT document_id, CASE WHEN ({EXT}) IN {_in(files.ARCHIVE_EXTENSIONS)} OR {RAW_TYPE} IN {_in(files.ARCHIVE_TYPES)} THEN 'archive' WHEN ({EXT}) IN {_in(files.MAIL_EXTENSIONS)} OR {RAW_TYPE} IN {_in(files.MAIL_TYPES)} THEN 'email' ELSE 'none' END AS kind FROM t_documents",
    "t11_supported": f"{ctes('documents')} SELECT document_id, ({EXT}) IN {_in(files.SUPPORTED_EXTENSIONS)} OR {RAW_TYPE} LIKE 'text/%' OR {RAW_TYPE} IN {_in(sorted(set(files.CONTENT_TYPES.values())))} AS supported FROM t_documents",
    "t12_route_extractor": f"{ctes('documents')} SELECT document_id, {ROUTE} AS route FROM t_documents",
    "t13_sniff": "WITH h AS (SELECT doc_id, [" + ", ".join(f"'{h}'" for h in MAGIC_HEX) + f"][doc_id % {len(MAGIC_HEX)} + 1] || hex(encode(left(text, 100))) AS h FROM documents), b AS (SELECT *, regexp_extract_all(left(h, 1024), '..') AS bytes FROM h)\nSELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(left(h, 16), '{p}') THEN '{t}'" for p, t in files.MAGIC)
    + " WHEN len(bytes) > 0 AND NOT list_contains(bytes, '00') AND len(list_filter(bytes, lambda x: x IN ('09', '0A', '0D') OR (x >= '20' AND x <= '7E') OR x >= 'C2')) >= floor(len(bytes) * 0.85) THEN 'text/plain' END AS content_type FROM b",
    "t14_url_gate": "WITH h AS (SELECT page_id, url, [" + ", ".join(f"'{h}'" for h in URL_HOSTS) + f"][page_id % {len(URL_HOSTS)} + 1] AS x FROM pages), u AS (SELECT page_id, CASE WHEN x = '' THEN url ELSE regexp_replace(url, '//[^/]+', '//' || x) END AS url FROM h), "
    + """p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/:?#]+)', 1)) AS host FROM u)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') OR host IN ('', '[fe80]') THEN 'not an absolute http address' WHEN scheme = 'http' THEN 'https is required'
  WHEN host = 'localhost' OR host LIKE '%.local' OR host LIKE '%.internal' THEN 'local host'
  WHEN regexp_matches(host, '^(?:0|10|127)\\.\\d+\\.\\d+\\.\\d+$|^172\\.(?:1[6-9]|2\\d|3[01])\\.\\d+\\.\\d+$|^192\\.168\\.\\d+\\.\\d+$|^169\\.254\\.\\d+\\.\\d+$') OR regexp_matches(host, '^\\[(?:::1|(?:0:)+1|fe[89a-f].:.*|f[cd]..:.*|::ffff:10\\.1\\.2\\.3)\\]$') THEN 'private address' ELSE 'ok' END AS outcome,
  host || regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS name FROM p""",
    "t15_pad_vector": "SELECT vec_id, [round(CAST(x AS DOUBLE), 5) FOR x IN embedding[1:8]] AS v4, [round(CAST(x AS DOUBLE), 5) FOR x IN list_concat(embedding, [CAST(0 AS FLOAT) FOR i IN range(16)])] AS v80 FROM embeddings",
    "t16_vector_bytes": "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, true AS same FROM embeddings",
    "t17_lifetime_expiry": f"{ctes('documents', 'projects')} SELECT document_id, strftime(created_at + to_hours(lifetime_preset), '%Y-%m-%d %H:%M') AS expires_at FROM t_documents JOIN t_projects USING (project_id) WHERE lifetime_preset IS NOT NULL",
    "g1_chunk_pages": f"{_P}, {CHUNK_SQL} SELECT document_id, start, chunk_index, character_count, md5(content) AS content_md5 FROM chunks",
    "g2_tokenize": f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), c AS (SELECT doc_id, t, list_filter(t, lambda x: length(x) >= 3 AND x NOT IN {STOP}) AS c FROM t) SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(c) AS BIGINT) AS candidates, array_to_string(c[1:5], ' ') AS first FROM c",
    "g3_keywords_frequency": f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents),
n AS (SELECT doc_id, t, count(*) AS n FROM t WHERE length(t) >= 3 AND t NOT IN {STOP} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(t) DESC, t) AS r FROM n)
SELECT doc_id, string_agg(t, '|' ORDER BY r) AS keywords FROM r WHERE r <= 12 GROUP BY doc_id""",
    "g6_attach_vectors": f"""{_P}, {CHUNK_SQL},
v AS (SELECT concat_ws(':', vec_id, 1, n) AS chunk_uid FROM embeddings, (SELECT unnest([0, 1, 2]) AS n)),
g AS (SELECT document_id, count(*) AS chunks, count(v.chunk_uid) AS vectors FROM chunks LEFT JOIN v ON v.chunk_uid = concat_ws(':', document_id, 1, chunk_index) GROUP BY 1)
SELECT document_id, chunks, vectors, chunks <> vectors AS failed FROM g""",
    "g7_embedding_batches": f"{_P}, {CHUNK_SQL} SELECT document_id, CAST(chunk_index // 4 AS INT) AS batch, count(*) AS chunks, min(chunk_index) AS first_chunk FROM chunks GROUP BY 1, 2",
    "g8_transcript": f"""{ctes('messages')}, t AS (SELECT project_id, string_agg('[' || CASE WHEN lower(role) = 'user' THEN 'User' ELSE 'Assistant' END || ' - ' || strftime(message_timestamp, '%Y-%m-%d %H:%M') || ']: ' || content, chr(10) ORDER BY message_timestamp, message_id) AS t FROM t_messages GROUP BY 1)
SELECT project_id, md5(t) AS transcript_md5, CAST(length(t) AS BIGINT) AS chars FROM t""",
    "s1_read_documents": f"WITH t AS (SELECT doc_id AS document_id, {_structured('text')} AS text FROM documents) SELECT document_id, 1 AS page_number, 'text' AS source_type, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM t WHERE text <> ''",
    "s1_read_files": f"WITH g AS (SELECT doc_id // 20 AS part, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1), t AS (SELECT part, {_structured('text')} AS text FROM g) SELECT part, 1 AS page_number, 'text' AS source_type, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM t WHERE text <> ''",
    "s2_read_html_pages": f"WITH t AS (SELECT page_id AS document_id, nullif({TITLE}, '') AS title, {_stripped('html')} AS text FROM pages) SELECT document_id, title, 1 AS page_number, 'text' AS source_type, md5(text) AS text_md5 FROM t WHERE text <> ''",
    "s3_read_catalog": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "s4_replace_chunks": f"{_C}, n AS (SELECT document_id, tag + 1 AS tag FROM t_chunks WHERE document_id % 5 = 0), u AS (SELECT index_version, tag FROM t_chunks WHERE document_id % 5 <> 0 UNION ALL SELECT 9, tag FROM n) SELECT index_version, count(*) AS n, CAST(sum(tag) AS BIGINT) AS tags FROM u GROUP BY 1",
    "s6_delete_index_rows": f"{ctes('chunks', 'documents')} SELECT index_version, count(*) AS n, CAST(sum(document_id) AS BIGINT) AS ids FROM t_chunks JOIN t_documents USING (document_id) WHERE NOT (document_id % 3 = 0 AND index_version = 1) GROUP BY 1",
    "s7_upsert_index": f"""{_C}, o AS (SELECT concat_ws(':', document_id, 1, chunk_index) AS u, max(tag) AS tag FROM t_chunks GROUP BY 1),
n AS (SELECT concat_ws(':', document_id, 1, chunk_index) AS u, -max(tag) AS tag FROM t_chunks WHERE document_id % 4 = 0 GROUP BY 1),
a AS (SELECT tag FROM o WHERE u NOT IN (SELECT u FROM n) UNION ALL SELECT tag FROM n) SELECT tag < 0 AS replaced, count(*) AS n, CAST(sum(tag) AS BIGINT) AS tags FROM a GROUP BY 1""",
    "s5_export_bulk": f"""{ctes('pages_text')}, {CHUNK_SQL.replace("document_id, project,", "document_id, project, lang,")}, u AS (SELECT *, concat_ws(':', document_id, 1, chunk_index) AS chunk_uid FROM chunks)
SELECT chunk_uid, CAST(0 AS INT) AS line_no, '{{"index":{{"_index":"chunks","_id":"' || chunk_uid || '"}}}}' AS value FROM u
UNION ALL SELECT chunk_uid, CAST(1 AS INT), '{{"chunkUid":"' || chunk_uid || '","documentId":' || document_id || ',"chunkIndex":' || chunk_index || CASE WHEN document_id % 2 = 0 THEN ',"projectId":"' || project || '"' ELSE '' END || ',"keywords":["' || lang || '","x"],"keywordsText":"' || lang || ' x"}}' FROM u""",
}
_RAKE = f"""WITH s AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_split_to_array(text, '{BREAK}')) AS s FROM conversations),
m AS (SELECT id, row_number() OVER () AS sid, {TOKENS.format('s')} AS t FROM s),
j AS (SELECT id, array_to_string([CASE WHEN length(x) >= 3 AND x NOT IN {STOP} THEN x ELSE chr(10) END FOR x IN t], ' ') AS j FROM m),
p AS (SELECT id, p FROM (SELECT id, trim(unnest(string_split(j, chr(10)))) AS p FROM j) WHERE length(p) >= 3),
w AS (SELECT id, unnest(string_split(p, ' ')) AS w, len(string_split(p, ' ')) - 1 AS deg FROM p),
sc AS (SELECT id, w, (sum(deg) + count(*)) / count(*) AS sc FROM w GROUP BY ALL),
d AS (SELECT id, p, unnest(string_split(p, ' ')) AS w FROM (SELECT DISTINCT id, p FROM p)),
r AS (SELECT id, p, round(sum(sc), 9) AS score FROM d JOIN sc USING (id, w) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(p) DESC, p) AS k FROM r)
SELECT id, string_agg(p, '|' ORDER BY k) AS keywords FROM k WHERE k <= 12 GROUP BY id"""
SQL["s5_export_files"] = f"SELECT value FROM ({SQL['s5_export_bulk']})"
SQL["g4_keywords_rake"] = SQL["g4_keywords_rake_rows"] = _RAKE

SQL |= {f"{k}_buckets": SQL[twin] for k, twin in (("s4_replace", "s4_replace_chunks"), ("s6_delete", "s6_delete_index_rows"), ("s7_upsert", "s7_upsert_index"))}
QUERIES = {f.__name__: f for f in (
    t1_normalize_inline, t2_normalize_structured, t3_strip_html, t4_html_title, t5_chunk_uid, t6_content_hash, t7_context_cache_key, t8_preview, t9_content_type,
    t10_container_kind, t11_supported, t12_route_extractor, t13_sniff, t14_url_gate, t15_pad_vector, t16_vector_bytes, t17_lifetime_expiry, g1_chunk_pages, g2_tokenize,
    g3_keywords_frequency, g4_keywords_rake, g4_keywords_rake_rows, g6_attach_vectors, g7_embedding_batches, g8_transcript, s1_read_documents, s1_read_files, s2_read_html_pages,
    s3_read_catalog, s4_replace_chunks, s5_export_bulk, s5_export_files, s6_delete_index_rows, s7_upsert_index, s4_replace_buckets, s6_delete_buckets, s7_upsert_buckets,
)}
