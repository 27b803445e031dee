"""Named queries of this subpackage, and the SQL that says the same where SQL can.

Every query reads whole tables of ``sf_dir`` and returns its operator's full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, language_id, language_model, line_dedup, mixing, ngram_join, periodic_runs, pii, quality, spelling, substring_dedup, warc
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_components(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(table(spark, sf_dir, "pages"), docs, docs)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_decontamination": op2_decontamination,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_pii": op4_pii,
        "op5_warc_salvage": op5_warc_salvage,
        "op6_quality_rules": op6_quality_rules,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_source_mixing": op8_source_mixing,
        "op9_line_dedup": op9_line_dedup,
        "op10_language_id": op10_language_id,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_lm_scoring": op13_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op9_line_dedup": OP9_SQL, "op11_spelling_variants": OP11_SQL}


OP2_SQL = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t
),
s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE kind = 1),
h AS (SELECT s.id AS doc_id, item_id, n_item, count(*) AS n_hit FROM s JOIN n USING (g) WHERE kind = 0 GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_hit, n_hit / n_item AS containment FROM h WHERE n_hit >= 0.8 * n_item - 1e-9
"""


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS parts FROM documents),
l AS (
  SELECT doc_id, source, unnest(range(len(parts))) AS no, trim(unnest(parts), ' ' || chr(9) || chr(13)) AS line FROM d
),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
g AS (SELECT l.doc_id, list(DISTINCT no) AS gone FROM l JOIN b USING (line) GROUP BY l.doc_id),
t AS (
  SELECT d.doc_id, d.text, len(d.parts) AS n, coalesce(len(g.gone), 0) AS k,
         CASE WHEN g.gone IS NULL THEN d.text
              ELSE coalesce(array_to_string([parts[i + 1] FOR i IN range(len(parts)) IF NOT list_contains(g.gone, i)], chr(10)), '') END AS cut
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(k AS BIGINT) AS n_removed, cut AS text FROM t
"""


OP11_SQL = r"""
WITH RECURSIVE
bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc
),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS r FROM documents
),
low AS (
  SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM runs GROUP BY 1, 2
),
bytes AS (
  SELECT d, r, n, flatten(list_transform(string_split(d || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS b FROM low
),
hashed AS (
  SELECT r, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, bits
),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed
),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS o, b.n AS o_n FROM cut a JOIN cut b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.s = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.s = w.word
),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min(struct_pack(m := -o_n, o := o)) AS b FROM near GROUP BY word),
forms AS (SELECT word, n_near, CASE WHEN -b.m >= 10 * n THEN b.o END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n FROM best),
walk AS (
  SELECT word, word AS root FROM words
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.root = forms.word WHERE forms.form IS NOT NULL
),
ends AS (SELECT walk.word, walk.root FROM walk LEFT JOIN forms ON walk.root = forms.word WHERE forms.form IS NULL)
SELECT w.word, f.form, e.root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM words w LEFT JOIN forms f USING (word) JOIN ends e USING (word)
"""
