import pytest
from pyspark.sql import functions as F

from ragloom.functions import files, text, vectors
from ragloom.operators import chunking, keywords


def col(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_normalizing(spark):
    assert col(spark, ["  a \t b \n c　", None, "\u0085"], text.normalize_inline) == ["a b c", "", ""]
    assert col(spark, ["a  \r\nb\r\r\n\n\nc  \n", None], text.normalize_structured) == ["a\nb\n\nc", ""]


def test_strip_html_keeps_script_bodies_and_decodes(spark):
    got = col(spark, ["<p>A&amp;B<br/>c</p><script>x=1</script><b>d</b>&#8364;&nbsp;", None, ""], text.strip_html)
    assert got == ["A&B\nc\n x=1  d €", "", ""]


def test_references_end_with_a_semicolon(spark):
    texts = ["a &amp b &lt", "&amp;&amp;amp", "&amp;lt;", "&copy;&middot;&apos;&#39;&#x20AC;&#X41;", "&#128;", "&nosuch;&hellip; &AMP; &;&#;&#x;", "&#xD800;&#1114112;&#99999999999999999999;", "&a&lt;"]
    want = ["a &amp b &lt", "&&amp", "&lt;", "©·''€A", "\x80", "&nosuch;… &AMP; &;&#;&#x;", "&#xD800;&#1114112;&#99999999999999999999;", "&a<"]
    assert col(spark, texts, text.decode_entities) == want
    assert col(spark, ["<title>R&amp;D &amp</title>"], text.html_title) == ["R&D &amp"] and col(spark, ["R&amp;D &amp"], text.strip_html) == ["R&D &amp"]


def test_title_within_the_first_bytes(spark):
    late = "é" * 4096 + "<title>x</title>"
    assert col(spark, ["<TITLE lang=en>\n a &lt; b </TITLE>", "<title> </title>", late, None], text.html_title) == ["a < b", None, None, None]


def test_preview(spark):
    assert col(spark, ["a" * 96, "a" * 97], text.preview) == ["a" * 96, "a" * 96 + "..."]


def test_tokens_need_two_characters_and_candidates_three(spark):
    assert col(spark, ["Ab c d-e_f The può x1 ÀÈ"], text.tokens) == [["ab", "d-e_f", "the", "può", "x1", "àè"]]
    assert col(spark, ["ab the d-e_f"], text.candidate_tokens) == [["d-e_f"]]


def literal_windows(t, size, overlap):
    out, start = [], 0
    stride = max(1, size - overlap)
    while start < len(t):
        out.append(t[start : start + size])
        if start + size >= len(t):
            break
        start += stride
    return [w.strip() for w in out if w.strip()]


@pytest.mark.parametrize("n", [0, 1, 1399, 1400, 1401, 2549, 2550, 2551, 2552, 7000])
def test_chunks_equal_a_literal_loop(spark, n):
    t = ("abcdefghi " * 800)[:n]
    pages = spark.createDataFrame([("d", 1, t), ("d", 2, "  "), ("d", 3, "tail")], "document_id string, page_number int, text string")
    got = [r["content"] for r in chunking.chunk_pages(pages).orderBy("chunk_index").collect()]
    assert got == literal_windows(t, 1400, 250) + ["tail"]
    one = pages.where("page_number = 1")
    assert [r["content"] for r in chunking.chunk_single_pages(one).orderBy("chunk_index").collect()] == literal_windows(t, 1400, 250)


def test_rake_twins_agree(spark):
    texts = ["Deep learning models. deep learning, learning", "the of and", "", None, "Perché città-stato città-stato\nnon il x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    a = {r["id"]: r["keywords"] for r in keywords.keywords_rake(df, "id", "t").collect()}
    b = {r["id"]: r["keywords"] for r in keywords.keywords_rake_rows(df, "id", "t").collect()}
    assert a == b and set(a) == {0, 4}
    assert a[0][0] == "deep learning models"


def test_frequency_ties_by_length_then_term(spark):
    df = spark.createDataFrame([(1, "bbb aaa cccc bbb aaa cccc ddd")], "id int, t string")
    assert keywords.keywords_frequency(df, "id", "t", 3).first()["keywords"] == ["cccc", "aaa", "bbb"]


def test_sniffing(spark):
    rows = [(b"PK\x03\x04", "application/zip"), (b"%PDF-1", "application/pdf"), (b"Rar!\x1a\x07\x01", "application/vnd.rar"), (b"plain", "text/plain"), (b"a\x00b", None), (b"", None),
            (bytes([0x41] * 17 + [0x01] * 3), "text/plain"), (bytes([0x41] * 16 + [0x85] * 4), None), (bytes([0xC2] * 20), "text/plain")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(rows)], "i int, h binary")
    got = [r["o"] for r in df.select("i", files.sniff_content_type(F.col("h")).alias("o")).orderBy("i").collect()]
    assert got == [t for _, t in rows]


def test_url_gate(spark):
    urls = ["https://a.example/x?q#f", "http://a.example", "ftp://a.example", "https://LOCALHOST/", "https://10.0.0.1/", "https://172.31.1.1", "https://172.32.1.1", "nonsense", None]
    got = col(spark, urls, files.url_gate)
    assert [g == "ok" for g in got] == [True, False, False, False, False, False, True, False, False]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 5.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]
    assert df.select(F.size(vectors.pad_vector(F.col("b"), 2))).first()[0] == 8
    back = df.select(vectors.decode_vector(vectors.encode_vector("b")).alias("x"), "b").collect()
    assert all(r["x"] == r["b"] for r in back)


def test_rounding_keeps_the_sign_of_zero(spark):
    df = spark.createDataFrame([(-1e-7, 1e-7, -0.0, -1.23456789, 2.5e-5)], "a double, b double, c double, d double, e double")
    assert [repr(x) for x in df.select(*[vectors.rounded(F.col(c), 5) for c in "abcde"]).first()] == ["-0.0", "0.0", "-0.0", "-1.23457", "3e-05"]


def test_content_types(spark):
    df = spark.createDataFrame([("x.TAR.GZ", None), ("a.docx", "application/octet-stream"), ("a", " Text/HTML ; q"), (".zip", ""), ("a.", None)], "n string, t string")
    got = [r[0] for r in df.select(files.guess_content_type(F.col("n"), F.col("t"))).collect()]
    assert got == ["application/gzip", files.CONTENT_TYPES[".docx"], "text/html", "application/zip", "application/octet-stream"]
