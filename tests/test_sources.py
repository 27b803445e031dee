import random
import time

from pyspark.sql import functions as F

from ragloom.functions import files
from ragloom.operators import chunking
from ragloom.shared import fresh_path
from ragloom.sources import bucketed, readers, sinks

SCHEMA = "chunk_uid string, document_id long, v long, updated_at long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_change_rewrites_the_touched_buckets_only(spark):
    old = spark.range(5000).select(F.concat_ws(":", "id", F.lit(0)).alias("chunk_uid"), F.col("id").alias("document_id"), F.lit(1).cast("long").alias("v"), F.lit(0).cast("long").alias("updated_at"))
    table = bucketed.BucketTable(fresh_path(spark, "table"), "document_id", 64, SCHEMA)
    assert table.version(spark) == 0 and table.read(spark).count() == 0
    table.create(old)
    before = table.manifest(spark)
    assert len(before) == 64 and rows_of(table.read(spark)) == rows_of(old)
    new = spark.createDataFrame([(f"{i}:0", i, 7, 5) for i in range(9)] + [("9000:0", 9000, 7, 5)], SCHEMA)
    reads = []
    read = bucketed.BucketTable.read
    bucketed.BucketTable.read = lambda self, s, only=None: reads.append(only) or read(self, s, only)
    try:
        assert table.upsert(new) == 2
    finally:
        bucketed.BucketTable.read = read
    after, touched = table.manifest(spark), table.touched(new)
    assert len(touched) <= 10 and reads == [touched]
    assert {b for b in after if after[b] != before.get(b)} == touched
    want = rows_of(sinks.upsert_index(old, new))
    assert rows_of(table.read(spark)) == want
    assert table.vacuum(spark) >= len(touched) - 1 and rows_of(table.read(spark)) == want
    assert table.upsert(new.where("v = 0")) == 2  # no rows: no version


def test_replace_delete_and_an_interrupted_change(spark):
    schema = "project_id long, document_id long, index_version long, chunk_index long"
    rng = random.Random(3)
    old = spark.createDataFrame([((i or 0) % 5, i, rng.randrange(3), c) for i in [*range(200), None] for c in range(3)], schema)
    table = bucketed.BucketTable(fresh_path(spark, "table"), "document_id", 16, schema)
    table.create(old)
    new = spark.createDataFrame([(1, 7, 9, 0), (1, 500, 9, 0)], schema)
    table.replace(new)
    one = sinks.replace_chunks(old, new)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(table.read(spark)) == key(one)
    keys = one.where("index_version = 1 and document_id % 4 = 0").select("project_id", "document_id", "index_version")
    table.delete(keys)
    two = key(sinks.delete_index_rows(one, keys))
    assert key(table.read(spark)) == two
    # a writer that dies before its manifest leaves the table as it was
    new.write.partitionBy("project_id").parquet(f"{table.root}/data/version=4-dead")
    assert table.version(spark) == 3 and key(table.read(spark)) == two


def test_a_catalog_table_is_read_by_jdbc_in_partitions(spark):
    url = f"jdbc:derby:memory:{fresh_path(spark, 'db').rsplit('-', 1)[-1]};create=true"
    options = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("kind")).write.format("jdbc").options(dbtable="things", **options).save()
    df = readers.read_catalog(spark, "things", "", split_by="id", parts=4, **options)
    assert df.rdd.getNumPartitions() == 4
    assert rows_of(df) == [(i, i % 7) for i in range(1000)]
    plan = df.where("kind = 3").select("id")._jdf.queryExecution().toString()
    assert "*EqualTo(kind,3)" in plan
    assert df.where("kind = 3").count() == 143
    assert readers.read_catalog(spark, "things", "", **options).count() == 1000


def test_addresses_in_every_spelling_are_refused(spark):
    bad = ["127.1", "2130706433", "0x7f.1", "0x7f000001", "0177.0.0.1", "[::ffff:7f00:1]", "[::ffff:10.0.0.1]", "10.0.0.1", "010.0.0.1", "172.31.0.1", "192.168.257", "169.254.169.254", "0", "[::1]", "[fe80::1]", "127.0.0.1."]
    good = ["8.8.8.8", "134744072", "172.32.0.1", "1.1", "[::ffff:808:808]", "[2001:db8::1]", "example.org", "example.org.", "10.example", "a.10", "12ab", "256.256.256.256.1"]
    local = ["localhost", "localhost.", "a.local", "b.internal."]
    rows = [(f"https://{h}/x", want) for hosts, want in ((bad, "private address"), (good, "ok"), (local, "local host")) for h in hosts]
    got = spark.createDataFrame(rows, "url string, want string").select("url", "want", files.url_gate(F.col("url")).alias("got")).where("not (got <=> want)").collect()
    assert got == []


def literal_chunks(text, size, overlap):
    stride = max(1, size - overlap)
    out, s = [], 0
    while True:
        out.append((s, text[s : s + size].strip()))
        s += stride
        if s >= len(text) - overlap:
            return [x for x in out if x[1]]


def test_windows_of_any_size_equal_slices(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cé\n漢😀") for _ in range(n)) for n in (1, 199, 200, 201, 400, 401, 950, 951, 1149, 1150, 1151, 1400, 1401, 3000, 5555)]
    docs = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "document_id long, page_number int, text string")
    for size, overlap in ((1400, 250), (200, 199), (200, 150), (300, 0), (500, 350)):
        want = [(i, s, c) for i, t in enumerate(texts) if t.strip() for s, c in literal_chunks(t, size, overlap)]
        got = chunking.chunk_pages(docs, size, overlap)
        assert sorted((r["document_id"], r["start"], r["content"]) for r in got.collect()) == want
        one = chunking.chunk_single_pages(docs, size, overlap)
        assert sorted((r["document_id"], r["content"]) for r in one.collect()) == sorted((i, c) for i, _, c in want)


def test_chunking_a_long_text_is_linear(spark):
    def seconds(n):
        df = spark.range(1).select(F.col("id").alias("document_id"), F.repeat(F.lit("some words of a very long text. "), n // 32).alias("text"))
        best = []
        for _ in range(3):
            began = time.time()
            chunking.chunk_single_pages(df).agg(F.sum(F.length("content")), F.count("*")).collect()
            best.append(time.time() - began)
        return min(best)

    seconds(1 << 20)
    assert seconds(8 << 20) <= 2.5 * seconds(4 << 20) + 0.5
