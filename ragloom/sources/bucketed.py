"""A table in buckets of a key's hash, of which a change rewrites only the buckets it touches.

Layout below ``root``: ``data/version=N-x/bucket=K`` holds bucket K as version N left it, ``manifest/N`` one row
per bucket with the version that is current in version N. A change writes its buckets as a new version
beside the old ones and then its manifest, in one rename of Spark's committer; readers take the newest
manifest that is complete, so they see the table before or after a change, never between. Of two writers of
the same version the second fails and can try again. Old versions stay until ``vacuum``.

Defined results: a null key has a bucket like any other value; changes without rows write nothing; reading a table
without rows gives none. The number of buckets is fixed when the table is made, and bounds what the driver holds.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import delete_index_rows, replace_chunks, upsert_index

_MANIFEST = "bucket int, version string"


class BucketTable(NamedTuple):
    """``key``: the column whose hash deals rows to ``buckets``; ``schema``: the rows' columns as DDL."""

    root: str
    key: str
    buckets: int
    schema: str

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _folder(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def version(self, spark: SparkSession) -> int:
        """The newest complete version; 0 for a table without one."""
        fs, path = self._folder(spark)
        if not fs.exists(path):
            return 0
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=0)

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict[int, str]:
        """The current version of each bucket that has one (``buckets`` rows at most)."""
        version = self.version(spark) if version is None else version
        if not version:
            return {}
        return {r["bucket"]: r["version"] for r in spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/{version}").collect()}

    def read(self, spark: SparkSession, only: set[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        paths = [f"{self.root}/data/version={v}/bucket={b}" for b, v in sorted(self.manifest(spark).items()) if only is None or b in only]
        fs, path = self._folder(spark)
        paths = [p for p in paths if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]  # a bucket may have become empty
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of the rows (``buckets`` numbers at most)."""
        return {r["bucket"] for r in self._bucket(rows).select("bucket").distinct().collect()}

    def _switch(self, rows: DataFrame, touched: set[int]) -> int:
        spark = rows.sparkSession
        old = self.version(spark)
        new = old + 1
        folder = f"{new}-{uuid.uuid4().hex[:8]}"  # a writer that loses the race leaves the winner's files alone
        names = rows.columns
        dealt = self._bucket(rows).repartition(max(1, min(self.buckets, len(touched))), "bucket")
        dealt.select(*names, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/version={folder}")
        current = self.manifest(spark, old) | {b: folder for b in touched}
        spark.createDataFrame(sorted(current.items()), _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/{new}")
        return new

    def _change(self, given: DataFrame, change) -> int:
        spark = given.sparkSession
        touched = self.touched(given)
        return self._switch(change(self.read(spark, touched)), touched) if touched else self.version(spark)

    def create(self, rows: DataFrame) -> int:
        """The first version of the table."""
        return self._switch(rows, set(range(self.buckets)))

    def upsert(self, rows: DataFrame) -> int:
        """The last write of each chunk_uid counts (upsert_index); returns the new version."""
        return self._change(rows, lambda old: upsert_index(old, rows))

    def replace(self, rows: DataFrame) -> int:
        """All chunks of the documents given go, the new ones come (replace_chunks)."""
        return self._change(rows, lambda old: replace_chunks(old, rows))

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of the (project_id, document_id, index_version) given (delete_index_rows)."""
        return self._change(keys, lambda old: delete_index_rows(old, keys))

    def vacuum(self, spark: SparkSession) -> int:
        """Remove the versions that the newest manifest does not name; returns how many folders went."""
        fs, path = self._folder(spark)
        current, gone = self.manifest(spark), 0
        data = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        for version in fs.listStatus(data) if fs.exists(data) else []:
            for bucket in fs.listStatus(version.getPath()):
                v, name = version.getPath().getName(), bucket.getPath().getName()
                if name.startswith("bucket=") and v != f"version={current.get(int(name[7:]))}":
                    gone += bool(fs.delete(bucket.getPath(), True))
        return gone
