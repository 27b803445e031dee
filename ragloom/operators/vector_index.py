"""A stored vector index, and exact cosine search in it that skips cells by the triangle bound.

``write_index`` clusters a bounded sample of the vectors round centroids, and writes every vector with
the centroid it is nearest to and its angle from there. Vectors of a centroid are parted by that angle into rings, so a
cell (centroid, ring) has a least and a greatest angle. For a question at angle t from a centroid no vector of a cell
is nearer than max(t - greatest, least - t): angles on the sphere obey the triangle inequality.

``search`` first compares a question with its nearest cells, until they hold SEEDS times k vectors. The
k-th best cosine found is a limit that the result cannot fall below, so of all other cells only those whose bound
reaches it are compared, in a second step. Cells and questions meet in co-grouped tasks
(lists salted to PART vectors, questions to slots), by matrix products. The rows are those of comparing everything.

Defined results: as for cosine_topk: a cosine over the shorter length, 0 where a norm is 0. Vectors of another length than
the index has, or without a norm, are kept apart and always compared; a question of another length is
compared with every vector. Null and empty vectors are in no result; ties are by chunk_uid.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import keep

#: Vectors of the sample, centroids, rounds of clustering, rings of a centroid; vectors of a part of a list, questions compared at once.
SAMPLE, LISTS, ROUNDS, RINGS, PART, QUERIES = 20_000, 1024, 6, 64, 8192, 2048
#: Groups into which the questions of a list are dealt.
SLOTS = 4
#: How many times k vectors the first step compares; slack of bounds for rounding.
SEEDS, SLACK = 8, 1e-6


class Index(NamedTuple):
    """rows: (list, salt, ring, chunk_uid, embedding); cells: (list, ring, least, most, n) of at most
    LISTS * RINGS cells; odd: vectors that are always compared."""

    rows: DataFrame
    cells: DataFrame
    odd: DataFrame
    centroids: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(1)), 1e-300)[:, None]


def centroids_of(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of a sample by spherical k-means."""
    x = _unit(sample)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.flatnonzero(~total.any(1))
        total[empty] = x[rng.choice(len(x), len(empty))]
        c = _unit(total)
    return c


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def write_index(vectors: DataFrame, path: str, dims: int | None = None) -> Index:
    """The index of ``vectors`` (chunk_uid, embedding) below ``path``. ``dims``: length of the indexed vectors,
    by default that of most."""
    spark = vectors.sparkSession
    vectors = vectors.select("chunk_uid", F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") > 0)
    if dims is None:
        most = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        dims = most["d"] if most else 1
    even = (F.size("embedding") == dims) & F.exists("embedding", lambda x: x != 0)
    n = vectors.where(even).count()
    share = min(1.0, SAMPLE / max(1, n))
    by_hash = F.pmod(F.xxhash64("chunk_uid"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = vectors.where(even & by_hash).select("embedding").limit(2 * SAMPLE).toArrow()  # SAMPLE vectors or about so many
    lists = max(1, min(LISTS, int(np.sqrt(n))))
    c = centroids_of(_matrix(sample.column(0).combine_chunks(), dims), lists) if sample.num_rows else np.eye(1, dims)
    kind = dict(vectors.dtypes)["chunk_uid"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = _unit(_matrix(b.column(1), dims)) @ c.T if b.num_rows else np.zeros((0, len(c)))
            near = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(near)), near], -1, 1))
            ring = np.minimum((angle * RINGS / np.pi).astype(np.int32), RINGS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(ring), pa.array(angle), b.column(0), b.column(1)], ["list", "ring", "angle", "chunk_uid", "embedding"])

    schema = f"list int, ring int, angle double, chunk_uid {kind}, embedding array<float>"
    placed = keep(vectors.where(even).mapInArrow(assign, schema), "placed")
    cells = placed.groupBy("list", "ring").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count("*").alias("n"))
    cells.write.parquet(f"{path}/cells")
    cells = spark.read.schema(cells.schema).parquet(f"{path}/cells")
    salts = F.broadcast(cells.groupBy("list").agg(F.ceil(F.sum("n") / PART).cast("int").alias("salts")))  # LISTS rows at most
    rows = placed.join(salts, "list").select("list", F.pmod(F.xxhash64("chunk_uid"), F.col("salts")).cast("int").alias("salt"), "ring", "chunk_uid", "embedding")
    rows.repartition("list", "salt").sortWithinPartitions("list", "ring").write.parquet(f"{path}/rows")
    odd = vectors.where(~even)
    odd.write.parquet(f"{path}/odd")
    return Index(spark.read.schema(rows.schema).parquet(f"{path}/rows"), cells, spark.read.schema(odd.schema).parquet(f"{path}/odd"), c)


def _probe(index: Index, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """(query_id, query_vector, list, rings) of the cells that the first step, or the second one (with the
    column ``limit``: a cosine) compares."""
    cells = index.cells.orderBy("list", "ring").toArrow()  # LISTS * RINGS rows at most
    which, ring, n = (cells.column(x).to_numpy() for x in ("list", "ring", "n"))
    least, most = cells.column("least").to_numpy(), cells.column("most").to_numpy()
    c, dims = index.centroids, index.centroids.shape[1]
    kind = dict(queries.dtypes)["query_id"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                v = _matrix(part.column(1), dims)
                t = np.arccos(np.clip(_unit(v) @ c.T, -1, 1))[:, which]
                bound = np.cos(np.clip(np.maximum(np.maximum(t - most, least - t), 0) - SLACK, 0, np.pi))
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                seeds = np.zeros(bound.shape, bool)
                np.put_along_axis(seeds, order, held - n[order] < SEEDS * k, axis=1)
                if first:
                    pick = seeds
                else:
                    limit = pc.fill_null(part.column(2), -2.0).to_numpy(zero_copy_only=False)
                    # a vector without a norm has the cosine 0 with all
                    pick = ~seeds & ((bound >= limit[:, None] - SLACK) | ~v.any(1)[:, None])
                q, cell = np.nonzero(pick)  # by question, then list
                first_of = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (which[cell][1:] != which[cell][:-1]))[: len(q)])
                rings = pa.ListArray.from_arrays(pa.array(np.append(first_of, len(q)), pa.int32()), pa.array(ring[cell]))
                ask = pa.array(q[first_of])
                yield pa.RecordBatch.from_arrays([part.column(0).take(ask), part.column(1).take(ask), pa.array(which[cell][first_of]), rings], ["query_id", "query_vector", "list", "rings"])

    columns = ["query_id", "query_vector", *([] if first else ["limit"])]
    return queries.select(*columns).mapInArrow(near, f"query_id {kind}, query_vector array<float>, list int, rings array<int>")


def _compare(index: Index, probes: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, chunk_uid, score, compared: the k best vectors of every part of a cell for the questions that probe it."""
    kinds = dict(probes.dtypes), dict(index.rows.dtypes)
    schema = f"query_id {kinds[0]['query_id']}, chunk_uid {kinds[1]['chunk_uid']}, score double, compared long"
    arrow, dims = to_arrow_schema(StructType.fromDDL(schema)), index.centroids.shape[1]
    probes = probes.withColumn("slot", F.pmod(F.xxhash64("query_id"), F.lit(SLOTS)).cast("int"))
    parts = index.rows.select("list", "salt").distinct()
    left = index.rows.join(probes.select("list", "slot").distinct(), "list")
    right = probes.join(parts, "list")
    by = ["list", "salt", "slot"]
    left = left.select(*[F.col(c).alias(c) for c in [*by, "ring", "chunk_uid", "embedding"]])
    right = right.select(*[F.col(c).alias(c) for c in [*by, "query_id", "query_vector", "rings"]])

    def score(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return arrow.empty_table()
        uids, ids = rows.column("chunk_uid").combine_chunks(), asks.column("query_id").combine_chunks()
        place = np.empty(len(uids), np.int64)
        place[pc.sort_indices(uids).to_numpy()] = np.arange(len(uids))
        m, ring = _matrix(rows.column("embedding").combine_chunks(), dims), rows.column("ring").to_numpy()
        v, rings = _matrix(asks.column("query_vector").combine_chunks(), dims), asks.column("rings").combine_chunks()
        probed = np.zeros((len(v), RINGS), bool)
        probed[np.repeat(np.arange(len(v)), np.diff(rings.offsets.to_numpy())), rings.flatten().to_numpy()] = True
        compared = probed.astype(np.int64) @ np.bincount(ring, minlength=RINGS)
        norm = np.sqrt((m * m).sum(1, dtype=np.float64))
        out = []
        for lo in range(0, len(v), QUERIES):
            w = v[lo : lo + QUERIES]
            best = ([], [], [])
            for r0 in np.unique(ring):
                at, of = np.flatnonzero(ring == r0), np.flatnonzero(probed[lo : lo + QUERIES, r0])
                if not len(of):
                    continue
                both = norm[at][:, None] * np.sqrt((w[of] * w[of]).sum(1, dtype=np.float64))
                rough = np.divide(m[at].astype(np.float64) @ w[of].T.astype(np.float64), both, out=np.zeros(both.shape), where=both > 0)
                least = np.partition(rough, len(at) - k, axis=0)[len(at) - k] if len(at) > k else np.full(len(of), -2.0)
                r, x = np.nonzero(rough >= least - max(SLACK, 10.0 ** (1 - digits)))
                dot = (m[at[r]] * w[of[x]]).sum(1, dtype=np.float64)
                for part, new in zip(best, (at[r], of[x], np.divide(dot, both[r, x], out=np.zeros(len(dot)), where=both[r, x] > 0)), strict=True):
                    part.append(new)
            if not best[0]:
                continue
            r, x, s = (np.concatenate(part) for part in best)
            o = np.lexsort((place[r], -np.round(s, digits), x))
            r, x, s = r[o], x[o], s[o]
            top = np.arange(len(x)) - np.searchsorted(x, np.arange(len(w)))[x] < k
            out.append(pa.table([ids.take(pa.array(lo + x[top])), uids.take(pa.array(r[top])), pa.array(s[top]), pa.array(compared[lo + x[top]])], names=arrow.names).cast(arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, schema)


def search(index: Index, queries: DataFrame, k: int = 6, digits: int = 9) -> DataFrame:
    """query_id, chunk_uid, score, compared: among them the k best vectors of every question (query_id,
    query_vector). ``compared``: how many vectors the question met where the row was found.
    Scores that are equal when rounded to ``digits`` are ties."""
    from .retrieval import cosine_topk

    dims = index.centroids.shape[1]
    q = queries.select("query_id", F.col("query_vector").cast("array<float>").alias("query_vector")).where(F.size("query_vector") > 0)
    fits = F.size("query_vector") == dims
    first = keep(_compare(index, _probe(index, q.where(fits), k, True), k, digits), "first-hits")
    ranked = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # k rows a cell of the first step
    limit = ranked.select("query_id", F.get("s", F.lit(k - 1)).alias("limit"))
    second = _compare(index, _probe(index, q.where(fits).join(limit, "query_id", "left"), k, False), k, digits)
    other = [cosine_topk(q.where(~fits), index.rows, k, digits=digits), cosine_topk(q, index.odd, k, digits=digits)]
    hits = first.unionByName(second)
    for x in other:
        hits = hits.unionByName(x.select("query_id", "chunk_uid", "score", F.lit(None).cast("long").alias("compared")))
    return hits
