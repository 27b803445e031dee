"""A stored inverted index over chunks, and BM25 search in it that skips blocks of chunks by their bounds.

``write_index`` deals the chunks of each scope to segments (dealing.salted), orders a segment's chunks
so that those with the same common words are neighbours, and stores a row per segment, field and
term: the places of the chunks that hold it, how often, and for every block of BLOCK neighbours the
greatest frequency and the least length, from which an upper bound of the term's score in that
block follows whatever the statistics are. A further row per segment (field -1) holds the ids and lengths
of its chunks. Terms that no question asks are never read further than their column of terms.

``search`` joins the questions' terms with the postings by scope and term, and co-groups them with the
questions segment by segment. There a question's terms are summed to a bound per block; blocks are
scored exactly in the order of their bounds until the k-th best score is above the bounds of
the rest (max-score with block bounds), so the result is that of scoring everything.

Defined results: statistics are those of the whole index, whatever the scope; a null in a scope's columns
agrees with nothing; chunks without text and keywords are in no posting; ties are by chunk_uid.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, trim_space
from .dealing import meet, salted, scope_of

#: Chunks of a segment, chunks of a block, questions of a slot.
SEGMENT, BLOCK, QUERIES = 4096, 2, 2_000
#: Terms of questions up to which they are broadcast.
BROADCAST_TERMS = 300_000
K1, B = 1.2, 0.75
#: The fields of a posting: tokens of the text, tokens of the keywords, whole keywords; and the segment's own row.
TEXT, WORDS, KEYS, CHUNKS = 0, 1, 2, -1

_SCHEMA = (
    "scope string, salt int, field int, term string, rows array<int>, tf array<int>, blocks array<int>, block_tf array<int>, "
    "block_len array<int>, uids array<{uid}>, docs array<{doc}>, len0 array<int>, len1 array<int>"
)


class Index(NamedTuple):
    """The tables of a stored index and the columns of its scope."""

    table: DataFrame
    same: tuple[str, ...]
    listed: bool

    @property
    def segments(self) -> DataFrame:
        return self.table.where(F.col("field") == CHUNKS)

    @property
    def postings(self) -> DataFrame:
        return self.table.where(F.col("field") >= 0)


def _lists(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, pa.int32()))


def _owners(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _split(joined: pa.Array) -> pa.Array:
    """Lists of tokens from tokens joined by blanks; an empty string has none."""
    lists = pc.split_pattern(joined, " ")
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    each = np.bincount(_owners(lists)[some.to_numpy(zero_copy_only=False)], minlength=len(lists))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), flat.filter(some))


def _counted(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, term number, frequency) of a column of lists, each pair once."""
    flat = lists.flatten().dictionary_encode()
    code, n = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(flat.dictionary))
    pair, tf = np.unique(_owners(lists) * n + code, return_counts=True)
    return flat.dictionary, pair // n, pair % n, tf


def _neighbours(row: np.ndarray, term: np.ndarray, n_rows: int) -> np.ndarray:
    """The new place of each row: rows are ordered by their three commonest terms."""
    df = np.bincount(term) if len(term) else np.zeros(1, np.int64)
    o = np.lexsort((term, -df[term], row))
    row, term = row[o], term[o]
    first = np.searchsorted(row, np.arange(n_rows))
    size = np.bincount(row, minlength=n_rows)
    keys = [np.where(size > k, term[np.minimum(first + k, max(0, len(term) - 1))] if len(term) else 0, -1) for k in range(3)]
    place = np.empty(n_rows, np.int64)
    place[np.lexsort(keys[::-1])] = np.arange(n_rows)
    return place


def _segment(t: pa.Table, schema: pa.Schema, asked: pa.Array | None) -> pa.Table:
    """The posting rows of a segment's chunks, of all terms or the asked ones."""
    t = t.combine_chunks()
    n = t.num_rows
    col = {c: t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([], t.schema.field(c).type) for c in ("t0", "t1", "keys")}
    col |= {c: _split(col[c]) for c in ("t0", "t1")}
    counted = [_counted(col[c]) for c in ("t0", "t1", "keys")]
    place = _neighbours(counted[0][1], counted[0][2], n)
    order = np.argsort(place)
    lengths = [np.bincount(_owners(col[c]), minlength=n)[order] for c in ("t0", "t1", "keys")]
    if asked is not None:
        lengths[0] = t.column("n0").to_numpy()[order]
    out = []
    for field, (terms, row, term, tf) in enumerate(counted):
        if not len(row):
            continue
        if asked is not None:  # the other terms' rows would never be read
            known = pc.index_in(terms, value_set=asked)
            at_term = np.cumsum(known.is_valid().to_numpy(zero_copy_only=False)) - 1
            some = known.is_valid().to_numpy(zero_copy_only=False)[term]
            terms, row, term, tf = terms.filter(known.is_valid()), row[some], at_term[term[some]], tf[some]
            if not len(row):
                continue
        at = place[row]
        o = np.lexsort((at, term))
        at, term, tf = at[o], term[o], tf[o]
        edge = np.searchsorted(term, np.arange(len(terms) + 1))
        block = term * (n // BLOCK + 1) + at // BLOCK
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        block_edge = np.searchsorted(term[first], np.arange(len(terms) + 1))
        data = {"field": pa.array(np.full(len(terms), field), pa.int32()), "term": terms, "rows": _lists(at, edge), "tf": _lists(tf, edge)}
        data |= {"blocks": _lists((at // BLOCK)[first], block_edge), "block_tf": _lists(np.maximum.reduceat(tf, first), block_edge)}
        data["block_len"] = _lists(np.minimum.reduceat(lengths[field][at], first), block_edge)
        out.append(data)
    own = [0, n]
    docs = t.column("document_id").take(pa.array(order)).combine_chunks()
    uids = t.column("chunk_uid").take(pa.array(order)).combine_chunks()
    out.append(
        {
            "field": pa.array([CHUNKS], pa.int32()), "len0": _lists(lengths[0], own), "len1": _lists(lengths[1], own),
            "uids": pa.ListArray.from_arrays(pa.array(own, pa.int32()), uids), "docs": pa.ListArray.from_arrays(pa.array(own, pa.int32()), docs),
        }
    )
    scope, salt = t.column("scope")[0].as_py(), t.column("salt")[0].as_py()

    def table(data: dict) -> pa.Table:
        k = len(data["field"])
        data |= {"scope": pa.array([scope] * k), "salt": pa.array(np.full(k, salt), pa.int32())}
        return pa.Table.from_arrays([data[f.name].cast(f.type) if f.name in data else pa.nulls(k, f.type) for f in schema], schema=schema)

    return pa.concat_tables([table(d) for d in out])


def write_index(rows: DataFrame, path: str, same: tuple[str, ...] = (), listed: bool = False, counted: DataFrame | None = None, asked: pa.Array | None = None) -> Index:
    """The index of ``rows`` (chunk_uid, text or its tokens, keywords, the columns of ``same``, and document_id if
    ``listed``), written below ``path``. ``counted``: the same rows in a form that is cheaper to count (with the
    columns of ``same``). With ``asked`` the index is one for these terms alone: rows then hold the asked ones of their
    tokens and the number of all, n_tokens, so statistics and scores are those of the whole index."""
    kinds = dict(rows.dtypes)
    doc = "document_id" if listed else F.lit(0).alias("document_id")
    schema = _SCHEMA.format(uid=kinds["chunk_uid"], doc=kinds["document_id"] if listed else "int")
    keys = F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>")))
    # chunks without a scope count in the statistics, under a name that no question's scope has
    scope = F.coalesce(scope_of(same), F.lit("\x00" * len(same)))
    sizes = None if counted is None else counted.select(scope.alias("scope"))
    text = "tokens" if "tokens" in rows.columns else "text"
    found = F.coalesce("tokens", F.array().cast("array<string>")) if text == "tokens" else tokens(F.col("text"))
    count = [] if asked is None else ["n_tokens"]
    dealt = salted(rows.select("chunk_uid", doc, text, "keywords", *count, scope.alias("scope")), "chunk_uid", SEGMENT, sizes)
    # tokens travel as one string, which is far smaller than an array of them
    parts = dealt.select("scope", "salt", "chunk_uid", "document_id", F.array_join(found, " ").alias("t0"), F.coalesce(F.array_join(tokens(F.array_join("keywords", " ")), " "), F.lit("")).alias("t1"), keys.alias("keys"), *([] if asked is None else [F.col("n_tokens").alias("n0")]))
    arrow = _arrow_schema(rows.sparkSession, schema)
    parts.groupBy("scope", "salt").applyInArrow(lambda t: _segment(t, arrow, asked), schema).write.partitionBy("field").parquet(path)
    return read_index(rows.sparkSession, path, schema, same, listed)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def asked_terms(queries: DataFrame) -> pa.Array | None:
    """The distinct tokens and keywords of the questions, where they are at most BROADCAST_TERMS."""
    every = F.concat(tokens(F.col("query_text")), F.coalesce("keywords", F.array().cast("array<string>")))
    terms = queries.select(F.explode(every).alias("term")).where("term is not null").distinct().limit(BROADCAST_TERMS + 1).toArrow().column(0).combine_chunks()
    return terms.cast(pa.string()) if len(terms) <= BROADCAST_TERMS else None


def read_index(spark, path: str, schema: str, same: tuple[str, ...] = (), listed: bool = False) -> Index:
    return Index(spark.read.schema(schema).parquet(path), same, listed)


class _Found(NamedTuple):
    """A term's chunks in a segment with their share of the score, and its bound in each block; both without the term's weight."""

    rows: np.ndarray
    part: np.ndarray
    blocks: np.ndarray
    bound: np.ndarray


def _share(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def best_of_segment(terms: list[tuple[float, _Found]], keys: list[_Found], bonus: float, n: int, k: int, allowed: np.ndarray | None, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, number of rows scored) of the k best rows of a segment of n rows."""
    blocks = np.zeros(-(-n // BLOCK))
    for w, t in terms:
        blocks[t.blocks] += w * t.bound
    extra = np.zeros(len(blocks), bool)
    for t in keys:
        extra[t.blocks] = True
    blocks += bonus * extra
    order = np.argsort(-blocks, kind="stable")
    order = order[blocks[order] > 0]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0), 0
    rows = np.concatenate([t.rows for _, t in terms]) if terms else np.zeros(0, np.int64)
    part = np.concatenate([w * t.part for w, t in terms]) if terms else np.zeros(0)
    of = rows // BLOCK
    key_rows = np.unique(np.concatenate([t.rows for t in keys])) if keys else np.zeros(0, np.int64)
    best_rows, best, scored, done, step = np.zeros(0, np.int64), np.zeros(0), 0, 0, max(1, -(-4 * k // BLOCK))
    while done < len(order):
        least = best[k - 1] - 1e-8 if len(best) >= k else 0.0
        now = order[done : done + step]
        now = now[blocks[now] >= least]
        if not len(now):
            break
        chosen = np.zeros(len(blocks), bool)
        chosen[now] = True
        hit = chosen[of]
        total = np.bincount(rows[hit], part[hit], n).astype(np.float64)  # of nothing it makes integers
        mine = key_rows[chosen[key_rows // BLOCK]]
        total[mine] += bonus
        if allowed is not None:
            total[~allowed] = 0.0
        at = np.flatnonzero(total > 0)
        scored += len(at)
        at, s = np.concatenate([best_rows, at]), np.concatenate([best, total[at]])
        o = np.lexsort((place[at], -np.round(s, 9)))[:k]
        best_rows, best = at[o], s[o]
        done += step
        step *= 4
    return best_rows, best, scored


def search(index: Index, queries: DataFrame, k: int = 24, match_weight: float = 2.0, keyword_weight: float = 1.0, terms_score: float = 1.0) -> DataFrame:
    """query_id, chunk_uid, score, scored: the k best chunks of every segment for each question
    (query_id, query_text, keywords, scope columns, document_ids if listed), and how many rows were scored there.

    Score: ``match_weight`` times the BM25 of the text, plus ``keyword_weight`` times that of the joined keywords, plus
    ``terms_score`` if any of the question's keywords is one of the chunk's."""
    kinds = dict(queries.dtypes), dict(index.table.dtypes)
    q = queries.where(trim_space(F.coalesce("query_text", F.lit(""))) != "")
    words = F.array_distinct(tokens(F.col("query_text")))
    keys = F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>")))
    q = q.select("query_id", scope_of(index.same).alias("scope"), words.alias("terms"), keys.alias("keys"), *(["document_ids"] if index.listed else []))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    filled = lambda c: F.size(F.filter(c, lambda x: x > 0)).cast("long")
    stats = index.segments.agg(*[F.sum(f(c)) for c in ("len0", "len1") for f in (filled, size)]).first()
    n = [stats[0] or 0, stats[2] or 0]
    average = [(stats[1] or 0) / n[0] if n[0] else 1.0, (stats[3] or 0) / n[1] if n[1] else 1.0]
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("t")) for f, c in ((TEXT, "terms"), (WORDS, "terms"), (KEYS, "keys"))])
    asked = q.select("query_id", "scope", F.explode(fields).alias("f")).select("query_id", "scope", "f.field", F.explode("f.t").alias("term"))
    terms = asked.select("field", "term").distinct()
    small = F.broadcast if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda d: d)
    everywhere = index.postings.join(small(terms), ["field", "term"], "left_semi")
    df = everywhere.where(F.col("field") != KEYS).groupBy("field", "term").agg(F.sum(F.size("rows")).alias("df"))
    count = F.when(F.col("field") == TEXT, n[0]).otherwise(n[1])
    weight = F.when(F.col("field") == TEXT, match_weight).otherwise(keyword_weight) * F.log(1 + (count - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, ["field", "term"], "left").select("query_id", F.struct("field", "term", F.when(F.col("field") == KEYS, terms_score).otherwise(weight).alias("weight")).alias("t"))
    weighed = weighed.where("t.weight is not null").groupBy("query_id").agg(F.collect_list("t").alias("asked"))
    questions = q.select("query_id", "scope", *(["document_ids"] if index.listed else [])).join(weighed, "query_id")
    # only the postings that a question of the same scope asks
    scoped = asked.select("scope", "field", "term").distinct()
    small = F.broadcast if scoped.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda d: d)
    wanted = index.postings.join(small(scoped), ["scope", "field", "term"], "left_semi")
    rows = wanted.select(*index.table.columns).unionByName(index.segments.join(q.select("scope").distinct(), "scope", "left_semi").select(*index.table.columns))
    listed = index.listed
    uid_kind, id_kind = kinds[1]["uids"].removeprefix("array<").removesuffix(">"), kinds[0]["query_id"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        head = left.filter(pc.equal(left.column("field"), CHUNKS)) if left.num_rows else left
        if head.num_rows and right.num_rows:
            uids = head.column("uids").combine_chunks().flatten()
            lens = [head.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("len0", "len1")]
            place = np.empty(len(uids), np.int64)
            place[pc.sort_indices(uids).to_numpy()] = np.arange(len(uids))
            docs = head.column("docs").combine_chunks().flatten() if listed else None
            where = {(f, t): i for i, (f, t) in enumerate(zip(left.column("field").to_pylist(), left.column("term").to_pylist(), strict=True))}
            columns = [left.column(c).combine_chunks() for c in ("rows", "tf", "blocks", "block_tf", "block_len")]
            edges = [c.offsets.to_numpy() for c in columns]
            values = [c.values.to_numpy(zero_copy_only=False) for c in columns]
            known: dict[tuple[int, str], _Found] = {}

            def found(f: int, t: str) -> _Found | None:
                i = where.get((f, t))
                if i is None:
                    return None
                if (f, t) not in known:
                    r, tf, blocks, btf, blen = (v[e[i] : e[i + 1]] for v, e in zip(values, edges, strict=True))
                    if f == KEYS:
                        known[f, t] = _Found(r.astype(np.int64), np.ones(len(r)), blocks, np.ones(len(blocks)))
                    else:
                        known[f, t] = _Found(r.astype(np.int64), _share(tf, lens[f][r], average[f]), blocks, _share(btf, blen, average[f]))
                return known[f, t]

            lists = right.column("document_ids").to_pylist() if listed else [None] * right.num_rows
            for query, asks, ids in zip(right.column("query_id").to_pylist(), right.column("asked").to_pylist(), lists, strict=True):
                allowed = pc.is_in(docs, value_set=pa.array(ids or [], docs.type)).to_numpy(zero_copy_only=False) if listed else None
                hits = [(a["field"], a["weight"], found(a["field"], a["term"])) for a in asks]
                terms = [(w, t) for f, w, t in hits if t is not None and f != KEYS]
                at, s, scored = best_of_segment(terms, [t for f, _, t in hits if t is not None and f == KEYS], terms_score, len(uids), k, allowed, place)
                out[0].extend([query] * len(at))
                out[1].append(uids.take(pa.array(at)))
                out[2].append(s)
                out[3].extend([scored] * len(at))
        schema = arrow
        if not out[0]:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(out[0], schema[0].type), pa.chunked_array(out[1]).cast(schema[1].type), pa.array(np.concatenate(out[2])), pa.array(out[3], pa.int64())], schema=schema)

    result = f"query_id {id_kind}, chunk_uid {uid_kind}, score double, scored long"
    arrow = _arrow_schema(queries.sparkSession, result)
    return meet(rows, questions, index.segments.select("scope", "salt"), QUERIES, score, result)
