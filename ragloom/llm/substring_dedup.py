"""Repeated passages: paragraph MinHash banding, for lines and for windows of words inside them.

Method: paragraphs (lines with a word) get MinHash signatures over five-word shingles; the
numbers of bands and rows are tuned for high recall at the threshold; paragraphs that
collide in a band are joined, verified by exact Jaccard similarity, and clustered by
connected components; of each cluster the first occurrence stays. A passage that was
pasted into the middle of paragraphs makes no two of them similar. So what line removal
leaves is also cut into overlapping pseudo-paragraphs of ``WINDOW`` words, each chosen as
the minimum of a sliding MinHash, so that any common run of ``RUN`` words holds one in both
documents. Of their 28 shingles similar ones share 25, that is they are equal but for words
at an edge; so their one band has all rows, colliding ones are equal, and each class of equal
ones is a cluster. Neighbouring windows of one fate are merged into passages.

Defined results: null or blank text has no paragraphs; a paragraph repeated within one
document counts like one in another, and windows likewise; a line under five words is one
shingle; rows are returned for repeated passages only, with positions in code points
(paragraphs) or words (windows). The first occurrence is that of the smallest doc_id, then
line or word; rows without doc_id come last, have a null doc_id in the result, and count
once if their texts are equal; rows that share a doc_id are parts of one document, whose
lines of one number are not told apart. doc_id is under 2^62. Texts of any length are cut
whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, keep, member, membership, mix, set_marks, shingle_hashes, signed, words_of
from .setjoin import connect, parity_bitmap

MIN_WORDS, WINDOW, RUN = 1, 32, 50
SHINGLE = 5
#: Ids from here on stand for rows without doc_id.
_NAMELESS = 1 << 62


def tune(similarity: float, recall: float = 0.9995, most_rows: int = 6) -> tuple[int, int]:
    """(bands, rows) with the fewest hashes that find pairs of the similarity with the recall;
    three rows at least keep chance collisions rare."""
    ways = [(math.ceil(math.log(1 - recall) / math.log(1 - similarity**r)), r) for r in range(3, most_rows + 1)]
    return min(ways, key=lambda x: x[0] * x[1])


def _signatures(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (sets, bands) of the MinHash signatures of the sets that begin at ``starts`` of ``values``."""
    h = (values >> U64(32)).astype(np.uint32)
    keys = np.zeros((len(starts), bands), U64)
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    for b in range(bands):
        key = np.full(len(starts), b + 1, U64)
        for r in range(rows):
            k = 2 * (b * rows + r)
            x = h * np.uint32(int(seeds[k]) & 0xFFFFFFFF | 1) ^ np.uint32(int(seeds[k + 1]) & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            key = mix(key * U64(31) + np.minimum.reduceat(x, starts).astype(U64))
        keys[:, b] = key
    return keys


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over runs of n."""
    out, done = x, 1
    while done < n:
        step = min(done, n - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def _windows(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the chosen windows of consecutive texts (``at``: the text of each word)."""
    if len(w) < WINDOW:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = shingle_hashes(w, WINDOW)
    inside = at[: len(h)] == at[WINDOW - 1 :]  # windows that no text's end cuts
    guard = RUN - WINDOW + 1
    h[~inside] = U64(0xFFFFFFFFFFFFFFFF)
    chosen = np.zeros(0, np.int64)
    if len(h) >= guard:
        low = _sliding(h, guard, np.minimum)
        n = len(low)
        low[~(inside[:n] & inside[guard - 1 :] & (at[:n] == at[guard - 1 : guard - 1 + n]))] = 0  # a window's hash is never 0 but by chance
        pad = np.zeros(guard - 1, U64)
        chosen = np.flatnonzero((_sliding(np.concatenate([pad, low, pad]), guard, np.maximum) == h) & inside)
    # texts with fewer windows than a guard have their least one
    first = np.flatnonzero(inside & np.append(True, at[1 : len(h)] != at[: len(h) - 1]))
    last = first + np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
    few = [lo + int(h[lo:hi].argmin()) for lo, hi in zip(first, last) if hi - lo < guard]
    chosen = np.sort(np.concatenate([chosen, np.array(few, np.int64)]))
    return h[chosen], chosen


class _Lines:
    """The lines with words of consecutive texts of a buffer: their places and shingles."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        base, n = int(off[0]), len(off) - 1
        part, off = data[base : off[-1]], off - base
        #: hash and text of each word, and the first word of each text
        self.w, ws, _, self.of = words_of(part, off)
        self.edge = np.searchsorted(self.of, np.arange(n + 1))
        lead = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=lead[1:])
        feeds = np.flatnonzero(part == 10)
        starts = np.concatenate([off[:-1], feeds + 1])
        text = np.concatenate([np.arange(n), np.searchsorted(off, feeds, "right") - 1])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        ends = np.append(starts[1:] - 1, 0)
        lasts = np.append(text[1:] != text[:-1], True)
        ends[lasts] = off[text[lasts] + 1]
        no = np.arange(len(text)) - np.searchsorted(text, text)
        lo, hi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
        some = hi - lo >= MIN_WORDS
        starts, ends, lo, hi = starts[some], ends[some], lo[some], hi[some]
        self.text, self.no, self.words = text[some], no[some], hi - lo
        self.start, self.end = lead[starts] - lead[off[self.text]], lead[ends] - lead[off[self.text]]
        self.at = lo - self.edge[self.text]
        # shingles of all lines, one after the other
        count = np.maximum(self.words - SHINGLE + 1, 1)
        self.first = np.cumsum(count) - count
        line = np.repeat(np.arange(len(lo)), count)
        where = lo[line] + np.arange(len(line)) - self.first[line]
        long = shingle_hashes(self.w, SHINGLE) if len(self.w) >= SHINGLE else np.zeros(1, U64)
        self.values = long[np.minimum(where, len(long) - 1)]
        for k in range(MIN_WORDS, SHINGLE):  # shorter lines are one shingle
            mine = np.flatnonzero(self.words == k)
            h = np.zeros(len(mine), U64)
            for i in range(k):
                h = h * U64(0xD6E8FEB86659FD93) + self.w[lo[mine] + i]
            self.values[self.first[mine]] = mix(h + U64(k))
        self.fresh = _first_of_line(self.values, line)
        #: number of different shingles of a line, and 64 bits that stand for the set
        self.n, self.node = set_marks(np.where(self.fresh, self.values, U64(0)), self.fresh, self.first)

    def shingles(self, i: int) -> np.ndarray:
        part = slice(self.first[i], self.first[i + 1] if i + 1 < len(self.first) else None)
        return np.sort(self.values[part][self.fresh[part]])


def _first_of_line(values: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which values are the first of their kind in their line."""
    fresh = np.ones(len(values), bool)
    key = values ^ mix(line.astype(U64) + U64(1))
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        i = np.flatnonzero(np.isin(key, twice))
        i = i[np.lexsort((i, values[i], line[i]))]
        again = np.append(False, (values[i[1:]] == values[i[:-1]]) & (line[i[1:]] == line[i[:-1]]))
        fresh[i[again]] = False
    return fresh


def _groups(col, limit: int = 2 << 20):
    data, off = buffers(col)
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, data, off[row : stop + 1]
        row = stop


SCAN = "doc_id long, no int, start int, end int, words int, at int, node long, n int, keys array<long>, windows array<long>, places array<int>"
_SCAN = pa.schema([("doc_id", pa.int64()), *((k, pa.int32()) for k in ("no", "start", "end", "words", "at")), ("node", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])


def _scan(bands: int, rows: int, num: int, den: int):
    """A row for each line (band keys with the first of its kind in the task), and one for each
    text's windows (no is null). Sets that can only equal their like have no keys."""

    def table(**cols):
        n = len(cols["doc_id"])
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if isinstance(cols.get(f.name), np.ndarray) else cols.get(f.name, pa.nulls(n, f.type)) for f in _SCAN], schema=_SCAN)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0).to_numpy()
            for row, data, off in _groups(b.column(1)):
                x = _Lines(data, off)
                h, at = _windows(x.w, x.of)
                if len(h):
                    mine, lo = np.unique(x.of[at], return_index=True)
                    cuts = pa.array(np.append(lo, len(h)), pa.int32())
                    places = (at - x.edge[x.of[at]]).astype(np.int32)
                    yield table(doc_id=ids[row + mine], words=np.diff(x.edge)[mine].astype(np.int32), windows=pa.ListArray.from_arrays(cuts, pa.array(signed(h))), places=pa.ListArray.from_arrays(cuts, pa.array(places)))
                if not len(x.node):
                    continue
                # another set can only be similar to one that is large enough
                able = den * x.n >= num * (x.n + 1)
                new = np.zeros(len(able), bool)
                for i, f in enumerate(x.node.tolist()):
                    if able[i] and f not in seen:
                        seen.add(f)
                        new[i] = True
                size = np.diff(np.append(x.first, len(x.values)))
                keys = np.zeros((0, bands), U64)
                if new.any():
                    starts = np.cumsum(size[new]) - size[new]
                    keys = _signatures(x.values[np.repeat(new, size)], starts, bands, rows)
                cuts = np.append(0, np.cumsum(np.where(new, bands, 0))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(keys.ravel())), mask=pa.array(~new))
                yield table(doc_id=ids[row + x.text], no=x.no.astype(np.int32), start=x.start.astype(np.int32), end=x.end.astype(np.int32), words=x.words.astype(np.int32), at=x.at.astype(np.int32), node=x.node, n=x.n.astype(np.int32), keys=keys)

    return run


def _sets(doc_bits, pair_bits):
    """(node, n, hs, bm) of the lines that are asked for by document and node."""

    def run(batches):
        docs, pairs, seen = np.frombuffer(doc_bits.value, np.uint8), np.frombuffer(pair_bits.value, np.uint8), set()
        for b in batches:
            b = b.filter(pa.array(member(docs, b.column(0).to_numpy())))
            ids = b.column(0).to_numpy()
            for row, data, off in _groups(b.column(1)):
                x = _Lines(data, off)
                out = []
                for i in np.flatnonzero(member(pairs, x.node ^ ids[row + x.text])):
                    f = int(x.node[i])
                    if f not in seen:
                        seen.add(f)
                        h = x.shingles(i)
                        out.append((f, len(h), signed(h).tobytes(), parity_bitmap(h)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["node", "n", "hs", "bm"])

    return run


MARKS = "doc_id long, h long, at int"


def _marks(batches):
    """A row for each window that meets no removed paragraph of its document."""
    for b in batches:
        docs, windows, places, froms, tos = (b.column(i) for i in range(5))
        keep_ = []
        for at, a, z in zip(places, froms, tos):
            p = at.values.to_numpy()
            if not a.is_valid:
                keep_.append(np.ones(len(p), bool))
                continue
            a, z = np.sort(a.values.to_numpy()), np.sort(z.values.to_numpy())
            k = np.searchsorted(z, p, "right")
            keep_.append((k >= len(a)) | (a[np.minimum(k, len(a) - 1)] >= p + WINDOW))
        if keep_:
            ids = docs.take(pa.array(np.repeat(np.arange(len(keep_)), [len(x) for x in keep_])))
            stay = pa.array(np.concatenate(keep_))
            yield pa.RecordBatch.from_arrays([ids, windows.flatten(), places.flatten()], ["doc_id", "h", "at"]).filter(stay)


RUNS = "doc_id long, start int, end int, first_doc long, copies long, removed boolean"


def _runs(batches):
    """Passages of each document's shared windows. Of equal windows the first stays; a passage
    holds removed windows of one first document, or windows that stay, and what is removed ends
    where a window that stays begins."""
    far = 1 << 40
    for b in batches:
        if not b.num_rows:
            continue
        row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
        at, first, first_at, copies = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
        order = np.lexsort((at, row))
        row, at, first, first_at, copies = (x[order] for x in (row, at, first, first_at, copies))
        ids = b.column(0).to_numpy()[row]
        stays = (first == ids) & (first_at == at)
        start = row * far + at
        end = start + WINDOW
        low = np.maximum.accumulate(np.where(stays, end, -1))
        high = np.minimum.accumulate(np.where(stays, start, 1 << 62)[::-1])[::-1]
        cut_start, cut_end = np.maximum(start, low), np.minimum(end, high)
        removed = ~stays & (cut_start < cut_end)
        start, end = np.where(removed, cut_start, start), np.where(removed, cut_end, end)
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (removed[1:] != removed[:-1]) | (first[1:] != first[:-1]) | (start[1:] > end[:-1])
        k = np.flatnonzero(new)
        base = row[k] * far
        cols = [ids[k], (start[k] - base).astype(np.int32), (np.maximum.reduceat(end, k) - base).astype(np.int32), first[k], np.maximum.reduceat(copies, k), removed[k]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "start", "end", "first_doc", "copies", "removed"])


def repeated_passages(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """kind, doc_id, no, start, end, words, first_doc, first_no, copies, removed, long_words of every repeated passage.

    kind 'paragraph': no is the line's number, start and end its code points; first_doc and
    first_no name the cluster by its first occurrence, which stays (removed is false).
    kind 'window': start and end are word numbers; first_doc is the smallest document that
    holds the passage's windows outside removed paragraphs; there they stay. Words of a
    window that stays are in no removed passage. long_words are the passage's words if there are
    WINDOW or more, else 0: shorter lines also repeat by chance.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    text = F.col("text").cast("string")
    nameless = F.lit(_NAMELESS) + F.pmod(F.xxhash64(text), F.lit(1 << 61))
    docs = docs.where(text.isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc_id"), text.alias("text"))
    bands, rows = tune(num / den)
    scan = keep(docs.mapInArrow(_scan(bands, rows, num, den), SCAN), "paragraphs")
    para = scan.where("no is not null")
    postings = para.where("keys is not null").select(F.explode("keys").alias("key"), "node", "n", F.lit(0).alias("pos"))
    sets: list[DataFrame] = []

    def bitmaps_of(nodes: DataFrame) -> DataFrame:
        wanted = keep(para.where("keys is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi").select("doc_id", F.expr("node ^ doc_id").alias("pair")), "wanted")
        bits = [sc.broadcast(membership(wanted, c)) for c in ("doc_id", "pair")]
        sets.append(keep(docs.mapInArrow(_sets(*bits), "node long, n int, hs binary, bm binary"), "line-sets"))
        return sets[0].select("node", "n", "bm")

    label = connect(postings, bitmaps_of, lambda nodes: sets[0].select("node", "hs").join(nodes, "node", "left_semi").dropDuplicates(["node"]), num, den, positions=False)
    occ = para.select("doc_id", "no", "start", "end", "words", "at", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    occ = keep(occ, "occurrences")
    clusters = keep(occ.groupBy("label").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "clusters")
    paragraphs = occ.join(clusters, "label").select(
        F.lit("paragraph").alias("kind"), "doc_id", "no", "start", "end", "words", "at",
        F.col("first.doc_id").alias("first_doc"), F.col("first.no").alias("first_no"), "copies",
        (F.struct("doc_id", "no") != F.col("first")).alias("removed"),
    )
    paragraphs = keep(paragraphs, "repeats")

    gone = paragraphs.where("removed").groupBy("doc_id").agg(F.collect_list("at").alias("froms"), F.collect_list(F.col("at") + F.col("words")).alias("tos"))
    marks = keep(scan.where("no is null").select("doc_id", "windows", "places").join(gone, "doc_id", "left").mapInArrow(_marks, MARKS), "marks")
    shared = keep(marks.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "shared")
    hits = marks.join(shared, "h").select("doc_id", F.struct("at", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"), "copies").alias("x"))
    lists = hits.groupBy("doc_id").agg(F.collect_list("x").alias("x")).select("doc_id", *[F.col(f"x.{c}").alias(c) for c in ("at", "first_doc", "first_at", "copies")])
    windows = lists.mapInArrow(_runs, RUNS).select(
        F.lit("window").alias("kind"), "doc_id", F.lit(None).cast("int").alias("no"), "start", "end", (F.col("end") - F.col("start")).alias("words"),
        "first_doc", F.lit(None).cast("int").alias("first_no"), "copies", "removed",
    )
    named = [F.when(F.col(c) < _NAMELESS, F.col(c)).alias(c) if c in ("doc_id", "first_doc") else c for c in windows.columns]
    long_words = F.when(F.col("words") >= WINDOW, F.col("words")).otherwise(0).cast("long").alias("long_words")
    return paragraphs.drop("at").unionByName(windows).select(*named, long_words)
