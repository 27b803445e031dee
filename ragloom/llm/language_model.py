"""Language-model scores of texts: a log-bilinear neural model trained with noise-contrastive estimation.

Model: the SHORT most frequent words of the training texts, the end and "any other word" are
symbols. A symbol has a context vector r and a target vector t; with the two symbols before a
token, s(w) = (c1 * r[h1] + c2 * r[h2]) . t[w] + b[w]. A word outside the short list has the
probability of "any other" times its add-one share of those words' counts, so the model is a
proper distribution over all words, seen and unseen.

Training: all training texts, every word of them. A task runs minibatches of noise-contrastive
estimation over its part of the texts (numpy matrix products; the noise is the unigram
distribution), the parts' parameters are averaged by a grouped aggregation weighted by tokens,
and the next round starts from the average. Counts of all words are one grouped aggregation.

Scoring: the normaliser of every pair of context symbols is computed once, by batched matrix
products over blocks of contexts in tasks; a token's log-probability is then exact and
normalised, and costs three lookups.

Scale: what tasks hold is bounded by parameters: HEAD counts (1 MB), the parameters (some
130 KB) and SYMBOLS^2 normalisers (4 MB). Counts of words beyond HEAD meet the texts in a join on the word's
hash; the most frequent of those words has at most 1/HEAD of the tokens, so no key is hot.
Texts are written once as 2-byte symbols, which training and scoring read again.

Defined results: words are told apart by 64-bit hashes of their bytes, A-Z lower-cased. A null
text is empty and has the end as its one token. A null doc_id counts as the empty string in the
split (learned from). Rows that repeat are scored each, and count as often as they stand there. Equal
counts at the edges of the head and the short list are taken by hash. Without training texts all counts are
0 and the base is 0. An empty table gives no rows. Extra columns are not carried over, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, keep, words_of

#: Symbols that need no word; words of the short list; words whose counts every task holds.
OTHER, END = 0, 1
SHORT, HEAD = 1022, 65_536
#: Size of vectors, words of context, rounds over the training texts, tokens of a minibatch, noise words of a minibatch, step size.
DIM, CONTEXT, ROUNDS, BATCH, NOISE, RATE = 16, 2, 2, 1024, 64, 0.05
#: Bytes of text, and of symbols, that a task works through at a time; distinct words it counts before it hands them on.
TEXT_BYTES, DISTINCT = 4 << 20, 2_000_000


def held_out(doc_id: str = "doc_id", of: int = 7, rest: int = 2):
    """The query's split: texts with this remainder are not learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of == rest


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of the words, row of each word) of TEXT_BYTES or one text at a time."""
    data, off = buffers(batch.column(column))
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + TEXT_BYTES, "right")) - 1)
        h, _, _, at = words_of(data, off[row : stop + 1])
        yield row, stop, h.view(np.int64), at
        row = stop


def count_words(texts: DataFrame) -> DataFrame:
    """(h, n) of every word of the text column, summed in tasks before it is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, waiting = [], [], 0
        for b in batches:
            for _, _, h, _ in _pieces(b, 0):
                u, n = np.unique(h, return_counts=True)
                words.append(u)
                counts.append(n)
                waiting += len(u)
                if waiting > DISTINCT:
                    u, n = _summed(words, counts)
                    if len(u) > DISTINCT // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["h", "n"])
                        words, counts, waiting = [], [], 0
                    else:
                        words, counts, waiting = [u], [n], len(u)
        if words:
            u, n = _summed(words, counts)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(np.concatenate(words), return_inverse=True)
    return u, np.bincount(inv, weights=np.concatenate(counts)).astype(np.int64)


def _split(counts: DataFrame) -> tuple[list, DataFrame]:
    """About HEAD of the most frequent words, collected by hash, and the rows that hold all others.
    Eighths of powers of two part the counts (512 of them at most); of the one in which the head ends, words are
    taken by a hash, so no more than the head itself comes to the driver."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True)
    room, last, share = HEAD, -1, 0.0
    for r in sizes:
        if r["words"] > room:
            last, share = r["level"], 0.9 * room / r["words"]
            break
        room -= r["words"]
    some = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))
    return sorted(counts.where((level > last) | ((level == last) & some)).collect()), counts.where(level <= last)


def encode(docs: DataFrame, head: np.ndarray, counts: np.ndarray, end_count: int, short: int) -> DataFrame:
    """A row per text: its symbols as 2-byte numbers, the hashes of the words beyond ``head`` (sorted
    by hash; of these the ``short`` first by count are symbols), and sums over the words of the head."""
    by_count = np.lexsort((head, -counts))[:short]
    symbol = np.zeros(len(head) + 1, np.uint16)
    symbol[np.sort(by_count)] = np.arange(2, 2 + len(by_count))
    logs = np.append(np.log10(counts + 1.0), 0.0)
    end_log = float(np.log10(end_count + 1.0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, stop, h, at in _pieces(b, 3):
                n = stop - row
                p = np.searchsorted(head, h)
                p[p == len(head)] = 0 if len(head) else len(head)
                known = (head[p] == h) if len(head) else np.zeros(len(h), bool)
                p = np.where(known, p, len(head))
                s = symbol[p]
                log = logs[p]
                edge = np.searchsorted(at, np.arange(n + 1))
                with_end = np.insert(s, edge[1:], END)
                tail, tail_edge = h[~known], np.searchsorted(at[~known], np.arange(n + 1))
                ids = [with_end[edge[k] + k : edge[k + 1] + k + 1].astype("<u2").tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(k).slice(row, n) for k in range(3)),
                        pa.array(np.diff(edge) + 1),
                        pa.array(np.bincount(at, weights=known, minlength=n).astype(np.int64) + (end_count > 0)),
                        pa.array(np.bincount(at, weights=s == OTHER, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(at, weights=log, minlength=n) + end_log),
                        pa.array(np.bincount(at, weights=np.where(s == OTHER, log, 0.0), minlength=n)),
                        pa.array(ids, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(tail_edge, pa.int32()), pa.array(tail)),
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "n_other", "log_known", "log_other", "ids", "tail"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, n_other long, log_known double, log_other double, ids binary, tail array<long>")


def _sequences(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, h1, h2, symbol of each token) of some texts at a time; END stands before a text."""
    col = batch.column(column).cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) // 2
    data = np.frombuffer(data, "<u2") if data else np.zeros(0, np.uint16)
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + TEXT_BYTES // 2, "right")) - 1)
        w = data[off[row] : off[stop]].astype(np.int64)
        first = off[row:stop] - off[row]
        h1 = np.concatenate([[END], w[:-1]])
        h1[first] = END
        h2 = np.concatenate([[END], h1[:-1]])
        h2[first] = END
        yield row, stop, np.repeat(np.arange(stop - row), np.diff(off[row : stop + 1])), h1, h2, w
        row = stop


class Model:
    """The parameters: context vectors ``r``, target vectors ``t``, biases ``b`` and the two context weights ``c``."""

    def __init__(self, r: np.ndarray, t: np.ndarray, b: np.ndarray, c: np.ndarray):
        self.r, self.t, self.b, self.c = r, t, b, c

    @staticmethod
    def fresh(share: np.ndarray, dim: int = DIM, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        s = len(share)
        c = np.stack([np.full(dim, 1.0), np.full(dim, 0.5)]).astype(np.float32)
        return Model(rng.normal(0, 0.1, (s, dim)).astype(np.float32), rng.normal(0, 0.1, (s, dim)).astype(np.float32), np.log(share).astype(np.float32), c)

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.t, self.b, self.c]

    def copy(self) -> Model:
        return Model(*(x.copy() for x in self.parts()))

    def rows(self) -> np.ndarray:
        """A row per symbol and one per context word, so that parameters can be averaged as a table."""
        s, d = self.r.shape
        out = np.zeros((s + CONTEXT, 2 * d + 1), np.float32)
        out[:s] = np.concatenate([self.r, self.t, self.b[:, None]], 1)
        out[s:, :d] = self.c
        return out

    @staticmethod
    def from_rows(x: np.ndarray) -> Model:
        d, s = x.shape[1] // 2, len(x) - CONTEXT
        x = x.astype(np.float32)
        return Model(x[:s, :d].copy(), x[:s, d : 2 * d].copy(), x[:s, 2 * d].copy(), x[s:, :d].copy())

    def normalisers(self, h1: np.ndarray) -> np.ndarray:
        """log Z of each pair (one of h1, any symbol): two matrix products and a sum."""
        z = np.empty((len(h1), len(self.r)), np.float32)
        for k, h in enumerate(h1):
            q = self.c[0] * self.r[h] + self.c[1] * self.r
            s = q @ self.t.T + self.b
            top = s.max(1)
            z[k] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return z


class Trainer:
    """Minibatches of noise-contrastive estimation with Adagrad steps."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.m, self.rng, self.seen = model.copy(), np.random.default_rng(seed), 0
        self.sums = [np.full_like(x, 1e-6) for x in self.m.parts()]
        self.below = np.cumsum(share.astype(np.float64))
        self.noise = np.log(NOISE * share).astype(np.float32)

    def _scatter(self, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        s, d = self.m.r.shape
        return np.bincount((at[:, None] * d + np.arange(d)).ravel(), weights=g.ravel(), minlength=s * d).reshape(s, d)

    def step(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> None:
        m = self.m
        r1, r2, tw = m.r[h1], m.r[h2], m.t[w]
        q = m.c[0] * r1 + m.c[1] * r2
        z = np.minimum(np.searchsorted(self.below, self.rng.random(NOISE)), len(m.r) - 1)
        tz = m.t[z]
        data = 1 / (1 + np.exp((q * tw).sum(1) + m.b[w] - self.noise[w]))
        noise = -1 / (1 + np.exp(-(q @ tz.T + (m.b[z] - self.noise[z]))))
        dq = data[:, None] * tw + noise @ tz
        both = np.concatenate([w, z])
        grads = [
            self._scatter(np.concatenate([h1, h2]), np.concatenate([m.c[0] * dq, m.c[1] * dq])),
            self._scatter(both, np.concatenate([data[:, None] * q, noise.T @ q])),
            np.bincount(both, weights=np.concatenate([data, noise.sum(0)]), minlength=len(m.b)),
            np.stack([(r1 * dq).sum(0), (r2 * dq).sum(0)]),
        ]
        for x, total, g in zip(m.parts(), self.sums, grads, strict=True):
            g = (g / len(w)).astype(np.float32)
            total += g * g
            x += RATE * g / np.sqrt(total)
        self.seen += len(w)


def train(texts: DataFrame, share: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model of the texts' symbols (column ids), of which ``share`` is the unigram distribution."""
    model = Model.fresh(share)
    size = 2 * DIM + 1
    for number in range(rounds):
        start = texts.sparkSession.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], start=start, number=number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            t = Trainer(start.value, share, 1 + number + 1_000 * TaskContext.get().partitionId())
            left = [np.zeros(0, np.int64)] * 3
            for b in batches:
                for _, _, _, *example in _sequences(b, 0):
                    left = [np.concatenate(x) for x in zip(left, example, strict=True)]
                    whole = len(left[0]) // BATCH * BATCH
                    for k in range(0, whole, BATCH):
                        t.step(*(x[k : k + BATCH] for x in left))
                    left = [x[whole:] for x in left]
            if len(left[0]):
                t.step(*left)
            if t.seen:
                rows = t.m.rows()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), t.seen)), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(rows.ravel()))],
                    ["row", "seen", "x"],
                )

        parts = texts.select("ids").mapInArrow(work, "row long, seen long, x array<float>")
        mean = [(F.sum(F.col("x")[k].cast("double") * F.col("seen")) / F.sum("seen")).alias(f"x{k}") for k in range(size)]
        rows = sorted(parts.groupBy("row").agg(F.array(*mean).alias("x")).collect())  # a row per symbol
        start.unpersist()
        if not rows:
            break
        model = Model.from_rows(np.array([r["x"] for r in rows]))
    return model


def _log_z(spark, model: Model) -> np.ndarray:
    """The normalisers of all pairs of context symbols, computed in tasks."""
    s = len(model.r)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            for k in range(0, len(h), 16):
                z = model.normalisers(h[k : k + 16])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 16), pa.array([x.tobytes() for x in z], pa.binary())], ["h", "z"])

    out = np.empty((s, s), np.float32)
    for r in spark.range(0, s, 1, 16).mapInArrow(work, "h long, z binary").collect():  # SYMBOLS rows of SYMBOLS floats
        out[r["h"]] = np.frombuffer(r["z"], np.float32)
    return out


def token_scores(model: Model, log_z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables a, b, z with log10 P(w | h1, h2) = a[h1, w] + b[h2, w] - z[h1, h2]."""
    ln10 = np.float32(np.log(10))
    return ((model.c[0] * model.r) @ model.t.T + model.b) / ln10, ((model.c[1] * model.r) @ model.t.T) / ln10, log_z / ln10


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    learned = docs.where(~held_out())
    counts = keep(count_words(learned.select(F.col("text").cast("string"))), "word-counts")
    n_docs = learned.count()
    total = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    tokens, kinds = (total["n"] or 0) + n_docs, total["v"] + (n_docs > 0)
    top, rare = _split(counts)
    head, head_n = np.array([r["h"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64)
    short = np.sort(np.lexsort((head, -head_n))[:SHORT])
    encoded = keep(encode(docs, head, head_n, n_docs, SHORT), "symbols")

    # counts of the words beyond the head: a join on the hash, summed by text
    tails = encoded.select("uid", F.explode("tail").alias("h")).join(rare, "h").groupBy("uid").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("n") + 1)).alias("tail_log"))

    other = tokens - n_docs - int(head_n[short].sum())
    other_kinds = total["v"] - len(short)
    share = np.concatenate([[other, n_docs], head_n[short]]) + 1.0
    share /= share.sum()
    model = train(encoded.where("not held_out"), share)
    tables = spark.sparkContext.broadcast(token_scores(model, _log_z(spark, model)))

    columns = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "n_other", "log_known", "log_other"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, z = tables.value
        for batch in batches:
            for row, stop, at, h1, h2, w in _sequences(batch, len(columns)):
                log = a[h1, w] + b[h2, w] - z[h1, h2]
                same = [batch.column(k).slice(row, stop - row) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.bincount(at, weights=log, minlength=stop - row))], [*columns, "log"])

    scored = encoded.select(*columns, "ids").mapInArrow(work, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, n_other long, log_known double, log_other double, log double")
    tail_log, tail_known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0).cast("long"))
    return (
        scored.join(tails, "uid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + tail_known).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("log_known") + tail_log - F.col("n_tokens") * float(np.log10(tokens + kinds + 1.0))).alias("base_score"),
            (F.col("log") + F.col("log_other") + tail_log - F.col("n_other") * float(np.log10(other + other_kinds + 1.0))).alias("score"),
        )
    )
