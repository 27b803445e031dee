"""Quality rules with line labelling by a linear-chain conditional random field.

Counting rules come first (too few words, too many repeated eight-word windows). Then a
CRF, trained here on a bounded sample of labelled documents, marks each line as content
or boilerplate by Viterbi decoding; a document stays if words of content lines are a
sufficient share of its words.

Line labels for the training are weak: every line of a bad document is boilerplate, and of
a good one the lines that are common in the corpus, that is, stand between many different
pairs of neighbours (copies of a text do not make its lines common: their neighbours are
the same). Whether a line is common is also one of its features. The counts cover all
documents. A line is common from ``COMMON`` contexts on, and from one in ``RARE`` of all
lines' on, so the table of common lines has RARE rows at most, whatever the corpus.

Defined results: null or blank text has no words and fails the base rules; a document
without a line with words has content share 0; if ``labels`` holds no usable rows of both
kinds, no model is fitted, line_labels is null and the base rules decide; a share that
equals the least one is enough; repeated rows are judged alike, and so are texts of any
length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, keep, mix, shingle_hashes, words_of

#: Rows of the labelled sample at most, and the least share of words in content lines.
SAMPLE, MIN_SHARE = 2000, 0.2
#: Contexts that make a line common, and the bound on the number of common lines.
COMMON, RARE = 10, 1_000_000
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: Counted symbols, fixed by the contract.
SYMBOLS = "#*$%&|<>"

_WS = "\x20\x09\x0a\x0b\x0c\x0d"
_KIND = np.zeros((256, 7), np.uint8)
for _c in SYMBOLS.encode():
    _KIND[_c, 0] = 1
_KIND[65:91, 1] = 1
_KIND[97:123, 2] = 1
_KIND[48:58, 3] = 1
for _c in b"!?":
    _KIND[_c, 4] = 1
for _c in b",;:'\"()-":
    _KIND[_c, 5] = 1
_KIND[128:, 2] = 1  # letters beyond ASCII count with the lower case
_KIND[128:192, 2] = 0  # continuation bytes count with their first byte
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in _WS]] = True
_LEAD = np.ones(256, np.uint8)
_LEAD[128:192] = 0
FEATURES = 15


def _sums(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=c[1:])
    return c[ends] - c[starts]


def _line_places(part: np.ndarray, off: np.ndarray, ws: np.ndarray):
    """(text, start, end, first word, words) of the lines with words."""
    n = len(off) - 1
    feeds = np.flatnonzero(part == 10)
    starts = np.sort(np.concatenate([off[:-1], feeds + 1]))
    doc = np.minimum(np.searchsorted(off, starts, "right") - 1, n - 1)
    # a feed at a text's end leaves an empty last line; it starts where the next text does
    ends = np.minimum(np.append(starts[1:], off[-1]), off[doc + 1])
    ends = np.where((ends > starts) & (part[np.maximum(ends - 1, 0)] == 10), ends - 1, ends)
    first = np.searchsorted(ws, starts)
    words = np.searchsorted(ws, ends) - first
    some = words > 0
    return doc[some], starts[some], ends[some], first[some], words[some]


def _line_hashes(h: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64 bits of the words of each line, in their order."""
    if not len(first):
        return np.zeros(0, U64)
    place = np.arange(len(h)) - np.repeat(first, words)  # every word is in a line
    return np.add.reduceat(mix(h + place.astype(U64) * U64(0x9E3779B97F4A7C15)), first)


def _contexts(batches):
    """(line, context) of every line with words: the hashes of the line and of its neighbours."""
    for b in batches:
        for _, _, data, off in _groups(b.column(0)):
            part, off = data[int(off[0]) : off[-1]], off - off[0]
            h, ws, _, _ = words_of(part, off, lower=False)
            doc, _, _, first, words = _line_places(part, off, ws)
            line = _line_hashes(h, first, words)
            same = doc[1:] == doc[:-1]
            context = np.zeros(len(line), U64)
            context[1:] += np.where(same, mix(line[:-1]), U64(0))
            context[:-1] += np.where(same, mix(line[1:] + U64(1)), U64(0))
            yield pa.RecordBatch.from_arrays([pa.array(line.view(np.int64)), pa.array(context.view(np.int64))], ["line", "context"])


def common_lines(docs: DataFrame, least: int = COMMON, rare: int = RARE) -> np.ndarray:
    """Hashes of the lines that stand in many contexts, sorted: ``rare`` at most."""
    lines = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts, "line long, context long")
    spread = lines.groupBy("line", "context").agg(F.count("*").alias("n")).groupBy("line").agg(F.count("*").alias("contexts"), F.sum("n").alias("n"))
    often = keep(spread.where(F.col("contexts") >= least), "spread")
    total = docs.select(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit("\n")) + 1)).first()[0] or 0
    found = often.where(F.col("contexts") >= -(-total // rare)).select("line").toArrow()  # ``rare`` rows at most
    return np.sort(found.column(0).to_numpy())


def _measure(data: np.ndarray, off: np.ndarray, common: np.ndarray):
    """For texts off[0]..off[-1] of the buffer: per text counts, and per line with words its features.

    Yields nothing twice: returns (counts of texts, line's text, line's words, features).
    """
    n = len(off) - 1
    base = int(off[0])
    part = data[base : off[-1]]
    off = off - base
    h, ws, we, at = words_of(part, off, lower=False)
    lead = _LEAD[part] * ~_SPACE[part]
    n_words = np.bincount(at, minlength=n)
    chars, symbols = _sums(lead, off[:-1], off[1:]), _sums(_KIND[part, 0], off[:-1], off[1:])
    edge = np.searchsorted(at, np.arange(n + 1))
    repeat, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n):
        w = h[edge[k] : edge[k + 1]]
        if len(w) >= WINDOW:
            _, inv, c = np.unique(shingle_hashes(w, WINDOW), return_inverse=True, return_counts=True)
            hit = np.flatnonzero(c[inv] > 1)
            if len(hit):
                cover = np.zeros(len(w) + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + WINDOW, -1)
                repeat[k] = int((np.cumsum(cover)[:-1] > 0).sum())
    doc, starts, ends, first, words = _line_places(part, off, ws)
    line = _line_hashes(h, first, words).view(np.int64)
    known = np.searchsorted(common, line)
    shared = np.append(common, 0)[known] == line if len(common) else np.zeros(len(line), bool)
    shared &= known < len(common)
    dup = np.zeros(len(starts), bool)
    raw = part.tobytes()
    was, seen = -1, set()
    for i, (s, e, d) in enumerate(zip(starts.tolist(), ends.tolist(), doc.tolist())):
        if d != was:
            was, seen = d, set()
        line = raw[s:e]
        if line in seen:
            dup[i] = True
        else:
            seen.add(line)
    np.add.at(dups, doc[dup], 1)
    size = np.maximum(_sums(lead, starts, ends), 1)
    kinds = [_sums(_KIND[part, j], starts, ends) for j in range(6)]
    last = part[we[np.searchsorted(ws, ends) - 1] - 1] if len(starts) else np.zeros(0, np.uint8)
    closed = np.isin(last, np.frombuffer(b".!?:;\"')", np.uint8))
    letters = np.maximum(kinds[1] + kinds[2], 1)
    words_of_doc = np.maximum(n_words[doc], 1)
    f = np.stack(
        [
            np.ones(len(starts)),
            np.log1p(words) / 3,
            kinds[0] / size * 4,
            np.minimum(kinds[0] / np.maximum(words, 1), 3),
            kinds[1] / letters,
            (kinds[1] > 0.6 * letters) & (words > 1),
            kinds[3] / size * 2,
            np.minimum(kinds[4] / np.maximum(words, 1), 2),
            kinds[5] / np.maximum(words, 1),
            closed,
            dup,
            np.minimum(size / np.maximum(words, 1), 30) / 10,
            words < 4,
            repeat[doc] / words_of_doc,
            shared,
        ],
        axis=1,
    ).astype(np.float64)
    return (n_words, chars, symbols, dups, repeat), doc, words, f


def _groups(col, limit: int = 2 << 20):
    data, off = buffers(col)
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, stop, data, off[row : stop + 1]
        row = stop


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best sequence of two labels: scores (lines, 2), trans[from, to]."""
    n = len(scores)
    a, b = float(scores[0, 0]), float(scores[0, 1])
    t = trans.tolist()
    back = np.zeros((n, 2), np.int8)
    for i in range(1, n):
        a0, b0, a1, b1 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
        if b0 > a0:
            back[i, 0], a0 = 1, b0
        if b1 > a1:
            back[i, 1], a1 = 1, b1
        a, b = a0 + float(scores[i, 0]), a1 + float(scores[i, 1])
    out = np.zeros(n, np.int8)
    out[-1] = b > a
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _runs(sequences: list[tuple[np.ndarray, np.ndarray]], length: int):
    """The documents' lines in runs of ``length`` at most, none over a document's end, stacked by
    padded length: (x (steps, runs, features), y, live)."""
    stacks: dict[int, list] = {}
    for x, y in sequences:
        for i in range(0, len(x), length):
            part = x[i : i + length], y[i : i + length]
            stacks.setdefault(1 << (len(part[1]) - 1).bit_length(), []).append(part)
    for size, parts in sorted(stacks.items()):
        x, y, live = np.zeros((size, len(parts), parts[0][0].shape[1])), np.zeros((size, len(parts)), int), np.zeros((size, len(parts)))
        for j, (px, py) in enumerate(parts):
            x[: len(py), j], y[: len(py), j], live[: len(py), j] = px, py, 1
        yield x, y, live


def _gradient(x, y, live, w, t):
    """Sums of what was seen less what the model expects, for features and for transitions."""
    one, size = np.eye(2), len(x)
    s = (x @ w) * live[..., None]
    al, be = np.zeros_like(s), np.zeros_like(s)
    al[0] = s[0]
    for i in range(1, size):
        z = al[i - 1][:, :, None] + t[None]
        al[i] = np.where(live[i][:, None] > 0, s[i] + np.logaddexp(z[:, 0], z[:, 1]), al[i - 1])
    for i in range(size - 2, -1, -1):
        z = t[None] + (s[i + 1] + be[i + 1])[:, None, :]
        be[i] = np.logaddexp(z[:, :, 0], z[:, :, 1]) * live[i + 1][:, None]
    logz = np.logaddexp(al[-1][:, 0], al[-1][:, 1])
    p = np.exp(np.minimum(al + be - logz[None, :, None], 0))
    gw = np.einsum("lmf,lmk->fk", x, (one[y] - p) * live[..., None])
    if size == 1:
        return gw, np.zeros((2, 2))
    pair = np.exp(np.minimum(al[:-1][:, :, :, None] + t[None, None] + (s[1:] + be[1:])[:, :, None, :] - logz[None, :, None, None], 0))
    seen = one[y[:-1]][..., :, None] * one[y[1:]][..., None, :]
    return gw, ((seen - pair) * live[1:][..., None, None]).sum((0, 1))


def train_crf(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.1, l2: float = 1e-4, length: int = 64):
    """Weights (features, 2) and transitions (2, 2) by gradient ascent (with Adam's step sizes) on the
    conditional log-likelihood of the label of each line; every document is a sequence of its own."""
    runs = list(_runs(sequences, length))
    n, m = sum(live.sum() for *_, live in runs), sequences[0][0].shape[1]
    both, mean, square = np.zeros((m + 2, 2)), 0.0, 0.0
    for step in range(1, steps + 1):
        parts = [np.concatenate(_gradient(*run, both[:m], both[m:])) for run in runs]
        g = sum(parts) / n - l2 * both
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        both = both + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return both[:m], both[m:]


def _sampled(common):
    def run(batches):
        for b in batches:
            out_n, out_f = [], []
            for row, stop, data, off in _groups(b.column(1)):
                _, doc, _, f = _measure(data, off, common.value)
                for k in range(stop - row):
                    mine = f[doc == k]
                    out_n.append(len(mine))
                    out_f.append(mine.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out_n, pa.int32()), pa.array(out_f, pa.binary())], ["doc_id", "quality", "lines", "f"])

    return run


def fit(docs: DataFrame, labels: DataFrame, common, sample: int = SAMPLE):
    """A CRF from at most ``sample`` labelled documents (the first by a hash of doc_id), or None.
    common: the broadcast hashes of common lines."""
    picked = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(picked), "doc_id")  # ``sample`` rows at most
        .select("doc_id", "text", "quality")
        .mapInArrow(_sampled(common), "doc_id long, quality int, lines int, f binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .toArrow()
    )
    seqs = [(np.frombuffer(f.as_buffer(), "<f4").reshape(-1, FEATURES).astype(float), q.as_py()) for q, n, f in zip(rows.column(1), rows.column(2), rows.column(3)) if n.as_py()]
    if len({q for _, q in seqs}) < 2:
        return None
    return train_crf([(f, (f[:, -1] == 0).astype(int) * q) for f, q in seqs])


def _judged(model, common, min_share: float, rows_only: bool = False):
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("line_labels", pa.string())])

    def run(batches):
        for b in batches:
            place = b.schema.get_field_index("text")
            for row, stop, data, off in _groups(b.column(place)):
                counts, doc, words, f = _measure(data, off, common.value)
                n_words, chars, symbols, dups, repeat = counts
                n = stop - row
                failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n_words)
                share = np.where(n_words > 0, 1.0, 0.0)
                marks = ["" if model else None] * n
                if model is not None and len(doc):
                    w, t = model
                    scores = f @ w
                    edge = np.searchsorted(doc, np.arange(n + 1))
                    for k in range(n):
                        i, j = edge[k], edge[k + 1]
                        if j > i:
                            good = viterbi(scores[i:j], t) == 1
                            share[k] = words[i:j][good].sum() / n_words[k]
                            marks[k] = np.where(good, b"C", b"B").tobytes().decode()
                kept = ~failed & (share >= min_share)
                if rows_only:
                    yield b.slice(row, n).filter(pa.array(kept))
                    continue
                ids = b.column(0).slice(row, n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, dups, repeat)), pa.array(failed), pa.array(kept), pa.array(share), pa.array(marks, pa.string())], schema=schema)

    return run


def _trained(docs: DataFrame, labels: DataFrame, sample: int):
    common = docs.sparkSession.sparkContext.broadcast(common_lines(docs))
    return fit(docs, labels, common, sample), common


def judge(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE, sample: int = SAMPLE) -> DataFrame:
    """One row per document: counts, base_failed, kept, content_share, and line_labels: C (content)
    or B (boilerplate) for each line with words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _judged(*_trained(docs, labels, sample), min_share),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, line_labels string",
    )


def keep_good(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, as they are, whose document is kept."""
    return docs.mapInArrow(_judged(*_trained(docs, labels, sample), min_share, rows_only=True), docs.schema)
