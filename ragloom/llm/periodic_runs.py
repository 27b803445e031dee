"""Periodic runs of words by grammar compression, and texts with the repetitions collapsed.

Method: Re-Pair in passes over the word ids of a group of texts: a pass counts the adjacent
pairs of each text, and replaces those that are more frequent than the pairs they overlap, so
each replaced pair becomes a nonterminal with two halves; when no pair repeats, what is left is
paired up evenly until a text is one symbol. The runs that cross the boundary between the
halves of a nonterminal are computed once, from its first place: periods are the distances at
which the words around the boundary recur inside it, each extended both ways. They are then
translated to all places of the nonterminal (known from the pass that made it), and intervals
of a period that lie in others of that period are merged away. Every run crosses the boundary
of the lowest nonterminal that holds it, so none is missed.

Work is n log n steps of numpy for a text of n words; a task holds one group of texts
(GROUP words, or one text) at a time. Nothing is shuffled.

Defined results: words are compared as they are (case-sensitively). A null or blank text has no
word: no run, null run columns, both digests of the empty string. A null doc_id is not
rewritten by the query's rule. Repeated rows give repeated rows. Of runs with equal exponent the first start, then the
smaller period is reported. An empty table gives no rows. Extra columns are not carried over,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least FEWEST words and POWER periods.
FEWEST, POWER = 24, 3
#: Words of a group of texts that is compressed together; most passes of pairing before the rest is paired evenly.
GROUP, PASSES = 400_000, 60
#: Words around a boundary that must recur at a period's distance (any run has so many on its longer side).
SEED = 5

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)
_P = np.uint64((1 << 31) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grammar(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nonterminals of the texts: (lo, mid, hi) of a first place of each, and all places as
    (nonterminal, lo). ``doc``: number of the text of each word; pairs never span two texts."""
    n = len(ids)
    # symbols of different texts differ, so counts are by text
    sym = np.unique(doc * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1]
    at, end, of = np.arange(n), np.arange(1, n + 1), doc
    fresh = n
    lo, mid, hi, rule, where = [], [], [], [], []
    rules = 0

    def replace(left: np.ndarray, name: np.ndarray, first: np.ndarray) -> None:
        """Join the symbols at ``left`` with their right neighbours; ``name`` numbers the new
        symbols from 0, ``first`` gives a place of each in ``left``."""
        nonlocal sym, at, end, of, fresh, rules
        lo.append(at[left[first]])
        mid.append(end[left[first]])
        hi.append(end[left[first] + 1])
        rule.append(rules + name)
        where.append(at[left])
        sym[left] = fresh + name
        end[left] = end[left + 1]
        stay = np.ones(len(sym), bool)
        stay[left + 1] = False
        sym, at, end, of = sym[stay], at[stay], end[stay], of[stay]
        fresh += len(first)
        rules += len(first)

    new = np.ones(n, bool)  # symbols made in the last pass; a pair of old symbols that was alone stays alone
    dead = np.zeros(n, bool)
    for _ in range(PASSES):
        same = np.flatnonzero((of[:-1] == of[1:]) & ~(dead[:-1] & ~new[:-1] & ~new[1:]))
        if not len(same):
            break
        _, pair, count = np.unique(sym[same] * fresh + sym[same + 1], return_inverse=True, return_counts=True)
        freq = np.zeros(len(sym) + 1, np.int64)
        freq[same] = count[pair]
        freq[freq < 2] = 0
        dead = freq[:-1] == 0
        if not freq.any():
            break
        # a pair wins over those it overlaps by frequency, then by a hash of it; among equal neighbours (a a a) every second one
        tie = np.zeros(len(sym) + 1, np.uint64)
        tie[same] = _mix(pair) >> np.uint64(1)
        f, t = freq[:-1], tie[:-1]
        before_f, before_t = np.concatenate([[0], f[:-1]]), np.concatenate([[np.uint64(0)], t[:-1]])
        eq = (f > 0) & (f == before_f) & (t == before_t)
        ge_l = (f > before_f) | ((f == before_f) & (t >= before_t))
        ge_r = (f > freq[1:]) | ((f == freq[1:]) & (t >= tie[1:]))
        run = np.arange(len(f))
        begin = np.maximum.accumulate(np.where(eq, -1, run))
        pick = np.flatnonzero((f > 0) & ge_l & ge_r & ((run - begin) % 2 == 0))
        _, first, name = np.unique(sym[pick] * fresh + sym[pick + 1], return_index=True, return_inverse=True)
        mark = np.zeros(len(sym), bool)
        mark[pick] = True
        gone = np.zeros(len(sym), bool)
        gone[pick + 1] = True
        replace(pick, name, first)
        new, dead = mark[~gone], dead[~gone]
    while len(sym) > 1:
        start = np.concatenate([[True], of[1:] != of[:-1]])
        index = np.arange(len(sym))
        index -= np.maximum.accumulate(np.where(start, index, 0))
        left = np.flatnonzero((index[:-1] % 2 == 0) & (of[:-1] == of[1:]))
        if not len(left):
            break
        replace(left, np.arange(len(left)), np.arange(len(left)))
    if not rules:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    return tuple(np.concatenate(x).astype(np.int64) for x in (lo, mid, hi, rule, where))


class _Equal:
    """Longest common extensions, by sums of two random polynomials modulo a prime."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.ids, self.n, self.sums, self.pows = ids, n, [], []
        for base, seed in ((1_103_515_245, 11), (694_847_539, 77)):
            p = np.ones(n + 1, np.uint64)
            k = 1
            b = np.uint64(base)
            while k <= n:
                m = min(k, n + 1 - k)
                p[k : k + m] = p[:m] * b % _P
                b = b * b % _P
                k *= 2
            v = _mix(ids + seed) % _P * p[:n] % _P
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(v, out=s[1:])
            self.sums.append(s)
            self.pows.append(p)

    def same(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the k words from i on equal those from j > i on."""
        out = np.ones(len(i), bool)
        for s, p in zip(self.sums, self.pows, strict=True):
            a, b = (s[i + k] - s[i]) % _P, (s[j + k] - s[j]) % _P
            out &= a * p[j - i] % _P == b
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The length, up to ``most``, to which the words from i on equal those from j on."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            m = (low + high + 1) // 2
            ok = self.same(i, j, m)
            low, high = np.where(ok, m, low), np.where(ok, high, m - 1)
        return low

    def back(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words that end before i and before j."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            m = (low + high + 1) // 2
            ok = self.same(i - m, j - m, m)
            low, high = np.where(ok, m, low), np.where(ok, high, m - 1)
        return low


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0..n-1) for each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _seeds(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups of equal SEED words within a text: the group of each place, places by group, sizes."""
    g = max(0, len(ids) - SEED + 1)
    h = _mix(doc[:g])
    for k in range(SEED):
        h = _mix(h ^ _mix(ids[k : k + g] + k))
    order = np.argsort(h, kind="stable")
    hs = h[order]
    edge = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))[:g]
    size = np.diff(np.append(edge, g))
    of = np.empty(g, np.int64)
    of[order] = np.repeat(np.arange(len(edge)), size)
    return of, order, size


def runs_of(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts that follow each other, by start, then period."""
    z = np.zeros(0, np.int64)
    if len(ids) < FEWEST:
        return z, z, z
    # three periods, of 24 words or more, hold some SEED words three times: other texts have no run
    of, _, size = _seeds(ids, doc)
    busy = np.zeros(int(doc[-1]) + 1, bool)
    busy[doc[: len(of)][size[of] > 2]] = True
    at = np.flatnonzero(busy[doc])
    if not len(at):
        return z, z, z
    s, e, q = _runs(ids[at], doc[at])
    return at[s], at[e - 1] + 1, q


def _runs(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = np.zeros(0, np.int64)
    n = len(ids)
    of_gram, order, size = _seeds(ids, doc)
    keys = np.repeat(np.arange(len(size)), size) * n + order  # ascending: by group, then place
    lo, mid, hi, rule, where = _grammar(ids, doc)
    if not len(lo):
        return z, z, z
    wide = np.flatnonzero(hi - lo >= FEWEST)
    found = []
    for side in (0, 1):
        # right: the words from one before the boundary on recur later; left: those up to one after it recur earlier
        anchor = mid[wide] - 1 if side == 0 else mid[wide] - (SEED - 1)
        fits = (anchor >= lo[wide]) & (anchor + SEED <= hi[wide])
        node, anchor = wide[fits], anchor[fits]
        reach = (hi[node] - lo[node]) // POWER
        if side == 0:
            first, last = anchor + 1, np.minimum(anchor + reach, hi[node] - SEED)
        else:
            first, last = np.maximum(anchor - reach, lo[node]), anchor - 1
        k = of_gram[anchor] * n
        a, b = np.searchsorted(keys, k + first), np.searchsorted(keys, k + last, "right")
        row, step = _spread(np.maximum(b - a, 0))
        other = order[a[row] + step]
        # both places of a word of the run inside the nonterminal: the boundary's, and the period further on (or before)
        i, j = (anchor[row], other) if side == 0 else (other, anchor[row])
        found.append((node[row], i, j))
    node, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(node):
        return z, z, z
    q = j - i
    eq = _Equal(ids)
    begin = i - eq.back(i, j, i - lo[node])
    end = j + eq.ahead(i, j, hi[node] - j)
    good = end - begin >= np.maximum(FEWEST, POWER * q)
    _, one = np.unique(np.stack([node[good], begin[good], q[good]]), axis=1, return_index=True)
    node, begin, end, q = node[good][one], begin[good][one], end[good][one], q[good][one]
    if not len(node):
        return z, z, z
    # to all places of the nonterminal
    by = np.argsort(rule, kind="stable")
    places, rules = where[by], rule[by]
    a, b = np.searchsorted(rules, node), np.searchsorted(rules, node, "right")
    row, step = _spread(b - a)
    shift = places[a[row] + step] - lo[node][row]
    return _merge(begin[row] + shift, end[row] + shift, q[row])


def _merge(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal intervals the smallest period; of a period's intervals those that lie in no other."""
    by = np.lexsort((q, e, s))
    s, e, q = s[by], e[by], q[by]
    one = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])
    s, e, q = s[one], e[one], q[one]
    by = np.lexsort((-e, s, q))
    s, e, q = s[by], e[by], q[by]
    top = int(e.max()) + 1
    far = np.maximum.accumulate(e + q * top)  # ends rise with the period, so each period begins anew
    inside = np.concatenate([[False], e[1:] + q[1:] * top <= far[:-1]])
    s, e, q = s[~inside], e[~inside], q[~inside]
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def repeated_by_rule(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rewriting of the query: places of the original words, or None where the text stays."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a, i = g % n, np.arange(n)
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def _text_rows(doc_ids: list, words: list[list[bytes]], ids: np.ndarray, doc: np.ndarray, edge: np.ndarray) -> Iterator[tuple]:
    s, e, q = runs_of(ids, doc)
    first = np.searchsorted(s, edge)
    for k, (doc_id, w) in enumerate(zip(doc_ids, words, strict=True)):
        a, b = first[k], first[k + 1]
        if a == b:
            yield doc_id, 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(w)).hexdigest(), len(w), 0
            continue
        rs, re_, rq = (s[a:b] - edge[k]).tolist(), (e[a:b] - edge[k]).tolist(), q[a:b].tolist()
        digest = hashlib.sha256()
        drop = np.zeros(len(w) + 1, np.int64)
        best = 0
        for t, (x, y, p) in enumerate(zip(rs, re_, rq, strict=True)):
            digest.update(f"{x},{y - x},{p}\n".encode())
            drop[x + p] += 1
            drop[y] -= 1
            if (y - x) * rq[best] > (re_[best] - rs[best]) * p:  # ties stay with the first by start, then period
                best = t
        stay = np.cumsum(drop[:-1]) == 0
        kept = [w[t] for t in np.flatnonzero(stay).tolist()]
        length = re_[best] - rs[best]
        yield (
            doc_id, b - a, rs[best], length, rq[best], 1000 * length // rq[best], digest.hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest(), len(w), len(w) - len(kept),
        )


def find_runs(docs: DataFrame, rewrite=repeated_by_rule) -> DataFrame:
    """Runs of every text, as a digest: their number, the one of greatest exponent, sha256 of all
    of them and of the text without the repetitions. ``rewrite`` (doc_id, number of words) may
    give other places from which the words are taken; None leaves all texts as they are."""
    schema = pa.schema(
        [(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (x.split() for x in SCHEMA.split(", "))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                other = rewrite(doc_id, len(w)) if rewrite else None
                group.append((doc_id, [w[i] for i in other.tolist()] if other is not None else w))
                size += len(w)
                if size >= GROUP:
                    yield rows(group)
                    group, size = [], 0
            if group:
                yield rows(group)

    def rows(group: list[tuple]) -> pa.RecordBatch:
        doc_ids, words = [x[0] for x in group], [x[1] for x in group]
        n = np.array([len(w) for w in words], np.int64)
        edge = np.concatenate([[0], np.cumsum(n)])
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(x, len(known)) for w in words for x in w), np.int64, int(edge[-1]))
        found = list(_text_rows(doc_ids, words, ids, np.repeat(np.arange(len(n)), n), edge))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(work, SCHEMA)
