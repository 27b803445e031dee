"""Exact connection of similar sets from index lists, without all pairs of a list.

Nodes are distinct sets. An index list holds the nodes that share a key (a
rare shingle, or a band of MinHash values), sorted by set size. Links are found
in two steps that together look at every pair a list proposes:

1. Each node goes, with a bitmap, to two of its lists only, the longest and the
   shortest. Blocks of those lists are compared by bitmaps, blocks that the size
   bound rules out are skipped, and of each block the pairs of its maximum
   spanning forest are verified: at most one pair a node. Verified links give
   components; rounds go on among nodes of different components.
2. A pair whose two nodes are already connected needs no answer of its own: it
   follows from the answers of sets that are highly similar to it. All other
   pairs of a list are held against exact bounds (size, position, bitmaps folded to
   SKETCH bytes), each pair that remains once against the whole bitmaps, and what is
   left is verified.

Within a list only the nodes outside its largest component are held against the others, and
long lists are dealt out in pairs of slots, so no task holds a whole list: a list of n nodes, m
of them outside, costs n (1 + m / SLOT) rows. Postings carry no whole bitmaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keep, mix

#: Nodes of a long list that one slot holds; nodes of a block that bitmaps compare; rounds of
#: spanning forests before all pairs left are looked at.
SLOT, BLOCK, ROUNDS = 1024, 512, 2
#: Bytes of a bitmap in a block at most: wider ones are folded, which keeps the bound valid.
WIDEST = 2048
#: Bytes of the folded bitmap that travels with a row that is held against the others of its list.
SKETCH = 32


def bitmap_bits(n: int) -> int:
    """Bits of the parity bitmap of a set of n: the power of two from 4 n up, 128 at least."""
    return max(128, 1 << int(4 * max(n, 1) - 1).bit_length())


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """Bit b is the parity of the number of hashes that fall on b. The Hamming distance of
    two bitmaps never exceeds the symmetric difference of the sets; halves can be XORed
    to compare bitmaps of different lengths."""
    bits = bitmap_bits(len(hashes))
    count = np.bincount((mix(hashes + U64(12345)) & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(b: np.ndarray, size: int) -> np.ndarray:
    while len(b) > size:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


def _need(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least intersection of sets of sizes a and b whose Jaccard similarity is num / den at least."""
    return -((-num * (a + b)) // (num + den))


def _starts(*cols: np.ndarray) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _neighbours(num: int, den: int) -> Callable:
    """Streams through (key, node, n, pos) sorted by key, n, node. Keeps one row a node of those
    that have a neighbour of compatible size in their list; of an open list only the last row
    is remembered."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # row, whether it is out
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            key, node, n, _ = rows
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
            if last is not None:
                new &= ~((key == last[0][0]) & (node == last[0][1]) & (n == last[0][2]))
            rows = [c[new] for c in rows]
            if not len(rows[0]):
                continue
            joined = last is not None and rows[0][0] == last[0][0]
            if joined:
                rows = [np.concatenate([[x], c]) for x, c in zip(last[0], rows)]
            key, _, n, _ = rows
            near = (key[1:] == key[:-1]) & (n[:-1] * den >= n[1:] * num)
            show = np.zeros(len(key), bool)
            show[1:] |= near
            show[:-1] |= near
            last_out = bool(show[-1]) or (joined and len(key) == 1 and last[1])
            if joined and last[1]:
                show[0] = False
            if show.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[show], k) for c, k in zip(rows, kinds)], ["key", "node", "n", "pos"])
            last = ([c[-1] for c in rows], last_out)

    return run


def _differ(u: np.ndarray, v: np.ndarray) -> int:
    """A lower bound of the symmetric difference of the sets of two parity bitmaps."""
    size = min(len(u), len(v))
    return int(np.bitwise_count(_fold(u, size) ^ _fold(v, size)).sum())


def _possible(num: int, den: int) -> Callable:
    """(a, b, n and bitmap of a, n and bitmap of b) to the pairs that the bitmaps do not rule out."""

    def run(batches):
        for t in batches:
            na, nb = (t.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
            most = na + nb - 2 * _need(na, nb, num, den)
            good = [i for i, (x, y) in enumerate(zip(t.column(3), t.column(5))) if _differ(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= most[i]]
            at = pa.array(good, pa.int32())
            yield pa.RecordBatch.from_arrays([t.column(0).take(at), t.column(1).take(at)], ["a", "b"])

    return run


def possible(pairs: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps (node, n, bm) allow to link."""
    left = bitmaps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bm").alias("ba"))
    right = bitmaps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bm").alias("bb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "ba", "nb", "bb")
    return both.mapInArrow(_possible(num, den), "a long, b long")


def _verified(num: int, den: int) -> Callable:
    """(a, b, hashes of a, hashes of b) to the pairs (a, b) that link."""

    def run(batches):
        for t in batches:
            a, b = t.column(0).to_pylist(), t.column(1).to_pylist()
            good = []
            for i, (x, y) in enumerate(zip(t.column(2), t.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and den * both >= num * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, hs) have a Jaccard similarity of num / den at least."""
    left = sets.select(F.col("node").alias("a"), F.col("hs").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hs").alias("hb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ha", "hb")
    return both.mapInArrow(_verified(num, den), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node of its component.

    Alternating large-star and small-star steps (every step a grouped minimum and an
    equi-join, so a node with very many links is pre-aggregated and skew-splittable)
    until the edges no longer change; each round is written to the shared folder.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            nb = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            nb = e
        low = nb.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = nb.join(low, "a")
        if large:
            moved = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = state(e)
    if was[0]:
        for _ in range(rounds):
            e = keep(star(star(e, True), False), "cc")
            now = state(e)
            if now == was:
                break
            was = now
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _whole_groups(batches, cols: int):
    """Tables whose groups, by the first ``cols`` columns they are sorted by, are whole."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if rest is None or not rest.num_rows else [*rest.to_batches(), b]).combine_chunks()
        at = int(_starts(*(t.column(i).to_numpy() for i in range(cols)))[-1])
        rest = t.slice(at)
        if at:
            yield t.slice(0, at)
    if rest is not None and rest.num_rows:
        yield rest


def _forest(num: int, den: int) -> Callable:
    """Streams through (key, slot, node, n, label, bm) sorted by key, slot, n; proposes the pairs of
    the maximum spanning forest of each block, by the margin that the bitmaps leave; pairs of one
    label are joined from the start."""
    far = np.int32(2**30)

    def edges(node, n, label, bm):
        m = len(node)
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in bm]
        size = np.array([len(x) for x in raw])
        margin = np.full((m, m), -1, np.int32)
        stop = np.searchsorted(n, n * den // num, "right")
        for z in np.unique(size):  # as sizes rise with n, a row is compared at its own width
            mine = np.flatnonzero(size == z)
            lo, hi = int(mine[0]), int(stop[mine].max())
            folded = np.stack([_fold(x, z) for x in raw[lo:hi]])
            words = folded.view(np.uint64)
            for i in mine:
                j = slice(i + 1, stop[i])
                if i + 1 < stop[i]:
                    apart = np.bitwise_count(words[i + 1 - lo : stop[i] - lo] ^ words[i - lo]).sum(1, dtype=np.int32)
                    margin[i, j] = n[i] + n[j] - 2 * _need(n[i], n[j], num, den) - apart
        margin = np.maximum(margin, margin.T)
        margin[label[:, None] == label[None, :]] = far
        # Prim's algorithm: the best way into the tree of each node outside
        best, way, out = np.full(m, -2, np.int32), np.zeros(m, np.int64), np.ones(m, bool)
        for _ in range(m):
            at = int(np.where(out, best, -3).argmax())
            out[at] = False
            if 0 <= best[at] < far:
                yield int(node[at]), int(node[way[at]])
            closer = margin[at] > best
            best[closer], way[closer] = margin[at][closer], at

    def run(batches):
        for t in _whole_groups(batches, 2):
            c = [t.column(k).to_numpy().astype(np.int64) for k in range(5)]
            bm = t.column(5).combine_chunks()
            first = np.append(_starts(*c[:2]), t.num_rows)
            found = []
            for lo, hi in zip(first[:-1], first[1:]):
                if hi - lo > 1:
                    found += edges(*(x[lo:hi] for x in c[2:5]), bm.slice(lo, hi - lo))
            ab = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab.min(1)), pa.array(ab.max(1))], ["a", "b"])

    return run


def _sketches(batches):
    """(node, sketch): the bitmap folded to SKETCH bytes; shorter ones are filled up with zeros."""
    for b in batches:
        small = [_fold(np.frombuffer(x.as_buffer(), np.uint8), SKETCH).tobytes().ljust(SKETCH, b"\0") for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(small, pa.binary())], ["node", "sketch"])


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """The sketches of a column as rows of 64-bit words."""
    data = b"".join(x.as_buffer() for x in col)
    return np.frombuffer(data, np.uint64).reshape(-1, SKETCH // 8)


#: Groups up to this size are compared in bulk, by the distance of their rows.
_FEW = 16


def _crossing(num: int, den: int, positions: bool) -> Callable:
    """Streams through (key, s, t, side, node, n, pos, label, sketch) sorted by key, s, t, side, n;
    proposes the pairs of side 0 and side 1 whose labels differ and that size, position and
    sketches do not rule out."""

    def able(ni, nj, pi, pj, si, sj):
        need = _need(ni, nj, num, den)
        ok = (ni * den >= nj * num) & (nj * den >= ni * num)
        if positions:
            ok &= 1 + np.minimum(ni - 1 - pi, nj - 1 - pj) >= need
        apart = np.bitwise_count(si ^ sj)
        half = np.bitwise_count(si[..., :2] ^ si[..., 2:] ^ sj[..., :2] ^ sj[..., 2:])
        whole = (ni > SKETCH) == (nj > SKETCH)  # else one fills half of its sketch only, and the other is folded
        return ok & (np.where(whole, apart.sum(-1, dtype=np.int64), half.sum(-1, dtype=np.int64)) <= ni + nj - 2 * need)

    def run(batches):
        for t in _whole_groups(batches, 3):
            c = [t.column(k).to_numpy().astype(np.int64) for k in range(8)]
            first = _starts(*c[:3])
            size = np.diff(np.append(first, len(c[0])))
            side, node, n, pos, label = c[3:]
            sk = _matrix(t.column(8))
            found = []
            few = np.repeat(np.where(size <= _FEW, np.arange(len(size)), -1 - np.arange(len(size))), size)
            for d in range(1, min(_FEW, int(size.max()))):
                i = np.flatnonzero((few[d:] == few[:-d]) & (few[d:] >= 0) & (side[d:] != side[:-d]) & (label[d:] != label[:-d]))
                i = i[able(n[i], n[i + d], pos[i], pos[i + d], sk[i], sk[i + d])]
                found.append(np.stack([node[i], node[i + d]], 1))
            for g in np.flatnonzero(size > _FEW):
                lo, hi = first[g], first[g] + size[g]
                one = lo + int((side[lo:hi] == 0).sum())
                for p in range(lo, one):  # the other side's block of compatible sizes
                    j = slice(one + np.searchsorted(n[one:hi], -(-n[p] * num // den)), one + np.searchsorted(n[one:hi], n[p] * den // num, "right"))
                    k = np.flatnonzero((label[j] != label[p]) & able(n[p], n[j], pos[p], pos[j], sk[p], sk[j]))
                    found.append(np.stack([np.full(len(k), node[p]), node[j][k]], 1))
            ab = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            ab = np.sort(ab, axis=1)
            ab = ab[np.lexsort((ab[:, 1], ab[:, 0]))]
            ab = ab[_starts(ab[:, 0], ab[:, 1])] if len(ab) else ab
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return run


def _checked(pairs: DataFrame, sets_of: Callable, num: int, den: int, name: str) -> DataFrame:
    """The links among the pairs; sets are fetched for the nodes of the pairs only."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return keep(verify(pairs, keep(sets_of(nodes), "sets"), num, den), name)


def _narrow(batches):
    """(node, n, bm) with bitmaps of WIDEST bytes at most."""
    for b in batches:
        bm = b.column(2)
        if (pc.max(pc.binary_length(bm)).as_py() or 0) > WIDEST:
            bm = pa.array([_fold(np.frombuffer(x.as_buffer(), np.uint8), WIDEST).tobytes() for x in bm], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bm], ["node", "n", "bm"])


def connect(postings: DataFrame, bitmaps_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, positions: bool) -> DataFrame:
    """(node, label): the components of the nodes under links of similarity num / den at least.

    postings: (key long, node long, n int, pos int); a key's nodes are proposed to each
    other. positions: pos is the place of the key in the node's ordered set, and two
    linked nodes meet at the first key they share.
    bitmaps_of, sets_of: give (node, n, bm) and (node, hs) for the nodes asked for (more are
    allowed, and equal rows may repeat). Nodes without links are not returned.
    """
    lists = keep(
        postings.select("key", "node", "n", "pos").repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_neighbours(num, den), "key long, node long, n int, pos int"),
        "lists",
    )
    bitmaps = keep(bitmaps_of(lists.select("node").distinct()).dropDuplicates(["node"]), "bitmaps")
    narrow = bitmaps.select("node", "n", "bm").mapInArrow(_narrow, "node long, n int, bm binary").select("node", "bm")

    sketches = bitmaps.select("node", "bm").mapInArrow(_sketches, "node long, sketch binary")

    def named(label: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The lists' rows with labels; and of each list with several labels its size, largest label and that one's nodes."""
        if label is None:
            rows = lists.withColumn("label", F.col("node"))
            sizes = lists.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("major"), F.lit(1).cast("long").alias("most"))
        else:
            rows = keep(lists.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).select("key", "node", "n", "pos", "label"), "named")
            counts = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
            sizes = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("size"), F.max("c").alias("most"))
        return rows, sizes.where("most < size")

    def forest(label: DataFrame | None, turn: int) -> DataFrame:
        """Pairs of a spanning forest of the nodes, by bitmaps, each in its longest and its shortest list."""
        rows, sizes = named(label)
        placed = rows.join(sizes.select("key", "size"), "key")
        home = F.struct("size", "key")
        homes = placed.groupBy("node", "n", "label").agg(F.max(home).alias("long"), F.min(home).alias("short"))
        homes = homes.select("node", "n", "label", F.explode(F.array_distinct(F.array("long", "short"))).alias("home"))
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("home.size") / BLOCK)).cast("int")
        homes = homes.select(F.col("home.key").alias("key"), slot.alias("slot"), "node", "n", "label").join(narrow, "node")
        blocks = homes.select("key", "slot", "node", "n", "label", "bm").repartition("key", "slot").sortWithinPartitions("key", "slot", "n", "node")
        return keep(blocks.mapInArrow(_forest(num, den), "a long, b long").distinct(), "forest")

    def crossing(label: DataFrame) -> DataFrame:
        """All pairs of a list across labels that no bound rules out."""
        rows, sizes = named(label)
        slots = {"s": "S", "t": "T"}
        wide = sizes.select("key", "major", F.ceil(F.col("size") / SLOT).cast("int").alias("S"), F.ceil((F.col("size") - F.col("most")) / SLOT).cast("int").alias("T"))
        rows = rows.join(wide, "key").join(sketches, "node")

        def dealt_to(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
            """Each row goes to its own slot of its side, with every slot of the other side."""
            rows = rows.withColumn(own, F.pmod(F.xxhash64("node"), F.col(slots[own])).cast("int")).withColumn(other, F.explode(F.expr(f"sequence(0, {slots[other]} - 1)")))
            return rows.select("key", "s", "t", F.lit(side).alias("side"), "node", "n", "pos", "label", "sketch")

        dealt = dealt_to(rows.where("label <> major"), 0, "t", "s").unionByName(dealt_to(rows, 1, "s", "t"))
        runs = dealt.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "side", "n")
        pairs = keep(runs.mapInArrow(_crossing(num, den, positions), "a long, b long").distinct(), "crossing")
        return keep(possible(pairs, bitmaps, num, den), "possible")

    label, links = None, None
    for turn in range(ROUNDS):
        pairs = forest(label, turn)
        more = _checked(pairs, sets_of, num, den, "links")
        if turn and more.isEmpty():
            break
        links = more if links is None else links.unionByName(more)
        label = components(links)
    more = _checked(crossing(label), sets_of, num, den, "links")
    return label if more.isEmpty() else components(links.unionByName(more))
