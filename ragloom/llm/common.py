"""Shared helpers: durable intermediate tables, hashing of words and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path, keep  # noqa: F401

#: Words are runs of anything but these bytes (blank, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_PRIME = 0x100000001B3
#: Bytes hashed at a time; bounds the temporaries to some tens of MB.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (a bijection on 64-bit values)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_GOLD))
_POW = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 2 * len(_POW), 256), _PRIME, U64)
        p[0] = 1
        _POW = np.cumprod(p, dtype=U64)
    return _POW


def _hash_words(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of ``data``. ``cuts``: offsets at which words must break."""
    text = ~_SEP[data]
    first = text.copy()
    first[1:] &= ~text[:-1]
    inner = cuts[cuts < len(data)]
    first[inner] = text[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z
    body = np.flatnonzero(text)
    begin = np.searchsorted(body, starts)
    lens = np.diff(np.append(begin, len(body)))
    at = np.arange(len(body)) - np.repeat(begin, lens)
    v = _BYTE[_LOWER[data[body]] if lower else data[body]] * _powers(int(lens.max()))[at]
    return mix(np.add.reduceat(v, begin) + U64(_GOLD) * lens.astype(U64)), starts, starts + lens


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, number of the text) of every word of consecutive texts in one buffer;
    lower: ASCII letters are lower-cased first.

    ``offsets`` has one more entry than there are texts. Works through the
    buffer in pieces of about CHUNK bytes, cut where no word is cut.
    """
    hs, ss, es = [], [], []
    pos, end = int(offsets[0]), int(offsets[-1])
    while pos < end:
        stop = min(end, pos + CHUNK)
        while stop < end:
            sep = np.flatnonzero(_SEP[data[pos:stop]])
            if len(sep):
                stop = pos + int(sep[-1]) + 1
                break
            k = np.searchsorted(offsets, stop, "right") - 1
            if offsets[k] > pos:
                stop = int(offsets[k])
                break
            stop = min(end, stop + CHUNK)
        lo, hi = np.searchsorted(offsets, [pos, stop])
        h, s, e = _hash_words(data[pos:stop], (offsets[lo:hi] - pos).astype(np.int64), lower)
        hs.append(h)
        ss.append(s + pos)
        es.append(e + pos)
        pos = stop
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    return h, s, e, np.searchsorted(offsets, s, "right") - 1


def shingle_hashes(w: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words; a shorter, non-empty sequence is one shingle."""
    n = len(w)
    if n == 0:
        return np.zeros(0, U64)
    k = min(size, n)
    h = np.zeros(n - k + 1, U64)
    for i in range(k):
        h = h * U64(0xD6E8FEB86659FD93) + w[i : n - k + 1 + i]
    return mix(h + U64(k))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), off


def text_shingles(batch: pa.RecordBatch, text: str = "text", group_bytes: int = 4 << 20, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of the batch."""
    data, off = buffers(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + group_bytes, "right")) - 1)
        h, _, _, at = words_of(data, off[row : stop + 1])
        edge = np.searchsorted(at, np.arange(stop - row + 1))
        for k in range(stop - row):
            yield row + k, np.unique(shingle_hashes(h[edge[k] : edge[k + 1]], size))
        row = stop


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits that identify a set of hashes (order does not matter)."""
    if not len(hashes):
        return 0
    s = np.add.reduce(mix(hashes + U64(_GOLD)), keepdims=True)
    return int(mix(s ^ U64((len(hashes) * _GOLD) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)[0])


def set_marks(values: np.ndarray, fresh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sets that begin at ``first``: the number of fresh values, and the fingerprint of those."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.add.reduceat(fresh.astype(np.int64), first)
    s = np.add.reduceat(np.where(fresh, mix(values + U64(_GOLD)), U64(0)), first)
    return n, mix(s ^ (n.astype(U64) * U64(_GOLD))).view(np.int64)


#: Bits of a membership filter: 8 an id, within these bounds (at most 16 MB).
FEWEST, MOST = 1 << 20, 1 << 27


def slot(ids: np.ndarray, slots: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64) + U64(77)) % U64(slots)).astype(np.int64)


def membership(ids: DataFrame, col: str) -> bytes:
    """A bitmap over the ids, made by a grouped aggregation; its size follows their number up
    to 16 MB. It only spares work (false positives are joined away later), so beyond some
    16 M ids it spares less."""
    size = min(MOST, max(FEWEST, 1 << (8 * ids.count()).bit_length()))

    def slots(batches):
        for b in batches:
            v = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slot(v, size)))], ["slot"])

    s = ids.select(F.col(col).cast("long")).mapInArrow(slots, "slot long")
    rows = (
        s.groupBy(F.bitmap_bucket_number("slot").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()
    )  # at most MOST / 32768 + 1 rows of 4 KB
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        if r["b"] < 1:  # slot 0, which member() always admits
            continue
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def member(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the set. Spark puts slot s > 0 in bucket 1 + (s - 1) // 32768."""
    s = slot(ids, 8 * len(bits))
    t = np.maximum(s - 1, 0)
    hit = (bits[t >> 3] >> (t & 7).astype(np.uint8)) & 1
    return (hit == 1) | (s == 0)
