"""Spelling variants of words, grouped under their most frequent near words by pivotal grams.

Method: the bigrams of a word are ordered by their rarity among all words. A word's prefix are
its three rarest (and their repeats); its pivots are the two disjoint bigrams of the prefix with
the smallest total frequency, chosen by dynamic programming over positions. One inserted,
deleted or replaced character leaves one of two disjoint bigrams whole. So of two near words,
that whose prefix ends earlier in the order has a pivot that stands in the other's prefix.
Position limits: the one edit is on one side of that pivot, so all that is on its other side is
equal, and the position shifts by no more than the lengths differ; of two pivots, each stands for
edits up to the other. Pivots and prefix grams are therefore joined by their gram together with
the equal side of the word (and, where that is short, with the unedited half of the other side), which is
one equi-join; pairs are then verified by edit distance.

Scale: texts are reduced to counted words before anything is shuffled but these counts. Words
take some thirty rows in the index. There are at most 8,100 bigrams (90 letters), so their
frequencies fit in a task's closure. The frequency of forms rises at least tenfold a step, so
roots take a handful of rounds of path doubling.

Defined results: a null or empty text has no words; a null doc_id counts as the empty string in
the rule below; repeated rows count as often as they stand there; of near words with equal
counts the smallest in code-point order is the form; words of any length are taken whole; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Letters, and the code points and occurrences that a word needs.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: Characters that an equal side of a word needs to be a key by itself.
LONG = 5
#: How much more frequent than a word its form must be.
TIMES = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelt(doc_id: Column, run: Column, rate: int = 31) -> Column:
    """The query's rule: where ``rate`` divides the crc32 of ``doc_id:run``, one character is left out."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % rate == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, rewrite=misspelt) -> DataFrame:
    """(word, n) of all words of the texts."""
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    word = rewrite(F.col("doc_id"), F.col("low")) if rewrite else F.col("low")
    return (
        runs.select("doc_id", run.alias("low"))
        .select(word.alias("word"))
        .where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def pivots(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Positions of the two disjoint bigrams of least total weight among (position, weight) by
    position. The state of the programme: the best single bigram that ends before this one, and
    the best pair so far."""
    single, pair, waiting = None, None, []
    for p, w in prefix:
        waiting.append((w, p))
        while waiting and waiting[0][1] <= p - 2:
            single = min(filter(None, (single, waiting.pop(0))))
        if single:
            pair = min(filter(None, (pair, (single[0] + w, single[1], p))))
    return pair[1], pair[2]


def signatures(found: DataFrame, gram_counts: dict[str, int]) -> DataFrame:
    """word, n, the rank of the prefix's last bigram, positions of the pivots and of the prefix."""
    order = {g: k for k, g in enumerate(sorted(gram_counts, key=lambda g: (gram_counts[g], g)))}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, pivot, prefix = [], [], []
            for w in b.column(0).to_pylist():
                ranks = [order[w[i : i + 2]] for i in range(len(w) - 1)]
                end = sorted(ranks)[2]
                at = [i for i, r in enumerate(ranks) if r <= end]
                last.append(end)
                prefix.append(at)
                pivot.append(pivots([(i, gram_counts[w[i : i + 2]]) for i in at]))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(last, pa.int32()), pa.array(pivot, kind), pa.array(prefix, kind)], ["word", "n", "last", "pivots", "prefix"])

    return found.select("word", "n").mapInArrow(work, "word string, n long, last int, pivots array<int>, prefix array<int>")


def keys_of(word: str, at: int, reach: tuple[int, int], asking: bool) -> list[str]:
    """What two near words share if the bigram at ``at`` survived and the edit is on one side of it.

    The other side with the bigram is equal in both. Where that is shorter than LONG, the edited
    side is split in the middle too: the half without the edit is equal, one way for words of equal length
    and one for each of a shorter and a longer word. ``reach``: how many characters after and before the
    bigram the edit may be away from it."""
    out = []
    for side, same, rest, far in (("<", word[: at + 2], word[at + 2 :], reach[0]), (">", word[at:], word[:at][::-1], reach[1])):
        if len(same) >= LONG:
            out.append(side + same)
            continue
        m = len(rest)
        shorter, longer = (0, 1) if asking else (1, 0)  # the asking word is the shorter of the pair where the other is the longer
        for kind, size, skip in ((2, m, 0), (shorter, m, 0), (longer, m - 1, 1)):
            half = size // 2
            if size < 0:
                continue
            head = f"{side}{kind}{size}{same} "
            out.append(f"{head}b{rest[half + skip :]}")
            if far > half:
                out.append(f"{head}a{rest[:half]}")
    return out


def _index(signed: DataFrame, asking: bool) -> DataFrame:
    """A row (key, word, n, last) for each key of each pivot (of asking words) or prefix bigram (of the others)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for w, at in zip(b.column("word").to_pylist(), b.column("pivots" if asking else "prefix").to_pylist(), strict=True):
                whole = (len(w), len(w))
                if asking:  # an edit beyond the other pivot leaves that pivot with more of the word
                    gap = at[1] - at[0]
                    keys.append([*keys_of(w, at[0], (gap, len(w)), True), *keys_of(w, at[1], (len(w), gap), True)])
                else:
                    keys.append([k for p in at for k in keys_of(w, p, whole, False)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("word", "n", "last")), pa.array(keys, pa.list_(pa.string()))], ["word", "n", "last", "keys"])

    keyed = signed.mapInArrow(work, "word string, n long, last int, keys array<string>")
    return keyed.select("word", "n", "last", F.explode("keys").alias("key")).select(F.xxhash64("key").alias("key"), "word", "n", "last")


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n) of the words that one edit tells apart, each pair once with a < b."""
    grams = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("g"))
    counts = {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.count("*").alias("n")).collect()}  # 90 letters: 8,100 rows at most
    signed = keep(signatures(found, counts), "signatures")
    a = _index(signed, True)
    b = _index(signed, False).select("key", *[F.col(c).alias(f"o_{c}") for c in ("word", "n", "last")])
    near = (F.col("last") <= F.col("o_last")) & (F.abs(F.length("word") - F.length("o_word")) <= 1) & (F.col("word") != F.col("o_word"))
    hits = a.join(b, (a["key"] == b["key"]) & near).where(F.levenshtein("word", "o_word", 1) == 1)
    first = F.col("word") < F.col("o_word")
    pair = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("word", "o_word", "a"), ("o_word", "word", "b"), ("n", "o_n", "a_n"), ("o_n", "n", "b_n"))]
    return hits.select(*pair).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to their end, by path doubling."""
    cur = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = keep(cur.join(cur.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left"), "roots")
        cur = nxt.select("word", F.coalesce("further", "root").alias("root"))
        if nxt.where("further is not null").isEmpty():
            return cur


def group_variants(docs: DataFrame, rewrite=misspelt) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    found = keep(words(docs, rewrite), "words")
    pairs = near_pairs(found)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("o"), F.col("b_n").alias("o_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("o"), F.col("a_n").alias("o_n")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("minus"), F.col("o"))).alias("best"), F.first("n").alias("n"))
    is_form = -F.col("best.minus") >= TIMES * F.col("n")
    best = keep(best.select("word", "n_near", F.when(is_form, F.col("best.o")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    roots = _roots(best.where("form is not null"))
    return (
        found.join(best, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )
