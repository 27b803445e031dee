"""Personal data: pattern spans, and information-theoretic sanitisation of revealing terms.

Base spans (email, ip, card, phone) come from patterns with checks, and so do assignments of
secrets (token = "..."). Each distinct value is a protected entity. Over the corpus, lines
are contexts: a term that stands in a line with an entity discloses it to the degree of
their pointwise mutual information, relative to the entity's information content,

    disclosure = PMI(entity; term) / IC(entity) = 1 + log P(entity | term) / -log P(entity),

with probabilities from co-occurrence counts over all lines. Low counts are smoothed, not
cut: P(entity | term) leans towards P(pool | term) P(entity | pool), and P(pool | term)
towards P(pool), where the pool of an address is its domain, and that of another entity
its kind. Terms whose disclosure reaches the threshold become spans of kind ``term``
wherever they occur; in the sanitised text all spans are generalised to their kind.

DataFrame functions only: no Python runs on the executors.

Defined results: null text is empty and has no spans; positions are code points, ends
exclusive; matches that fail their check are dropped without retries; a value matched twice
in a line counts once there, copies of a line count each; terms have ``TERM_CHARS``
characters at least and are no mere numbers; a disclosure that equals the threshold is
enough; repeated rows are judged alike; an empty table gives no rows; texts of any
length are searched whole, in nearly linear time; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Java forms of the base patterns that find the same leftmost, non-overlapping matches in
#: linear time: a run is entered at its start only (or where the last match ended), and
#: repetition is possessive where the next character decides.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][ -]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?+[ \t]*+[=:][ \t]*+[\"']?+[a-z0-9+/=_.~-]{16,}+",
}
#: Cheap tests that a text without a match mostly fails.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]", "secret": r"[=:][ \t]*[\"']?[A-Za-z0-9+/=_.~-]{16}"}
#: Least disclosure, pseudo-counts of a prior, least length of a term.
DISCLOSURE, PRIOR, TERM_CHARS = 0.9, 0.5, 3
BROADCAST_ROWS = 200_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))

    def add(acc, i):
        v = F.substring(d, i, F.lit(1)).cast("int")
        w = F.when(i % 2 == 0, v * 2).otherwise(v)
        return acc + F.when(w > 9, w - 9).otherwise(w)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when((n >= 16) & (n <= 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,end:int,value:string>>"
#: Items that are folded into one list at a time: lists of lists keep the copying small.
FOLD = 256


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int")), lambda i: F.slice(items, i * FOLD + 1, F.lit(FOLD)))


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pairs(text: Column, pattern: Column) -> Column:
    """The matches, each with the length of what lies before it."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    return F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))


def _placed(pairs: Column) -> Column:
    """(start, end, value) of each match: positions are running sums, blocks are folded one after the other."""

    def step(acc, m):
        s = acc["at"] + m["gap"]
        e = s + F.length(m["hit"])
        return F.struct(e.alias("at"), F.concat(acc["spans"], F.array(F.struct(s.alias("start"), e.alias("end"), m["hit"].alias("value")))).alias("spans"))

    def block(acc, part):
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("spans")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["done"], F.array(x["spans"])).alias("done")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("done"))
    return F.when(F.size(pairs) == 0, F.array().cast(SPAN)).otherwise(F.flatten(F.aggregate(_blocks(pairs), start, block)["done"]))


def matches(text: Column, kind: str) -> Column:
    """Valid spans of a kind: array of (start, end, value)."""
    spans = F.filter(_let(_pairs(text, F.lit(PATTERNS[kind])), _placed), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and an array column of spans for each kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", *[matches(F.col("text"), k).alias(k) for k in KINDS])


def _digest(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _terms(line: Column) -> Column:
    """Distinct lower-cased words of a line, without marks at their ends."""
    words = F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{Nd}][\p{L}\p{Nd}_'-]*[\p{L}\p{Nd}]"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= TERM_CHARS)


def _entities(line: Column, kind: str) -> Column:
    return F.transform(matches(line, kind), lambda s: F.concat(F.lit(kind + ":"), F.lower(s["value"])))


def _pool(entity: Column) -> Column:
    """The domain of an address, the kind of any other entity."""
    return F.when(entity.startswith("email:"), F.regexp_replace(entity, "^email:[^@]*@", "email:@")).otherwise(F.regexp_extract(entity, "^[a-z]+", 0))


def _marks(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.lit(kind.upper()).alias("kind")))


def revealing_terms(docs: DataFrame, spans: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, disclosure): terms that disclose a protected entity.

    docs: (doc_id, text); spans: base_spans of them, with only rows that have some.
    """
    # contexts with entities: no match spans lines, so each line is searched for its own
    lines = spans.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.select("line", F.array_distinct(F.flatten(F.array(*[_entities(F.col("line"), k) for k in KINDS]))).alias("values"))
    held = lines.select(F.explode("values").alias("entity"), F.regexp_replace("line", PATTERNS["secret"], " ").alias("line"))
    # addresses of one domain, and the values of any other kind, pool their evidence
    held = keep(held.select(F.xxhash64("entity").alias("entity"), F.xxhash64(_pool(F.col("entity"))).alias("pool"), "line"), "contexts")
    entities = held.groupBy("entity", "pool").agg(F.count("*").alias("n_entity"))
    pools = held.groupBy("pool").agg(F.count("*").alias("n_pool"))
    pairs = held.select("entity", "pool", F.explode(_terms(F.col("line"))).alias("term")).groupBy("entity", "pool", "term").agg(F.count("*").alias("n_both"))
    pairs = keep(pairs.where(~F.col("term").rlike("^[0-9]+$")), "pairs")
    asked = pairs.select("term").distinct()
    if asked.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("disclosure"))
    # occurrences of the candidate terms, by line, over the whole corpus
    uses = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).select(F.explode(_terms(F.col("line"))).alias("term"))
    near = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    uses = uses.groupBy("term").agg(F.count("*").alias("n_term")).join(near, "term", "left_semi")
    n = float(docs.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)))).first()[0] or 1)
    together = pairs.groupBy("pool", "term").agg(F.sum("n_both").alias("n_pool_both"))
    known = pairs.join(entities, ["entity", "pool"]).join(pools, "pool").join(together, ["pool", "term"]).join(uses, "term")
    ic = F.log(F.lit(n) / F.col("n_entity"))
    pool_given = F.least((F.col("n_pool_both") + PRIOR * F.col("n_pool") / n) / (F.col("n_term") + PRIOR), F.lit(1.0))
    given = F.least((F.col("n_both") + PRIOR * pool_given * F.col("n_entity") / F.col("n_pool")) / (F.col("n_term") + PRIOR), F.lit(1.0))
    return known.where(ic > 0).groupBy("term").agg(F.max(1 + F.log(given) / ic).alias("disclosure")).where(F.col("disclosure") >= disclosure)


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, term): the spans of the revealing terms in each text that holds one; row is a hash of
    doc_id and text. Each such text is matched once against the alternation of its own terms."""
    few = terms.select("term").distinct()
    near = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").where("text is not null")
    held = rows.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(near, "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("terms"))
    # terms hold letters, digits and inner marks only; the longest alternative goes first
    longest = F.transform(F.array_sort(F.transform("terms", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{Nd}])(?<![\p{L}\p{Nd}][_'-]{1,9})(?:"), F.array_join(longest, "|"), F.lit(r")(?![_'-]*[\p{L}\p{Nd}])"))
    found = rows.join(held, "row").withColumn("pattern", pattern)
    return found.select("row", _let(_pairs(F.col("text"), F.col("pattern")), _placed).alias("term")).dropDuplicates(["row"])


def find(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text, an array of spans for each kind and for ``term``, of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = base_spans(rows)
    some = keep(spans.where(" or ".join(f"size({k}) > 0" for k in KINDS)), "pii")
    terms = keep(revealing_terms(rows, some, disclosure), "terms")
    spans = spans.withColumn("row", F.xxhash64("doc_id", "text"))
    if terms.isEmpty():
        return spans.withColumn("term", F.array().cast(SPAN)).drop("row")
    return spans.join(term_spans(rows, terms), "row", "left").withColumn("term", F.coalesce("term", F.array().cast(SPAN))).drop("row")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, spans and the sanitised text of what ``find`` returns; n_entities
    counts all spans but the terms."""
    base = F.flatten(F.array(*[_digest(k, F.col(k)) for k in BASE]))
    more = [k for k in (*KINDS, "term") if k not in BASE]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, *[_digest(k, F.col(k)) for k in more]), ",").alias("spans"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in more],
        sum((F.size(k) for k in KINDS), F.lit(0)).cast("long").alias("n_entities"),
        sanitised().alias("sanitised"),
    )


def sanitised() -> Column:
    """The text of what ``find`` returns with every span generalised to its kind; of overlapping
    spans the first (then the longest) counts. Each block of spans is cut out of the text first, so
    no span is counted from the text's start."""
    every = F.array_sort(F.flatten(F.array(*[_marks(k) for k in (*KINDS, "term")])))

    def block(acc, part):
        end = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: -s["neg"])))
        piece = F.substring(F.col("text"), acc["at"] + 1, end - acc["at"])

        def step(a, s):
            start = s["start"] - acc["at"]
            cut = F.array(F.substring(a["text"], a["at"] + 1, start - a["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))
            return F.when(start < a["at"], a).otherwise(F.struct((-s["neg"] - acc["at"]).alias("at"), F.concat(a["out"], cut).alias("out"), a["text"].alias("text")))

        inner = F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), piece.alias("text")), step)
        return _let(inner, lambda x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(_blocks(every), start, block, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return F.when(F.size(every) == 0, F.col("text")).otherwise(whole)


def sanitise(found: DataFrame) -> DataFrame:
    """doc_id and the sanitised text of what ``find`` returns."""
    return found.select("doc_id", sanitised().alias("text"))
