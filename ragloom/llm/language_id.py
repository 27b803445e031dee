"""Language of pages and documents by Bayesian fusion of evidence.

The text's likelihood under byte-trigram models (trained here on a bounded sample of
labelled documents) is combined with the likelihood of the language that the markup
declares, that of the address (a language code as first path segment, or a country
suffix), and a prior of the host. Host priors are smoothed hierarchically: host towards
its registered domain, the domain towards the whole corpus. Priors and the likelihoods
of declarations and addresses come from grouped aggregations over all rows.

Defined results: without text, the other evidence decides; without any evidence, the
prior; if no labelled document exists, lang is 'und' and prob 0; a null host has the
prior of the corpus; of languages that score alike the first by code wins; texts of any
length are read whole; repeated rows are judged alike and each counts in the priors, but
once in the training sample; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, keep, mix

#: Labelled documents of the sample at most; trigram classes; pseudo-counts of a prior;
#: exponent on the text's likelihood (its trigrams are far from independent).
SAMPLE, CLASSES, STRENGTH, TEMPER = 2000, 1 << 15, 5.0, 0.2
#: Country suffixes that speak for a language.
SUFFIX_LANG = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}

#: Second labels that, before a country suffix, belong to the suffix: fixed values.
SHARED_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "ne", "net", "or", "org")

_TEXTLESS = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*+>")
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_B = mix(np.arange(1, 769, dtype=U64)).reshape(3, 256)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLD[[*range(0x30, 0x3A), 9, 10, 11, 12, 13]] = 32


def _classes(data: np.ndarray) -> np.ndarray:
    b = _FOLD[data]
    return ((_B[0][b[:-2]] ^ _B[1][b[1:-1]] ^ _B[2][b[2:]]) & U64(CLASSES - 1)).astype(np.int32)


def _counts(batches):
    for b in batches:
        data, off = buffers(b.column(2))
        n = []
        for i in range(len(off) - 1):
            d = data[off[i] : off[i + 1]]
            c = np.bincount(_classes(d), minlength=CLASSES) if len(d) > 2 else np.zeros(CLASSES, np.int64)
            at = np.flatnonzero(c)
            n.append(at.astype("<i4").tobytes() + c[at].astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.binary())], ["lang", "row", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray] | None:
    """Languages and log-probabilities (CLASSES, languages) from at most ``sample``
    documents with a language, the first by a hash of doc_id."""
    labelled = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.col("text").cast("string"), "lang").alias("row"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h")
    )
    # ids are picked first: no task ever holds the texts of more than its share of the sample
    picked = keep(labelled.select("h", "row").distinct().orderBy("h", "row").limit(sample).select("row"), "sample")
    rows = (
        labelled.join(F.broadcast(picked), "row", "left_semi")  # ``sample`` rows at most
        .select("lang", "row", "text")
        .mapInArrow(_counts, "lang string, row long, n binary")
        .dropDuplicates(["row"])
        .select("lang", "n")
        .toArrow()
    )
    total: dict[str, np.ndarray] = {}
    for lang, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        v = np.frombuffer(n, "<i4")
        t = total.setdefault(lang, np.zeros(CLASSES))
        t[v[: len(v) // 2]] += v[len(v) // 2 :]
    langs = sorted(total)
    if not langs:
        return None
    c = np.stack([total[x] + 0.5 for x in langs], axis=1)
    return langs, np.log(c / c.sum(0)).astype(np.float32)


def _scored(model, html: bool):
    """Adds the text's log-likelihoods, and their best language."""
    langs, logp = model

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            if html:
                texts = pa.array([None if t is None else _TEXTLESS.sub(" ", t) for t in texts.to_pylist()], pa.string())
            data, off = buffers(texts)
            out = np.zeros((len(off) - 1, len(langs)))
            for i in range(len(out)):
                for j in range(int(off[i]), int(off[i + 1]), 1 << 20):
                    d = data[j : min(off[i + 1], j + (1 << 20) + 2)]
                    if len(d) > 2:
                        out[i] += logp[_classes(d)].sum(0, dtype=np.float64)
            best = [langs[k] if v.any() else None for k, v in zip(out.argmax(1), out)]
            keep_cols = [b.column(i) for i, name in enumerate(b.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*keep_cols, pa.array(best, pa.string()), pa.array(out.tolist(), pa.list_(pa.float64()))], [*(n for n in b.schema.names if n != "text"), "text_lang", "loglik"])

    return run


def _registered(parts) -> Column:
    """The registered domain of a host's labels: the last two, or three below a suffix like co.uk."""
    shared = (F.length(F.try_element_at(parts, F.lit(-1))) == 2) & F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).isin(*SHARED_LABELS)
    labels = F.when(shared, 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")


def evidence(pages: DataFrame | None, docs: DataFrame | None) -> list[tuple[DataFrame, bool]]:
    """The rows to judge: (kind, doc_id, page_id, host, domain, declared, address, text) of each table.

    For pages the markup's lang attribute and the address speak; a document has only its
    source as host (its lang column serves as label of the training sample, never as evidence).
    """
    out = []
    null = F.lit(None)
    if pages is not None:
        url = F.col("url").cast("string")
        host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
        host = F.when(host != "", host)
        parts = F.split(host, r"\.")
        segment = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
        ends = F.create_map(*[F.lit(x) for kv in SUFFIX_LANG.items() for x in kv])
        html = F.col("html").cast("string")
        # comments and scripts may come before the tag, and hold others like it
        declared = F.lower(F.regexp_extract(F.regexp_replace(html, _UNSEEN, " "), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
        rows = pages.select(
            F.lit("page").alias("kind"),
            null.cast("long").alias("doc_id"),
            F.col("page_id").cast("long").alias("page_id"),
            host.alias("host"),
            _registered(parts).alias("domain"),
            F.when(declared != "", declared).alias("declared"),
            F.coalesce(F.when(segment != "", segment), F.try_element_at(ends, F.element_at(parts, -1))).alias("address"),
            html.alias("text"),
        )
        out.append((rows, True))
    if docs is not None:
        rows = docs.select(
            F.lit("document").alias("kind"),
            F.col("doc_id").cast("long").alias("doc_id"),
            null.cast("long").alias("page_id"),
            F.concat(F.lit("source:"), F.col("source").cast("string")).alias("host"),
            F.lit("source:").alias("domain"),
            null.cast("string").alias("declared"),
            null.cast("string").alias("address"),
            F.col("text").cast("string").alias("text"),
        )
        out.append((rows, False))
    return out


FIELDS = "kind string, doc_id long, page_id long, host string, domain string, declared string, address string"


def identify(pages: DataFrame | None, docs: DataFrame | None, labelled: DataFrame, sample: int = SAMPLE, strength: float = STRENGTH, temper: float = TEMPER) -> DataFrame:
    """kind, doc_id, page_id, lang, prob, text_lang, declared, address of every row."""
    tables = evidence(pages, docs)
    model = train(labelled, sample)
    if model is None:
        rows = [r.drop("text") for r, _ in tables]
        rows = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        return rows.select("kind", "doc_id", "page_id", F.lit("und").alias("lang"), F.lit(0.0).alias("prob"), F.lit(None).cast("string").alias("text_lang"), "declared", "address")
    langs = model[0]
    scored = [r.mapInArrow(_scored(model, html), f"{FIELDS}, text_lang string, loglik array<double>") for r, html in tables]
    scored = keep(scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1]), "scored")

    zero = F.array_repeat(F.lit(0.0), len(langs))
    names = F.array(*[F.lit(x) for x in langs])

    def tally(key: str) -> DataFrame:
        """Rows of each value of key by language of the text, one row a value."""
        counts = scored.where(F.col(key).isNotNull() & F.col("text_lang").isNotNull()).groupBy(key, "text_lang").agg(F.count("*").cast("double").alias("n"))
        found = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "n"))).alias("n"))
        return found.select(key, F.transform(names, lambda x: F.coalesce(F.try_element_at("n", x), F.lit(0.0))).alias(f"n_{key}"))

    seen = {r["text_lang"]: r["n"] for r in scored.where("text_lang is not null").groupBy("text_lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    every = [seen.get(x, 0) for x in langs]
    total = sum(every)
    corpus = [(c + strength / len(langs)) / (total + strength) for c in every]

    def towards(n: str, up):
        """Counts smoothed towards the distribution one level up."""
        n = F.coalesce(F.col(n), zero)
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, up, lambda x, q: (x + strength * q) / (size + strength))

    top = F.array(*[F.lit(p) for p in corpus])
    domains = tally("domain").select("domain", towards("n_domain", top).alias("p_domain"))
    hosts = (
        scored.where("host is not null").select("host", "domain").distinct()
        .join(tally("host"), "host", "left")
        .join(domains, "domain", "left")
        .select("host", towards("n_host", F.coalesce("p_domain", top)).alias("prior"))
    )

    def likelihood(key: str) -> DataFrame:
        """log P(value | language), smoothed; one row a value of declared or address."""
        floor = F.lit(0.5)
        return tally(key).select(key, F.zip_with(f"n_{key}", F.array(*[F.lit(float(c)) for c in every]), lambda x, c: F.log((x + floor) / (c + F.lit(0.5 * len(langs))))).alias(f"l_{key}"))

    joined = scored.join(hosts, "host", "left").join(likelihood("declared"), "declared", "left").join(likelihood("address"), "address", "left")
    score = F.zip_with(F.transform("loglik", lambda x: x * temper), F.transform(F.coalesce("prior", top), lambda p: F.log(p)), lambda a, b: a + b)
    score = F.zip_with(score, F.coalesce("l_declared", zero), lambda a, b: a + b)
    score = F.zip_with(score, F.coalesce("l_address", zero), lambda a, b: a + b)
    best = F.array_max("score")
    return (
        joined.withColumn("score", score)
        .withColumn("lang", F.element_at(names, F.array_position("score", best).cast("int")))
        .withColumn("prob", 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - best)))
        .select("kind", "doc_id", "page_id", "lang", "prob", "text_lang", "declared", "address")
    )
