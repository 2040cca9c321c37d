"""Language identification by Bayesian fusion of four kinds of evidence.

1. The text: naive Bayes over hashed byte trigrams. The model is fitted on a bounded sample of labelled rows (SAMPLE, a
   parameter); its log-likelihood is tempered, as trigrams of a text aren't independent.
2. The declared language of the markup (<html lang=...>), 3. the address suffix (country domain, else a two-letter first
   path segment, else the domain's ending): how far each value is to be trusted is learnt from all rows, as counts of its values by the text's posterior.
4. The host: a prior smoothed towards the prior of the host's domain, and that towards the prior of all rows. Counts are grouped sums over all rows.

Each row's own share is taken out of every count it meets again, so no evidence counts twice. Rows first yield their
text posterior, which grouped aggregation turns into small tables by host, domain and value; these are joined back (broadcast
if their rows, which are counted, are few) and the evidence is summed.

Defined results: a text without letters (null, empty, digits) has no text evidence and rests on the others; a row without any
evidence gets the overall prior. A row is rejected (kept is false, language 'und') if its text has no trigram of letters or its best
posterior is under `least`. Null hosts, declarations and suffixes are no evidence. Repeated rows are rows of their own. An
empty table gives an empty result; without a labelled row nothing can be fitted, and every row is 'und' and not kept. Other columns are kept as they are, by `identify` under the names that they have.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, in_small_batches, mapped, texts_of

#: Labelled rows that the text model is fitted on, at most.
SAMPLE = 4000
BITS = 16
#: A text's log-likelihood counts as that of so many trigrams at most.
TRIGRAMS = 60
#: Smoothing: rows that the broader prior weighs in a domain's and in a host's; rows that a value's overall share weighs.
DOMAIN_WEIGHT, HOST_WEIGHT, VALUE_WEIGHT = 20.0, 10.0, 5.0
LEAST = 0.5
#: A table of sums by key is broadcast if it has so many rows at most; beyond, the rows are shuffled to it.
BROADCAST_ROWS = 20_000

#: Bytes that aren't letters are one space here: ASCII other than letters. Bytes from 0x80 belong to letters.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w+;", re.S | re.I)


def visible_text(html: str | None) -> str:
    """The text of a page without markup, scripts and styles."""
    return _HIDDEN.sub(" ", html or "")


def trigrams(text: bytes) -> np.ndarray:
    """Codes of the byte trigrams of letters of a text, folded; those without a letter in the middle are left out."""
    x = _FOLD[np.frombuffer(text, np.uint8)]
    if len(x) < 3:
        return np.empty(0, np.uint32)
    code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
    return code[x[1:-1] != 32]


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # 2^BITS x languages, log-probabilities


def _count(batches):
    for batch in batches:
        found: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            held = found.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            held += np.bincount(trigrams(text), minlength=1 << BITS)
        for lang, held in found.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], names=["lang", "code", "n"])


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> TextModel:
    """A text model from labelled rows: the distinct (text, label) with the first `sample` hashes. Only hashes are ordered, never texts."""
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    last = rows.select("h", "lang").distinct().orderBy("h", "lang").limit(sample).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(last).cast("bigint")).select("lang", "text").distinct()
    counts = mapped(rows, _count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.zeros((1 << BITS, len(languages)))
    for k, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        table[own["code"].to_numpy(), k] = own["n"]
    overall = (table.sum(axis=1, keepdims=True) + 0.5) / (table.sum() + 0.5 * (1 << BITS)) if len(languages) else table
    table = (table + 200.0 * overall) / (table.sum(axis=0, keepdims=True) + 200.0)
    return TextModel(languages, np.log(table).astype(np.float32))


def _scores(model: TextModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-likelihoods, and numbers of trigrams."""
    out = np.zeros((len(texts), len(model.languages)))
    n = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        codes = trigrams(text)
        n[i] = len(codes)
        if len(codes):
            total = np.zeros(len(model.languages))
            for at in range(0, len(codes), 1 << 16):
                total += model.weights[codes[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
            out[i] = (total - total.max()) * (min(1.0, TRIGRAMS / len(codes)))
    return out, n


def _scorer(spark, model: TextModel, html: bool):
    in_small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # its size: 2^BITS numbers for each language

    def score(column: pa.Array) -> pa.Array:
        parts = []
        held, size = [], 0

        def settle():
            if held:
                parts.append(_scores(shared.value, held))
                held.clear()

        for value in column:
            raw = value.as_py() or ""
            text = (visible_text(raw) if html else raw).encode()
            held.append(text)
            size += len(text)
            if size > SLICE_BYTES:
                settle()
                size = 0
        settle()
        scores = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, len(shared.value.languages)))
        n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        offsets = np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.reshape(-1))), pa.array(n)], names=["ll", "n"])

    return F.arrow_udf(score, "struct<ll: array<double>, n: bigint>")


def declared_language(html: Column) -> Column:
    """The two-letter language of <html lang=...>, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1), F.lit(""))


def suffix_of(url: Column) -> Column:
    """Country domain, else the two-letter first path segment, else the domain's ending."""
    ending = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    segment = F.lower(F.regexp_extract(url, r"://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return F.nullif(F.when(F.length(ending) == 2, ending).otherwise(F.when(segment != "", segment).otherwise(ending)), F.lit(""))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _normal(ll: Column) -> Column:
    """Probabilities of log-likelihoods."""
    powers = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """Sums of the posteriors by key, as one array; partial sums come before the shuffle."""
    sums = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.sum(F.col("_post")[i]).alias(f"s{i}") for i in range(k)))
    return sums.select(key, F.array(*(f"s{i}" for i in range(k))).alias(name))


def identify(rows: DataFrame, model: TextModel, text: str, html: bool = False, host: Column | None = None, domain: Column | None = None, declared: Column | None = None, suffix: Column | None = None, least: float = LEAST) -> DataFrame:
    """rows with a struct column `langid` (language, posterior, n_trigrams, kept)."""
    if "langid" in rows.columns:
        raise ValueError("the input has a column langid already")
    k = len(model.languages)
    nothing = F.lit(None).cast("string")
    base = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), *(x.cast("string").alias(n) for x, n in ((nothing if host is None else host, "_host"), (nothing if domain is None else domain, "_domain"), (nothing if declared is None else declared, "_declared"), (nothing if suffix is None else suffix, "_suffix"))), F.col(f"`{text}`").alias("_text"))
    if not k:
        found = F.struct(F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept"))
        return base.select("_row.*", found.alias("langid"))
    scored = base.withColumn("_score", _scorer(rows.sparkSession, model, html)(F.col("_text")))
    # A text without trigrams has equal likelihoods and counts for no table.
    own = cut(scored.select("_host", "_domain", "_declared", "_suffix", _normal(F.col("_score.ll")).alias("_post"), F.col("_score.n").alias("_n")).where("_n > 0"))
    totals = own.agg(*(F.sum(F.col("_post")[i]) for i in range(k))).first()
    totals = np.array([x or 0.0 for x in totals])
    overall = (totals + 1.0) / (totals.sum() + k)
    prior = F.array(*(F.lit(float(x)) for x in overall))

    out = scored.withColumn("_post", F.when(F.col("_score.n") > 0, _normal(F.col("_score.ll"))).otherwise(F.array(*[F.lit(0.0)] * k)))
    mass = F.when(F.col("_score.n") > 0, 1.0).otherwise(0.0)
    zeros = F.array(*[F.lit(0.0)] * k)
    used = [key for key, column in (("_host", host), ("_domain", domain), ("_declared", declared), ("_suffix", suffix)) if column is not None]
    for key in used:
        sums = cut(_sums(own, key, k, f"{key}_n"))
        out = out.join(F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums, key, "left")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def others(key: str) -> Column:
        """Counts of a key without this row's own share."""
        return F.zip_with(F.coalesce(f"{key}_n", zeros), F.col("_post"), lambda x, y: F.greatest(x - y, F.lit(0.0))) if key in used else zeros

    def smoothed(counts: Column, towards: Column, weight: float) -> Column:
        return F.zip_with(counts, towards, lambda x, p: (x + F.lit(weight) * p) / (total(counts) + F.lit(weight)))

    host_prior = smoothed(others("_host"), smoothed(others("_domain"), prior, DOMAIN_WEIGHT), HOST_WEIGHT) if {"_host", "_domain"} & set(used) else prior
    evidence = _plus(F.col("_score.ll"), F.transform(host_prior, lambda p: F.log(p)))
    for key in ("_declared", "_suffix"):
        if key in used:  # P(value | language), smoothed towards the value's share of all rows
            counts = others(key)
            share = (total(counts) + 1.0) / (float(totals.sum()) + 1.0)
            likely = F.transform(F.zip_with(counts, F.array(*(F.lit(float(x)) for x in totals)), lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda s: F.log((s["x"] + F.lit(VALUE_WEIGHT) * share) / (s["n"] + F.lit(VALUE_WEIGHT))))
            evidence = _plus(evidence, F.when(F.col(key).isNotNull(), likely).otherwise(zeros))
    out = out.select("_row", "_score", mass.alias("_mass"), _normal(evidence).alias("_final"))
    best = F.array_max("_final")
    names = F.array(*(F.lit(x) for x in model.languages))
    kept = (F.col("_score.n") > 0) & (best >= least)
    language = F.when(kept, F.element_at(names, F.array_position("_final", best).cast("int"))).otherwise("und")
    return out.select("_row.*", F.struct(language.alias("language"), best.alias("posterior"), F.col("_score.n").alias("n_trigrams"), kept.alias("kept")).alias("langid"))


def identify_documents(docs: DataFrame, model: TextModel, text: str = "text", source: str = "source", least: float = LEAST) -> DataFrame:
    """Documents have no address or markup: their text, and their source as the host."""
    return identify(docs, model, text, host=F.col(f"`{source}`"), least=least)


def identify_pages(pages: DataFrame, model: TextModel, url: str = "url", html: str = "html", least: float = LEAST) -> DataFrame:
    address = F.col(f"`{url}`")
    return identify(pages, model, html, html=True, host=host_of(address), domain=domain_of(host_of(address)), declared=declared_language(F.col(f"`{html}`")), suffix=suffix_of(address), least=least)
