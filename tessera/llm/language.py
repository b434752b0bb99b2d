"""Operator 6: language by Bayesian fusion of evidence.

log P(language | row) is, up to a constant,
    log prior of the host + log P(text) + log P(declared language) + log P(address suffix),
each given the language. Text likelihoods are hashed byte-trigram models, trained by a
grouped count over at most PER_LANGUAGE labelled rows of each language (the documented bound;
those with the smallest hash of their key), each of which is read whole and weighs as much as
LEARNT trigrams at most. Everything else covers all rows: the text's own
posterior is summed by host, registered domain, declared language and suffix; a host's prior
is shrunk to its domain's, which is shrunk to the overall one (SHRINK pseudo-rows each), and
so are the tables of declared languages and suffixes. A row's own posterior is taken out of
all these sums before they speak about that row.

Trigrams of a text depend on each other, so its likelihood is tempered: it counts as that of
`full_text` trigrams at most, by their mean over the whole text.

A row is rejected if no language fits its text, or if none reaches SURE of the posterior. A
language fits if the mean log-likelihood reaches a limit that is fitted on the labelled rows:
models of one half of them score the other half, and the limit lies LIMIT of the way from
what a language's own texts reach (the median) to what texts of other languages reach, or of
random bytes where there is one language; short texts get three standard errors of slack.

Scores are written once (a few numbers a row); the rest are grouped sums and joins of
those, which adaptive execution splits where a host or a declared language is very common.

Cases: null text counts as empty, which is rejected; null host, declared language or
suffix says nothing (it is a value like any other, shrunk to the overall prior); repeated
rows each count; ties of the posterior go to the language first in the alphabet; extra
columns are ignored; an empty table gives no rows, and without labelled rows every row is
rejected; very long texts are read whole, markup in time linear in its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written
from tessera.llm.spans import let

BUCKETS = 1 << 14
PER_LANGUAGE = 1000
SHRINK = 20.0
FULL_TEXT = 60
LEARNT = 2000  # trigrams that a labelled text counts as at most, lest one long text be its language
SURE = 0.6
LIMIT = 0.75
_HIDDEN = re.compile(r"(?i)<(script|style)\b").match
_CLOSED = {x: re.compile(rf"(?i)</{x}\s*>").search for x in ("script", "style")}


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one after another, and how many each has."""
    size = np.array([max(0, len(t) - 2) for t in texts])
    raw = np.frombuffer(b"".join(t for t in texts if len(t) > 2), np.uint8).astype(np.uint32)
    if not len(raw):
        return np.zeros(0, np.int64), size
    codes = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    codes = ((codes * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts if len(t) > 2])[:-1]
    keep = np.ones(len(codes), bool)  # none reaches from a text into the next
    keep[ends - 1] = False
    keep[ends - 2] = False
    return codes[keep], size


def visible(markup: str) -> str:
    """What stands between tags, without scripts, styles and comments; each leaves a blank.

    What is never closed is a tag up to the next >, or text if there is none. No end is
    looked for again where there was none before, so this takes linear time.
    """
    out, at, never = [], 0, set()

    def end(kind: str, found: Callable[[], int]) -> int:
        if kind in never:
            return -1
        stop = found()
        if stop < 0:
            never.add(kind)
        return stop

    while (i := markup.find("<", at)) >= 0:
        stop = -1
        if markup.startswith("<!--", i):
            stop = end("-->", lambda: markup.find("-->", i + 4)) + 3  # noqa: B023
            stop = -1 if stop < 3 else stop
        elif m := _HIDDEN(markup, i):
            name = m[1].lower()
            stop = end(name, lambda: c.end() if (c := _CLOSED[name](markup, i)) else -1)  # noqa: B023
        if stop < 0:
            stop = markup.find(">", i) + 1
        if not stop:
            break
        out.append(markup[at:i])
        at = stop
    return " ".join([*out, markup[at:]])


def _plain(value: str | None, markup: bool) -> bytes:
    value = value or ""
    if markup:
        value = html.unescape(visible(value))
    return value.lower().encode("utf-8", "replace")


@dataclass
class Model:
    """langs in order; logs: log-probabilities of the buckets; limit and slack: of the mean
    log-likelihood from which a language fits, at infinite length and by 1 / sqrt(length)."""

    langs: list[str]
    logs: np.ndarray
    limit: np.ndarray
    slack: np.ndarray


def labelled_sample(labelled: DataFrame, key: str, text: str, lang: str, rows: int = PER_LANGUAGE) -> DataFrame:
    """text, lang and half (0 or 1) of at most `rows` rows of each language.

    A threshold on the hash, from the number of a language's rows, leaves little more than
    `rows` of them before any are sorted. The table of those numbers is written, so Spark
    knows its size: small enough to broadcast, no text is shuffled before the threshold.
    """
    top = 1 << 40
    known = labelled.where(F.col(lang).isNotNull())
    many = known.groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    many = written(many, "languages")
    hashed = known.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(key)), F.lit(top)).alias("_hash"))
    some = hashed.join(many, hashed["lang"] == many["_lang"])
    some = some.where(F.col("_hash") < F.lit(top) * F.least(F.lit(1.0), (1.3 * rows + 100) / F.col("_n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "_key"))
    return some.withColumn("_rank", rank).where(F.col("_rank") <= rows).select("text", "lang", (F.col("_rank") % 2).cast("long").alias("half"))


def train(labelled: DataFrame, key: str, text: str, lang: str, rows: int = PER_LANGUAGE) -> Model:
    """The model of a bounded sample of labelled rows."""
    some = written(labelled_sample(labelled, key, text, lang, rows), "labelled")

    def parts(batches):  # few texts at a time: a trigram takes some fifty bytes of memory
        return (b.slice(at, 64) for b in batches for at in range(0, len(b), 64))

    def count(batches):
        for batch in parts(batches):
            codes, size = _codes([_plain(t, False) for t in batch.column(0).to_pylist()])
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            known = sorted(set(names))
            of = np.repeat([known.index(n) for n in names], size).astype(np.int64)
            weight = np.repeat(np.minimum(1.0, LEARNT / np.maximum(size, 1)), size)
            found, back = np.unique(of * BUCKETS + codes, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([known[i][0] for i in found // BUCKETS], pa.string()),
                    pa.array([known[i][1] for i in found // BUCKETS], pa.int64()),
                    pa.array(found % BUCKETS, pa.int64()),
                    pa.array(np.bincount(back, weights=weight, minlength=len(found)), pa.float64()),
                ],
                names=["lang", "half", "bucket", "n"],
            )

    counts = some.mapInArrow(count, "lang string, half long, bucket long, n double").groupBy("lang", "half", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow().to_pydict()  # of the sample's buckets alone
    langs = sorted(set(got["lang"]))
    at = {x: i for i, x in enumerate(langs)}
    table = np.zeros((2, len(langs), BUCKETS))
    np.add.at(table, (got["half"], [at[x] for x in got["lang"]], got["bucket"]), got["n"])

    def logs(counted: np.ndarray) -> np.ndarray:
        counted = counted + 0.5
        return np.log(counted / counted.sum(axis=-1, keepdims=True)).astype(np.float32)

    whole = logs(table.sum(axis=0))
    halves = logs(table)

    def held_out(batches):
        for batch in parts(batches):
            codes, size = _codes([_plain(t, False) for t in batch.column(0).to_pylist()])
            means = [_means(h, codes, size) for h in halves]
            half = np.array(batch.column(2).to_pylist(), np.int64)
            seen = np.where(half == 0, means[1], means[0]).T if len(langs) else np.zeros((len(size), 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(size, pa.int64()), pa.array(seen.tolist(), pa.list_(pa.float64()))], names=["lang", "size", "means"]
            )

    seen = some.mapInArrow(held_out, "lang string, size long, means array<double>").where(F.col("size") >= FULL_TEXT)
    seen = seen.toArrow().to_pydict() if langs else {"lang": [], "means": []}  # a row of numbers for each of the sample
    dropped(some)
    means = np.array(seen["means"], float).reshape(len(seen["lang"]), len(langs))
    of = np.array([at.get(x, -1) for x in seen["lang"]], np.int64)
    floor = np.log(1 / BUCKETS)
    limit = np.full(len(langs), floor)
    for i in range(len(langs)):
        own, others = means[of == i, i], means[of != i, i]
        if len(own):
            low = float(np.median(others)) if len(others) else floor
            limit[i] = (1 - LIMIT) * float(np.median(own)) + LIMIT * low
    p = np.exp(whole.astype(float))
    spread = np.sqrt(np.maximum((p * whole**2).sum(axis=1) - (p * whole).sum(axis=1) ** 2, 0))
    return Model(langs, whole, limit, 3 * spread)


def _means(logs: np.ndarray, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean log-probability of each text's trigrams, a row for each language."""
    out = np.zeros((len(logs), len(size)))
    full = np.flatnonzero(size)
    if len(full):
        begins = (np.cumsum(size) - size)[full]
        for i, row in enumerate(logs):
            out[i, full] = np.add.reduceat(row[codes].astype(np.float64), begins) / size[full]
    return out


def score_texts(
    df: DataFrame, keys: list[str], text: str, others: list[str], model: Model, markup: bool = False, full_text: int = FULL_TEXT
) -> DataFrame:
    """keys and others, with logs (array of the tempered text log-likelihoods) and fits."""
    columns = [*keys, *others]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def work(batches):
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                codes, size = _codes([_plain(t, markup) for t in part.column(len(columns)).to_pylist()])
                means = _means(model.logs, codes, size)
                limit = model.limit[:, None] - model.slack[:, None] / np.sqrt(np.maximum(size, 1))[None, :]
                fits = (means >= limit).any(axis=0) & (size > 0)
                logs = means * np.minimum(size, full_text)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i) for i in range(len(columns))],
                        pa.array(logs.T.tolist(), pa.list_(pa.float64())),
                        pa.array(fits, pa.bool_()),
                    ],
                    names=[*columns, "logs", "fits"],
                )

    return df.select(*columns, text).mapInArrow(work, f"{schema}, logs array<double>, fits boolean")


def fuse(scored: DataFrame, langs: list[str], host: str, domain: str, declared: str, suffix: str) -> DataFrame:
    """scored (from score_texts), with identified, confidence and accepted."""
    n = len(langs)
    if not n:
        return scored.select(
            "*", F.lit(None).cast("string").alias("identified"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted")
        ).drop("logs", "fits")
    top = F.array_max("logs")
    weight = F.transform("logs", lambda x: F.exp(x - top))
    mass = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    own = scored.withColumn("_w", weight).withColumn("_m", mass)
    share = F.transform("_w", lambda w: F.when(F.col("fits"), w / F.col("_m")).otherwise(0.0))
    own = written(own.withColumn("_p", share).drop("_w", "_m"), "language")
    sums = [F.sum(F.get("_p", F.lit(i))).alias(f"_s{i}") for i in range(n)]
    every = [f"_s{i}" for i in range(n)]
    again = [F.sum(c).alias(c) for c in every]

    def together(df: DataFrame, keys: dict[str, str], out: str) -> DataFrame:
        return df.select(*[F.col(c).alias(k) for c, k in keys.items()], F.array(*every).alias(out))

    whole = own.agg(*sums).first()
    whole = F.array(*[F.lit(float(whole[c] or 0.0)) for c in every])
    joint = own.groupBy(domain, host).agg(*sums)
    by_domain = together(joint.groupBy(domain).agg(*again), {domain: "_d0"}, "_domain")
    hosts = together(joint, {domain: "_d", host: "_h"}, "_host").join(by_domain, F.col("_d").eqNullSafe(F.col("_d0")), "left").drop("_d0")
    hosts = written(hosts, "hosts")
    joined = own.join(hosts, F.col(domain).eqNullSafe(F.col("_d")) & F.col(host).eqNullSafe(F.col("_h")), "left")
    for column, out in ((declared, "_declared"), (suffix, "_suffix")):
        table = written(together(own.groupBy(column).agg(*sums), {column: f"_k{out}"}, out), out.strip("_"))
        joined = joined.join(table, F.col(column).eqNullSafe(F.col(f"_k{out}")), "left")

    # a row's own share is taken out of every sum (to no less than zero, against rounding)
    rest = lambda c: F.transform(c, lambda x, i: F.greatest(x - F.get("_p", i), F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def shrunk(shares: Column, prior: Column) -> Column:
        return let(total(shares), lambda t: F.transform(shares, lambda x, i: (x + SHRINK * F.get(prior, i)) / (t + SHRINK)))

    for c, of in (("_all", whole), *((x, F.col(x)) for x in ("_domain", "_host", "_declared", "_suffix"))):
        joined = joined.withColumn(c, rest(of))
    joined = joined.withColumn("_all", let(total(F.col("_all")), lambda t: F.transform("_all", lambda x: (x + 1) / (t + n))))
    joined = joined.withColumn("_domain", shrunk(F.col("_domain"), F.col("_all")))
    for c, prior in (("_host", "_domain"), ("_declared", "_all"), ("_suffix", "_all")):
        joined = joined.withColumn(c, shrunk(F.col(c), F.col(prior)))
    # P(value | language) is P(language | value) over the language's share, but for a constant
    logs = F.transform(
        "logs", lambda x, i: x + F.log(F.get("_host", i)) + F.log(F.get("_declared", i) * F.get("_suffix", i) / F.pow(F.get("_all", i), F.lit(2)))
    )
    joined = joined.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    best = F.array_position("_logs", F.col("_top")).cast("int")
    sure = 1 / F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    joined = joined.withColumn("identified", F.get(F.array(*[F.lit(x) for x in langs]), best - 1)).withColumn("confidence", sure)
    joined = joined.withColumn("accepted", F.col("fits") & (F.col("confidence") >= SURE))
    return joined.select(*[c for c in scored.columns if c not in ("logs", "fits")], "identified", "confidence", "accepted")


def page_evidence(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """pages with host, domain (its last two labels), suffix (its last) and declared language."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    lang = F.regexp_extract(F.coalesce(F.col(markup), F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    return pages.select(
        "*",
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"),
        F.lower(lang).alias("declared"),
    )


def identify_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", model: Model | None = None
) -> DataFrame:
    """key, identified, confidence, accepted of documents: lang is declared, source the host."""
    model = model or train(docs, key, text, lang)
    rows = docs.select(
        key, text, F.col(lang).alias("declared"), F.col(source).alias("host"),
        F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"\.([^.]+)$", 1).alias("suffix"),
    )
    scored = score_texts(rows, [key], text, ["host", "domain", "declared", "suffix"], model)
    return fuse(scored, model.langs, "host", "domain", "declared", "suffix").select(key, "declared", "identified", "confidence", "accepted")


def identify_pages(pages: DataFrame, model: Model, key: str = "page_id") -> DataFrame:
    """The same of pages with the columns url and html."""
    rows = page_evidence(pages.select(key, "url", "html"))
    scored = score_texts(rows, [key], "html", ["host", "domain", "declared", "suffix"], model, markup=True)
    return fuse(scored, model.langs, "host", "domain", "declared", "suffix").select(key, "declared", "identified", "confidence", "accepted")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without those that the fusion rejects."""
    # written first: a filter over the fusion would repeat its expressions in each other; and
    # of the few keys that it leaves, Spark then knows the size
    found = written(identify_documents(docs, key, text, lang, source).select(key, "accepted"), "accepted")
    gone = written(found.where("not accepted").select(key).distinct(), "rejected")
    return docs.join(gone, key, "left_anti")
