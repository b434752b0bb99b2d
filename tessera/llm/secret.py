"""Operator 3: secrets in texts, by fixed patterns and by character Markov models.

Three patterns give the base spans. Besides them, every run of 16 or more characters of
the usual secret alphabets outside base spans is scored by two first-order Markov models over
characters, one of random strings and one of ordinary identifiers: the sum of log-likelihood
ratios of its transitions. A run that scores at least THRESHOLD in all and RATE a character
is a span of the kind markov. So is, in other runs, every stretch that does: a stretch begins
where the sum turns positive and ends at its peak, once the sum is used up or THRESHOLD below
the peak; it is widened to the / _ - = around it.

The models are transition counts with add-one smoothing, trained from labelled samples
(value, label 1 random / 0 ordinary) by one grouped aggregation; 2 x 67 x 67 numbers at
most reach the driver. labelled_samples() makes them: random strings are digests in the
usual encodings, ordinary identifiers are words of at most TRAIN_DOCS texts (those with
the smallest hash of their key), also in capitals and joined as code joins them. TRAIN_DOCS
is the only bound; every text is searched whole.

All columns are built-in functions; nothing is shuffled but the training counts.

Cases: null text counts as empty and has no spans; ties of the sampling hash are decided
by the key; repeated rows each get their row; extra columns are not read by find_secrets
and kept by redact_secrets; an empty table trains on random strings alone and gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample
from tessera.llm.spans import find_spans, replaced, shown

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX_24 = r"(?<![0-9a-f])[0-9a-f]{24,}"  # the matches of [0-9a-f]+ that are long enough
KINDS = ["assign", "access", "hex", "markov"]

RUN = r"[A-Za-z0-9+/_=-]{16,}"
LEAST = 16
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
TRAIN_DOCS = 400
RANDOM = 4000
THRESHOLD, RATE = 14.0, 0.6


def labelled_samples(df: DataFrame, key: str, text: str, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """(value, label): random strings (1) and ordinary identifiers of the texts (0)."""
    ids = df.sparkSession.range(RANDOM).select(F.col("id").cast("string").alias("s"))
    raw = F.unhex(F.sha2(F.col("s"), 256))
    kinds = F.array(
        F.sha1(F.col("s")),
        F.upper(F.sha1(F.concat(F.lit("u"), "s"))),
        F.base64(raw),
        F.translate(F.base64(raw), "+/=", ""),
        F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("w"), "s"), 256))), "+/=", "-_"),
    )
    random = ids.select(F.explode(kinds).alias("value"), F.lit(1).alias("label"))
    some = bounded_sample(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")), key, max_docs)
    # what the patterns find is not ordinary
    plain = F.regexp_replace(F.regexp_replace("_t", ASSIGN, " "), r"[0-9a-f]{24,}|AKIA[A-Z0-9]+", " ")
    words = some.select(F.regexp_extract_all(plain, F.lit(r"[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    forms = F.transform(
        "w",
        lambda x, i: F.array(
            x,
            F.upper(x),
            F.concat(F.lower(x), F.initcap(F.coalesce(F.get("w", i + 1), F.lit("")))),
            F.concat_ws("_", F.lower(x), F.lower(F.get("w", i + 1))),
            F.concat_ws("_", F.upper(x), F.upper(F.get("w", i + 1)), F.upper(F.get("w", i + 2))),
            F.concat_ws("-", F.lower(x), F.lower(F.get("w", i + 1))),
            F.concat_ws("/", F.lower(x), F.lower(F.get("w", i + 1)), F.lower(F.get("w", i + 2))),
        ),
    )
    ordinary = words.select(F.explode(F.flatten(forms)).alias("value"), F.lit(0).alias("label"))
    return random.unionByName(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, at position a * len(ALPHABET) + b."""
    n = len(ALPHABET)
    steps = samples.select(
        "label", F.explode(F.regexp_extract_all("value", F.lit(r"(?=(.{2}))"), F.lit(1))).alias("pair")
    )
    counts = {(r.label, r.pair): r.n for r in steps.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratios = []
    row = {
        (label, a): sum(counts.get((label, a + b), 0) + 1 for b in ALPHABET) for label in (0, 1) for a in ALPHABET
    }
    for a in ALPHABET:
        for b in ALPHABET:
            p = [(counts.get((label, a + b), 0) + 1) / row[label, a] for label in (0, 1)]
            ratios.append(round(math.log(p[1] / p[0]), 4))
    assert len(ratios) == n * n
    return ratios


def score(value: Column, ratios: list[float]) -> Column:
    """The sum of log-likelihood ratios of a string's transitions."""
    n = len(ALPHABET)
    table = F.lit(ratios) if ratios else F.array()
    chars = F.split(value, "")
    where = F.transform(chars, lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).cast("double").alias("sum"))
    return F.aggregate(
        where,
        start,
        lambda acc, k: F.struct(
            k.alias("last"),
            (acc["sum"] + F.when((acc["last"] < 0) | (k < 0), F.lit(0.0)).otherwise(F.get(table, acc["last"] * n + k))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )


def stretches(run: Column, ratios: list[float]) -> Column:
    """Spans (as in find_spans, of kind 3) of a run's random stretches, or of the whole run."""
    n = len(ALPHABET)
    table = F.lit(ratios)
    where = F.transform(F.split(run["value"], ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(
        F.lit(-1).alias("last"), F.lit(-1).alias("i"), F.lit(0.0).alias("all"), F.lit(0.0).alias("sum"),
        F.lit(0).alias("a"), F.lit(0.0).alias("peak"), F.lit(0).alias("b"), none.alias("found"),
    )

    def closed(acc: Column) -> Column:
        good = (acc["peak"] >= THRESHOLD) & (acc["peak"] >= RATE * (acc["b"] - acc["a"]))
        return F.when(good, F.array_append(acc["found"], F.struct(acc["a"].alias("a"), acc["b"].alias("b")))).otherwise(acc["found"])

    def step(acc: Column, k: Column) -> Column:
        i = acc["i"] + 1
        r = F.when((acc["last"] < 0) | (k < 0), F.lit(0.0)).otherwise(F.get(table, acc["last"] * n + k)).cast("double")
        total = acc["sum"] + r
        over = (total <= 0) | (acc["peak"] - total > THRESHOLD)
        top = ~over & (total > acc["peak"])
        return F.struct(
            k.alias("last"), i.alias("i"), (acc["all"] + r).alias("all"), F.when(over, F.lit(0.0)).otherwise(total).alias("sum"),
            F.when(over, i).otherwise(acc["a"]).alias("a"),
            F.when(over, F.lit(0.0)).when(top, total).otherwise(acc["peak"]).alias("peak"),
            F.when(over, i).when(top, i + 1).otherwise(acc["b"]).alias("b"),
            F.when(over, closed(acc)).otherwise(acc["found"]).alias("found"),
        )

    size = run["end"] - run["start"]

    def done(acc: Column) -> Column:
        whole = (acc["all"] >= THRESHOLD) & (acc["all"] >= RATE * size)
        return F.when(whole, F.array(F.struct(F.lit(0).alias("a"), size.alias("b")))).otherwise(closed(acc))

    def widened(x: Column) -> Column:
        before = F.regexp_extract(F.substring(run["value"], F.lit(1), x["a"]), r"[^/_=-]*$", 0)
        after = F.regexp_extract(F.substring(run["value"], x["b"] + 1, size), r"^[^/_=-]*", 0)
        a, b = x["a"] - F.length(before), x["b"] + F.length(after)
        value = F.substring(run["value"], a + 1, b - a)
        return F.struct((run["start"] + a).alias("start"), F.lit(3).alias("kind"), (run["start"] + b).alias("end"), value.alias("value"))

    found = F.array_distinct(F.transform(F.aggregate(where, start, step, done), widened))
    # digits alone are numbers, not secrets
    return F.filter(found, lambda s: s["value"].rlike("[A-Za-z]") & (s["end"] - s["start"] >= LEAST))


def without(text: Column, spans: Column) -> Column:
    """The text with blanks in the place of spans (sorted by start)."""
    blank = lambda n: F.repeat(F.lit(" "), n)
    return replaced(text, spans, lambda s: blank(s["end"] - s["start"]), blank)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    assign = F.filter(
        find_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6
    )
    access = F.filter(find_spans(text, ACCESS, 1), lambda s: s["end"] - s["start"] >= 20)
    hexes = find_spans(text, HEX_24, 2)
    return F.concat(assign, access, hexes)


def find_secrets(df: DataFrame, text: str, ratios: list[float], base: str = "base", spans: str = "spans") -> DataFrame:
    """df with the array columns base and spans (all of them), sorted by start and kind.

    They replace columns of the same names.
    """
    t, runs = "__tessera_text", "__tessera_runs"
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(base, F.array_sort(base_spans(F.col(t))))
    out = out.withColumn(t, without(F.col(t), F.col(base)))
    out = out.withColumn(runs, find_spans(F.col(t), RUN, 3))
    random = F.flatten(F.transform(runs, lambda s: stretches(s, ratios)))
    return out.withColumn(spans, F.array_sort(F.concat(base, random))).drop(runs, t)


def model(df: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    return train(labelled_samples(df, key, text))


def secret_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_markov; one row per row of df."""
    found = find_secrets(df.select(key, text), text, model(df, key, text))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        key,
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(shown(F.col("base"), KINDS), 256).alias("base_sha256"),
        shown(F.col("spans"), KINDS).alias("spans"),
        of(3).alias("n_markov"),
    )


def redact_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span replaced by a mark; null texts stay null."""
    base, spans = "__tessera_base", "__tessera_spans"
    found = find_secrets(df, text, model(df, key, text), base, spans)
    clean = replaced(F.col(text), F.col(spans), lambda s: F.lit(mark))
    return found.withColumn(text, clean).select(*df.columns)
