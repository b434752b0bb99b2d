"""Operator 4: quality rules whose thresholds come from mergeable quantile sketches.

Per text, built-in functions count words and what speaks against them. Texts that fail the
base rules go. Of the rest, four ratios are sketched (KLL) per language and source by one
grouped aggregation; sketches of sources merge into one per language and one of all, which
stand in for groups of under MIN_ROWS rows. A fence lies WIDE spreads of the group beyond its
quartile: the interquartile range, or the way from the quartile to the tail decile where that
is longer. Only where both are zero, a feature's resolution stands in. A text outside any
fence isn't kept.
The fences are joined back by language and source, null matching null.

Features are written once (a few numbers a row) and read twice; the sketches are what is
shuffled, not rows. KLL draws random bits above SKETCH_K values, so fences may differ
between runs within the sketch's rank error.

Cases: null text has no words and fails; an empty or blank text likewise; a null language
or source is a group of its own; ties at a fence are kept; repeated rows count each time;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_ROWS = 100
SKETCH_K = 400
WIDE = 6.0
#: ratio: (numerator, denominator, distance of a fence where the spread is zero, fence below too)
RATIOS = {
    "mean_word": ("word_chars", "n_words", 0.25, True),
    "symbols_a_word": ("n_symbols", "n_words", 0.1, False),
    "dup_lines_a_line": ("n_dup_lines", "n_lines", 0.1, False),
    "repeats_a_word": ("n_repeat_words", "n_words", 0.02, False),
}


def repeat_words(words: str) -> Column:
    """How many words of an array column lie in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes.
    """
    w = F.col(words)
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def count(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(
                s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        covered = F.aggregate(
            _let(placed, places),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                (p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n")
            ),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(F.lit(0))

    return _let(hashes, count).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def features(df: DataFrame, key: str, text: str, groups: list[str]) -> DataFrame:
    """key, the columns of groups, and the counts of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.select(key, *groups, t.alias("_t"))
    out = out.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    out = out.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)))
    gone = lambda chars: F.length(F.translate("_t", chars, ""))
    return out.select(
        key,
        *groups,
        F.size("_w").cast("long").alias("n_words"),
        gone(SPACES).cast("long").alias("word_chars"),
        (F.length("_t") - gone(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words("_w").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fences(measured: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: by, and for each ratio the lowest and highest value that stays.

    measured has the ratios. by: from the coarser to the finer column.
    """
    names = list(RATIOS)
    sketch = lambda n: F.kll_sketch_agg_double(F.col(n), F.lit(SKETCH_K)).alias(n)
    merge = lambda n: F.kll_merge_agg_double(F.col(n), F.lit(SKETCH_K)).alias(n)
    fine = written(
        measured.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[sketch(n) for n in names]), "sketches"
    )
    coarse = fine.groupBy(by[0]).agg(F.sum("_n").alias("_n1"), *[merge(n) for n in names])
    coarse = coarse.select(F.col(by[0]).alias("_g"), "_n1", *[F.col(n).alias(f"{n}_1") for n in names])
    whole = fine.agg(*[merge(n) for n in names]).select(*[F.col(n).alias(f"{n}_0") for n in names])
    # whole is one row, an aggregate without keys
    joined = fine.join(coarse, fine[by[0]].eqNullSafe(F.col("_g")), "left").join(F.broadcast(whole), F.lit(True))
    out = [F.col(c) for c in by]
    for n in names:
        _, _, least, below = RATIOS[n]
        s = F.when(F.col("_n") >= MIN_ROWS, F.col(n)).when(F.col("_n1") >= MIN_ROWS, F.col(f"{n}_1")).otherwise(F.col(f"{n}_0"))
        at = lambda q: F.kll_sketch_get_quantile_double(s, F.lit(q))  # noqa: B023, E731
        wide = lambda tail: F.when(tail > 0, tail * WIDE).otherwise(F.lit(least))  # noqa: B023, E731
        low, high = at(0.25), at(0.75)
        up, down = (wide(F.greatest(high - low, x)) for x in (at(0.9) - high, low - at(0.1)))
        out += [(high + up).alias(f"{n}_high"), ((low - down) if below else F.lit(float("-inf"))).alias(f"{n}_low")]
    return written(joined.select(*out), "fences")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of df: key, counts, base_failed, kept."""
    found = features(df, key, text, list(by)).withColumn("base_failed", base_failed())
    for n, (a, b, _, _) in RATIOS.items():
        found = found.withColumn(n, F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)))
    found = written(found, "features")
    limits = fences(found.where("not base_failed"), list(by))
    limits = limits.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in limits.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    inside = F.lit(True)
    for n in RATIOS:
        inside = inside & F.coalesce(F.col(n).between(F.col(f"{n}_low"), F.col(f"{n}_high")), F.lit(True))
    kept = ~F.col("base_failed") & inside
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.join(limits, on, "left").select(key, *counts, "base_failed", kept.alias("kept"), *RATIOS)
