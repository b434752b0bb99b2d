"""Native columns over matches of a regular expression: where they are, and text without them.

Positions count code points, ends are exclusive. Spark's functions give the matches of a
pattern and the text between them; lengths added up give positions. Folds run over chunks of
CHUNK matches, so that neither a growing array nor a growing text is copied for every match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
CHUNK = 64


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _chunks(items: Column) -> Column:
    n = F.ceil(F.size(items) / CHUNK).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))).otherwise(
        F.slice(F.array(items), 1, 0)
    )


def folded(items: Column, kind: str, step, made=None) -> Column:
    """(at, out): a running number, from 0 on, and an array of what step(at, item) gives.

    step returns the next number and one element of type `kind`, or null for none. made turns
    a chunk's elements, with the number before it, into that chunk's one result.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(out.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], out)).alias("out"))

    def chunk(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return let(done, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], made(acc["at"], r) if made else r["out"]).alias("out")))

    empty = F.array().cast("array<string>" if made else f"array<array<{kind}>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return let(items, lambda xs: F.aggregate(_chunks(xs), start, chunk))


def find_spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches: array of (start, kind, end, value); none: empty.

    Texts without a match cost one pass of the pattern.
    """
    both = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("before")
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["before"])
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        # the text after the last match comes with no match
        return F.coalesce(end, at), F.when(end.isNotNull(), one)

    found = F.flatten(folded(both, SPAN.removeprefix("array<")[:-1], step)["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def shown(spans: Column, names: list[str]) -> Column:
    """Spans as kind:start:end, joined by commas in their order."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def replaced(text: Column, spans: Column, new, over=None) -> Column:
    """The text with each span (sorted by start) replaced by new(span).

    Of spans that overlap, the one that begins first is replaced whole; of the others, what
    sticks out becomes over(length), which is nothing by default.
    """
    piece = f"struct<a:int,b:int,fresh:boolean,span:{SPAN.removeprefix('array<')[:-1]}>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        start = F.greatest(s["start"], at)
        one = F.struct(at.alias("a"), start.alias("b"), (s["start"] >= at).alias("fresh"), s.alias("span"))
        return F.greatest(at, s["end"]), F.when(s["end"] > at, one)

    def made(before: Column, chunk: Column) -> Column:
        # one cut through the whole text for a chunk, and short ones for its pieces
        part = F.substring(text, before + 1, chunk["at"] - before)

        def text_of(x: Column, cut: Column) -> Column:
            rest = over(x["span"]["end"] - x["b"]) if over else F.lit("")
            return F.concat(F.substring(cut, x["a"] - before + 1, x["b"] - x["a"]), F.when(x["fresh"], new(x["span"])).otherwise(rest))

        return let(part, lambda cut: F.array_join(F.transform(chunk["out"], lambda x: text_of(x, cut)), ""))

    done = let(folded(spans, piece, step, made), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(text, r["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
