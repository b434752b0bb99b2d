"""Operator 7: fuzzy deduplication of lines by MinHash.

Lines are parts of texts between line feeds; lines without a non-space are left alone.
The signature of a line is a MinHash over its shingles of NARROW characters, the same set that
verification compares: BANDS bands of ROWS values, so lines at the threshold meet with a
probability of 1 - (1 - THRESHOLD^ROWS)^BANDS = 0.974, and of 0.997 at 0.85. The range
of hashes is cut into BANDS classes, and the ROWS smallest hashes of a class are a band. Lines
of fewer than MANY shingles sign each in several copies, with a hash of its own each, so that
classes hold enough; sizes next to where the number of copies changes are signed in both ways.

A bucket (lines with one band) is named by its smallest hash, its leader; whoever shares a
bucket shares its leader, and all members of a leader's group meet, in blocks, as in
jaccard.py, by exact Jaccard similarity (THRESHOLD) of their sets. A task folds its members into
clusters and gives each line's cluster, so rows grow with lines, not pairs. Distributed
union-find joins those to components, of which the first line (by key, then line number) stays.

All of it is built-in functions; band_keys() is the signature in plain Python, for tests.
Shuffled are band hashes, texts of candidate lines and, once, texts of documents. Tables that
nothing reads any more are removed on the way. Bitmaps that are broadcast keep out of shuffles
what has no partner; common.MOST_BITS bounds them, and beyond it they let more rows pass, never
fewer. Lines are told apart by 128 bits of hash.

Cases: null text stays null and an empty text stays empty; rows with a null key keep their
text; rows that repeat a key count as one document's lines; ties go to the smaller key,
then line number; extra columns are kept, but for n_lines and n_dropped, which are replaced;
an empty table gives no rows; very long lines are compared whole.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, dropped, only_marked, sweep, written
from tessera.llm.jaccard import BLOCK, BLOCK_TEXTS, dealt_members

NARROW = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 6
MANY = 100  # shingles from which a line signs each once
_MASK = (1 << 64) - 1
#: what cuts the range of hashes into BANDS classes
_BOUNDS = [c * (1 << 64) // BANDS - (1 << 63) + 1 for c in range(BANDS)] + [(1 << 63) - 1]


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, no, line of every line with a non-space."""
    out = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    return out.where(F.col("line").rlike(r"\S"))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), F.col("line")).alias("g")]


def _shingles(line: str) -> str:
    """The distinct shingle hashes of a text; one of less than NARROW characters is one shingle.

    The text in UTF-32 is bound to a lambda variable, so it is encoded once, and a shingle
    is found by its place. array_distinct stays outside, where it is compiled.
    """
    return f"""array_distinct(get(transform(array(encode({line}, 'UTF-32')), b -> transform(
        sequence(1, cast(greatest(length(b) - {4 * NARROW - 1}, 1) as int), 4), i -> xxhash64(substring(b, i, {4 * NARROW})))), 0))"""


def _ways(n: int) -> list[int]:
    """How many copies a line signs its n shingles in: one or two numbers."""
    most = 1
    while n * most < MANY:
        most *= 2
    return [most, most // 2] if most > 1 and n * most // 2 >= MANY * THRESHOLD else [most]


def signed_lines(lines: DataFrame) -> DataFrame:
    """key, no, h, g, size (in characters), first and bands of lines with key, no and line; no shuffle.

    A line that is signed in two ways has two rows, of which one is first.
    """
    names = ["key", "no", "h", "g", "size"]
    bounds = f"array({', '.join(f'{x}L' for x in _BOUNDS)})"
    hashed = lines.select("key", "no", *_hashes(), F.length("line").alias("size"), F.expr(f"sort_array(concat({_shingles('line')}, {bounds}))").alias("_s"))
    # explodes of one item keep Spark from working out what they hold once per use
    hashed = hashed.select(*names, F.explode(F.array("_s")).alias("_s")).withColumn("_n", F.size("_s") - len(_BOUNDS))
    few = F.array(*[F.array(*map(F.lit, _ways(max(n, 1)))) for n in range(MANY)])
    ways = F.when(F.col("_n") < MANY, F.get(few, F.col("_n"))).otherwise(F.array(F.lit(1)))
    hashed = hashed.select(*names, "_s", F.posexplode(ways).alias("_way", "_copies"))

    copied = f"""CASE WHEN _copies = 1 THEN _s ELSE sort_array(concat(flatten(transform(
        array_except(_s, {bounds}), x -> transform(sequence(0, _copies - 1), r -> xxhash64(x, r)))), {bounds})) END"""
    found = hashed.selectExpr(*names, "_way", "_copies", f"{copied} AS _s")
    found = found.select(*names, "_way", "_copies", F.explode(F.array("_s")).alias("_s"))
    at = [f"array_position(_s, {x}L)" for x in _BOUNDS]
    found = found.selectExpr(*names, "_way", "_copies", "_s", f"array({', '.join(at)}) AS _at")
    found = found.select(*names, "_way", "_copies", "_s", F.explode(F.array("_at")).alias("_at"))
    own = [f"get(_at, {c + 1}) - get(_at, {c}) - 1" for c in range(BANDS)]
    bands = [
        f"CASE WHEN {n} > 0 THEN xxhash64(_copies, {c}, slice(_s, cast(get(_at, {c}) + 1 as int), cast(least({n}, {ROWS}) as int))) END" for c, n in enumerate(own)
    ]
    # exists keeps this out of whole-stage code, whose one method would be too long to be compiled;
    # array_compact isn't compiled, nor is what it takes, and there a slice copies all of _s
    found = found.selectExpr(*names, "exists(array(_way), w -> w = 0) AS first", f"array({', '.join(bands)}) AS bands")
    found = found.select(*names, "first", F.explode(F.array("bands")).alias("bands"))
    return found.withColumn("bands", F.array_compact("bands"))


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(band, line) of all bands of some lines, by line: signed_lines in plain Python, for tests."""
    import xxhash

    def hashed(data: bytes, seed: int) -> int:
        return xxhash.xxh64_intdigest(data, seed & _MASK)

    band, of = [], []
    for at, line in enumerate(lines):
        own = {hashed(line[i : i + NARROW].encode("utf-32-be"), 42) for i in range(max(1, len(line) - NARROW + 1))}
        for copies in _ways(len(own)):
            hashes = own if copies == 1 else {hashed(struct.pack("<i", r), hashed(struct.pack("<Q", x), 42)) for x in own for r in range(copies)}
            ordered = sorted(x - (1 << 64) if x >> 63 else x for x in hashes)
            for c in range(BANDS):
                some = [x for x in ordered if _BOUNDS[c] < x < _BOUNDS[c + 1]][:ROWS]
                seed = hashed(struct.pack("<i", c), hashed(struct.pack("<i", copies), 42))
                for x in some:
                    seed = hashed(struct.pack("<q", x), seed)
                if some:
                    band.append(seed)
                    of.append(at)
    return np.array(band, np.uint64).view(np.int64), np.array(of, np.int64)


def similar_members(members: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of the members of a task that hang together; members: leader, bi, bj, rep, block, line.

    A task is one row with the shingle sets of all its members. A fold over them keeps
    their clusters so far: the next member joins all clusters that hold a line like it to
    one. So near copies are mostly compared once each, with the first line of their cluster.
    """
    dealt = members.select("leader", "bi", "bj", F.struct("rep", "block", "line").alias("x")).repartition("leader", "bi", "bj")
    tasks = dealt.groupBy("leader", "bi", "bj").agg(F.collect_list("x").alias("_all")).where("size(_all) > 1")
    tasks = tasks.selectExpr("bi", "bj", f"transform(_all, x -> struct(x.rep AS rep, x.block AS block, {_shingles('x.line')} AS items)) AS _all")
    tasks = tasks.select("bi", "bj", F.explode(F.array("_all")).alias("_all"))
    x, y = "get(_all, i)", "get(_all, j)"
    # a tolerance as in jaccard.py: pairs at the threshold count
    alike = f"""(bi = bj OR {x}.block <> {y}.block)
        AND least(size({x}.items), size({y}.items)) >= {threshold!r}D * greatest(size({x}.items), size({y}.items)) - 1e-9D
        AND size(array_intersect({x}.items, {y}.items)) * {1 + threshold!r}D >= {threshold!r}D * (size({x}.items) + size({y}.items)) - 1e-9D"""
    step = f"""transform(
        array(transform(acc, c -> struct(c, exists(c, j -> {alike}) AS met))),
        m -> concat(
            transform(filter(m, e -> NOT e.met), e -> e.c),
            array(concat(flatten(transform(filter(m, e -> e.met), e -> e.c)), array(i)))))[0]"""
    fold = f"aggregate(sequence(0, size(_all) - 1), cast(array() as array<array<int>>), (acc, i) -> {step})"
    # an explode of one item, else Spark takes the fold into a filter too and works it out several times
    found = tasks.selectExpr(f"explode(array(transform(filter({fold}, c -> size(c) > 1), c -> transform(c, k -> get(_all, k).rep)))) AS _found")
    found = found.select(F.explode("_found").alias("_reps"))
    return found.select(F.explode("_reps").alias("node"), F.get("_reps", F.lit(0)).alias("root"))


def line_groups(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All lines, signed (key, no, h, g, ...), and of those that repeat or resemble others (h, g, component).

    component is a number, or null for lines that only repeat. The caller drops both tables.
    """
    spark = df.sparkSession
    lines = split_lines(df, key, text)
    signed = written(signed_lines(lines), "lines")

    spread = signed.select(F.explode("bands").alias("band"), "h")
    buckets = spread.groupBy("band").agg(F.min("h").alias("leader"), F.max("h").alias("_last"))
    buckets = written(buckets.where("leader <> _last").drop("_last"), "buckets")
    sweep(spark)
    spread = signed.select("h", "g", "size", F.explode("bands").alias("band"))
    led = only_marked(spread, "band", buckets.select("band")).join(buckets, "band")
    led = written(led.groupBy("leader", "h", "g").agg(F.min("size").alias("size")), "groups")
    dropped(buckets)
    sweep(spark)
    members = F.count(F.lit(1))
    many = F.least(members, F.ceil(F.greatest(F.sum("size") / BLOCK, members / BLOCK_TEXTS))).cast("int")
    sizes = led.groupBy("leader").agg(many.alias("nb"))
    placed = led.join(sizes, "leader").groupBy("h", "g").agg(F.array_sort(F.collect_list(F.struct("leader", "nb"))).alias("groups"))
    placed = written(placed.withColumn("rep", F.monotonically_increasing_id()), "members")
    dropped(led)
    sweep(spark)

    found = only_marked(lines.select("line", _hashes()[0]), "h", placed.select("h"))
    found = found.withColumn("g", _hashes()[1]).groupBy("h", "g").agg(F.first("line").alias("line"))
    # lines are dealt out as texts: their shingle sets would take eight times the space
    dealt = dealt_members(found.join(placed, ["h", "g"]).select("rep", "groups", F.col("line").alias("grams")))
    links = written(similar_members(dealt.withColumnRenamed("grams", "line"), threshold), "links")
    sweep(spark)

    parts = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    repeats = signed.where("first").groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", F.lit(None).cast("long").alias("component"))
    about = placed.join(parts, placed["rep"] == parts["node"]).select("h", "g", "component").unionByName(repeats)
    about = written(about.groupBy("h", "g").agg(F.max("component").alias("component")), "similar")
    dropped(placed, links, parts)
    sweep(spark)
    return signed, about


def drop_similar_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with each component's lines taken out but its first; plus n_lines and n_dropped."""
    signed, about = line_groups(df, key, text, threshold)
    hits = signed.where("first").select("key", "no", "h", "g").join(about, ["h", "g"])
    # lines that only repeat are a group by their own hashes
    own = [F.when(F.col("component").isNull(), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("h", "g")]
    hits = written(hits.select(F.coalesce("component", F.lit(-1)).alias("component"), *own, F.struct("key", "no").alias("id")), "hits")
    first = written(hits.groupBy("component", "h", "g").agg(F.min("id").alias("_first")), "first")
    dropped(signed, about)
    gone = hits.join(first, ["component", "h", "g"]).where("id <> _first")
    gone = written(gone.groupBy(F.col("id.key").alias("__tessera_key")).agg(F.collect_set("id.no").alias("__tessera_gone")), "gone")
    dropped(hits, first)
    sweep(df.sparkSession)
    # the plan is the same at every size: gone grows with the table
    out = df.join(gone.hint("merge"), df[key] == F.col("__tessera_key"), "left")
    parts = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__tessera_gone", i)), "\n")
    return out.select(
        *[
            F.when(F.col("__tessera_gone").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c)
            for c in df.columns
            if c not in ("n_lines", "n_dropped")
        ],
        F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(r"\S"))), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("__tessera_gone").isNull(), F.lit(0)).otherwise(F.size("__tessera_gone")).cast("long").alias("n_dropped"),
    )
