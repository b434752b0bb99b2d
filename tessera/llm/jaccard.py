"""Operator 5: n-gram Jaccard join by MinHash banding.

Texts are sets of word 5-grams (64-bit hashes; lower-cased words between white space; a
text of fewer words is one gram). Equal sets form a text class, whose smallest key stands
for it. Representatives get MinHash signatures; bands() picks rows and bands for a target
recall at the threshold.

Band hashes are shuffled, never pairs: a bucket is named by its smallest member, its
leader, and a representative joins the groups of its leaders. Two texts that share any
bucket share its leader, so no candidate pair is lost, however large a bucket is. A group
is dealt out by blocks of about BLOCK grams, or BLOCK_TEXTS short texts: one task compares two
blocks, so its memory is bounded by bytes. There every pair that is due (once, under the smallest leader that both have) is verified on the
full n-gram sets, which are made anew from the whole texts of group members alone. A number
of links per text needs every pair of a group, so what is shuffled for a group of m members
is m * m / block; union-find alone would need less, but would not count links. Tasks
return, per text, the number of verified links and the smallest text it hangs together
with: rows grow with texts, not pairs. Distributed union-find joins those to classes.

Cases: null text counts as empty; empty texts are one text class without links; a null key
takes part in no class; ties need no rule, since leaders and classes are smallest keys; rows
that repeat a key and text count once (a key names one text); extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, dropped, only_marked, sweep, written

BLOCK, BLOCK_TEXTS = 1 << 18, 1024
MOST_HASHES = 160
_WORDS: dict[str, int] = {}
_MEMO = 300_000


def bands(threshold: float, recall: float = 0.999, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which `most` hashes reach the recall.

    A pair at the threshold meets in some band with probability 1 - (1 - t^rows)^bands.
    """
    for rows in range(32, 0, -1):
        n = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if n * rows <= most:
            return n, rows
    raise ValueError(f"{most} hashes can't reach a recall of {recall} at {threshold}")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    memo = _WORDS
    if len(memo) > _MEMO:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def grams(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of a whole text."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(out))


def _signatures(sets: list[np.ndarray], n: int, rows: int) -> list[list[int]]:
    """Band hashes of each set; an empty set has none."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[list[int]] = [[] for _ in sets]
    if not full:
        return out
    rng = np.random.default_rng(5)
    factor = rng.integers(1, 1 << 63, n * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, n * rows, dtype=np.uint64)
    flat = np.concatenate([sets[i] for i in full])
    size = np.array([len(sets[i]) for i in full])
    begins = np.cumsum(size) - size
    band = np.zeros((len(full), n), np.uint64)
    for k in range(n * rows):
        value = flat * factor[k]
        value += shift[k]
        value ^= value >> np.uint64(32)
        least = np.minimum.reduceat(value, begins)
        band[:, k // rows] = _mix(band[:, k // rows] * np.uint64(31) + least + np.uint64(k // rows))
    for i, row in zip(full, band.view(np.int64).tolist(), strict=True):
        out[i] = row
    return out


def signatures(df: DataFrame, key: str, text: str, n: int, number: int, rows: int) -> DataFrame:
    """key, digest of the n-gram set, band hashes, size of the set; no shuffle."""

    def work(batches):
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                sets = [grams(t, n) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(_signatures(sets, number, rows), pa.list_(pa.int64())),
                        pa.array([len(s) for s in sets], pa.int64()),
                    ],
                    names=[key, "digest", "bands", "size"],
                )

    return df.select(key, text).mapInArrow(work, f"`{key}` long, digest binary, bands array<long>, size long")


def _verify(block: np.ndarray, leaders: list[list[int]], leader: int, sets: list[np.ndarray], cross: bool, t: float):
    """(a, b) index arrays of the pairs of a group's task that are due and similar."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m <= 6:
        pairs = [
            (a, b)
            for a in range(m)
            for b in range(a + 1, m)
            if min(size[a], size[b]) >= t * max(size[a], size[b]) - 1e-9
            and (n := len(np.intersect1d(sets[a], sets[b], assume_unique=True))) * (1 + t) >= t * (size[a] + size[b]) - 1e-9
        ]
        a, b = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    else:
        flat = np.concatenate(sets)
        of = np.repeat(np.arange(m), size)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        code = np.cumsum(new) - 1
        shared = np.bincount(code)[code] > 1  # a gram of one text alone adds to no intersection
        code, of = code[shared], of[shared]
        both = np.zeros((m, m), np.float32)
        if len(code):
            code = np.unique(code, return_inverse=True)[1]
            for first in range(0, int(code[-1]) + 1, 4096):
                lo, hi = np.searchsorted(code, [first, first + 4096])
                x = np.zeros((m, min(4096, int(code[-1]) + 1 - first)), np.float32)
                x[of[lo:hi], code[lo:hi] - first] = 1
                both += x @ x.T
        # counts below 2^24 are whole in float32, their products with the threshold are not
        a, b = np.where(np.triu(both.astype(np.float64) * (1 + t) >= t * (size[:, None] + size[None, :]) - 1e-9, 1))
    if cross:
        due = block[a] != block[b]
        a, b = a[due], b[due]
    # a pair is due under the smallest leader that both have
    if len(a) and m <= 6:
        lower = [{x for x in own if x < leader} for own in leaders]
        due = np.array([lower[i].isdisjoint(lower[j]) for i, j in zip(a, b, strict=True)], bool)
        a, b = a[due], b[due]
    elif len(a):
        held = Counter(x for own in leaders for x in own if x < leader)
        lower = [x for x, n in held.items() if n > 1]  # what one text alone has is not in common
        due = np.ones(len(a), bool)
        for first in range(0, len(lower), 4096):
            at = {x: i for i, x in enumerate(lower[first : first + 4096])}
            has = np.zeros((m, len(at)), np.float32)
            for i, own in enumerate(leaders):
                for x in own:
                    if (k := at.get(x)) is not None:
                        has[i, k] = 1
            due &= (has @ has.T)[a, b] == 0
        a, b = a[due], b[due]
    return a, b


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each one hangs together with."""
    root = np.arange(m)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def verified_links(members: DataFrame, threshold: float, make_sets=None) -> DataFrame:
    """(node, links, root) per text and task; members: leader, bi, bj, rep, block, leaders, grams.

    grams are sorted sets as bytes, or with make_sets (lists of texts to sets) the texts.
    """
    names = ["node", "links", "root"]

    def work(batches):
        held, now = [], None
        ready, count = [], 0

        def done():
            rows = sorted({r[0]: r for r in held}.values())  # a row that is there twice counts once
            reps = np.array([r[0] for r in rows], np.int64)
            a, b = _verify(
                np.array([r[1] for r in rows]),
                [r[2] for r in rows],
                now[0],
                [r[3] for r in rows],
                now[1] != now[2],
                threshold,
            )
            links = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
            some = np.flatnonzero(links)
            root = _roots(len(rows), a, b)
            return [reps[some], links[some].astype(np.int64), reps[root[some]]]

        def together():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*ready, strict=True)], names=names)

        for batch in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
            columns = [batch.column(i).to_pylist() for i in range(6)]
            sets = batch.column(6).to_pylist()
            sets = make_sets(sets) if make_sets else [np.frombuffer(x, np.uint64) for x in sets]
            for grams_, leader, bi, bj, rep, block, leaders in zip(sets, *columns, strict=True):
                if (leader, bi, bj) != now:
                    if len(held) > 1:
                        ready.append(done())
                        count += len(ready[-1][0])
                        if count > 8192:
                            yield together()
                            ready, count = [], 0
                    held, now = [], (leader, bi, bj)
                held.append((rep, block, leaders, grams_))
        if len(held) > 1:
            ready.append(done())
        if ready:
            yield together()

    dealt = members.repartition("leader", "bi", "bj").sortWithinPartitions("leader", "bi", "bj")
    return dealt.mapInArrow(work, ", ".join(f"{x} long" for x in names))


def bucket_groups(spread: DataFrame, buckets: DataFrame) -> DataFrame:
    """rep, groups (leader, number of blocks) of all that share a bucket; spread: rep, size, band; buckets: band, leader."""
    led = written(spread.join(buckets, "band").select("leader", "rep", "size").distinct(), "groups")
    members = F.count(F.lit(1))
    many = F.least(members, F.ceil(F.greatest(F.sum("size") / BLOCK, members / BLOCK_TEXTS))).cast("int")
    sizes = led.groupBy("leader").agg(many.alias("nb"))
    placed = led.join(sizes, "leader").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("leader", "nb"))).alias("groups"))
    placed = written(placed, "members")
    dropped(led)
    return placed


def dealt_members(sets: DataFrame) -> DataFrame:
    """Members for verified_links, a row for each pair of blocks they are in; sets: rep, groups, grams."""
    sets = sets.select("rep", "grams", F.col("groups.leader").alias("leaders"), F.explode("groups").alias("g"))
    block = F.pmod(F.xxhash64("rep"), F.col("g.nb").cast("long")).cast("int")
    sets = sets.select("rep", "grams", "leaders", F.col("g.leader").alias("leader"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("g.nb") - 1)).alias("other"))
    return sets.select("leader", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rep", "block", "leaders", "grams")


def similar_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999
) -> DataFrame:
    """One row per row of df: key, class_id, text_id, n_links.

    class_id: smallest key of the texts that hang together by links; text_id: smallest key
    with the same n-gram set; n_links: verified links of that set to other sets.
    """
    number, rows = bands(threshold, recall)
    marked = written(signatures(df, key, text, n, number, rows), "signatures")
    classes = written(
        marked.where(F.col(key).isNotNull()).groupBy("digest").agg(F.min(key).alias("rep"), F.min("size").alias("size"), F.first("bands").alias("bands")), "texts"
    )
    rep_of = marked.select(key, "digest").join(classes.select("digest", "rep"), "digest", "left").select(key, F.col("rep").alias("text_id"))

    spread = classes.select("rep", "size", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = written(buckets.drop("m"), "buckets")
    placed = bucket_groups(spread, buckets)
    dropped(buckets)
    sweep(df.sparkSession)

    def make(batches):
        for batch in batches:
            sets = [grams(t, n).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["rep", "groups", "grams"]
            )

    # a bounded bitmap keeps texts that are in no group out of the shuffle
    texts = only_marked(df.select(F.col(key).alias("rep"), text, F.xxhash64(F.col(key)).alias("_h")), "_h", placed.select(F.xxhash64("rep").alias("_h")))
    whole = placed.join(texts.drop("_h"), "rep")
    sets = whole.select("rep", "groups", text).mapInArrow(make, "rep long, groups array<struct<leader:long,nb:int>>, grams binary")
    members = dealt_members(sets)
    links = written(verified_links(members, threshold), "links")

    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    found = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    about = written(counts.join(found, "node", "left"), "classes")
    about = about.select(F.col("node").alias("text_id"), "n_links", "component")
    rep_of = written(rep_of, "classes")
    dropped(marked, classes, placed, links)
    sweep(df.sparkSession)
    out = rep_of.join(about, "text_id", "left")
    return out.select(
        key, F.coalesce("component", "text_id").alias("class_id"), "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with one row of each class: the one with the smallest key."""
    gone = similar_groups(df, key, text, **how).where(F.col(key) != F.col("class_id")).select(key).distinct()
    return df.join(gone, key, "left_anti")
