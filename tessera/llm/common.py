"""Helpers that several operators share: shared folders, written tables, union-find."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 1 << 28  # of a bitmap that is broadcast: 32 MB
_OWN: list[str] = []


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

    Only where the setting is absent and all runs on one machine (tests) a temporary folder
    is used. The folder is removed when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        base = _OWN[0]
    path = f"{base.rstrip('/')}/tessera/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has already ended
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read back.

    Unlike checkpoint(), what is read has no partitioning that a later join would reuse,
    so adaptive execution can split its skewed partitions.
    """
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that written() gave and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "written_path", None):
            _remove(t.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark find the shuffles that nothing refers to any more, and remove their files.

    It does so when the driver collects garbage, which else may be half an hour away.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows: those with the smallest hash of their key.

    A threshold on the hash, from the number of all rows, leaves little more than `rows`
    of them before any are sorted, so no task gathers rows of many partitions.
    """
    total, top = df.count(), 1 << 40
    if total > 2 * rows:
        df = df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(top)) < int(top * (1.3 * rows + 100) / total))
    return df.orderBy(F.pmod(F.xxhash64(F.col(key)), F.lit(top)), F.col(key)).limit(rows)


def only_marked(df: DataFrame, column: str, marks: DataFrame) -> DataFrame:
    """Rows of df whose 64-bit hash in a column may be among marks (their one column).

    A bitmap of about 16 bits a mark (at most MOST_BITS) is broadcast, in rows of 2^15 bits.
    """
    bits = min(max(1 << 15, 1 << (16 * marks.count()).bit_length()), MOST_BITS)
    at = F.col(marks.columns[0]).bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, cast(_at & 63 as int))")
    words = marks.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_w"), one.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    held = words.groupBy(F.shiftright("_w", 9).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_w").bitwiseAND(F.lit(511)), "_b"))).alias("_m"))
    held = held.select("_row", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.get(F.array(F.col("_m")[i.cast("long")]), F.lit(0)), F.lit(0).cast("long"))).alias("_words"))
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    near = df.withColumn("_row", F.shiftright(at, 15)).join(F.broadcast(held), "_row")
    word = F.get("_words", F.shiftright(at, 6).bitwiseAND(F.lit(511)).cast("int"))
    return near.withColumns({"_word": word, "_bit": at.bitwiseAND(F.lit(63)).cast("int")}).where("shiftright(_word, _bit) & 1 = 1").select(*df.columns)


def connected_components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over edges (src, dst) of any ordered type: (node, component).

    component is the smallest node of the component. Each round contracts: every node
    hooks onto its smallest neighbour, labels are shortened by pointer jumping until the trees
    are flat, and edges are rewritten between labels until none is left. A root that no node
    hooks onto has a smaller neighbour in the next round, so two rounds at least halve the
    nodes: rounds, and jumps in a round, are logarithmic. Every round is a written table, so a
    lost executor costs one round at most. Nodes without edges don't appear.
    """
    live = written(
        edges.where("src <> dst")
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct(),
        "edges",
    )
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(
            live.select(F.col("a").alias("node"), F.col("a").alias("to"))
        )
        # hooking: parent <= node, so no cycle can arise
        table = hook = written(both.groupBy("node").agg(F.min("to").alias("root")), "hook")
        while True:  # pointer jumping
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = hook.join(up, "root").select("node", F.col("top").alias("root"), F.expr("top <> root").alias("moved"))
            jumped = written(jumped, "hook")
            dropped(table)
            table, hook = jumped, jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if labels is None:
            before, labels = None, written(hook, "labels")
        else:
            before, labels = labels, written(
                labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")),
                "labels",
            )
        la = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        lb = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        last, live = live, written(
            live.join(la, "a")
            .join(lb, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
        dropped(last, table, *([before] if before is not None else []))
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = labels.select("node", F.col("root").alias("component"))
    out.written_path = labels.written_path
    return out
