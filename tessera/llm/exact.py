"""Operator 9: exact deduplication with a stateful stream.

Texts are equal when identical after lower-casing A-Z. A stream of document keys runs
through keyed state that never expires and lives in RocksDB on the executors' disks: per
digest it retains the stable identifier that wins (the largest), the content locator that
came with it, and a count. Keys are aggregated inside each task before they are shuffled,
so a text with very many copies sends one row per task. Each micro-batch upserts what it
changed into a table in the shared folder; a restarted query goes on from its checkpoint.

A content locator is a file and a row's place in it. Rows that come from no file are written
to the shared folder first. A digest hit is then held against content: the full bytes of
each member are compared with those of the retained row, and both are fetched by their
locators, so identifiers may repeat. Should bytes differ, the digest is split by content, so
a collision never drops a document.

Cases: null text counts as empty, and empty texts are equal; a null identifier loses
against any other; rows that repeat an identifier each count in group_size and share one
fate; extra columns are ignored here and kept by drop_exact_copies; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, shared_dir, sweep, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def located(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, locator): a row's file and its place there."""
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    try:
        return df.select(key, text, place.alias("locator"))
    except AnalysisException:  # no files behind it
        return written(df.select(key, text), "content").select(key, text, place.alias("locator"))


def text_digests(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_sha256, n_bytes, locator): lower-case hex SHA-256 of the normalised text."""

    def work(batches):
        for batch in batches:
            raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                    pa.array([len(r) for r in raw], pa.int64()),
                    batch.column(2),
                ],
                names=[key, "text_sha256", "n_bytes", "locator"],
            )

    return rows.select(key, text, "locator").mapInArrow(
        work, f"`{key}` {rows.schema[key].dataType.simpleString()}, text_sha256 string, n_bytes long, locator string"
    )


def same_text(column: str):
    """The normalised text: A-Z lowered, null as empty. ASCII texts take the quick way."""
    c = F.coalesce(F.col(column), F.lit(""))
    plain = F.length(c) == F.octet_length(c)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def retain(keys: DataFrame, key: str) -> DataFrame:
    """The stateful operator: per text_sha256 the winning key, its locator and the count.

    keys is a streaming (or static) frame of text_digests(); the same plan serves both.
    """
    return keys.groupBy("text_sha256", "n_bytes").agg(
        F.max(F.struct(F.col(key).alias("keep_id"), F.col("locator"))).alias("kept"), F.count(F.lit(1)).alias("n")
    )


def stream_retained(spark, path: str, schema, key: str, per_trigger: int | None = None) -> DataFrame:
    """Runs every file of path through retain() as a stream; returns the final state's rows."""
    session = spark.newSession()  # so that the caller's settings stay as they are
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name, value in (
        ("allowFAllocate", "false"),  # else each state partition reserves megabytes before it holds a row
        ("changelogCheckpointing.enabled", "true"),  # commits upload changes, not whole stores
    ):
        session.conf.set(f"spark.sql.streaming.stateStore.rocksdb.{name}", value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    out, at = shared_dir(spark, "retained"), shared_dir(spark, "stream")
    reader = session.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxBytesPerTrigger", per_trigger)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again after a failure replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        retain(reader.parquet(path), key)
        .writeStream.outputMode("update")
        .option("checkpointLocation", at)
        .trigger(availableNow=True)
        .foreachBatch(upsert)
        .start()
    )
    query.awaitTermination()
    kind = schema[key].dataType.simpleString()
    rows = spark.read.schema(
        f"text_sha256 string, n_bytes long, kept struct<keep_id: {kind}, locator: string>, n long, batch int"
    ).parquet(out) if query.lastProgress else None
    if rows is None:
        return spark.createDataFrame([], f"text_sha256 string, n_bytes long, keep_id {kind}, locator string, n long")
    # a later batch has seen all that earlier ones had
    return rows.groupBy("text_sha256", "n_bytes").agg(F.max(F.struct("n", "kept")).alias("s")).select(
        "text_sha256", "n_bytes", "s.kept.keep_id", "s.kept.locator", "s.n"
    )


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", per_trigger: int | None = None) -> DataFrame:
    """One row per row of df: key, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    path = shared_dir(spark, "digests")
    content = located(df, key, text)
    text_digests(content, key, text).write.parquet(path)
    keys = spark.read.parquet(path)
    if keys.isEmpty():
        kept = spark.createDataFrame(
            [], f"text_sha256 string, n_bytes long, keep_id {keys.schema[key].dataType.simpleString()}, locator string, n long"
        )
    else:
        kept = stream_retained(spark, path, keys.schema, key, per_trigger)
    kept = written(kept, "kept")
    joined = keys.join(kept.withColumnRenamed("locator", "kept_at"), ["text_sha256", "n_bytes"])
    joined = joined.select(key, "locator", "keep_id", "kept_at", F.col("n").alias("group_size"), "text_sha256")
    joined = written(joined, "groups")

    # Full bytes on hits: members of groups against the rows that their groups retain.
    hits = joined.where("group_size > 1").select("locator", "kept_at", "text_sha256")
    hits = content.select(key, text, "locator").join(hits, "locator")
    hits = written(hits.select(key, "locator", "kept_at", "text_sha256", same_text(text).alias("_t")), "hits")
    kept_text = hits.where("locator = kept_at").select("kept_at", F.col("_t").alias("_k"))
    wrong = hits.where("locator <> kept_at").join(kept_text, "kept_at").where("_t <> _k").select("text_sha256").distinct()
    wrong = written(wrong, "collisions")
    sweep(spark)
    if not wrong.isEmpty():  # digests of different texts: these groups are formed by content
        split = hits.join(wrong, "text_sha256")
        named = written(
            split.groupBy("text_sha256", "_t").agg(F.max(key).alias("_keep"), F.count(F.lit(1)).alias("_n")), "split"
        )
        split = split.join(named, ["text_sha256", "_t"]).select("locator", "_keep", "_n")
        joined = (
            joined.join(split, "locator", "left")
            .withColumn("keep_id", F.coalesce("_keep", "keep_id"))
            .withColumn("group_size", F.coalesce("_n", "group_size"))
            .drop("_keep", "_n")
        )
        joined = written(joined, "groups")
    dropped(kept, hits)
    return joined.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows whose text an equal row with a larger key has."""
    gone = exact_groups(df, key, text).where("not kept").select(key).distinct()
    return df.join(gone, key, "left_anti")
