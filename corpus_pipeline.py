"""A corpus pipeline over documents: five stages, each one of the subpackage's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every result
as Parquet in the shared folder and hands the next stage what it reads back, so a lost
executor or a failed stage never reaches behind the last written table.

Cases, in every stage but the last: columns that it doesn't read are kept as they are, nulls
included, also where they are named like an operator's own columns; rows that repeat each
count, and share their fate; an empty table gives an empty table with the same columns; texts
of any length are read whole. What a null or empty text means is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.exact import drop_exact_copies
from tessera.llm.jaccard import one_of_each
from tessera.llm.language import keep_identified
from tessera.llm.packing import pack_texts
from tessera.llm.secret import redact_secrets


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence identifies.

    Null and empty texts have no language and go; a null lang or source says nothing. Rows
    with a null doc_id stay, since there is no key to reject them by. Ties of the posterior
    go to the language first in the alphabet.
    """
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id.

    Null and empty texts are equal, texts that differ in the case of A-Z too. A null doc_id
    loses against any other, and its row stays; rows that repeat the kept doc_id all stay.
    """
    return drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that hang together by 5-gram similarity of 0.8 or more, the smallest doc_id.

    Null and empty texts are one text without likeness to others, whose smallest doc_id stays;
    rows with a null doc_id are in no group and stay.
    """
    return one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark, and n_chars of what remains.

    A null text stays null, with 0 characters; of spans that overlap, the one that
    begins first is replaced and the rest of the others goes.
    """
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens: the columns of op1_packing.

    A null or empty text is its end id alone; a null doc_id stays null; repeated rows are
    packed each.
    """
    return pack_texts(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), tokens=1024)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Packing depends on the tokeniser and language on a trained model: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
