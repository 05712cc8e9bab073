"""A corpus pipeline of five stages over `documents`; each works on what its predecessor wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Further columns of docs are left behind.
A stage of an empty table gives an empty one. Ids, texts and sources may be null, ids and rows may repeat: each stage says what it makes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, jaccard, line_dedup, mixing, quality
from kinweave.llm._common import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null texts and texts without words go; a null id changes nothing."""
    return quality.classify(docs).where("keep").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of ten documents or more; n_chars follows the text. Every row is a document, and a null text becomes the empty one."""
    return line_dedup.dedup_lines(docs, min_docs=10).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 over five-word shingles, the one with the smallest id; null ids come last.

    Rows are told apart by a number of their own, so each group keeps exactly one row, also where ids repeat or are null. Texts without words are linked
    with nothing and all stay.
    """
    rows = write_table(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = jaccard.near_duplicates(rows, words=5, similarity="0.8", id_col="__row").join(rows.select("__row", "doc_id"), "__row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    return rows.join(first.select("first.__row"), "__row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts towards sources weighted by the square root of their size, shuffled. Null sources are one source, and null ids draw one count."""
    return mixing.mix_sources(docs, temperature=0.5, seed=17).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the decoded bytes. A null text has none."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, ids=True, digests=True, parted=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_common_lines),
    ("n-gram jaccard", drop_near_duplicates),
    ("poisson mixing", mix),
    ("byte bpe", encode),
]

#: SQL can't express the classifier; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, name.replace(" ", "-"))
    return docs
