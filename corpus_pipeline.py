"""A training corpus from raw documents: quality, repeated lines, near copies, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm._common import fresh, keyed, stage
from strideframe.llm.lines import remove_repeated_lines
from strideframe.llm.packing import pack_documents
from strideframe.llm.pii import redact
from strideframe.llm.quality import keep_good
from strideframe.llm.simhash import near_duplicates

#: Words of a shingle, and the Jaccard similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, and how many of its bits may differ in a candidate.
WORDS, BITS = 2, 32


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality model accepts.

    Null and empty texts are scored like others, rows of null or repeated ids each on their own;
    null sites are a site. An empty table stays empty; all columns stay as they are.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of line runs of 50 words or more.

    Null and empty texts stay as they are, and all rows stay: a text that goes whole becomes empty.
    Rows of equal or null ids are ordered by a hash of their texts. ``n_chars`` follows the text;
    other columns stay. An empty table stays empty.
    """
    return _sized(remove_repeated_lines(docs, min_words=50))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest (id, text hash) of each group of near copies, a null id after all others.

    Two texts are near copies if their sets of five-word shingles have a similarity of 0.8 or more.

    Documents whose text is empty or null (emptied by the line stage) are one group of their own.
    Rows are told apart by a number where ids are null or repeated, so that rows of different
    groups stay whatever their ids; of repeated rows one stays. An empty table stays empty; all
    columns stay as they are.
    """
    (key,) = fresh(docs, "row_key")
    rows = keyed(docs, "doc_id", key, "text")
    groups = near_duplicates(rows, id_col=key, shingle=SHINGLE, bits=BITS, words=WORDS, confirm=SIMILARITY)
    # Row keys grow with the id, so the smallest key of a group, its component's name, is its first row.
    return rows.join(groups.filter(F.col(key) == F.col("component_id")).select(key), key, "left_semi").drop(key)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind.

    Null and empty texts stay as they are; every row stays, whatever its id. ``n_chars`` follows
    the text; other columns stay. An empty table stays empty.
    """
    return _sized(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids.

    Null and empty texts are an end id alone; rows of null or repeated ids are packed each. An
    empty table gives no pieces; other columns are not carried along.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Trained models, fingerprints and a tokenizer are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
