"""From raw documents to packed training sequences, in five stages.

Each stage takes the table the one before has written and returns the next
one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import packing, perplexity, pii, simhash, suffixes
from flowloom.llm.common import at_most, given_back, read, renamed
from flowloom.session import cut_lineage

ROWS = 1000  # documents that a task gets at once


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's quantile stay."""
    at_most(spark, ROWS)
    rows, at = renamed(docs)
    judged = perplexity.judge(rows, read(spark, sf_dir, "labels"), id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"])
    return judged.where("kept").select(*given_back(at))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    at_most(spark, ROWS)
    return simhash.drop_near_copies(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur elsewhere as well are cut out of the texts."""
    at_most(spark, ROWS)
    rows, at = renamed(docs)
    cut = suffixes.cut_repeats(rows, id_col=at["doc_id"], text_col=at["text"])
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[changed.get(c, F.col(name)).alias(c) for c, name in at.items()])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    at_most(spark, ROWS)
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

# The stages use fitted models, hashes of shingles and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
