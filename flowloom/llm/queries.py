"""Queries of the numbered operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import article, descent, hosts, packing, perplexity, pieces, pii, ranked, runs, simhash, suffixes, topk, warc
from flowloom.llm.common import read


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return perplexity.judge(docs, read(spark, sf_dir, "labels")).drop("text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op8_html_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.main_text(read(spark, sf_dir, "pages"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_codec(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeating(read(spark, sf_dir, "documents"))
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS first, -r.period AS shortest)))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    found = runs.find_runs(docs).withColumns({"_best": best, "_listed": listed})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.first")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.shortest")).alias("period"), F.expr("(1000 * _best.length) div -_best.shortest").alias("exponent_milli"),
        F.sha2("_listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def repeating(docs: DataFrame) -> DataFrame:
    """The contract's texts: in a tenth of the documents, chosen by a checksum of
    the id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = docs.select("doc_id", "text", h.alias("_h")).withColumn(
        "_words", F.when(F.col("_h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^ \t-\r]+', 0)")))
    changed = changed.withColumn("_n", F.size("_words")).withColumn("_g", F.expr("_h div 10"))
    changed = changed.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    changed = changed.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    text = F.expr("array_join(transform(_words, (w, i) -> CASE WHEN i < _a THEN w ELSE _words[CAST(_a + (i - _a) % _p AS INT)] END), ' ')")
    return changed.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (
    op1_pii_spans, op2_best_fit_packing, op3_exact_top_k, op4_simhash_near_dedup, op5_quality_perplexity, op6_suffix_dedup, op7_url_reputation, op8_html_article, op9_embedding_near_dedup,
    op10_piece_codec, op11_ranked_search, op12_warc_archives, op13_periodic_runs)}

ORACLE: dict[str, str] = {"op7_url_reputation": hosts.SQL, "op11_ranked_search": ranked.SQL, "op12_warc_archives": warc.SQL}
