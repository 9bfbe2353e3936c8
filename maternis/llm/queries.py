"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, collocations, edit_counts, itq, link_graph, mixing, nbsvm, oracles, order_minhash, packing, quality_rules,
               secret_scan, spelling, token_files)
from .common import scratch_path, written

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf, "documents"), BYTE_VOCABULARY, out)
    return token_files.read_token_files(spark, out)


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf, "documents"))


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).drop("draw")


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf, "documents"), WORD_VOCABULARY)


def op5_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf, "documents"))


def op6_link_graph(spark: SparkSession, sf: str) -> DataFrame:
    return link_graph.judge_urls(table(spark, sf, "pages"))


def op7_edit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return edit_counts.count_after_masking(table(spark, sf, "documents"), BYTE_VOCABULARY)


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = nbsvm.fit_quality(docs, table(spark, sf, "labels"))
    return nbsvm.score_quality(docs, model).select(
        "doc_id", nbsvm.held_out().alias("held_out"), "score",
        (F.col("score") >= nbsvm.THRESHOLD).cast("int").alias("predicted"))


def op9_itq(spark: SparkSession, sf: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    stats = written(quality_rules.text_statistics(table(spark, sf, "documents")), "text-statistics")
    rules = quality_rules.fit_rules(stats, table(spark, sf, "labels"))
    return quality_rules.judge(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_rule")


def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = written(packing.encoded_pieces(table(spark, sf, "documents"), WORD_VOCABULARY), "pieces")
    digests = pieces.select("uid", "doc_id", "piece", "start", F.col("length").cast("bigint").alias("n"),
                            F.crc32("ids").alias("ids_crc32"))
    places = packing.placed(pieces.select("uid", "length"))
    return digests.join(places, "uid").select(
        "doc_id", "piece", "start", F.col("n").alias("length"), "ids_crc32", "sequence_id",
        F.col("offset").cast("bigint").alias("offset"))


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"), word_of=spelling.altered)


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_secret_scan": op2_secret_scan,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_order_minhash": op5_order_minhash,
    "op6_link_graph": op6_link_graph,
    "op7_edit_counts": op7_edit_counts,
    "op8_quality": op8_quality,
    "op9_itq": op9_itq,
    "op10_quality_rules": op10_quality_rules,
    "op11_packing": op11_packing,
    "op12_spelling": op12_spelling,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op6_link_graph": oracles.link_graph_sql(),
    "op13_collocations": oracles.collocations_sql(),
}
