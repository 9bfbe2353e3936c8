"""The training-data pipeline: quality, near-duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what its predecessor
kept (with the columns of ``documents``), and returns a DataFrame that is
written as Parquet and read again before the next stage.

Defined results, stage by stage:

quality          a null or empty text is scored by the model's bias; every row is judged by
                 its own text, repeated rows alike; an empty table stays empty.
near_duplicates  rows with a null id, and null or empty texts, stay; of rows equal in id and
                 text one stays; rows of one id with different texts are judged each by its
                 text; of a class the row of the least id (then digest of the text) stays.
secrets          null texts stay null; every other text has its spans masked, of any length
                 and number; ``n_chars`` is the masked text's.
mixing           a row for each pass; null sources are a source; texts without tokens are in
                 the mixture; ties of the draw are ordered by id and text.
bpe              a null or empty text has no ids; one result row for each row of the mixture.

Only the columns of ``documents`` are carried, so columns of other names, clashing or not, do
not reach a stage. Texts of any length are processed whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maternis.llm import bpe, mixing, nbsvm, order_minhash, secret_scan
from maternis.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Sources are mixed towards equal shares; no document is repeated more than once, and every
#: document that reaches the stage is in the mixture.
TARGET = mixing.Target(entropy=0.95, repetition=2.0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least ``nbsvm.THRESHOLD``; the others go."""
    model = nbsvm.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # the text is carried along the score, so that rows need no identity to be told apart
    scored = nbsvm.score_quality(docs, model, keep=COLUMNS)
    return scored.where(F.col("score") >= nbsvm.THRESHOLD).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return order_minhash.one_of_each(docs.select(*COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    out = secret_scan.mask_secrets(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in the order of its blocks: a row for each pass of a document."""
    rest = [c for c in COLUMNS if c not in ("doc_id", "source")]
    mixed = mixing.mix(docs, TARGET, payload=tuple(rest))
    ordered = mixed.repartitionByRange("block", "draw").sortWithinPartitions("block", "draw")
    return ordered.select(*[F.col(c if c not in rest else f"row_{c}").alias(c) for c in COLUMNS])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and digests of every document of the mixture."""
    return bpe.bpe_digests(docs, VOCABULARY)


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("secrets", secrets_stage),
          ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SQL can't express the classifier and the alignment; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
