"""A training-corpus pipeline: five stages, each the operator of that name applied to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import bpe, common, decontaminate, jaccard, quality, secrets
from lexquarry.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more). The model learns from the labels of documents in docs."""
    common.bounded_batches(spark)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    score, predicted = common.fresh(docs, "score", "predicted")
    scored = quality.classify(docs, model, score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 1).drop(score, predicted)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that links of 90 % or more shingles in common make."""
    common.bounded_batches(spark)
    return jaccard.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text that the ids decode to."""
    common.bounded_batches(spark)
    return bpe.encode_documents(docs, TOKENIZER)


STAGES = [("quality", keep_good), ("jaccard", keep_one), ("decontamination", keep_clean), ("secrets", redact), ("bpe", encode)]

#: SQL can express neither the classifier nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each stage's rows are stored in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
