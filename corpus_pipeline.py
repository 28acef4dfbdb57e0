"""The corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed and the mix is tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.

Every stage takes frames of any origin and keeps all columns, whatever their
names. Null and empty texts are scored alike and are copies of each other; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import exact_dedup, jaccard, mixing, pieces, toxicity
from pagewright.shared import table, write_shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from labels of three quarters of the documents; those scored 0.3 or more go.

    Rows with a null doc_id are scored and never learned from; without labels nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.bucket(F.col("doc_id"), 4) != 2)
    return toxicity.keep_clean(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays: that with most code points, then the smallest doc_id (null last), then one of the repeated rows."""
    return exact_dedup.drop_copies(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one stays, by the smallest doc_id; texts without a word are in no class."""
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the null source is one of its own, texts without a word are never taken, repeated rows share their key."""
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, checked by decoding them; null and empty texts have none."""
    return pieces.round_trip(docs, MODEL)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = write_shared(docs, f"pipeline-{k}")
    return docs
