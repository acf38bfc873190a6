"""The corpus pipeline: toxicity, exact dedup, near dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to the documents, writing
each result as Parquet into the shared folder and giving it, read again, to the next. All stages but the
last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.llm.exact_dedup import drop_copies
from procurelake.llm.near_join import keep_one_of_each_class
from procurelake.llm.packing import pack_documents
from procurelake.llm.secrets import redact_secrets
from procurelake.llm.shared import quoted, stash, unused
from procurelake.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from all labelled documents. Without any, none is rejected."""
    weights = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if weights is None:
        return docs
    score = unused(docs, "score")
    return score_toxicity(docs, weights, out=score).where(F.col(score) < THRESHOLD).select(*[F.col(quoted(c)) for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return keep_one_of_each_class(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; one row per piece."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_join", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The classifier, the forest and the tokenizer are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
