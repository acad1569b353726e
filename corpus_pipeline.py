"""From raw documents to packed sequences: quality rules, near-duplicate removal, surrogates for personal data, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read back as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import neardup, packing, pii, quality
from tessera.llm.bpe import vocabulary_path
from tessera.llm.common import remove, shared_dir

#: Policy of the quality ledger, and key of the surrogates; a deployment passes a key of its own.
POLICY, SECRET_KEY = quality.CURRENT, pii.DEMO_KEY


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality.keep(docs, POLICY)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each class of near duplicates."""
    return neardup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data, and n_chars counted anew."""
    done = pii.replace_pii(docs, SECRET_KEY)
    if "n_chars" not in docs.columns:
        return done
    counted = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*[counted if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, vocabulary_path(), with_ids=False)


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: ProbMinHash, keyed surrogates and byte-pair encoding have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Of the written ones the last, which the result reads from, stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
