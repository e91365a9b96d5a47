"""Corpus preparation in stages: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; every
stage but the last returns the columns of ``documents``. All of them take empty tables, null ids
and texts, repeated rows, texts of any length and further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import exact, minhash, packing, quality, secrets
from sievemill.llm.common import settle, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null texts are judged as empty ones; repeated rows stay or go together; without labels of both
    kinds all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: the smallest id, null ids last.

    Null and empty texts are equal, so one of them stays; of repeated rows the first stays.
    """
    return exact.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (similarity of 0.8 or more over five words).

    The smallest id stays. Documents without an id or without words are near nothing and stay;
    repeated rows, which an earlier stage has dropped, would stay together.
    """
    kept = minhash.near_components(docs, percent=80).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    nameless = docs.where("doc_id IS NULL")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(nameless)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in each text by a mark; ``n_chars``, where there is one, follows the text.

    No row is dropped; null texts stay null and keep their ``n_chars``.
    """
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", size)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a null text is empty and gives the end id alone."""
    return packing.pack_documents(docs, *packing.public_vocabulary())


STAGES = [("quality", keep_quality), ("exact", drop_exact), ("near", drop_near), ("secrets", mask_secrets), ("packing", pack)]

#: SQL can't express the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again.

    Once the result is written, ``sievemill.llm.common.sweep`` deletes what the stages wrote.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage-{name}")
    return docs
