"""From raw documents to token ids: each stage is one of the numbered operators.

A stage gets what its predecessor kept, written as Parquet and read again, and
works on all of it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.decontam import drop_contaminated
from folioflow.llm.language import keep_identified
from folioflow.llm.lines import dedup_lines
from folioflow.llm.pieces import encode_pieces
from folioflow.llm.simhash import keep_one
from folioflow.session import materialize, ship_package

#: Machines are trained and texts hashed outside SQL; a brute-force version checks the rows in the tests.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that no language can be named for go; all others stay as they are."""
    ship_package(spark)
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them only."""
    ship_package(spark)
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship_package(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    ship_package(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of what they decode to."""
    ship_package(spark)
    return encode_pieces(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
