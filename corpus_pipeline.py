"""From raw documents to shards: five operators of the training-data subpackage in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.decontaminate import drop_contaminated
from larkspan.llm.lineage import stored
from larkspan.llm.mixing import mix
from larkspan.llm.quality import keep_good
from larkspan.llm.sharding import assign
from larkspan.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 4)."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (operator 3)."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages (operator 6)."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked weights (operator 1)."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes (operator 9)."""
    return assign(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mixing), ("sharding", sharding)]
#: SimHash and the raked draw have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else stored(docs), sf_dir)
    return docs
