"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs. Null and empty
texts are judged like others by the classifiers, are equal to one another, are near nothing, and are packed as their end id.
Rows that repeat a doc_id with another text are rows of their own but for near dedup, where a doc_id goes or stays. An
empty table gives an empty table.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import documents, shared_dir
from quillon.llm.exact import drop_exact_copies
from quillon.llm.mixing import mixed_rows
from quillon.llm.near import drop_near_copies
from quillon.llm.packing import pack, tokenizer_file
from quillon.llm.quality import keep_quality
from quillon.session import ship_package
from quillon.sources.tables import delete, scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return keep_quality(docs, _labels(spark, sf_dir))


def exact(spark, docs, sf_dir):
    """Of equal texts the row with the smallest doc_id stays."""
    ship_package(spark)
    return drop_exact_copies(docs)


def near(spark, docs, sf_dir):
    """One document of each group of near duplicates (five-word shingles, 0.8) stays."""
    ship_package(spark)
    return drop_near_copies(docs)


def mixing(spark, docs, sf_dir):
    """Documents are thinned to the target weights of domains; clean ones set the total and no document is repeated."""
    ship_package(spark)
    return mixed_rows(docs, _labels(spark, sf_dir), anchor="q1t0", most=1.0)


def packing(spark, docs, sf_dir):
    """Every document that is left, as pieces of packed sequences."""
    ship_package(spark)
    return pack(docs, tokenizer_file())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Learned weights and tokens decide its rows; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex[:12]}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
