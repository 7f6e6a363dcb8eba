"""Scan of a file tree into rows of the index."""

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.extract import extracted
from ..functions.keywords import keywords
from ..functions.languages import indexable, language
from ..functions.text import content_hash, decoded, line_count, relative_path


@F.pandas_udf(T.StringType())
def _local(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: unquote(p[5:] if p.startswith("file:/") else p))


def plain_path(path):
    """A reader's path without a file scheme and with its percent escapes undone."""
    bare = F.regexp_replace(path, "^file:/+", "/")
    return F.when(F.contains(bare, F.lit("%")), _local(bare)).otherwise(bare)


def scan(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """(path, relative_path, size, modified_time, created_time, language, text) of the indexable files under root.

    Unreadable files are skipped. The reader has no creation time: that column is null.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    named = raw.withColumn("_path", plain_path(F.col("path"))).where(indexable(F.col("_path"), config.excluded))
    return named.select(
        F.col("_path").alias("path"), relative_path("_path", root).alias("relative_path"), F.col("length").alias("size"),
        F.col("modificationTime").cast("double").alias("modified_time"), F.lit(None).cast("double").alias("created_time"),
        language(F.col("_path")).alias("language"), decoded("content").alias("text"),
    )


def indexed(files: DataFrame) -> DataFrame:
    """Index rows of scanned files: hashes, line counts, structure and keywords; the text stays for the text tiers."""
    e = extracted(files.withColumns({"content_hash": content_hash("text"), "line_count": line_count("text")}))
    return e.withColumn("keywords", keywords(F.col("relative_path"), F.col("functions"), F.col("classes"), F.col("imports")))
