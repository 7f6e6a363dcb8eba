"""Shared plumbing of the training-data operators: names, hashes of ids, and how large Arrow batches get."""

import ctypes
import gc
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import forget, saved, shared_dir

__all__ = ["bound_batches", "crc_mod", "documents", "forget", "released", "remembered", "saved", "shared_dir", "unused"]

_KEPT: dict = {}


def bound_batches(spark: SparkSession, rows: int = 512, mb: int = 8) -> None:
    """Keep Arrow batches small by rows and by bytes, so that very long texts don't fill a Python worker.

    The setting stays: a returned frame needs it when the caller runs it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def released() -> None:
    """Drop what this Python worker remembers, and give the memory back: workers outlive the operator they served."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass


def remembered[T](key: Hashable, make: Callable[[], T]) -> T:
    """What this Python worker remembers under key; one thing at a time, so that memory doesn't add up over operators."""
    if key not in _KEPT:
        released()
        _KEPT[key] = make()
    return _KEPT[key]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's decimal text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
