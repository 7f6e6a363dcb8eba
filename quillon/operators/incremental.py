"""What changed between a stored index and the files there are now."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(existing: DataFrame, current: DataFrame) -> DataFrame:
    """(relative_path, status) of both sides' (relative_path, content_hash): unchanged, changed, new or removed."""
    old = existing.select("relative_path", F.col("content_hash").alias("old"), F.lit(True).alias("had"))
    now = current.select("relative_path", F.col("content_hash").alias("now"), F.lit(True).alias("has"))
    both = old.join(now, "relative_path", "full_outer")
    status = F.when(F.col("has").isNull(), "removed").when(F.col("had").isNull(), "new").when(F.col("old").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return both.select("relative_path", status.alias("status"))


def applied(existing: DataFrame, current: DataFrame, index) -> DataFrame:
    """Index rows after the change: unchanged rows as they are, index(rows) of the others, nothing of removed files."""
    hashes = current.select("relative_path", F.col("content_hash").alias("_hash"))
    same = existing.join(hashes, "relative_path").where(F.col("content_hash").eqNullSafe(F.col("_hash"))).drop("_hash")
    again = index(current.join(same.select("relative_path"), "relative_path", "left_anti"))
    return same.select(*again.columns).unionByName(again)


def counts(changes: DataFrame) -> DataFrame:
    kinds = ("unchanged", "changed", "new", "removed")
    return changes.agg(*(F.count_if(F.col("status") == k).alias(k) for k in kinds))
