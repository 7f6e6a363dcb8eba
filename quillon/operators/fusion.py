"""Reciprocal rank fusion of the two tiers, and which tier answers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top


def fused(fast: DataFrame, semantic: DataFrame, k: int, *, alpha: float = 0.5, constant: int = 60) -> DataFrame:
    """(query_id, path, rank) of both tiers to query_id, path, score, fast_rank, semantic_rank, rank.

    A tier gives its weight over constant + rank. Ties: fast hits first, in their order, then semantic ones.
    """
    both = fast.select("query_id", "path", F.col("rank").alias("fast_rank"), F.lit(None).cast("int").alias("semantic_rank")).unionByName(
        semantic.select("query_id", "path", F.lit(None).cast("int").alias("fast_rank"), F.col("rank").alias("semantic_rank"))
    )
    one = both.groupBy("query_id", "path").agg(F.min("fast_rank").alias("fast_rank"), F.min("semantic_rank").alias("semantic_rank"))
    part = lambda w, r: F.coalesce(w / (constant + F.col(r)), F.lit(0.0))
    scored = one.withColumn("score", part(F.lit(1 - alpha), "fast_rank") + part(F.lit(alpha), "semantic_rank"))
    return top(scored, k, F.desc("score"), F.asc_nulls_last("fast_rank"), F.asc_nulls_last("semantic_rank"))


def answered(queries: DataFrame, fast: DataFrame, semantic: DataFrame, k: int, threshold: float) -> DataFrame:
    """query_id, path, score, mode, rank: fused where both tiers found something, else the one that did.

    The threshold holds for semantic-only answers, and after their cut to k.
    """
    has = queries.select("query_id")
    has = has.join(fast.select("query_id").distinct().withColumn("f", F.lit(True)), "query_id", "left").join(semantic.select("query_id").distinct().withColumn("s", F.lit(True)), "query_id", "left")
    mode = F.when(F.col("f") & F.col("s"), "fused").when(F.col("s"), "semantic").when(F.col("f"), "fast")
    mode = has.select("query_id", mode.alias("mode")).where("mode is not null")
    cols = ("query_id", "path", "score", "mode", "rank")
    alone = fast.join(mode.where("mode = 'fast'"), "query_id").where(F.col("rank") <= k).select(*cols)
    near = semantic.join(mode.where("mode = 'semantic'"), "query_id").where((F.col("rank") <= k) & (F.col("score") >= threshold)).select(*cols)
    return fused(fast, semantic, k).join(mode.where("mode = 'fused'"), "query_id").select(*cols).unionByName(alone).unionByName(near)


def enriched(results: DataFrame, fast: DataFrame, files: DataFrame) -> DataFrame:
    """results with match_type, matched_terms and metadata.

    The keyword tier's own come first; what only the semantic tier found gets the metadata of its index row. A path that
    has no row (any more) keeps nulls.
    """
    told = fast.select("query_id", "path", "match_type", "matched_terms", F.col("metadata").alias("_told"))
    counts = [F.size(c).alias(c) for c in ("functions", "classes", "imports")]
    known = files.select(F.col("relative_path").alias("path"), F.struct("language", "size", "line_count", *counts).alias("_known"))
    out = results.join(told, ["query_id", "path"], "left").join(known, "path", "left")
    return out.select(*results.columns, "match_type", "matched_terms", F.coalesce("_told", "_known").alias("metadata"))
