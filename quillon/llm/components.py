"""Connected components of a table of links by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _settled(edges: DataFrame) -> bool:
    """Whether (u, v) maps every node to a root that has no edge of its own."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    return ends.groupBy("n").agg(F.sum("from").alias("f"), F.max("to").alias("t")).where("f > 1 or (f = 1 and t = 1)").isEmpty()


def components(links: DataFrame, most: int = 200) -> DataFrame:
    """(id, component_id) for every id in links (a, b): the smallest id that links reach. Self links and nulls are ignored.

    Each step is a grouping that combines before it moves and a join on the node; no neighbourhood is collected.
    Every round is written to the shared folder, so lineage stays short, and the one before it is deleted. Rounds grow with
    the logarithm of a component's width; RuntimeError after ``most`` of them rather than a wrong result.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most):
        if _settled(edges):
            break
        # Large star: neighbours above n go to the smallest of n and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct(), "large")
        # Small star: neighbours below n, and n, go to the smallest of them.
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, saved(small.unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        forget(before, large)
    else:
        raise RuntimeError(f"components not settled after {most} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots).distinct()
