"""Embedding near-dedup: exact metric range join.

Identical vectors of a label become one with a count. Pivots split each label's vectors into cells by the nearest
pivot; a vector is copied to every other cell whose members it could link with: by the triangle inequality on the
cell's radius, and on the distance to the plane between the two pivots. Cells are then joined independently, each
counting the links of its own members and emitting a spanning forest instead of all pairs. A label with no more vectors
than a cell, or with a share of under two pivots, is one cell without pivots.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved
from .components import components

#: Members of a cell that one group holds, and candidates that they meet there; larger cells are dealt out in pairs of blocks.
BLOCK = 2_000
#: Slack on distances for rounding; it only copies more.
SLACK = 1e-6


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def link_vectors(table: DataFrame, *, least: float = 0.98, cell: int = 1_000, max_pivots: int = 4_096) -> DataFrame:
    """One row per row of table (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when labels are equal and not null, lengths are equal and the cosine in double precision is at least
    ``least``. Vectors that are null, empty, zero or hold null or non-finite components link with nothing: they are
    their own component. A null vec_id gets a null component and is kept. Rows that repeat a vec_id are vectors of their own.
    ``max_pivots`` bounds what is broadcast (pivots x dimensions doubles).
    """
    spark = table.sparkSession
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    finite = ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("e", lambda v: v != 0)
    usable = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(usable).select("vec_id", F.array_join(F.array(F.col("label").cast("string"), F.size("e").cast("string")), "/").alias("part"), "e")
    reps = saved(good.groupBy("part", "e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "vectors")

    # Pivots: a share of each larger part's vectors, the ones with the smallest hashes.
    sizes = reps.groupBy("part").count()
    total = max(1, reps.count())
    share = F.least(F.ceil(F.col("count") / cell), F.floor(F.col("count") * max_pivots / total))
    shares = saved(sizes.select("part", "count", share.alias("n")), "shares")
    split = shares.where("n >= 2").select("part", "n")
    large = reps.join(split.select("part"), "part", "left_semi")
    # A cut by hash leaves about twice as many as wanted; only those are ranked.
    place = F.xxhash64("rep").bitwiseAND(F.lit(2**53 - 1)) / float(2**53)
    few = large.select("part", "rep", place.alias("place")).join(shares, "part").where(F.col("place") < (2 * F.col("n") + 100) / F.col("count"))
    row = F.row_number().over(Window.partitionBy("part").orderBy("place", "rep"))
    chosen = few.withColumn("r", row).where("r <= n").select("part", "rep", "r")
    pivots = saved(chosen.join(reps, ["part", "rep"]).select("part", F.col("r").cast("int").alias("r"), "e"), "pivots")
    by_part: dict = {}
    for p in pivots.orderBy("part", "r").collect():
        by_part.setdefault(p.part, []).append(p.e)
    shared = spark.sparkContext.broadcast({k: _unit(v) for k, v in by_part.items()})
    reach = float(np.sqrt(2 - 2 * least)) + SLACK

    def distances(batch):
        for part, g in batch.groupby("part"):
            x, p = _unit(g.e), shared.value[part]
            yield g, p, np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))

    def home(batches):
        for b in batches:
            for g, _, d in distances(b):
                k = d.argmin(axis=1)
                yield pd.DataFrame({"part": g.part, "cell": k, "rep": g.rep, "m": g.m, "e": g.e, "d": d[np.arange(len(k)), k]})

    homes = saved(large.mapInPandas(home, "part string, cell int, rep long, m long, e array<double>, d double"), "homes")
    cells = homes.groupBy("part", "cell").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius: dict = {}
    blocks: dict = {}
    for c in cells:  # bounded by max_pivots
        radius[c.part, c.cell] = c.radius
        blocks[c.part, c.cell] = -(-c.n // BLOCK)
    extent = spark.sparkContext.broadcast((radius, blocks))

    def deal(batches):
        """Groups are pairs (x, y) of a cell's blocks: members of x meet candidates of y. Where x = y members are candidates too."""
        radius, blocks = extent.value
        for b in batches:
            for g, p, d in distances(b):
                part, out = g.part.iloc[0], []
                r = np.array([radius.get((part, k), -np.inf) for k in range(len(p))])
                own = d.argmin(axis=1)
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                base = d[np.arange(len(own)), own]
                gap = between[own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gap > 1e-9, (d**2 - base[:, None] ** 2) / (2 * gap), 0)
                to = (d <= r + reach) & (d - base[:, None] <= 2 * reach) & (plane <= reach)
                to[np.arange(len(own)), own] = True
                reps_, ms, es = g.rep.to_numpy(), g.m.to_numpy(), list(g.e)
                for i, k in zip(*to.nonzero()):
                    n = blocks.get((part, int(k)), 0)
                    at = int(reps_[i]) % n if n else 0
                    row = (int(reps_[i]), int(ms[i]), es[i])
                    out += [(part, int(k), x, at, *row, False) for x in range(n) if x != at or k != own[i]]
                    out += [(part, int(k), at, y, *row, True) for y in range(n) if k == own[i]]
                yield pd.DataFrame(out, columns=["part", "cell", "x", "y", "rep", "m", "e", "own"])

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rep", "own"], ignore_index=True)
        x, m, rep = _unit(g.e), g.m.to_numpy(), g.rep.to_numpy()
        own = g.own.to_numpy().nonzero()[0]
        others = np.arange(len(g)) if g.x.iloc[0] == g.y.iloc[0] else (~g.own.to_numpy()).nonzero()[0]
        parent = np.arange(len(g))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links = np.zeros(len(g), np.int64)
        for i in range(0, len(own), 256):
            rows = own[i : i + 256]
            near = (x[rows] @ x[others].T >= least) | (rows[:, None] == others)
            links[rows] = near @ m[others]
            for j, k in zip(rows, near):
                for q in others[k.nonzero()[0]]:
                    a, b = root(j), root(q)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        roots = np.array([root(i) for i in range(len(g))], int)
        edges = roots != np.arange(len(g))
        counted = pd.DataFrame({"rep": rep[own], "n_links": links[own], "b": rep[own], "kind": 0})
        forest = pd.DataFrame({"rep": rep[edges], "n_links": 0, "b": rep[roots[edges]], "kind": 1})
        return pd.concat([counted, forest])

    dealt = homes.select("part", "rep", "m", "e").mapInPandas(deal, "part string, cell int, x int, y int, rep long, m long, e array<double>, own boolean")
    # Parts of one cell are dealt out alike.
    n = F.ceil(F.col("count") / BLOCK).cast("int")
    single = reps.join(shares.where("n < 2").select("part", n.alias("n")), "part").withColumn("at", F.pmod("rep", F.col("n").cast("long")).cast("int"))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    to = F.concat(F.transform(every, lambda y: F.struct(F.col("at").alias("x"), y.alias("y"), F.lit(True).alias("own"))), F.transform(F.filter(every, lambda x: x != F.col("at")), lambda x: F.struct(x.alias("x"), F.col("at").alias("y"), F.lit(False).alias("own"))))
    single = single.withColumn("to", F.explode(to))
    dealt = dealt.unionByName(single.select("part", F.lit(0).alias("cell"), "to.x", "to.y", F.col("rep").cast("long").alias("rep"), "m", "e", "to.own"))
    got = saved(dealt.groupBy("part", "cell", "x", "y").applyInPandas(join, "rep long, n_links long, b long, kind int"), "vector-links")
    shared.destroy()
    extent.destroy()
    forget(homes)
    found = components(got.where("kind = 1").select(F.col("rep").alias("a"), "b"))
    # Every vector has met itself once.
    counts = got.where("kind = 0").groupBy("rep").agg((F.sum("n_links") - 1).alias("n_links"))
    result = reps.select("part", "e", "rep").join(counts, "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    result = result.select(F.col("part").alias("_part"), F.col("e").alias("_e"), "n_links", F.coalesce("component_id", "rep").alias("c"))
    linked = good.join(result, (F.col("part") == F.col("_part")) & (F.col("e") == F.col("_e"))).select("vec_id", "n_links", F.col("c").alias("component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def vectors_query(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, min(r.c) AS component_id, min(r.c) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
GROUP BY e.vec_id, n.n
"""
