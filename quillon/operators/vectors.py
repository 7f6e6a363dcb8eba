"""Exact inner-product search over stored embeddings, and a vector cache keyed by content and model."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexical import few, top

#: From so many queries on, vectors and queries meet in blocks, of so many vectors and so many queries.
MANY_QUERIES, VECTOR_BLOCK, QUERY_BLOCK = 17, 8192, 4096
#: Queries and vectors whose products are added up together: small enough for a core's cache.
TILE_QUERIES, TILE_VECTORS = 64, 1024


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors (path, embedding, ...) and queries (query_id, vector): the k nearest with score in [0, 1], raw and rank.

    Ranked by the raw product, so clamping makes no ties; ties by path. The best vector of a path counts. A few queries
    are compared row by row, more in blocks, with the same products bit by bit.
    """
    raw = in_blocks(vectors, queries, 3 * k) if queries.limit(MANY_QUERIES).count() == MANY_QUERIES else by_row(vectors, queries)
    best = top(raw, 3 * k, F.desc("raw"), F.asc("path"))
    others = [c for c in best.columns if c not in ("query_id", "path", "raw", "rank")]
    best = best.groupBy("query_id", "path").agg(F.max("raw").alias("raw"), *(F.max_by(c, "raw").alias(c) for c in others))
    return top(best.withColumn("score", clamped(F.col("raw"))), k, F.desc("raw"), F.asc("path"))


def by_row(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    return vectors.crossJoin(few(queries, "vector")).withColumn("raw", inner_product(F.col("embedding"), F.col("vector"))).drop("embedding", "vector")


def in_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The rows of by_row that can be among the k first of their query: the k first of each block of vectors.

    Every block of vectors meets every block of queries in a group of its own, so a task's memory depends on neither table.
    """
    nv, nq = (max(1, -(-df.count() // n)) for df, n in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK)))
    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    doubles = lambda c: F.col(c).cast("array<double>").alias(c)
    rest = [c for c in vectors.columns if c != "embedding"]
    left = vectors.select(*rest, doubles("embedding"), block(nv, "path", "embedding").alias("_v"), every(nq).alias("_q"))
    right = queries.select("query_id", doubles("vector"), every(nv).alias("_v"), block(nq, "query_id", "vector").alias("_q"))
    schema = T.StructType([queries.schema["query_id"], *(vectors.schema[c] for c in rest), T.StructField("raw", T.DoubleType())])
    return left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInArrow(lambda v, q: best_of_block(v, q, k, rest), schema)


def dense(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: rows that have a vector without nulls, and their components, one line each."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values, size = flat.to_numpy(zero_copy_only=False), np.maximum(n, 0)
    start = np.cumsum(size) - size
    if flat.null_count:
        n[np.repeat(np.arange(len(n)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    found = {int(x): np.flatnonzero(n == x) for x in np.unique(n) if x >= 0}
    return {x: (rows, np.ascontiguousarray(values[start[rows] + np.arange(x)[:, None]], np.float64)) for x, rows in found.items()}


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all columns of q with all of v, added up component by component as inner_product does."""
    out = np.zeros((q.shape[1], v.shape[1]))
    for a in range(0, v.shape[1], TILE_VECTORS):
        part = np.zeros((q.shape[1], min(TILE_VECTORS, v.shape[1] - a)))
        one = np.empty_like(part)
        for x, y in zip(q, v[:, a : a + TILE_VECTORS]):
            np.multiply(x[:, None], y, out=one)
            part += one
        out[:, a : a + TILE_VECTORS] = part
    return out


def best_of_block(vectors: pa.Table, queries: pa.Table, k: int, rest: list[str]) -> pa.Table:
    """The k first vectors of each query, by raw product and path; as in Spark NaN comes before all numbers, null after them."""
    vectors = vectors.take(pc.sort_indices(vectors, sort_keys=[("path", "ascending")], null_placement="at_start"))
    have, asked = dense(vectors["embedding"]), dense(queries["vector"])
    found = []
    with np.errstate(all="ignore"):
        for a in range(0, queries.num_rows if vectors.num_rows else 0, TILE_QUERIES):
            n = min(TILE_QUERIES, queries.num_rows - a)
            key, kind = np.full((n, vectors.num_rows), np.inf), np.full((n, vectors.num_rows), 2, np.uint8)
            for size in have.keys() & asked.keys():
                (rows, v), (at, q) = have[size], asked[size]
                here = (at >= a) & (at < a + n)
                raw = products(q[:, here], v)
                cells, odd = np.ix_(at[here] - a, rows), np.isnan(raw)
                key[cells], kind[cells] = np.where(odd, -np.inf, -raw), np.where(odd, 0, 1)
            last = np.partition(key, k - 1, axis=1)[:, k - 1 : k] if key.shape[1] > k else np.inf
            i, j = np.nonzero(key <= last)
            order = np.lexsort((j, key[i, j], kind[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[first], j[first]
            found.append((i + a, j, -key[i, j], kind[i, j]))
    i, j, raw, kind = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint8))
    raw = pa.array(np.where(kind == 0, np.nan, raw), mask=kind == 2, from_pandas=False)
    return pa.table({"query_id": queries["query_id"].take(pa.array(i)), **{c: vectors[c].take(pa.array(j)) for c in rest}, "raw": raw})


def cache_split(current: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """current (relative_path, content_hash, ...) with its cached embedding of this model, or null where it must be made.

    Where the cache has paths, the entry of the same path and content comes before others of that content.
    """
    own = cache.where(F.col("model") == model)
    by_content = own.groupBy("content_hash").agg(F.first("embedding").alias("embedding"))
    if "relative_path" not in cache.columns:
        return current.join(by_content, "content_hash", "left")
    by_path = own.groupBy("relative_path", "content_hash").agg(F.first("embedding").alias("_same"))
    both = current.join(by_path, ["relative_path", "content_hash"], "left").join(by_content, "content_hash", "left")
    return both.withColumn("embedding", F.coalesce("_same", "embedding")).drop("_same")


def cache_stats(split: DataFrame) -> DataFrame:
    """total, cached and new vectors, as one row."""
    have = F.col("embedding").isNotNull()
    return split.agg(F.count(F.lit(1)).alias("total"), F.count_if(have).alias("cached"), F.count_if(~have).alias("new"))
