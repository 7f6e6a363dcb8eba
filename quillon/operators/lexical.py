"""Symbol-name and path scores, and the linear combination of the keyword tier."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import search_terms
from ..functions.text import query_words
from ..sources.tables import saved
from . import bm25

WEIGHTS = {"keyword": 0.5, "name": 0.3, "path": 0.2}
#: Queries, and characters or vector components of theirs, that are broadcast to all files; a larger batch is left to the planner.
FEW_QUERIES, FEW_CELLS = 10_000, 16_000_000


def name_score(query: Column, names: Column, tokens: Column | None = None) -> Column:
    """Best over names: equal 1, query within name 0.7, name within query 0.5, any query word within name 0.3; 0 if none.

    tokens: the query's words, where they are at hand; else they are split anew for every name of every row.
    """
    q, tokens = F.lower(query), query_words(query) if tokens is None else tokens

    def one(name):
        n = F.lower(name)
        return F.when(n == q, 1.0).when(F.contains(n, q), 0.7).when(F.contains(q, n), 0.5).when(F.exists(tokens, lambda t: F.contains(n, t)), 0.3).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(names, one)), F.lit(0.0))


def path_score(query: Column, path: Column, tokens: Column | None = None) -> Column:
    """1 if the whole query is in the path, else 0.6 times the share of query words that are."""
    p, tokens = F.lower(path), query_words(query) if tokens is None else tokens
    share = F.size(F.filter(tokens, lambda t: F.contains(p, t))) / F.size(tokens)
    return F.when(F.contains(p, F.lower(query)), 1.0).when(F.size(tokens) == 0, 0.0).otherwise(share * 0.6)


def matched_terms(query: Column, names: Column, path: Column, most: int = 10) -> Column:
    """For each query word the names that hold it and the path if it does; each once, in order, the first ten."""
    none = F.array().cast("array<string>")
    per = F.transform(query_words(query), lambda t: F.concat(F.filter(names, lambda n: F.contains(F.lower(n), t)), F.when(F.contains(F.lower(path), t), F.array(path)).otherwise(none)))
    return F.slice(F.array_distinct(F.flatten(per)), 1, most)


def few(queries: DataFrame, content: str = "query") -> DataFrame:
    """queries, to be broadcast if they are few and small; content is their text or vector."""
    size = F.size(content) if dict(queries.dtypes)[content].startswith("array") else F.length(content)
    n, cells = queries.limit(FEW_QUERIES + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(queries) if n <= FEW_QUERIES and (cells or 0) <= FEW_CELLS else queries


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows of each query with their rank; the planner cuts each partition to k before the rows move."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def corpus_of(files: DataFrame) -> DataFrame:
    return files.select(F.col("relative_path").alias("id"), search_terms(files).alias("terms"))


def fast_search(files: DataFrame, queries: DataFrame, k: int, *, posted=None, lengths=None, stats=None) -> DataFrame:
    """queries (query_id, query) over index rows: query_id, path, score, match_type, matched_terms, metadata, rank.

    Ranked by the unrounded score, ties by path; the score is rounded to four places after ranking.
    """
    asked = queries.select("query_id", query_words("query").alias("terms"))
    # Scores of a corpus without postings cost a pass over its words, and are read twice.
    keyword = saved(bm25.search(asked, corpus_of(files)), "keyword-scores") if posted is None else bm25.scores(asked, posted, lengths, stats)
    best = keyword.groupBy("query_id").agg(F.max("bm25").alias("best"))
    keyword = keyword.join(best, "query_id").select("query_id", F.col("id").alias("relative_path"), (F.col("bm25") / F.col("best")).alias("keyword"))
    names = F.concat("functions", "classes")
    each = files.select("relative_path", "functions", "classes", "imports", "language", "size", "line_count").crossJoin(few(queries.select("query_id", "query", query_words("query").alias("tokens"))))
    each = each.withColumns({"name": name_score(F.col("query"), names, F.col("tokens")), "path_s": path_score(F.col("query"), F.col("relative_path"), F.col("tokens"))}).drop("tokens")
    both = each.join(keyword, ["query_id", "relative_path"], "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    found = both.where("keyword > 0 or name > 0 or path_s > 0")
    score = WEIGHTS["keyword"] * F.col("keyword") + WEIGHTS["name"] * F.col("name") + WEIGHTS["path"] * F.col("path_s")
    ranked = top(found.withColumn("score", score), k, F.desc("score"), F.asc("relative_path"))
    positive = sum(F.when(F.col(c) > 0, 1).otherwise(0) for c in ("keyword", "name", "path_s"))
    kind = F.when(positive > 1, "composite").when(F.col("keyword") > 0, "keyword").when(F.col("name") > 0, "name").otherwise("path")
    counts = [F.size(c).alias(c) for c in ("functions", "classes", "imports")]
    return ranked.select(
        "query_id", F.col("relative_path").alias("path"), F.round("score", 4).alias("score"), kind.alias("match_type"),
        matched_terms(F.col("query"), names, F.col("relative_path")).alias("matched_terms"), F.struct("language", "size", "line_count", *counts).alias("metadata"), "rank",
    )
