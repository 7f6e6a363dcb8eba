"""Okapi BM25 over postings tables.

The published formula with k1 = 1.5 and b = 0.75; a negative inverse document frequency becomes a quarter of the mean
one. Statistics are ordinary aggregates over (id, term, tf), so an index can store them and a query reads the postings
of its own terms only.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved

K1, B, FLOOR = 1.5, 0.75, 0.25


def postings(corpus: DataFrame) -> DataFrame:
    """corpus (id, terms) to (id, term, tf), for an index to keep; a query over a corpus without one is ``search``."""
    return corpus.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(corpus: DataFrame) -> DataFrame:
    return corpus.select("id", F.size("terms").cast("long").alias("dl"))


def term_stats(posted: DataFrame, lengths: DataFrame) -> DataFrame:
    """(term, df, idf) of (id, term, ...), each pair once, and a row for each id."""
    return with_idf(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), lengths.agg(F.count(F.lit(1)).alias("n")))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """(term, df, idf) of corpus (id, terms): a row's terms are made distinct in the row, so counts combine before they move."""
    df = corpus.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return with_idf(df, corpus.agg(F.count(F.lit(1)).alias("n")))


def with_idf(df: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf) with the floor applied; the corpus size (n) and the mean are one-row frames."""
    raw = df.crossJoin(F.broadcast(size)).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def asked_terms(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """queries (query_id, terms) to (query_id, term, qtf, idf). A term counts as often as the query has it."""
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return asked.join(stats.select("term", "idf"), "term")


def summed(hits: DataFrame) -> DataFrame:
    """hits (query_id, id, qtf, idf, tf, dl, avgdl) to (query_id, id, bm25), positive scores only.

    Scores keep nine places: equal texts tie, in whatever order their terms were added up.
    """
    tf = F.col("tf")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * weight), 9).alias("bm25")).where("bm25 > 0")


def scores(queries: DataFrame, posted: DataFrame, lengths: DataFrame, stats: DataFrame) -> DataFrame:
    """queries (query_id, terms) to (query_id, id, bm25), positive scores only. Reads the postings of the queries' terms."""
    average = lengths.agg(F.avg("dl").alias("avgdl"))
    return summed(posted.join(asked_terms(queries, stats), "term").join(lengths, "id").crossJoin(F.broadcast(average)))


def search(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """As scores, over corpus (id, terms) that has no postings: only the terms asked for are counted by document."""
    asked = sized(asked_terms(queries, corpus_stats(corpus)))
    average = corpus.agg(F.avg(F.size("terms")).alias("avgdl"))
    hits = corpus.select("id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    hits = hits.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return summed(hits.join(asked, "term").crossJoin(F.broadcast(average)))


def sized(asked: DataFrame) -> DataFrame:
    """Asked terms as a saved table, for the planner to broadcast if it is small."""
    return saved(asked, "asked-terms")


def batch_postings(corpus: DataFrame) -> DataFrame:
    """corpus (id, terms), dealt out by id, to (id, term, tf, dl): for batches of long queries, which ask for most postings."""
    return corpus.select("id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def batch_scores(queries: DataFrame, posted: DataFrame, lengths: DataFrame, stats: DataFrame) -> DataFrame:
    """As scores, with dl in posted: queries come to the postings, and hits are summed before they move."""
    average = lengths.agg(F.avg("dl").alias("avgdl"))
    return summed(posted.join(sized(asked_terms(queries, stats)), "term").crossJoin(F.broadcast(average)))
