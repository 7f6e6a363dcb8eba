"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with
temperature-calibrated probabilities.

Inputs of a score are the text alone. Labels, lang, source and doc_id never enter a score.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod
from .features import TextModel, fit, scorer

#: Bound on the labelled rows a model is fitted on; chosen by a hash of doc_id, so alike at every size.
MAX_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, target, max_rows: int) -> DataFrame:
    """At most max_rows documents (text, y): ids with the smallest hashes among the labelled ones, one label an id.

    A doc_id labelled twice takes its largest label; of rows that repeat a doc_id the smallest text counts, so the bound
    holds for rows too; null labels and null ids are left out.
    """
    ids = labels.withColumn("y", target).where("doc_id is not null and y is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> TextModel:
    """Learn labels.quality (0 or 1) from rows whose crc32(doc_id) mod 3 is not 1."""
    usable = labels.where((crc_mod("doc_id", 3) != 1) & F.col("quality").isin(0, 1))
    return fit(labelled_sample(docs, usable, F.col("quality"), max_rows))


def score_quality(docs: DataFrame, model: TextModel) -> DataFrame:
    """docs with held_out, score (probability of label 1) and predicted added; every row and whole text is scored.

    Null and empty texts get the score of a document without words. Without usable labels every score is 0.5. Input
    columns named held_out, score or predicted are replaced; other columns stay.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if not model.classes:
        score = F.lit(0.5)
    else:
        at = model.classes.index(1) if 1 in model.classes else None
        score = F.lit(0.0) if at is None else scorer(model, spark)(F.col("text"))["p"][at]
    scored = docs.withColumn("score", score.cast("double"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the columns of docs, whatever their names.

    Null and empty texts are judged as documents without words; repeated rows alike. Without usable labels all rows stay.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text")
    return score_quality(rows, fit_quality(docs, labels)).where("predicted = 1").select("_row.*")


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels)).select("doc_id", "held_out", "score", "predicted")
