"""Language ID: multinomial naive Bayes over hashed character n-grams.

The matrix of log probabilities (n-gram bucket by language) is broadcast in blocks of at most ``max_languages``
languages, one pass over the documents for each block. Documents are scored in numpy from their sparse bucket counts.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, documents, saved, unused

#: Documents of each language that the model is fitted on, chosen by a hash of doc_id.
MAX_ROWS = 2_000
LETTER = re.compile(r"[^\W\d_]")
SLICE = 1 << 16


def buckets_of(text: str, buckets: int):
    """Buckets of the 1- to 3-grams of code points of the lower-cased text, slice by slice; a slice overlaps the next by two."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    for i in range(0, len(points), SLICE):
        c = points[i : i + SLICE + 2]
        own = min(SLICE, len(points) - i)
        one = c * np.uint32(0x9E3779B1)
        yield (one[:own] >> np.uint32(8)) % buckets
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        yield (two[:own] >> np.uint32(8)) % buckets
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        yield (three[:own] >> np.uint32(8)) % buckets


def counts_of(text: str, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for b in buckets_of(text, buckets):
        out += np.bincount(b, minlength=buckets)
    return out


def fit_languages(docs: DataFrame, *, max_rows: int = MAX_ROWS, buckets: int = 1 << 14, max_languages: int = 256):
    """Blocks of (languages, log priors, log probabilities [bucket, language]) from text and lang of rows whose crc32(doc_id) mod 4 isn't 2.

    At most ``max_rows`` documents of each language are read, of rows that repeat a doc_id and lang one (the smallest text); every language is in one block of at most ``max_languages``. None without any.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    usable = docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = saved(usable.groupBy("lang").count(), "languages")
    languages = sorted(r.lang for r in sizes.select("lang").collect())
    if not languages:
        return None
    # A cut by hash leaves about twice the rows wanted of each language, whatever its size; only those are ranked.
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(2**53 - 1)) / float(2**53)
    few = usable.select("lang", "doc_id", place.alias("place")).join(F.broadcast(sizes), "lang").where(F.col("place") < (2 * max_rows + 100) / F.col("count"))
    row = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    ids = few.groupBy("lang", "doc_id", "place").agg(F.count(F.lit(1)).alias("n")).withColumn("n", row).where(F.col("n") <= max_rows).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    ids = saved(ids, "language-ids")
    rows = usable.select("doc_id", "lang", "text").join(ids, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    sample = saved(rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text"), "language-sample")

    def merge(part):
        total = sum(np.frombuffer(x, np.int64) for x in part.counts)
        return pd.DataFrame({"lang": part.lang.iloc[:1], "n": [part.n.sum()], "counts": [total.tobytes()]})

    def fitted(block):
        def count(batches):
            sums = {x: np.zeros(buckets, np.int64) for x in block}
            n = dict.fromkeys(block, 0)
            for b in batches:
                for lang, text in zip(b.lang, b.text):
                    sums[lang] += counts_of(text, buckets)
                    n[lang] += 1
            yield pd.DataFrame([{"lang": x, "n": n[x], "counts": sums[x].tobytes()} for x in block if n[x]])

        kind = "lang string, n long, counts binary"
        own = sample if len(block) == len(languages) else sample.where(F.col("lang").isin(block))
        got = {r.lang: r for r in own.coalesce(16).mapInPandas(count, kind).groupBy("lang").applyInPandas(merge, kind).collect()}
        block = [x for x in block if x in got]
        if not block:
            return None
        counts = np.stack([np.frombuffer(got[x].counts, np.int64) for x in block], axis=1) + 0.1
        return block, np.array([got[x].n for x in block], float), np.log(counts / counts.sum(axis=0)).astype(np.float32)

    blocks = [x for i in range(0, len(languages), max_languages) if (x := fitted(languages[i : i + max_languages]))]
    total = sum(n.sum() for _, n, _ in blocks)
    return [(names, np.log(n / total), logs) for names, n, logs in blocks] or None


def predict_languages(docs: DataFrame, model) -> DataFrame:
    """docs with held_out, lang_pred and score (posterior of lang_pred) added; input columns of these names are replaced.

    Every whole text is read. lang_pred is ``und`` with score 0 where the text is null or has no letter, or where
    nothing could be learned. Ties go to the language that sorts first. Each row is predicted by itself, repeated ones alike.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def scored(block):
        shared = spark.sparkContext.broadcast(block)

        @F.pandas_udf("lang_pred string, z double, mass double")
        def predict(texts: pd.Series) -> pd.DataFrame:
            """The block's best language, its log probability, and the block's probability over that of its best."""
            out = []
            for text in texts:
                if text is None or shared.value is None or not LETTER.search(text):
                    out.append(("und", 0.0, np.inf))
                    continue
                languages, prior, logs = shared.value
                z = prior.copy()
                for b in buckets_of(text, len(logs)):
                    found = np.bincount(b, minlength=len(logs)) if len(b) > len(logs) else None
                    if found is None:
                        z += logs[b].sum(axis=0, dtype=np.float64)
                    else:
                        at = found.nonzero()[0]
                        z += found[at] @ logs[at].astype(np.float64)
                k = int(z.argmax())
                out.append((languages[k], float(z[k]), float(np.exp(z - z[k]).sum())))
            return pd.DataFrame(out, columns=["lang_pred", "z", "mass"])

        return predict(F.col("text"))

    p, q = unused(docs, "p", "q")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    first, *others = model or [None]
    rows = docs.withColumn(p, scored(first))
    for block in others:
        # A table between blocks: a Python worker holds one block only.
        both = saved(rows, "language-block").withColumn(q, scored(block))
        most = F.greatest(f"{p}.z", f"{q}.z")
        mass = F.col(f"{p}.mass") * F.exp(F.col(f"{p}.z") - most) + F.col(f"{q}.mass") * F.exp(F.col(f"{q}.z") - most)
        best = F.when(F.col(f"{q}.z") > F.col(f"{p}.z"), F.col(f"{q}.lang_pred")).otherwise(F.col(f"{p}.lang_pred"))
        rows = both.withColumn(p, F.struct(best.alias("lang_pred"), most.alias("z"), mass.alias("mass"))).drop(q)
    return rows.select(*kept, held.alias("held_out"), f"{p}.lang_pred", (1 / F.col(f"{p}.mass")).alias("score"))


def language_query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict_languages(docs.select("doc_id", "text"), fit_languages(docs)).select("doc_id", "held_out", "lang_pred", "score")
