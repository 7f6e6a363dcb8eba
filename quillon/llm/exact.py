"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text's white space is normalised and cut where its own content says so. Chunks are deduplicated by hash and content
together: a hash that stands for one content is that content's verified identifier; contents that share a hash get
(hash, rank). A document's recipe is the ordered list of identifiers. Only recipes are grouped and compared.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, saved, unused

#: Runs of white space that aren't already one space.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: A chunk ends after 512 code points at the next cut pattern, or at 4096.
CHUNK = r"(?s).{512,4095}?(?:[aeiou][nrst]\x20|[.!?]\x20)|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def _hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def recipes(docs: DataFrame, *, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, recipe (ordered verified chunk identifiers).

    bits: length of the chunk hash; fewer only to test the handling of shared hashes.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    chunked = text.select("doc_id", F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"), F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0)).alias("chunks"))
    hashes = F.transform("chunks", lambda c: _hash(c, bits))
    plain = F.transform("chunks", lambda c: F.struct(_hash(c, bits).alias("h"), F.lit(0).alias("v")))
    distinct = chunked.select(F.explode("chunks").alias("c")).select(_hash(F.col("c"), bits).alias("h"), "c").distinct()
    shared = saved(distinct.groupBy("h").count().where("count > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        return saved(chunked.select("doc_id", "text_sha256", plain.alias("recipe")), "recipes")
    # Contents that share a hash: rank them, and look the rank up by hash and content in the documents that hold one.
    variants = saved(distinct.join(shared, "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_set("c")).alias("all")).select("h", F.posexplode("all").alias("v", "c")), "variants")
    rows = saved(chunked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", hashes.alias("hs"), "chunks"), "rows")
    ranked = rows.select("row", F.posexplode("chunks").alias("pos", "c")).withColumn("h", _hash(F.col("c"), bits)).join(variants, ["h", "c"], "left")
    lists = ranked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("v", F.lit(0)).alias("v")))).alias("l"))
    lists = lists.select("row", F.transform("l", lambda x: F.struct(x["h"].alias("h"), x["v"].alias("v"))).alias("recipe"))
    empty = F.array().cast("array<struct<h:bigint,v:int>>")
    return saved(rows.drop("chunks").join(lists, "row", "left").select("doc_id", "text_sha256", F.coalesce("recipe", empty).alias("recipe")), "recipes")


def exact_groups(docs: DataFrame, *, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the smallest doc_id stays; null ids sort last. Rows that
    repeat both doc_id and text count as often as they occur, and one of them stays.
    """
    rec = recipes(docs.select("doc_id", "text"), bits=bits)
    # Equal rows first become one with a count, so a hot group is combined before it moves.
    per = rec.groupBy("recipe", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    groups = rec.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    both = per.join(groups.withColumnRenamed("recipe", "_r"), F.col("recipe") == F.col("_r"))
    copies = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs, whatever their names.

    Null text counts as empty. Of rows that repeat doc_id and text one stays; rows of a doc_id with other texts are judged alone.
    """
    key, sha, own = unused(docs, "id", "sha", "own_sha")
    found = saved(exact_groups(docs), "exact")
    stays = found.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    keyed = docs.withColumn(own, F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))
    left = keyed.join(stays, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left_semi")
    if not found.where("not kept and doc_id <=> keep_id").isEmpty():  # repeated rows
        left = left.dropDuplicates(["doc_id", own])
    return left.select(*docs.columns)


def exact_query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size,
       row_number() OVER (PARTITION BY d.t ORDER BY d.doc_id NULLS LAST) = 1 AS kept, d.text_sha256
FROM d JOIN g ON d.t = g.t
"""
