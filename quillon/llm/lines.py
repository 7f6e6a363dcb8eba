"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches, largest doc_id first. A batch's line keys are merge-anti-joined with the keys that the
runs have already settled, and what is left is added as a new sorted run; runs of a level are compacted into one of
the next level when there are ``fan_in`` of them. The last compaction says which keys are frequent and where they stay.
"""

import contextlib
import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete
from .common import bound_batches, documents, saved, shared_dir

SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """A line's key: white space stripped at both ends, A-Z in lower case, UTF-8."""
    return [x.strip(SPACE) for x in (text or "").encode("utf-8", "replace").lower().split(b"\n")]


def key_hash(key: bytes, least: int) -> bytes | None:
    """128 bits of a key of at least ``least`` code points; None for shorter ones."""
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class Runs:
    """Sorted runs of (key, n_docs, top_id) by level, bucketed by key and sorted in each bucket.

    A new batch is merge-joined with the runs, and runs with one another, bucket by bucket: a run is never moved or
    sorted again.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 2):
        self.spark, self.min_docs, self.fan_in, self.levels = spark, min_docs, fan_in, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: dict[DataFrame, str] = {}

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """One table of the runs, by full outer merges on the key."""
        out, *others = runs
        for r in others:
            r = r.select("key", F.col("n_docs").alias("n2"), F.col("top_id").alias("top2")).hint("merge")
            out = out.join(r, "key", "full_outer").select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.greatest("top_id", "top2").alias("top_id"))
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: (key, n_docs, top_id), each key once, with smaller ids than any before.

        A key that a run has already settled (enough documents there) can't change any more: its largest id is known.
        """
        for r in self.runs():
            batch = batch.join(r.where(F.col("n_docs") >= self.min_docs).select("key").hint("merge"), "key", "left_anti")
        self.put(0, batch)

    def put(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"quillon_run_{uuid.uuid4().hex}"
        with ordered_scans(self.spark):
            rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        run = self.spark.table(name)
        self.names[run] = name
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            self.put(level + 1, self.merged(old))
            self.drop(old)

    def drop(self, runs: list[DataFrame]) -> None:
        for r in runs:
            name = self.names.pop(r)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{shared_dir(self.spark)}/{name}")

    def frequent(self) -> DataFrame:
        """(key, top_id) of the keys of enough documents, as a saved table; the runs are dropped."""
        with ordered_scans(self.spark):
            out = saved(self.merged(self.runs()).where(F.col("n_docs") >= self.min_docs).select("key", "top_id"), "frequent-lines")
        self.drop(self.runs())
        self.levels = []
        return out


@contextlib.contextmanager
def ordered_scans(spark: SparkSession):
    """Spark trusts the order within buckets of one file each, and plans no sort."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dedup_lines(docs: DataFrame, *, least: int = 40, min_docs: int = 5, batch_keys: int = 1_000_000, fan_in: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, text, n_lines, n_dropped, kept_text.

    Null and empty texts are one empty line. Rows that repeat a doc_id count as one document. A null doc_id counts
    as one document smaller than all others. There are three batches, or more where a batch would have over ``batch_keys``
    keys for each shuffle partition. Columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    @F.pandas_udf("array<binary>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([list({h for k in line_keys(t) if (h := key_hash(k, least))}) for t in texts])

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.col("doc_id"), F.col("text"))
    keyed = saved(rows.select("id", hashes("text").alias("keys")).where("size(keys) > 0"), "line-keys")
    runs = Runs(spark, min_docs, fan_in)
    total = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    batches = max(3, -(-total // (batch_keys * runs.buckets)))
    cuts = keyed.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("c")).first().c or []
    bounds = [None, *sorted(set(cuts), reverse=True), None]
    for high, low in zip(bounds, bounds[1:]):
        part = keyed
        if high is not None:
            part = part.where(F.col("id") <= high)
        if low is not None:
            part = part.where(F.col("id") > low)
        # A document counts once for a key, even if its rows repeat; both groupings combine before they move.
        once = part.select("id", F.explode("keys").alias("key")).distinct()
        runs.add(once.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("top_id")))
    frequent = runs.frequent()
    hits = keyed.select("id", F.explode("keys").alias("key")).join(frequent, "key").where("id < top_id")
    dropped = hits.groupBy("id").agg(F.collect_set("key").alias("dropped"))

    @F.pandas_udf("n_lines long, n_dropped long, kept_text string")
    def rewrite(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, dropped):
            lines = (text or "").split("\n")
            kept = lines
            if gone is not None and len(gone):
                gone = {bytes(x) for x in gone}
                kept = [x for x, k in zip(lines, line_keys(text)) if key_hash(k, least) not in gone]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_text"])

    joined = rows.join(dropped.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    return joined.select("doc_id", "text", rewrite("text", "dropped").alias("r")).select("doc_id", "text", "r.*")


def lines_query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, max(doc_id) AS top_id FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL AND l.doc_id < f.top_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (f.k IS NULL OR l.doc_id >= f.top_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k
GROUP BY l.doc_id
"""
