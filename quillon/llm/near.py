"""MinHash near-dedup with odd sketches.

Documents with equal shingle sets become one. MinHash samples give band keys; the smallest shingle hash of each of
BINS equal ranges (one-permutation MinHash) is folded into a parity bitmap (odd sketch), and the population count of
the XOR of two sketches estimates a high similarity. Documents that share a band key with the bucket's smallest
document (its hub) are candidates if their sketches allow it, and are confirmed on the full sets. In buckets that hold
more than one component after that, the members outside the hub's component are compared by sketch with the others.
"""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, documents, forget, released, saved, unused
from .components import components
from .words import mixed, run_hashes, word_hashes

#: MinHash samples of a band, and the chance that a pair just at the threshold shares no band.
ROWS, MISS = 6, 1e-6
#: Ranges of shingle hashes that give a sample each to the sketch (a power of two), and bits of the sketch.
BINS, SKETCH_BITS = 4096, 4096
#: Members of a bucket that are compared with its unsettled members at once, and pairs of a hub that are confirmed at once.
BLOCK, PAIRS = 1_000, 256

_SHIFT = np.uint64(65 - BINS.bit_length())


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def coefficients(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(0, 2**31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, samples, dtype=np.uint32)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter; none without words."""
    words = word_hashes((text or "").encode("utf-8", "replace").lower())
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(words, min(k, len(words))) + np.uint64(min(k, len(words))))


def minhashes(shingle_set: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = shingle_set.astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), 256):
        h = low[i : i + 256, None] * a
        h += b
        np.minimum(out, h.min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    m = mixed(samples.astype(np.uint64)).reshape(-1, ROWS)
    h = np.arange(len(m), dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
    return h


def odd_sketch(shingle_set: np.ndarray) -> np.ndarray:
    """Bit p is the parity of the samples that hash to p; a sample is the smallest hash of its range, if that has any."""
    bins = shingle_set >> _SHIFT
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    at = mixed(shingle_set[first] * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def most_bits(m, na, nb, percent: int):
    """Largest XOR population count to expect of a pair of sets of these sizes at the threshold; m: numpy, or Spark's functions.

    At similarity j the union has u = (na + nb) / (1 + j) shingles, which fill U of the ranges. A share j of those agrees,
    with the variance of drawing U of u without putting back; where they don't, one sample differs, or two if both sets
    have one. To that comes the variance of samples that share a bit; five deviations in all are allowed.
    """
    j = percent / 100
    filled = lambda n: BINS * (1 - m.exp(n * math.log1p(-1 / BINS)))
    u = (na + nb) / (1 + j)
    used, fa, fb = filled(u), filled(na), filled(nb)
    differ = fa + fb - 2 * j * used
    each = 1 + (fa + fb) / (2 * BINS)
    left = m.exp(differ * (-4 / SKETCH_BITS))
    spread = each * each * used * j * (1 - j) * (1 - used / u) * left + SKETCH_BITS / 4 * (1 - left) - differ * left
    return SKETCH_BITS / 2 * (1 - m.sqrt(left)) + 5 * m.sqrt(spread + 0.5) + 1


def _apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= percent * union of their k-word shingle sets. Null, empty and blank
    texts have no shingles and link with nothing: such a row is its own component. A null doc_id has a null component and is kept. Rows that repeat a
    doc_id are one document, which links as any of its rows does. Columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    samples = ROWS * bands_for(percent)

    @F.pandas_udf("n long, digest binary, keys array<long>, sketch array<long>")
    def signature(texts: pd.Series) -> pd.DataFrame:
        released()
        a, b = coefficients(samples)
        out = []
        for text in texts:
            s = shingles(text, k)
            if not len(s):
                out.append((0, None, None, None))
                continue
            out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(minhashes(s, a, b)).view(np.int64), odd_sketch(s).view(np.int64)))
        return pd.DataFrame(out, columns=["n", "digest", "keys", "sketch"])

    source = docs.select("doc_id", "text")
    signed = saved(source.select("doc_id", F.monotonically_increasing_id().alias("row"), signature("text").alias("s")).select("doc_id", "row", "s.*"), "signatures")
    usable = signed.where("digest is not null and doc_id is not null")
    classes = saved(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("f")).select("digest", F.col("f.doc_id").alias("rep"), F.col("f.row").alias("row")), "set-classes")
    reps = saved(usable.select("row", "n", "keys", "sketch").join(classes.select("row", "rep"), "row").select("rep", "n", "keys", "sketch"), "representatives")

    bands = reps.select("rep", F.explode("keys").alias("key"))
    buckets = saved(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub")).where("size > 1"), "buckets")
    members = saved(bands.join(buckets, "key").select("key", "size", "hub", "rep"), "members")
    forget(buckets)
    sketches = reps.select("rep", "n", "sketch")

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches allow the similarity."""
        left = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        return pairs.join(right, "b").join(left, "a").where(sizes & (_apart("sa", "sb") <= most_bits(F, F.col("na"), F.col("nb"), percent))).select("a", "b")

    @F.pandas_udf("array<long>")
    def full_set(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, k).view(np.int64) for t in texts])

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full sets are similar enough; sets are made again from the texts of these documents only.

        A document of many pairs is dealt out with its set once for each PAIRS of them.
        """
        pairs = saved(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = source.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), full_set("text").alias("s"))
        sets = saved(sets, f"{name}-sets")
        parts = saved(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts")), f"{name}-parts")
        dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
        one = parts.join(sets, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("s").alias("sa"))
        both = dealt.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(one, ["a", "part"])
        common = F.size(F.array_intersect("sa", "sb"))
        out = saved(both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"), f"{name}-links")
        forget(pairs, sets, parts)
        return out

    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(close(stars), "star")
    # A doc_id with several sets ties their classes together.
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    tied = usable.join(several, "doc_id", "left_semi").join(classes.drop("row"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = saved(components(links.unionByName(tied)), "components")

    # What a star can't see: members of a bucket that aren't linked with its hub but with one another.
    place = found.select(F.col("id").alias("rep"), "component_id")
    placed = members.join(place, "rep", "left").select("key", "size", "hub", "rep", F.coalesce("component_id", "rep").alias("c"))
    shares = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("c", "m").alias("main"))
    unsettled = saved(shares.where("kinds > 1").select("key", "main"), "unsettled")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = placed.join(unsettled, "key").withColumn("free", F.col("c") != F.col("main")).withColumn("at", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    # Free members go to every block, those of the largest component to their own.
    to = F.when(F.col("free"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("at"))
    dealt = dealt.withColumn("block", F.explode(to)).select("key", "block", "rep", "c", "free", (F.col("at") == F.col("block")).alias("own"))

    def across(g: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a free member and one of this block, in different components, whose sizes and sketches allow the similarity.

        A pair counts in the first of its buckets only.
        """
        s, c, rep, n, keys = np.stack(g.sketch).view(np.uint64), g.c.to_numpy(), g.rep.to_numpy(), g.n.to_numpy().astype(float), np.stack(g["keys"])
        free, own, key = g.free.to_numpy(), g.own.to_numpy().nonzero()[0], g.key.iloc[0]
        most = most_bits(np, n.max(), n.max(), percent)
        words = s[own].T.copy()
        out = []
        for rows in np.array_split(free.nonzero()[0], max(1, free.sum() // 64)):
            apart = np.zeros((len(rows), len(own)), np.uint16)
            for w, column in enumerate(words):
                apart += np.bitwise_count(s[rows, w, None] ^ column)
            x, y = (apart <= most).nonzero()
            bits, x, y = apart[x, y], rows[x], own[y]
            fit = (c[x] != c[y]) & (~free[y] | (rep[x] < rep[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            fit[fit] = bits[fit] <= most_bits(np, n[x[fit]], n[y[fit]], percent)
            x, y = x[fit], y[fit]
            first = (keys[x] == keys[y]).argmax(axis=1)
            x, y = (side[keys[x, first] == key] for side in (x, y))
            out.append(np.stack([rep[x], rep[y]], axis=1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    # As many tasks as shuffle partitions: small rows, but much work for each.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(reps, "rep").repartition(tasks, "key", "block")
    rest = saved(dealt.groupBy("key", "block").applyInPandas(across, "a long, b long"), "rest")
    forget(members, unsettled)
    if not rest.isEmpty():
        more = confirmed(rest, "rest")
        if not more.isEmpty():
            found = saved(components(more.unionByName(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")))), "components")
    root = classes.join(found.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select(F.col("digest").alias("_d"), F.coalesce("component_id", "rep").alias("_c"))
    result = signed.select("doc_id", "n", "digest").join(root, (F.col("digest") == F.col("_d")) & F.col("doc_id").isNotNull(), "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one document of each group, with the columns of docs, whatever their names.

    Rows with a null doc_id, and with null, empty or blank texts, stay. All rows of a doc_id stay or go together.
    """
    (key,) = unused(docs, "id")
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(saved(gone, "near-copies"), F.col("doc_id") == F.col(key), "left_anti")


def near_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT r.id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = r.id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.id
GROUP BY r.id
"""
