"""Dependency edges from import strings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import LANGUAGE_OF
from ..sources.tables import saved


def file_names(files: DataFrame) -> DataFrame:
    """(relative_path, short, key): the dotted path of files (relative_path) without its extension, and their short names."""
    path = F.col("relative_path")
    last = F.regexp_extract(path, r"\.([^./]+)$", 1)
    bare = F.when(last.isin(*LANGUAGE_OF), F.left(path, F.length(path) - F.length(last) - 1)).otherwise(path)
    dotted = F.translate(bare, "/\\", "..")
    stem = F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^(.+?)(?:\.[^.]+)?$", 1)
    keys = F.array(F.struct(F.lit(0).alias("short"), dotted.alias("key")), F.struct(F.lit(1).alias("short"), F.substring_index(dotted, ".", -1).alias("key")), F.struct(F.lit(1).alias("short"), stem.alias("key")))
    return files.select("relative_path", F.explode(keys).alias("k")).select("relative_path", "k.*")


def module_lookup(files: DataFrame) -> DataFrame:
    """(key, target): the names that files (relative_path) can be imported by.

    A file's dotted path without its extension outranks the short names (last dotted part, file stem). Of several
    files with the same dotted path the last by path has it, of several with the same short name the first.
    """
    return targets(file_names(files))


def targets(names: DataFrame) -> DataFrame:
    whole = F.max(F.when(F.col("short") == 0, F.col("relative_path")))
    short = F.min(F.when(F.col("short") == 1, F.col("relative_path")))
    return names.groupBy("key").agg(F.coalesce(whole, short).alias("target"))


def dependency_edges(files: DataFrame) -> DataFrame:
    """files (relative_path, imports) to distinct (src, dst): by the whole import, else by its last part; no self edges.

    The distinct imports are resolved, and only the names they ask for are looked up, so that what is joined, sorted and
    held by a task is their number and not that of the files; stored, for the planner to broadcast them if they are few.
    """
    name = lambda i: F.replace(F.replace(i, F.lit("/"), F.lit(".")), F.lit("::"), F.lit("."))
    wanted = files.select(F.col("relative_path").alias("src"), F.explode(F.array_distinct(F.transform("imports", name))).alias("i"))
    asked = saved(wanted.select("i").distinct().withColumn("l", F.substring_index("i", ".", -1)), "imports")
    keys = asked.select(F.explode(F.array("i", "l")).alias("key")).distinct()
    lookup = targets(file_names(files).join(saved(keys, "import-names"), "key", "left_semi"))
    full = lookup.select(F.col("key").alias("i"), F.col("target").alias("by_full"))
    last = lookup.select(F.col("key").alias("l"), F.col("target").alias("by_last"))
    found = asked.join(full, "i", "left").join(last, "l", "left").select("i", F.coalesce("by_full", "by_last").alias("dst")).where("dst is not null")
    return wanted.join(saved(found, "resolved-imports"), "i").where("dst <> src").select("src", "dst").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(path, imports, dependents), sorted lists; for export."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("imports"))
    back = edges.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))
    none = F.array().cast("array<string>")
    return out.join(back, "path", "full_outer").select("path", F.coalesce("imports", none).alias("imports"), F.coalesce("dependents", none).alias("dependents"))


def resolve_target(files: DataFrame, wanted: str) -> str | None:
    """The file meant: exactly, else the first by path that ends with the argument or that the argument ends with."""
    p = F.col("relative_path")
    found = files.where((p == wanted) | p.endswith(wanted) | F.lit(wanted).endswith(p)).orderBy((p != wanted).cast("int"), p).select(p).limit(1).collect()
    return found[0][0] if found else None


def related(edges: DataFrame, target: str, similar: DataFrame | None, k: int) -> DataFrame:
    """file_path, relationship, score: imports and dependents at 1, then similar (path, score, rank); each file once, not the target."""
    out = edges.where(F.col("src") == target).select(F.col("dst").alias("file_path"), F.lit("imports").alias("relationship"), F.lit(1.0).alias("score"), F.lit(0).alias("kind"))
    out = out.unionByName(edges.where(F.col("dst") == target).select(F.col("src").alias("file_path"), F.lit("imported_by").alias("relationship"), F.lit(1.0).alias("score"), F.lit(1).alias("kind")))
    if similar is not None:
        out = out.unionByName(similar.select(F.col("path").alias("file_path"), F.lit("semantically_similar").alias("relationship"), F.round("score", 4).alias("score"), F.lit(2).alias("kind")))
    once = out.where(F.col("file_path") != target).groupBy("file_path").agg(F.min_by(F.struct("relationship", "score", "kind"), "kind").alias("r")).select("file_path", "r.*")
    return once.orderBy(F.desc("score"), "kind", "file_path").limit(k).select("file_path", "relationship", "score")
