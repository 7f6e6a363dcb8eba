"""Index tables in Parquet, in versions that are switched whole, with a JSON export and import of the keyword tier.

Every table is written to a folder of its own that is never changed. A version is a small file that names the folder of
each table; readers take the newest version that is complete. A writer that dies leaves the version before it in place.
"""

import json
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import delete

MANIFEST = "file_count long, root_path string, version string, created_at timestamp, updated_at timestamp, model string"
TABLES = ("files", "edges", "postings", "doc_len", "term_stats", "vectors", "manifest")
#: Versions that stay for readers that have begun with them.
KEPT = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[tuple[int, dict[str, str]]]:
    """(number, folder of each table) of the versions that can be read, newest first."""
    fs, p = _fs(spark, f"{folder}/versions")
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if not name.isdigit():
            continue
        stream = fs.open(status.getPath())
        try:
            out.append((int(name), json.loads(bytes(stream.readAllBytes()).decode())))
        except ValueError:  # being written
            continue
        finally:
            stream.close()
    return sorted(out, key=lambda x: -x[0])


class Version:
    """The next version of an index: tables of the one before until they are written anew; ``commit`` switches to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.before = versions(spark, folder)
        self.tables = dict(self.before[0][1]) if self.before else {}

    def read(self, table: str) -> DataFrame | None:
        return _read(self.spark, self.folder, self.tables.get(table))

    def write(self, df: DataFrame, table: str, *, sort: str | None = None) -> None:
        """sort: clusters the files by that column, so that row groups can be skipped when it is filtered."""
        if sort:
            df = df.repartitionByRange(F.col(sort)).sortWithinPartitions(sort)
        place = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{place}")
        self.tables[table] = place

    def commit(self) -> None:
        fs, p = _fs(self.spark, f"{self.folder}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        number = 1 + max((int(n) for n in names if n.isdigit()), default=0)
        fs, p = _fs(self.spark, f"{self.folder}/versions/{number}")
        stream = fs.create(p, False)  # of two writers one fails here
        stream.write(json.dumps(self.tables).encode())
        stream.close()
        kept = [self.tables, *(tables for _, tables in self.before[: KEPT - 1])]
        named = {place for tables in kept for place in tables.values()}
        for old, tables in self.before[KEPT - 1 :]:
            for place in set(tables.values()) - named:
                delete(self.spark, f"{self.folder}/{place}")
            delete(self.spark, f"{self.folder}/versions/{old}")
        self.before.insert(0, (number, dict(self.tables)))


def _read(spark: SparkSession, folder: str, place: str | None) -> DataFrame | None:
    if place is None:
        return None
    try:
        return spark.read.parquet(f"{folder}/{place}")
    except (AnalysisException, Py4JError):
        return None


def exists(spark: SparkSession, folder: str, table: str) -> bool:
    found = versions(spark, folder)
    return bool(found) and table in found[0][1]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """None if the table was never written, or its files can't be read as Parquet."""
    found = versions(spark, folder)
    return _read(spark, folder, found[0][1].get(table)) if found else None


def export_json(files: DataFrame, edges: DataFrame, manifest: DataFrame, folder: str) -> None:
    """One index as three folders of JSON, an object a line: files.json, edges.json, manifest.json."""
    files.drop("text").write.mode("overwrite").json(f"{folder}/files.json")
    edges.write.mode("overwrite").json(f"{folder}/edges.json")
    manifest.write.mode("overwrite").json(f"{folder}/manifest.json")


def import_json(spark: SparkSession, folder: str, schema) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (of this schema), edges and manifest of an exported index."""
    read_as = lambda name, kind: spark.read.schema(kind).json(f"{folder}/{name}.json")
    return read_as("files", schema), read_as("edges", "src string, dst string"), read_as("manifest", MANIFEST)
