"""Intermediate tables in the folder that driver and executors share."""

import contextlib
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary = WeakKeyDictionary()
_MADE: list[str] = []
#: Rows of a partition where much is made of each row.
ROWS_A_PART = 50_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: one in the warehouse on a cluster, a temporary one in local mode."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base and not context.master.split("[")[0] == "local":
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.intermediate"
    if not base:
        base = _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="quillon-")
        _OWN[context.applicationId] = base
    return f"{base.rstrip('/')}/quillon-{context.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once.

    The table lives until ``forget`` or the end of the application's folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    # The table replaces the shuffles it came from: their files may go when the write ends.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _MADE.append(path)
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in partitions of bounded size, dealt out by keys: the rows of a small file are one partition, however much work each of them is."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_PART))
    return df.repartition(parts, *keys)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read any more."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            delete(t.sparkSession, path)
            if path in _MADE:
                _MADE.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables saved inside are deleted at the end: for work whose result is written inside."""
    n = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[n:]:
            delete(spark, path)
        del _MADE[n:]
