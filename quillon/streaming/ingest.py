"""Keep an index up to date from a stream of changed files: each micro-batch replaces the rows of its paths.

The tables made of the files are then written anew, as Engine.index does, and switched together; vectors only where the
index has some.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content_hash
from ..plans.engine import Engine
from ..sources import store
from ..sources.files import indexed


def upsert(spark: SparkSession, folder: str, batch: DataFrame) -> None:
    """Rows of batch (index columns and modified_time) over those in the folder; of several for a path the newest counts."""
    row = F.row_number().over(Window.partitionBy("relative_path").orderBy(F.desc("modified_time"), F.desc("content_hash")))
    fresh = batch.withColumn("content_hash", content_hash("text")).withColumn("_n", row).where("_n = 1").drop("_n", "content_hash")
    rows = indexed(fresh)
    to = store.Version(spark, folder)
    old, manifest = to.read("files"), to.read("manifest")
    if old is not None:
        rows = old.join(rows.select("relative_path"), "relative_path", "left_anti").select(*rows.columns).unionByName(rows)
    to.write(rows, "files")
    made = None if manifest is None else manifest.first()
    engine = Engine(spark, made.root_path, Config(embedding_model=made.model), folder) if made else Engine(spark, "", index=folder)
    engine.derive(to)
    if to.read("vectors") is not None:
        engine.embed(to)
    to.commit()


def follow(spark: SparkSession, source: str, schema, folder: str, checkpoint: str):
    """A started query over Parquet files of scanned rows that arrive in source; available rows are taken, then it ends."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: upsert(spark, folder, batch)).start()
