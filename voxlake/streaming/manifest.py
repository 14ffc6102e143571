"""Streams of manifest rows into a corpus: each micro-batch is an idempotent upsert into a partitioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from voxlake.operators.corpus import preferred


def upsert_batch(rows: DataFrame, batch: int, path: str, keys: tuple[str, ...], order: str) -> None:
    """Writes version `batch` of the corpus at path: the version before with the rows of this batch on top.

    A batch that is run again writes the same version again, so a restart changes nothing.
    """
    spark = rows.sparkSession
    try:
        base = spark.read.parquet(f"{path}/version={batch - 1}") if batch else None
    except AnalysisException:
        base = None
    every = rows if base is None else base.unionByName(rows)
    preferred(every, keys, F.desc(order)).write.mode("overwrite").parquet(f"{path}/version={batch}")


def follow(spark: SparkSession, source: str, schema: str, path: str, keys: tuple[str, ...], order: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follows Parquet files at source into versions of the corpus at path; once: stop when all that is there is in."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda rows, batch: upsert_batch(rows, batch, path, keys, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the corpus at path."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).drop("version")
