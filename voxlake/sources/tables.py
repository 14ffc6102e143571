"""The driver tables, and the grids that are made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def voxels(spark: SparkSession, folder: str) -> DataFrame:
    """A (z, y, x, v) grid from lineitem: month of shipping, part and supplier cells; v is a byte."""
    t = table(spark, folder, "lineitem")
    z = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long")
    cells = t.groupBy(z.alias("z"), (F.col("l_partkey") % 64).alias("y"), (F.col("l_suppkey") % 64).alias("x"))
    return cells.agg((F.sum("l_quantity").cast("long") % 256).alias("v"))


def plane(spark: SparkSession, folder: str) -> DataFrame:
    """A (y, x, v) grid from events: user and hour of the month; v counts events and their value."""
    t = table(spark, folder, "events")
    x = ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("long")
    return t.groupBy((F.col("user_id") % 128).alias("y"), x.alias("x")).agg(F.sum(F.floor("value")).cast("long").alias("v"))
