"""Multi-pass refinement over a grid: every pass blends a scorer's answer over windows and reads the pass before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from voxlake.functions.vectors import quantised, sigmoid


def neighbour_scorer(cells: DataFrame) -> DataFrame:
    """The stand-in for a network: log odds from a cell's value and its previous answer. Adds `d`."""
    return cells.withColumn("d", (F.col("v") - 128) / 32.0 + (F.col("prev") - 128) / 64.0)


def windows_of(cells: DataFrame, size: int, stride: int, offset: int) -> DataFrame:
    """cells once for each window (begins at offset + k * stride along y and x) that holds them."""
    out = cells
    for a in "yx":
        last = F.floor((F.col(a) - offset) / stride)
        first = F.floor((F.col(a) - offset - size) / stride) + 1
        out = out.withColumn(f"w{a}", F.explode(F.sequence(first, last))).withColumn(f"w{a}", F.col(f"w{a}") * stride + offset)
    return out


def one_pass(grid: DataFrame, previous: DataFrame, scorer: Callable[[DataFrame], DataFrame], size: int, stride: int, offset: int, air: int) -> DataFrame:
    """(y, x, p) of one pass; windows whose largest value is below `air` are not scored."""
    cells = grid.join(previous.withColumnRenamed("p", "prev"), ["y", "x"], "left").fillna(0, ["prev"])
    held = windows_of(cells, size, stride, offset)
    live = held.groupBy("wy", "wx").agg(F.max("v").alias("_top")).where(F.col("_top") >= air).select("wy", "wx")
    scored = scorer(held.join(live, ["wy", "wx"], "left_semi"))
    weight = F.exp(-0.5 * (((F.col("y") - F.col("wy") - (size - 1) / 2) / (size / 8)) ** 2 + ((F.col("x") - F.col("wx") - (size - 1) / 2) / (size / 8)) ** 2))
    blend = scored.groupBy("y", "x").agg(F.sum(F.col("d") * weight).alias("acc"), F.sum(weight).alias("sw"))
    found = blend.select("y", "x", quantised(sigmoid(F.col("acc") / F.greatest(F.col("sw"), F.lit(1e-12)))).alias("p"))
    return grid.select("y", "x").join(found, ["y", "x"], "left").fillna(0, ["p"])


def refine(grid: DataFrame, out: str, passes: int = 3, size: int = 16, stride: int = 8, air: int = 25, scorer: Callable[[DataFrame], DataFrame] = neighbour_scorer) -> DataFrame:
    """The last pass's (y, x, p). Passes are Parquet tables out/pass=k; a rerun goes on after the last complete one."""
    spark, done = grid.sparkSession, -1
    for k in range(passes - 1, -1, -1):
        try:
            spark.read.parquet(f"{out}/pass={k}").schema
            done = k
            break
        except AnalysisException:
            continue
    for k in range(done + 1, passes):
        before = spark.read.parquet(f"{out}/pass={k - 1}") if k else grid.select("y", "x", F.lit(0).alias("p"))
        one_pass(grid, before, scorer, size, stride, stride // 2 if k % 2 else 0, air).write.mode("overwrite").parquet(f"{out}/pass={k}")
    return spark.read.parquet(f"{out}/pass={passes - 1}")
