"""Seeded choices without a random stream: every draw is a hash of the seed and the row's own key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("double") / 4294967296.0


def sampled_windows(spark: SparkSession, n: int, shape: tuple[int, int, int], margin: int, seed: int) -> DataFrame:
    """(i, z, y, x) of n window middles at least `margin` inside the shape."""
    df = spark.range(n).withColumnRenamed("id", "i")
    at = lambda k, dim: (F.lit(margin) + F.floor(draw(seed, F.col("i"), F.lit(k)) * (dim - 2 * margin))).cast("long")
    return df.select("i", *(at(a, d).alias(a) for a, d in zip("zyx", shape)))


def composed(cells: DataFrame, candidates: int, seed: int, key: str = "item", zero: float = 0.15) -> DataFrame:
    """The previous-answer channel of training: each octant of an item comes from one candidate c0.., or is blank.

    cells: (item, z, y, x, c0, c1, ...) with `half` the middle of the axes. Adds `prev`.
    """
    octant = F.concat_ws("", *((F.col(a) >= F.col("half")).cast("int").cast("string") for a in "zyx"))
    pick = F.floor(draw(seed, F.col(key), octant) * candidates).cast("int")
    blank = draw(seed + 1, F.col(key), octant) < zero
    return cells.withColumn("prev", F.when(blank, F.lit(0)).otherwise(F.element_at(F.array(*(F.col(f"c{k}") for k in range(candidates))), pick + 1)))


def in_slab(unit: tuple[float, float, float], offset: float, thickness: float) -> Column:
    """Cells within half the thickness of an oriented plane."""
    return F.abs(sum((F.col(a) * u for a, u in zip("zyx", unit)), F.lit(-offset))) <= thickness / 2


def dropped(cells: DataFrame, value: str, unit: tuple[float, float, float], offset: float, thickness: float) -> DataFrame:
    """cells with the value blanked inside an oriented slab."""
    return cells.withColumn(value, F.when(in_slab(unit, offset, thickness), F.lit(0)).otherwise(F.col(value)))
