"""Edits of labelled points: units, splits, merges, deletions, and what an edit leaves of a window's quality.

Points are rows (id, unit, label, pz, py, px); label -1 is noise. An edit gives a new table and never changes other labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.regions import cells_of


def unit_labels(units: DataFrame, points: DataFrame) -> DataFrame:
    """(unit, label) of every unit, -1 for those without points."""
    held = points.groupBy("unit").agg(F.max("label").alias("label"))
    return units.select("unit").distinct().join(held, "unit", "left").fillna(-1, ["label"])


def sides_apart(points: DataFrame, label: int, sides: DataFrame, keep: bool) -> DataFrame:
    """points with `label` split by the side (0 or 1) of each unit. keep: side 0 keeps the label and side 1 gets one above the
    largest; else both get new ones, the first two above it. Units that `sides` does not name are of side 0."""
    top = points.agg(F.max("label").alias("_top"))
    met = points.crossJoin(F.broadcast(top)).join(sides.select("unit", F.col("side").alias("_side")), "unit", "left")
    other = F.coalesce(F.col("_side"), F.lit(0)) == 1
    new = F.when(other, F.col("_top") + 1).otherwise(F.lit(label)) if keep else F.when(other, F.col("_top") + 2).otherwise(F.col("_top") + 1)
    return met.withColumn("label", F.when(F.col("label") == label, new).otherwise(F.col("label")).cast(points.schema["label"].dataType)).select(*points.columns)


def merged_sheets(points: DataFrame, a: int, b: int) -> DataFrame:
    """points with both labels under that of the larger one (a on ties)."""
    sizes = points.agg(F.count_if(F.col("label") == a).alias("_a"), F.count_if(F.col("label") == b).alias("_b"))
    kept = F.when(F.col("_a") >= F.col("_b"), a).otherwise(b)
    return points.crossJoin(F.broadcast(sizes)).withColumn("label", F.when(F.col("label").isin(a, b), kept).otherwise(F.col("label")).cast(points.schema["label"].dataType)).select(*points.columns)


def deleted_sheets(points: DataFrame, labels: list[int], shape: dict[str, int], steps: int = 4) -> tuple[DataFrame, DataFrame]:
    """(points with the labels as noise, cells within `steps` of their points in city-block distance)."""
    gone = F.col("label").isin(labels)
    cells = cells_of(points.where(gone), shape).select(*shape).distinct()
    one = [F.sequence(F.lit(-steps).cast("long"), F.lit(steps).cast("long"))] * len(shape)
    spread = cells
    for a, moves in zip(shape, one):
        spread = spread.withColumn(f"_{a}", F.explode(moves))
    spread = spread.where(sum((F.abs(F.col(f"_{a}")) for a in shape), F.lit(0)) <= steps)
    region = spread.select(*((F.col(a) + F.col(f"_{a}")).alias(a) for a in shape))
    for a, n in shape.items():
        region = region.where((F.col(a) >= 0) & (F.col(a) < n))
    return points.withColumn("label", F.when(gone, -1).otherwise(F.col("label"))), region.distinct()


def edited_quality(sheets: DataFrame, scores: DataFrame, window: str) -> DataFrame:
    """(window, sheet, quality, of_window): a sheet that had a score keeps it, another is `manual`; the window has its least score."""
    kept = sheets.select(window, "sheet").join(scores.select(window, "sheet", "score"), [window, "sheet"], "left")
    least = kept.groupBy(window).agg(F.round(F.min("score"), 4).alias("_least"))
    said = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("manual"))
    text: Column = F.when(F.col("score").isNull(), "manual").otherwise(said(F.col("score")))
    return kept.join(least, window).select(window, "sheet", text.alias("quality"), F.when(F.col("_least").isNull(), "manual").otherwise(said(F.col("_least"))).alias("of_window"))
