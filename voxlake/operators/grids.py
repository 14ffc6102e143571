"""Operators on grids in long form (z, y, x, v) and on their blocks: boxes, screens, pyramids, blends, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.histogram import otsu


def box(df: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Rows inside half-open ranges; plain comparisons, so that they reach the scan."""
    return reduce(lambda d, kv: d.where((F.col(kv[0]) >= kv[1][0]) & (F.col(kv[0]) < kv[1][1])), ranges.items(), df)


def oriented(df: DataFrame, axes: str) -> DataFrame:
    """The same cells under permuted axes: `xzy` reads the old x as z, the old z as y, the old y as x."""
    return df.select(*(F.col(old).alias(new) for new, old in zip("zyx", axes)), *(c for c in df.columns if c not in "zyx"))


def gather(points: DataFrame, grid: DataFrame, fill: int = 0) -> DataFrame:
    """points (pz, py, px in doubles) with the value of the nearest cell, half to even; missing cells give fill."""
    keyed = points.withColumns({a: F.rint(f"p{a}").cast("long") for a in "zyx"})
    return keyed.join(grid.select("z", "y", "x", "v"), ["z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def pooled(df: DataFrame, keys: tuple[str, ...], value: str, how: str, factor: int = 2) -> DataFrame:
    """Cells merged by `factor` along the keys; how: max, avg or sum. Cells that are missing count as absent."""
    merged = [F.floor(F.col(k) / factor).cast("long").alias(k) for k in keys]
    return df.groupBy(*merged).agg(getattr(F, how)(value).alias(value))


def pyramid(df: DataFrame, keys: tuple[str, ...], value: str, levels: int, how: str = "max") -> DataFrame:
    """(level, keys, value), level 0 being df. Each level is made from the one below, never from the cells again."""
    out, level = df.select(F.lit(0).alias("level"), *keys, value), df
    for k in range(1, levels):
        level = pooled(level, keys, value, how)
        out = out.unionByName(level.select(F.lit(k).alias("level"), *keys, value))
    return out


def material_mask(grid: DataFrame, value: str = "v") -> DataFrame:
    """grid with `mask`: 1 where the value is strictly above the Otsu threshold of all."""
    return grid.crossJoin(F.broadcast(otsu(grid, value))).withColumn("mask", (F.col(value) > F.col("threshold")).cast("int"))


def material_tiles(mask: DataFrame, tile: int, least: float) -> DataFrame:
    """(ty, tx, cells, fraction) of tiles of (y, x) cells whose share of material is strictly above least."""
    keys = [F.floor(F.col(a) / tile).cast("long").alias(f"t{a}") for a in "yx"]
    return mask.groupBy(*keys).agg(F.count("*").alias("cells"), F.avg(F.col("mask").cast("double")).alias("fraction")).where(F.col("fraction") > least)


def overlap_add(values: DataFrame, windows: DataFrame, size: int, at: str = "t") -> DataFrame:
    """Weighted blend of overlapping windows along an axis: sigmoid of the weighted mean, as a byte.

    values: (w, t, d) of each window w; windows: (w, begin). Weights are a Gaussian around the window's middle.
    """
    from voxlake.functions.vectors import quantised, sigmoid

    off = F.col(at) - F.col("begin") - F.lit((size - 1) / 2)
    weight = F.exp(-0.5 * (off / F.lit(size / 8)) ** 2)
    summed = values.join(windows, "w").groupBy(at).agg(F.sum(F.col("d") * weight).alias("acc"), F.sum(weight).alias("sw"))
    return summed.select(at, quantised(sigmoid(F.col("acc") / F.greatest(F.col("sw"), F.lit(1e-12)))).alias("p"))


def shifted(df: DataFrame, offsets: list[tuple[int, ...]], keys: tuple[str, ...]) -> DataFrame:
    """A row for each cell and offset: `c` counts the offsets, the keys are moved by them."""
    rows = F.array(*(F.struct(F.lit(c).alias("c"), *(F.lit(d).cast("long").alias(f"d{k}") for k, d in zip(keys, o))) for c, o in enumerate(offsets)))
    spread = df.withColumn("_o", F.explode(rows))
    return spread.withColumns({k: F.col(k) + F.col(f"_o.d{k}") for k in keys}).withColumn("c", F.col("_o.c")).drop("_o")


def affinity_target(labels: DataFrame, offsets: list[tuple[int, ...]], keys: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """(c, keys, aff): for labelled cells with a labelled partner at offset c, whether both have one label."""
    known = labels.where(F.col("label") > 0)
    partner = known.select(*keys, F.col("label").alias("other"))
    back = shifted(known.withColumns({f"u{k}": F.col(k) for k in keys}), offsets, keys).join(partner, list(keys))
    return back.select("c", *(F.col(f"u{k}").alias(k) for k in keys), (F.col("label") == F.col("other")).cast("int").alias("aff"))


def dilated(cells: DataFrame, steps: int, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Cells within `steps` of the given ones in city-block distance."""
    reach = range(-steps, steps + 1)
    offsets = [(a, b) for a in reach for b in reach if abs(a) + abs(b) <= steps]
    return shifted(cells.select(*keys), offsets, keys).select(*keys).distinct()


def interface_band(labels: DataFrame, a: int, b: int, steps: int) -> DataFrame:
    """Cells near both labels."""
    return dilated(labels.where(F.col("label") == a), steps).intersect(dilated(labels.where(F.col("label") == b), steps))


def splat(points: DataFrame, value: Column) -> DataFrame:
    """(z, y, x, s, n): sums and counts of points in the cell they round to."""
    cells = [F.rint(f"p{a}").cast("long").alias(a) for a in "zyx"]
    return points.groupBy(*cells).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
