"""Fields over a region in long form: separable Gaussian smoothing of sparse cells, and the confidences that come of it.

A field is (keys, value); cells that are missing are zero. Smoothing goes axis by axis: every cell sends its share to the
cells around it, and to those that see it mirrored at an edge, so each axis is one aggregation with map-side sums. Rows
grow with the kernel's width, not with the region.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.vectors import clip
from voxlake.operators.histogram import quantiles


def reach_of(sigma: float, truncate: float = 4.0) -> int:
    return int(truncate * sigma + 0.5)


def smoothed(cells: DataFrame, shape: dict[str, int], values: tuple[str, ...], sigma: float) -> DataFrame:
    """cells (keys of shape, values) under a Gaussian cut off at four sigmas, edges mirrored; each axis longer than the kernel."""
    r = reach_of(sigma)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    kernel = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-r, r + 1), weights)))
    keys = list(shape)
    for axis, n in shape.items():
        if n <= r:
            raise ValueError(f"axis {axis} is shorter than the kernel")
        images = F.array(F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis))
        seen = cells.withColumn("_p", F.explode(F.filter(images, lambda p: (p >= -r) & (p < n + r)))).withColumn("_k", F.explode(kernel))
        seen = seen.withColumn(axis, F.col("_p") + F.col("_k.k")).where((F.col(axis) >= 0) & (F.col(axis) < n))
        cells = seen.groupBy(*keys).agg(*(F.sum(F.col(v) * F.col("_k.w")).alias(v) for v in values))
    return cells


def cells_of(points: DataFrame, shape: dict[str, int]) -> DataFrame:
    """points (p<axis>) with the cell they round to, half to even, moved into the region."""
    return points.withColumns({a: clip(F.rint(f"p{a}").cast("long"), 0, n - 1).cast("long") for a, n in shape.items()})


def covered_confidence(cells: DataFrame, shape: dict[str, int], doubt: str, cover: str, sigma: float) -> DataFrame:
    """(keys, confidence): one minus the smoothed doubt over the smoothed cover, in 0..1."""
    s = smoothed(cells.select(*shape, F.col(doubt).cast("double").alias("_d"), F.col(cover).cast("double").alias("_c")), shape, ("_d", "_c"), sigma)
    return s.select(*shape, clip(1 - F.col("_d") / (F.col("_c") + 1e-6), 0.0, 1.0).alias("confidence"))


def point_confidence(points: DataFrame, shape: dict[str, int], doubt: str, sigma: float, least_cover: float = 0.02) -> DataFrame:
    """(keys, confidence, cover): one minus the smoothed mean doubt of points; cover where points are dense enough."""
    held = cells_of(points, shape).groupBy(*shape).agg(F.sum(doubt).cast("double").alias("_u"), F.count("*").cast("double").alias("_n"))
    s = smoothed(held, shape, ("_u", "_n"), sigma)
    top = s.agg(F.max("_n").alias("_top"))  # one row
    return s.crossJoin(F.broadcast(top)).select(*shape, (1 - F.col("_u") / (F.col("_n") + 1e-6)).alias("confidence"), (F.col("_n") > least_cover * F.col("_top") + 1e-9).alias("cover"))


def dropped_confidence(points: DataFrame, shape: dict[str, int], sigma: float = 3.0, share: float = 0.99, gamma: float = 2.5, least: float = 0.1) -> DataFrame:
    """(keys, confidence, region) around points that no unit holds; cells beyond their reach are certain and are left out."""
    held = cells_of(points, shape).groupBy(*shape).agg(F.count("*").cast("double").alias("_n"))
    s = smoothed(held, shape, ("_n",), sigma)
    scale = quantiles(s.where("_n > 0"), "_n", share)[0]
    u = F.pow(clip(F.col("_n") / ((1.0 if scale is None else scale) + 1e-9), 0.0, 1.0), F.lit(gamma))
    return s.select(*shape, (1 - u).alias("confidence"), (u > least).alias("region"))


def quantised_fraction(v: Column) -> Column:
    """A fraction as a byte."""
    return clip(F.rint(v * 255), 0, 255).cast("int")


def weight_of(channels: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """(keys, weight): the product of confidence channels (keys, confidence as bytes); a cell that a channel lacks is certain."""
    every = reduce(DataFrame.unionByName, channels)
    return every.groupBy(*keys).agg(clip(F.product(F.col("confidence") / 255.0), 0.0, 1.0).alias("weight"))


def magnified(coarse: DataFrame, keys: tuple[str, ...], value: str, shape: dict[str, int], fine: dict[str, int]) -> DataFrame:
    """A coarse field on a finer grid by linear interpolation, corners on corners; missing coarse cells are zero.

    Each coarse cell goes to the fine cells on either side that it has a share in, axis by axis.
    """
    out = coarse.select(*keys, F.col(value).cast("double").alias(value))
    for a in keys:
        n, m = shape[a], fine[a]
        step = (n - 1) / (m - 1) if m > 1 else 0.0
        if step == 0:
            out = out.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
            continue
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(a) - 1) / step).cast("long"))
        last = F.least(F.lit(m - 1).cast("long"), F.floor((F.col(a) + 1) / step).cast("long"))
        spread = out.where(last >= first).withColumn("_t", F.explode(F.sequence(first, last)))
        share = 1 - F.abs(F.col("_t") * step - F.col(a))
        spread = spread.withColumn(value, F.col(value) * F.greatest(F.lit(0.0), share)).withColumn(a, F.col("_t"))
        out = spread.groupBy(*keys).agg(F.sum(value).alias(value))
    return out


def opened(cells: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, e, o): the least value of the cells around (missing ones take no part), and the greatest of these around."""
    from voxlake.operators.grids import shifted

    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    inside = cells.select(*keys)
    e = shifted(cells.select(*keys, value), around, keys).groupBy(*keys).agg(F.min(value).alias("e")).join(inside, list(keys), "left_semi")
    o = shifted(e, around, keys).groupBy(*keys).agg(F.max("e").alias("o"))
    return e.join(o, list(keys))


def soft_skeleton(cells: DataFrame, keys: tuple[str, ...], value: str, rounds: int) -> DataFrame:
    """(keys, skeleton) of a field in 0..1: residuals of openings, joined by s + (d - s * d) where that is positive."""
    level, out = cells.select(*keys, F.col(value).cast("double").alias("_v")), None
    for _ in range(rounds + 1):
        both = level.join(opened(level, keys, "_v"), list(keys))
        rest = both.select(*keys, F.greatest(F.col("_v") - F.col("o"), F.lit(0.0)).alias("_d"))
        if out is None:
            out = rest.withColumnRenamed("_d", "skeleton")
        else:
            s, d = F.col("skeleton"), F.col("_d")
            out = out.join(rest, list(keys)).select(*keys, (s + F.greatest(d - s * d, F.lit(0.0))).alias("skeleton"))
        level = both.select(*keys, F.col("e").alias("_v"))
    return out


def bridged_gaps(cells: DataFrame, keys: tuple[str, str], label: str, radius: int) -> DataFrame:
    """Background cells (label 0) that a closing of the surface (label 1) fills; cells that are missing are no background.

    A cell is filled if every cell of its square is near the surface: as many near ones as the square has inside the region.
    """
    from voxlake.operators.grids import shifted

    square = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    inside = cells.select(*keys)
    near = shifted(cells.where(F.col(label) == 1).select(*keys), square, keys).select(*keys).distinct().join(inside, list(keys), "left_semi")
    full = shifted(near, square, keys).groupBy(*keys).agg(F.count("*").alias("_near"))
    sizes = shifted(inside, square, keys).groupBy(*keys).agg(F.count("*").alias("_all"))
    closed = full.join(sizes, list(keys)).where("_near = _all").select(*keys)
    return cells.where(F.col(label) == 0).join(closed, list(keys), "left_semi")
