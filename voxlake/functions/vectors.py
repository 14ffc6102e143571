"""Vector and slab-membership expressions over array columns and component columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot3(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -30.0, 30.0)))


def quantised(p: Column) -> Column:
    """A fraction as a byte, rounded half to even."""
    return F.rint(p * 255).cast("int")


def slab_log_score(chord: tuple, normal: tuple, jacobian: list[tuple], ss2: float, sn2_above: float, sn2_below: float) -> Column:
    """Log membership of a candidate in the slab of an anchor: in-plane reach ss2, across-plane width by the side that the
    chord lies on, after the surface's own curvature along the chord is taken off."""
    across = dot3(chord, normal)
    plane = tuple(c - across * n for c, n in zip(chord, normal))
    reach = F.greatest(dot3(plane, plane), F.lit(0.0))
    bent = tuple(dot3(row, plane) for row in jacobian)
    kappa = -dot3(plane, bent) / F.greatest(reach, F.lit(1e-9))
    off = (across - 0.5 * kappa * reach) / F.sqrt(1 + kappa * kappa * reach)
    return -(reach / ss2 + off * off / F.when(across >= 0, sn2_above).otherwise(sn2_below))


def mutual_weight(one_way: Column, other_way: Column, across_um: Column, width_um: float = 30.0, steep: float = 12.0) -> Column:
    """Both slabs' agreement, damped where the pair lies further apart across the sheet than its width."""
    return F.exp(clip(one_way + other_way, -60.0, 0.0)) * (1 / (1 + F.exp((F.abs(across_um) - width_um) / steep)))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid array): component-wise means, aggregated before the shuffle."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
