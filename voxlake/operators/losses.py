"""Agreement of a predicted probability p with a target g, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dice(df: DataFrame, keys: tuple[str, ...], p: str, g: str, ignore: Column | None = None) -> DataFrame:
    """(keys, dice): smoothed overlap of p and g; rows where ignore holds take no part."""
    df = df.where(~ignore) if ignore is not None else df
    return df.groupBy(*keys).agg(((2 * F.sum(F.col(p) * F.col(g)) + 1) / (F.sum(p) + F.sum(g) + 1)).alias("dice"))


def tversky(df: DataFrame, keys: tuple[str, ...], p: str, g: str, alpha: float = 0.3, beta: float = 0.7, gamma: float = 1.0) -> DataFrame:
    tp, fp, fn = F.sum(F.col(p) * F.col(g)), F.sum(F.col(p) * (1 - F.col(g))), F.sum((1 - F.col(p)) * F.col(g))
    return df.groupBy(*keys).agg(F.pow(1 - (tp + 1e-5) / (tp + alpha * fp + beta * fn + 1e-5), F.lit(gamma)).alias("loss"))


def recall_of(df: DataFrame, keys: tuple[str, ...], p: str, mark: str) -> DataFrame:
    """1 - share of the marked mass that p covers."""
    return df.groupBy(*keys).agg((1 - F.sum(F.col(p) * F.col(mark)) / F.greatest(F.sum(mark), F.lit(1e-6))).alias("loss"))


def material_prob(v: Column, tau: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-(v - tau) / scale))


def grow_air(edges: DataFrame, aff: str, gate: str, along: str) -> DataFrame:
    """(grow, air): growth is asked for inside material and along the sheet, forbidden where either end is air."""
    w, air = F.col(gate) * F.col(along), 1 - F.col(gate)
    return edges.agg((F.sum(w * (F.col(aff) - 1) ** 2) / F.greatest(F.sum(w), F.lit(1.0))).alias("grow"), (F.sum(air * F.col(aff) ** 2) / F.greatest(F.sum(air), F.lit(1.0))).alias("air"))


def supervision_weights(levels: int) -> list[float]:
    """Halving weights that sum to one; the coarsest level has none."""
    raw = [0.5**k for k in range(levels - 1)] + [0.0]
    return [w / sum(raw) for w in raw]
