"""Histograms and what is read off them: Otsu thresholds, percentile scaling, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.greatest(high - low, F.lit(1e-3))))


def order_values(df: DataFrame, value: str, ranks: list[int], bins: int = 4096, few: int = 10_000) -> dict[int, float]:
    """The values at the given ranks (from 0) of a column without nulls, exactly.

    A histogram of `bins` counts narrows each rank down to one bin, again and again, until a bin has few values or only
    one; only counts and the few values reach the driver, and no task holds the distinct values of the column.
    """
    v = F.col(value).cast("double")
    n, low, high = df.agg(F.count("*"), F.min(v), F.max(v)).first()
    if n == 0:
        return {}
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= few:
        ordered = sorted(r[0] for r in df.select(v).collect())
        return {r: ordered[r] for r in ranks}
    bin_of = F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins)).cast("int")
    counts = sorted(map(tuple, df.groupBy(bin_of.alias("b")).count().collect()))
    out: dict[int, float] = {}
    before = 0
    for b, c in counts:
        inside = [r for r in ranks if before <= r < before + c]
        if inside:
            out |= {r + before: x for r, x in order_values(df.where(bin_of == b), value, [r - before for r in inside], bins, few).items()}
        before += c
    return out


def quantiles(df: DataFrame, value: str, *fractions: float) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring ranks; None for a column without values."""
    df = df.where(F.col(value).isNotNull())
    n = df.count()
    if not n:
        return [None] * len(fractions)
    places = [f * (n - 1) for f in fractions]
    found = order_values(df, value, sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))}))
    return [found[int(p)] + (p - int(p)) * (found[min(int(p) + 1, n - 1)] - found[int(p)]) for p in places]


def percentile_scaled(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, into: str = "scaled") -> DataFrame:
    """value between its own percentiles, clipped to 0..1."""
    ends = quantiles(df, value, low, high)
    return df.withColumn(into, scaled(F.col(value), F.lit(ends[0]).cast("double"), F.lit(ends[1]).cast("double")))


def histogram(df: DataFrame, value: str, bins: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n, lo, hi) of values above zero; the last bin is closed. Counts are combined before the shuffle."""
    df = df.where(F.col(value) > 0)
    ends = df.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    joined = df.join(F.broadcast(ends) if not keys else ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    bin_of = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width * bins)).cast("long")
    return joined.groupBy(*keys, bin_of.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))


def otsu(df: DataFrame, value: str, keys: tuple[str, ...] = (), bins: int = 256) -> DataFrame:
    """(keys, threshold): left edge of the first bin of greatest between-class variance. Windows run over bins only."""
    h = histogram(df, value, bins, keys)
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    total, moment = F.sum("n").over(every), F.sum(F.col("n") * F.col("bin")).over(every)
    h = h.withColumn("w", F.sum("n").over(upto) / total).withColumn("mu", F.sum(F.col("n") * F.col("bin")).over(upto) / total).withColumn("mt", moment / total)
    spread = F.when(F.col("w") * (1 - F.col("w")) == 0, F.lit(1e-12)).otherwise(F.col("w") * (1 - F.col("w")))
    between = F.round((F.col("mt") * F.col("w") - F.col("mu")) ** 2 / spread, 9)
    best = h.withColumn("b", between).groupBy(*keys).agg(F.max(F.struct("b", (-F.col("bin")).alias("first"))).alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return best.select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * (-F.col("m.first")) / bins).alias("threshold"))


def period(df: DataFrame, bin_col: str, n_col: str, lag_min: int, lag_max: int) -> DataFrame:
    """(lag): the first local maximum above zero of the autocorrelation of a mean-centred histogram (a few hundred bins)."""
    mean = df.agg(F.avg(n_col).alias("_m"))
    h = df.crossJoin(F.broadcast(mean)).select(F.col(bin_col).alias("i"), (F.col(n_col) - F.col("_m")).alias("v"))
    lags = h.select("i", "v", F.explode(F.sequence(F.lit(lag_min - 1), F.lit(lag_max))).alias("lag"))
    other = h.select(F.col("i").alias("j"), F.col("v").alias("u"))
    ac = lags.withColumn("j", F.col("i") + F.col("lag")).join(other, "j").groupBy("lag").agg(F.round(F.sum(F.col("v") * F.col("u")), 6).alias("ac"))
    by = Window.orderBy("lag")  # over the lags only
    peaks = ac.withColumn("before", F.lag("ac").over(by)).withColumn("after", F.lead("ac").over(by))
    return peaks.where((F.col("ac") >= F.col("before")) & (F.col("ac") >= F.col("after")) & (F.col("ac") > 0)).agg(F.min("lag").alias("lag"))
