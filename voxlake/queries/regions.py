"""Queries on confidence over regions: smoothed doubts, dropped points, weights of channels, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import regions as ops
from voxlake.queries.grids import PLANE
from voxlake.queries.registry import query
from voxlake.sources.tables import plane, table

SHAPE = {"y": 128, "x": 744}


def _smoothed(name: str, source: str, values: tuple[str, ...], sigma: float) -> str:
    """CTEs <name>_y and <name>: a Gaussian along y, then along x, edges mirrored."""
    r = ops.reach_of(sigma)
    kernel = f"{name}_k AS (SELECT k, exp(-0.5 * (k / {sigma}) ** 2) / (SELECT sum(exp(-0.5 * (j / {sigma}) ** 2)) FROM range({-r}, {r + 1}) b(j)) AS w FROM range({-r}, {r + 1}) a(k))"
    out = [kernel]
    for axis, n, before, after in (("y", 128, source, f"{name}_y"), ("x", 744, f"{name}_y", name)):
        other = "x" if axis == "y" else "y"
        sums = ", ".join(f"sum({v} * w) AS {v}" for v in values)
        out.append(f"{after} AS (SELECT p + k AS {axis}, {other}, {sums} FROM (SELECT *, unnest([{axis}, -1 - {axis}, {2 * n - 1} - {axis}]) AS p FROM {before}) s, {name}_k WHERE p + k BETWEEN 0 AND {n - 1} GROUP BY 1, 2)")
    return ", ".join(out)


@query(f"""
WITH {PLANE}, d AS (SELECT y, x, CASE WHEN v % 3 = 0 THEN (v % 10) / 10.0::DOUBLE ELSE 0 END AS d, 1.0::DOUBLE AS c FROM plane), {_smoothed("s", "d", ("d", "c"), 2.0)}
SELECT y, x, round(greatest(0, least(1, 1 - d / (c + 1e-6))), 5) AS confidence FROM s""")
def covered_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence where sheets overlap or were perturbed: one minus the smoothed share of doubt in the cover."""
    d = plane(spark, sf).select("y", "x", F.when(F.col("v") % 3 == 0, (F.col("v") % 10) / 10.0).otherwise(0.0).alias("d"), F.lit(1.0).alias("c"))
    return ops.covered_confidence(d, SHAPE, "d", "c", 2.0).withColumn("confidence", F.round("confidence", 5))


EVENT_POINTS = "e AS (SELECT event_id, round_even(greatest(0, least(127, user_id % 128)), 0)::BIGINT AS y, round_even(greatest(0, least(743, value * 7)), 0)::BIGINT AS x, (event_id % 11) / 10.0::DOUBLE AS u, event_type FROM events)"


def _event_points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", (F.col("user_id") % 128).cast("double").alias("py"), (F.col("value") * 7).alias("px"), ((F.col("event_id") % 11) / 10.0).alias("u"), "event_type")


@query(f"""
WITH {EVENT_POINTS}, d AS (SELECT y, x, sum(u) AS u, count(*)::DOUBLE AS n FROM e GROUP BY y, x), {_smoothed("s", "d", ("u", "n"), 2.0)}
SELECT y, x, round(1 - u / (n + 1e-6), 5) AS confidence, n > 0.02 * (SELECT max(n) FROM s) + 1e-9 AS cover FROM s""")
def point_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence around points with a doubt each, and where there are enough of them."""
    return ops.point_confidence(_event_points(spark, sf), SHAPE, "u", 2.0).withColumn("confidence", F.round("confidence", 5))


@query(f"""
WITH {EVENT_POINTS}, d AS (SELECT y, x, count(*)::DOUBLE AS n FROM e WHERE event_type = 'purchase' GROUP BY y, x), {_smoothed("s", "d", ("n",), 3.0)},
q AS (SELECT quantile_cont(n, 0.99) AS q FROM s WHERE n > 0), u AS (SELECT y, x, greatest(0, least(1, n / (q + 1e-9))) ** 2.5 AS u FROM s, q)
SELECT y, x, round(1 - u, 5) AS confidence, u > 0.1 AS region FROM u""")
def dropped_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Doubt around points that no unit holds."""
    dropped = _event_points(spark, sf).where("event_type = 'purchase'")
    return ops.dropped_confidence(dropped, SHAPE).withColumn("confidence", F.round("confidence", 5))


@query(f"""
WITH {PLANE}, c AS (SELECT y, x, round_even(greatest(0, least(255, (v % 100) / 100.0::DOUBLE * 255)), 0)::INTEGER AS c FROM plane UNION ALL SELECT y, x, round_even((v % 7) / 7.0::DOUBLE * 255, 0)::INTEGER FROM plane WHERE y % 2 = 0)
SELECT y, x, round(greatest(0, least(1, product(c / 255.0::DOUBLE))), 6) AS weight FROM c GROUP BY y, x""")
def channel_weight(spark: SparkSession, sf: str) -> DataFrame:
    """The product of confidence channels that are held as bytes."""
    p = plane(spark, sf)
    one = p.select("y", "x", ops.quantised_fraction((F.col("v") % 100) / 100.0).alias("confidence"))
    two = p.where("y % 2 = 0").select("y", "x", ops.quantised_fraction((F.col("v") % 7) / 7.0).alias("confidence"))
    return ops.weight_of([one, two], ("y", "x")).withColumn("weight", F.round("weight", 6))


@query(f"""
WITH {PLANE}, c AS (SELECT y // 8 AS y, x // 24 AS x, avg(v) AS v FROM plane GROUP BY 1, 2),
yy AS (SELECT t AS y, c.x, sum(v * greatest(0, 1 - abs(t * 15.0::DOUBLE / 63 - c.y))) AS v FROM c, range(0, 64) r(t) WHERE abs(t * 15.0::DOUBLE / 63 - c.y) <= 1 GROUP BY 1, 2),
xx AS (SELECT yy.y, t AS x, sum(v * greatest(0, 1 - abs(t * 30.0::DOUBLE / 92 - yy.x))) AS v FROM yy, range(0, 93) r(t) WHERE abs(t * 30.0::DOUBLE / 92 - yy.x) <= 1 GROUP BY 1, 2)
SELECT y, x, round(v, 7) AS v FROM xx WHERE v > 1e-6""")
def magnified(spark: SparkSession, sf: str) -> DataFrame:
    """A coarse channel on a finer grid."""
    coarse = plane(spark, sf).groupBy(F.floor(F.col("y") / 8).alias("y"), F.floor(F.col("x") / 24).alias("x")).agg(F.avg("v").alias("v"))
    return ops.magnified(coarse, ("y", "x"), "v", {"y": 16, "x": 31}, {"y": 64, "x": 93}).where("v > 1e-6").withColumn("v", F.round("v", 7))
