"""Queries on lines of ordered points: events of a user, rows of a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.operators import histogram
from voxlake.operators import lines as ops
from voxlake.queries.registry import query
from voxlake.sources.tables import table

#: A point of a user's line: hour of the month and value; the order is time, then number.
POINTS = "pt AS (SELECT user_id, event_id, ts, ((day(ts) - 1) * 24 + hour(ts) + minute(ts) / 60.0)::DOUBLE AS x, value AS y FROM events)"
ORDER = ("ts", "event_id")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    hours = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts") + F.minute("ts") / 60.0
    return table(spark, sf, "events").select("user_id", "event_id", "ts", hours.cast("double").alias("x"), F.col("value").alias("y"))


SEG = f"""{POINTS}, st AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sg AS (SELECT *, sqrt(dx * dx + dy * dy) AS seg FROM st)"""


@query(f"""
WITH {SEG}, f AS (SELECT * FROM sg WHERE seg > 1e-6),
n AS (SELECT *, lead(dx) OVER w AS nx, lead(dy) OVER w AS ny, lead(seg) OVER w AS ns FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT user_id, atan2(dx * ny - dy * nx, dx * nx + dy * ny) AS turn, greatest(0.5 * (seg + ns), 1e-6) AS ds FROM n WHERE ns IS NOT NULL)
SELECT user_id, round(sum(turn) / sum(ds), 6) AS signed, round(sum(abs(turn)) / sum(ds), 6) AS absolute FROM t GROUP BY user_id HAVING count(*) >= 2""")
def curvature(spark: SparkSession, sf: str) -> DataFrame:
    c = ops.curvature(_points(spark, sf), "user_id", ORDER)
    return c.select("user_id", F.round("signed", 6).alias("signed"), F.round("absolute", 6).alias("absolute"))


@query(f"""
WITH {SEG}, c AS (
  SELECT *, coalesce(sum(seg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM sg),
k AS (SELECT *, unnest(range(ceil(s0 / 500)::BIGINT, ceil((s0 + seg) / 500)::BIGINT)) AS k FROM c WHERE seg > 0)
SELECT user_id, k, round(x + (k * 500 - s0) / seg * dx, 3) AS x, round(y + (k * 500 - s0) / seg * dy, 3) AS y FROM k""")
def arc_resample(spark: SparkSession, sf: str) -> DataFrame:
    r = ops.resampled(_points(spark, sf), "user_id", ORDER, 500.0)
    return r.select("user_id", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("""
WITH b AS (SELECT user_id, ts, event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER w) > 43200, false)::INTEGER AS b FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, run::BIGINT AS run, count(*) AS n, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last FROM r GROUP BY user_id, run HAVING count(*) >= 3""")
def split_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    now = F.col("ts").cast("timestamp_ntz")  # whole microseconds, whatever the session's time zone is
    before = F.lag(now).over(Window.partitionBy("user_id").orderBy(*(F.asc_nulls_last(c) for c in ORDER)))
    r = ops.runs(e.withColumn("gap", now - before), "user_id", ORDER, F.col("gap") > F.expr("interval '12' hour"))
    return r.select("user_id", "run", "n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


ORDERS = [(p, n - p) for n in (2, 3) for p in range(n, -1, -1)]


@query(f"""
WITH m AS (SELECT l_partkey, avg(l_quantity) AS mx, avg(l_discount * 100) AS my FROM lineitem GROUP BY 1),
d AS (SELECT l_partkey, l_quantity - mx AS x, l_discount * 100 - my AS y FROM lineitem JOIN m USING (l_partkey)),
r AS (SELECT l_partkey, greatest(sqrt(avg(x * x + y * y)), 1e-9) AS r, {', '.join(f'avg(x ** {p} * y ** {q}) AS m_{p}{q}' for p, q in ORDERS)} FROM d GROUP BY 1)
SELECT l_partkey, {', '.join(f'round(m_{p}{q} / r ** {p + q}, 4) + 0.0 AS m_{p}{q}' for p, q in ORDERS)} FROM r WHERE r > 1e-6""")
def moments(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    several = t.groupBy("l_partkey").agg(F.avg(F.col("x")).alias("a"), F.avg("y").alias("b"))
    spread = t.join(several, "l_partkey").groupBy("l_partkey").agg(F.sqrt(F.avg((F.col("x") - F.col("a")) ** 2 + (F.col("y") - F.col("b")) ** 2)).alias("r")).where("r > 1e-6")
    m = ops.moments(t.join(spread.select("l_partkey"), "l_partkey", "left_semi"), "l_partkey", "x", "y", 3)
    return m.select("l_partkey", *((F.round(f"m_{p}{q}", 4) + F.lit(0.0)).alias(f"m_{p}{q}") for p, q in ORDERS))


@query("""
SELECT user_id, round(quantile_cont(value, 0.98) - quantile_cont(value, 0.02), 6) AS width,
       round((quantile_cont(value, 0.98) + quantile_cont(value, 0.02)) / 2, 6) AS middle
FROM events GROUP BY user_id HAVING count(*) >= 6""")
def width_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    w = ops.widths(table(spark, sf, "events"), "user_id", "value")
    return w.select("user_id", F.round("width", 6).alias("width"), F.round("middle", 6).alias("middle"))


@query("""
WITH h AS (SELECT ((day(ts) - 1) * 24 + hour(ts)) // 3 AS i, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT i, n - (SELECT avg(n) FROM h) AS v FROM h),
a AS (SELECT lag, round(sum(p.v * q.v), 6) AS ac FROM c p, range(1, 41) l(lag), c q WHERE q.i = p.i + lag GROUP BY lag),
n AS (SELECT lag, ac, lag(ac) OVER (ORDER BY lag) AS b, lead(ac) OVER (ORDER BY lag) AS f FROM a)
SELECT min(lag)::BIGINT AS lag FROM n WHERE ac >= b AND ac >= f AND ac > 0""")
def period_autocorr(spark: SparkSession, sf: str) -> DataFrame:
    i = F.floor(((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")) / 3)
    h = table(spark, sf, "events").groupBy(i.alias("i")).agg(F.count("*").alias("n"))
    return histogram.period(h, "i", "n", 2, 40).select(F.col("lag").cast("long").alias("lag"))


@query("""
WITH l AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS nx, embedding[4]::DOUBLE AS ny FROM embeddings),
n AS (SELECT *, greatest(nx * nx + ny * ny, 1e-18) AS n2 FROM l),
p AS (SELECT *, 1 - nx * nx / n2 AS a, -nx * ny / n2 AS b, 1 - ny * ny / n2 AS d FROM n),
s AS (SELECT label, sum(a) AS a, sum(b) AS b, sum(d) AS d, sum(a * x + b * y) AS p, sum(b * x + d * y) AS q FROM p GROUP BY label)
SELECT label, round((d * p - b * q) / (a * d - b * b), 6) AS cx, round((a * q - b * p) / (a * d - b * b), 6) AS cy FROM s""")
def umbilicus(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k: F.get("embedding", k).cast("double")
    e = table(spark, sf, "embeddings").select("label", *(at(k).alias(n) for k, n in enumerate(("x", "y", "nx", "ny"))))
    return ops.convergence(e, ("label",)).select("label", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS v FROM embeddings), g AS (SELECT v, lead(v) OVER (ORDER BY v) AS u FROM v),
t AS (SELECT (u + v) / 2 AS t FROM g WHERE u IS NOT NULL ORDER BY u - v DESC, v LIMIT 1)
SELECT vec_id, (v > t)::INTEGER AS side FROM v, t""")
def largest_gap_split(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("v"))
    return ops.largest_gap(e, "v", "vec_id").select("vec_id", "side")


@query(f"""
WITH {SEG} SELECT user_id, round(sum(seg), 4) AS length, count(*) AS points, round(max(y) - min(y), 6) AS spread, round(avg(y), 6) AS level
FROM sg GROUP BY user_id""")
def line_features(spark: SparkSession, sf: str) -> DataFrame:
    s = ops.segments(_points(spark, sf), "user_id", ORDER)
    return s.groupBy("user_id").agg(F.round(F.sum("seg"), 4).alias("length"), F.count("*").alias("points"), F.round(F.max("y") - F.min("y"), 6).alias("spread"), F.round(F.avg("y"), 6).alias("level"))


@query("""
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value FROM events),
f AS (SELECT user_id, min(CASE WHEN t = 1 THEN value END) AS v0 FROM r GROUP BY user_id)
SELECT user_id, coalesce(min(CASE WHEN value < 0.6 * v0 THEN t END), -1) AS edge FROM r JOIN f USING (user_id) GROUP BY user_id""")
def ray_first_edge(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    r = table(spark, sf, "events").select("user_id", F.row_number().over(w).alias("t"), "value", F.first("value").over(w).alias("v0"))
    return r.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("value") < 0.6 * F.col("v0"), F.col("t").cast("long"))), F.lit(-1)).cast("long").alias("edge"))
