"""Queries on grids: screens, boxes, pyramids, blends, tilings, neighbours, refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import fields, grids, histogram, losses, regions
from voxlake.operators.graph import maximin_losses
from voxlake.plans import refine, tiling
from voxlake.queries.registry import query
from voxlake.sources import catalog, demo, store
from voxlake.sources.tables import plane, table, voxels

VOX = """vox AS (
  SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS z, l_partkey % 64 AS y, l_suppkey % 64 AS x,
         (sum(l_quantity)::BIGINT % 256)::BIGINT AS v
  FROM lineitem GROUP BY ALL)"""
PLANE = """plane AS (
  SELECT user_id % 128 AS y, (day(ts) - 1) * 24 + hour(ts) AS x, sum(floor(value))::BIGINT AS v FROM events GROUP BY ALL)"""


def _otsu_sql(source: str, value: str) -> str:
    return f"""
ends AS (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM {source} WHERE {value} > 0),
h AS (
  SELECT least(255, floor(({value} - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 256))::BIGINT AS bin, count(*) AS n
  FROM {source}, ends WHERE {value} > 0 GROUP BY 1),
c AS (
  SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS w, sum(n * bin) OVER (ORDER BY bin) / sum(n) OVER () AS mu,
         sum(n * bin) OVER () / sum(n) OVER () AS mt FROM h),
b AS (SELECT bin, round((mt * w - mu) ** 2 / CASE WHEN w * (1 - w) = 0 THEN 1e-12 ELSE w * (1 - w) END, 9) AS s FROM c),
cut AS (SELECT lo + (hi - lo) * (SELECT bin FROM b ORDER BY s DESC, bin LIMIT 1) / 256 AS threshold FROM ends)"""


@query(f"WITH {_otsu_sql('events', 'value').strip()} SELECT round(threshold, 6) AS threshold FROM cut")
def otsu_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.otsu(table(spark, sf, "events"), "value").select(F.round("threshold", 6).alias("threshold"))


@query("""
WITH e AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (l_extendedprice - lo) / greatest(hi - lo, 1e-3))), 6) AS scaled
FROM lineitem, e""")
def ct_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d = histogram.percentile_scaled(table(spark, sf, "lineitem"), "l_extendedprice")
    return d.select("l_orderkey", "l_linenumber", F.round("scaled", 6).alias("scaled"))


@query(f"""
WITH {VOX}, flat AS (SELECT y, x, sum(v)::BIGINT AS v FROM vox GROUP BY ALL), {_otsu_sql('flat', 'v').strip()},
m AS (SELECT y, x, (v > threshold)::INTEGER AS mask FROM flat, cut)
SELECT y // 8 AS ty, x // 8 AS tx, count(*) AS cells, round(avg(mask), 6) AS fraction FROM m GROUP BY ALL HAVING avg(mask) > 0.02""")
def material_screen(spark: SparkSession, sf: str) -> DataFrame:
    flat = voxels(spark, sf).groupBy("y", "x").agg(F.sum("v").alias("v"))
    return grids.material_tiles(grids.material_mask(flat), 8, 0.02).select("ty", "tx", "cells", F.round("fraction", 6).alias("fraction"))


@query(f"""
WITH {VOX}, flat AS (SELECT y, x, sum(v)::BIGINT AS v FROM vox GROUP BY ALL), {_otsu_sql('flat', 'v').strip()},
m AS (SELECT y, x FROM flat, cut WHERE v > threshold)
SELECT min(y) * 4 AS y0, max(y) * 4 AS y1, min(x) * 4 AS x0, max(x) * 4 AS x1 FROM m""")
def material_bbox(spark: SparkSession, sf: str) -> DataFrame:
    flat = voxels(spark, sf).groupBy("y", "x").agg(F.sum("v").alias("v"))
    m = grids.material_mask(flat).where("mask = 1")  # found on cells of a level 4 times as coarse
    return m.agg(*((f(a) * 4).alias(f"{a}{k}") for a in "yx" for k, f in enumerate((F.min, F.max))))


@query(f"""
WITH {VOX}, t AS (SELECT quantile_cont(v, 0.55) AS t FROM vox)
SELECT z, round(avg((v > t)::INTEGER), 6) AS fraction FROM vox, t WHERE y < 32 AND x >= 16 AND x < 48 GROUP BY z""")
def material_frac(spark: SparkSession, sf: str) -> DataFrame:
    v = voxels(spark, sf)
    cut = histogram.quantiles(v, "v", 0.55)[0]
    inside = grids.box(v, y=(0, 32), x=(16, 48))
    return inside.groupBy("z").agg(F.round(F.avg((F.col("v") > F.lit(cut)).cast("double")), 6).alias("fraction"))


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z >= 3 AND z < 9 AND y >= 10 AND y < 40 AND x >= 0 AND x < 20")
def box_scan(spark: SparkSession, sf: str) -> DataFrame:
    return grids.box(voxels(spark, sf), z=(3, 9), y=(10, 40), x=(0, 20)).select("z", "y", "x", "v")


@query(f"WITH {VOX} SELECT x AS z, z AS y, y AS x, v FROM vox")
def oriented_view(spark: SparkSession, sf: str) -> DataFrame:
    return grids.oriented(voxels(spark, sf), "xzy").select("z", "y", "x", "v")


@query(f"""
WITH {VOX}, p AS (SELECT event_id, round_even(value / 25, 0)::BIGINT AS z, user_id % 64 AS y, round_even(value / 10, 0)::BIGINT AS x FROM events)
SELECT event_id, p.z, p.y, p.x, coalesce(v, 0)::BIGINT AS v FROM p LEFT JOIN vox USING (z, y, x)""")
def point_gather(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    points = e.select("event_id", (F.col("value") / 25).alias("pz"), (F.col("user_id") % 64).cast("double").alias("py"), (F.col("value") / 10).alias("px"))
    return grids.gather(points, voxels(spark, sf)).select("event_id", "z", "y", "x", "v")


def _levels(how: str) -> str:
    agg = {"max": "max(v)", "avg": "avg(v)"}[how]
    one = lambda k: f"l{k} AS (SELECT y // 2 AS y, x // 2 AS x, {agg} AS v FROM l{k - 1} GROUP BY 1, 2)"
    first = "l0 AS (SELECT y, x, v FROM plane)"
    take = "v::BIGINT" if how == "max" else "round(v, 4)"
    every = " UNION ALL ".join(f"SELECT {k} AS level, y, x, {take} AS v FROM l{k}" for k in range(4))
    return f"WITH {PLANE}, {first}, {one(1)}, {one(2)}, {one(3)} {every}"


@query(_levels("max"))
def max_pool_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return grids.pyramid(plane(spark, sf), ("y", "x"), "v", 4)


@query(_levels("avg"))
def mean_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    base = plane(spark, sf).withColumn("v", F.col("v").cast("double"))
    return grids.pyramid(base, ("y", "x"), "v", 4, "avg").withColumn("v", F.round("v", 4))


@query("""
WITH d AS (SELECT p_partkey, 50 + p_size * 7 AS dim FROM part),
k AS (SELECT p_partkey, dim, unnest(range((floor(-4.0 / 8))::BIGINT, (ceil((dim - 24 - 4) / 8.0))::BIGINT + 1)) AS k FROM d)
SELECT p_partkey, list_sort(list_distinct(list(greatest(0, least(4 + k * 8, dim - 24))::BIGINT)))::VARCHAR AS starts FROM k GROUP BY p_partkey""")
def overlap_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "part").select("p_partkey", (50 + F.col("p_size") * 7).alias("dim"))
    starts = tiling.starts_of(F.col("dim"), 24, 8, 4)
    return d.select("p_partkey", F.concat(F.lit("["), F.array_join(starts.cast("array<string>"), ", "), F.lit("]")).alias("starts"))


@query("""
WITH e AS (SELECT unnest([0, 400] || range(24, 400, 64)) AS e), s AS (SELECT DISTINCT e FROM e),
t AS (SELECT e AS a, lead(e) OVER (ORDER BY e) AS b FROM s)
SELECT a::BIGINT AS begin, b::BIGINT AS "end", least(a, 336)::BIGINT AS window_begin FROM t WHERE b IS NOT NULL""")
def axis_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(tiling.axis_tiles(400, 64, 24), "begin long, end long, window_begin long")


@query("""
WITH z AS (SELECT * FROM (VALUES (0, 32, 0), (32, 64, 32), (64, 80, 48)) t(z0, z1, wz)),
y AS (SELECT * FROM (VALUES (0, 32, 0), (32, 64, 32)) t(y0, y1, wy)),
x AS (SELECT * FROM (VALUES (32, 64, 32), (64, 96, 64)) t(x0, x1, wx))
SELECT z0::BIGINT AS z0, z1::BIGINT AS z1, wz::BIGINT AS wz, y0::BIGINT AS y0, y1::BIGINT AS y1, wy::BIGINT AS wy,
       x0::BIGINT AS x0, x1::BIGINT AS x1, wx::BIGINT AS wx FROM z, y, x""")
def pass_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.tiles_frame(spark, (80, 64, 96), 32, 0, (0, 80, 0, 64, 40, 96))


@query("""
WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS t FROM orders),
s AS (SELECT unnest(range(0, 2400, 16)) AS s)
SELECT (t // 64 * 64)::BIGINT AS t0, s::BIGINT AS s, count(*) AS n
FROM (SELECT DISTINCT t // 64 * 64 AS t FROM o) o JOIN s ON s < t + 64 AND s + 48 > t GROUP BY ALL""")
def pass_blend_tiles(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1992-01-01")))
    tiles = table(spark, sf, "orders").select((F.floor(day / 64) * 64).alias("t0")).distinct().withColumn("t1", F.col("t0") + 64)
    windows = spark.range(0, 2400, 16).withColumnRenamed("id", "s")
    from voxlake.operators.spatial import covered_by

    return covered_by(tiles, windows, 48, 64).groupBy("t0", "s").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT floor(epoch(ts) / 3600)::BIGINT - 473352 AS t, avg(value) AS m FROM events GROUP BY 1),
w AS (SELECT unnest(range(-16, 760, 8)) AS b),
a AS (
  SELECT t, sum((m - 60) / 20 * exp(-0.5 * ((t - b - 7.5) / 2.0) ** 2)) AS acc, sum(exp(-0.5 * ((t - b - 7.5) / 2.0) ** 2)) AS sw
  FROM d JOIN w ON b <= t AND t < b + 16 GROUP BY t)
SELECT t, round_even(1 / (1 + exp(-greatest(-30, least(30, acc / greatest(sw, 1e-12))))) * 255, 0)::INTEGER AS p FROM a""")
def gaussian_blend(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    hour = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) - 473352).cast("long")
    values = e.groupBy(hour.alias("t")).agg(((F.avg("value") - 60) / 20).alias("d"))
    first = F.floor((F.col("t") - 16) / 8) + 1
    held = values.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("t") / 8)))).where("w >= -2")
    return grids.overlap_add(held, held.select("w").distinct().withColumn("begin", F.col("w") * 8), 16)


@query("""
WITH v AS (SELECT unnest([1.0, -1.0, 0.5, 2.0]) AS g)
SELECT user_id, round(avg(greatest(-3, least(3, value / 100 * g))), 6) AS logit FROM events, v GROUP BY user_id""")
def tta_average(spark: SparkSession, sf: str) -> DataFrame:
    variants = F.explode(F.array(*map(F.lit, (1.0, -1.0, 0.5, 2.0))))
    e = table(spark, sf, "events").select("user_id", "value", variants.alias("g"))
    return e.groupBy("user_id").agg(F.round(F.avg(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("value") / 100 * F.col("g")))), 6).alias("logit"))


@query(f"""
WITH {VOX}, l AS (SELECT z, y, x, v % 4 AS label FROM vox WHERE v % 4 > 0),
o AS (SELECT * FROM (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1), (3, 0, 3, 0)) t(c, dz, dy, dx))
SELECT c, count(*) AS edges, sum((a.label = b.label)::INTEGER)::BIGINT AS same
FROM l a JOIN o ON true JOIN l b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY c""")
def affinity_target(spark: SparkSession, sf: str) -> DataFrame:
    labels = voxels(spark, sf).select("z", "y", "x", (F.col("v") % 4).alias("label"))
    found = grids.affinity_target(labels, [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 3, 0)])
    return found.groupBy("c").agg(F.count("*").alias("edges"), F.sum("aff").alias("same"))


@query(f"""
WITH {PLANE}, l AS (SELECT y, x, v % 5 AS label FROM plane),
o AS (SELECT i AS dy, j AS dx FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE abs(i) + abs(j) <= 2)
SELECT (y + dy)::BIGINT AS y, (x + dx)::BIGINT AS x FROM l, o WHERE label = 1
INTERSECT SELECT (y + dy)::BIGINT, (x + dx)::BIGINT FROM l, o WHERE label = 2""")
def interface_band(spark: SparkSession, sf: str) -> DataFrame:
    labels = plane(spark, sf).select("y", "x", (F.col("v") % 5).alias("label"))
    return grids.interface_band(labels, 1, 2, 2)


AROUND = "o AS (SELECT i AS dy, j AS dx FROM range(-1, 2) a(i), range(-1, 2) b(j))"


def _opened(name: str, source: str) -> str:
    return f"""{name}e AS (SELECT a.y, a.x, min(b.v) AS v FROM {source} a, o JOIN {source} b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
{name}o AS (SELECT a.y, a.x, max(b.v) AS o FROM {name}e a, o JOIN {name}e b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
{name}d AS (SELECT y, x, greatest(v - o, 0) AS d FROM {source} JOIN {name}o USING (y, x))"""


@query(f"""
WITH {PLANE}, g AS (SELECT y, x, least(1, v / 300.0::DOUBLE) AS v FROM plane), {AROUND}, {_opened("a", "g")}, {_opened("b", "ae")}
SELECT y, x, round(a.d + greatest(b.d - a.d * b.d, 0), 6) AS skeleton FROM ad a JOIN bd b USING (y, x)""")
def soft_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals of two openings."""
    g = plane(spark, sf).select("y", "x", F.least(F.lit(1.0), F.col("v") / 300.0).alias("v"))
    return regions.soft_skeleton(g, ("y", "x"), "v", 1).withColumn("skeleton", F.round("skeleton", 6))


@query(f"""
WITH {PLANE}, g AS (SELECT y, x, CASE WHEN v % 3 = 0 THEN 1 WHEN v % 7 = 0 THEN 2 ELSE 0 END AS label, v FROM plane),
o AS (SELECT i AS dy, j AS dx FROM range(-2, 3) a(i), range(-2, 3) b(j)),
n AS (SELECT g.y, g.x FROM g WHERE EXISTS (SELECT 1 FROM o JOIN g b ON b.y = g.y + dy AND b.x = g.x + dx AND b.label = 1)),
f AS (SELECT g.y, g.x, count(n.y) AS near, count(*) AS every FROM g, o JOIN g b ON b.y = g.y + dy AND b.x = g.x + dx LEFT JOIN n ON n.y = b.y AND n.x = b.x GROUP BY g.y, g.x)
SELECT g.y // 16 AS ty, count(*) AS gaps, round(avg(least(1, v / 300.0::DOUBLE)), 6) AS loss FROM g JOIN f USING (y, x) WHERE label = 0 AND near = every GROUP BY 1""")
def separation_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """Mean prediction in the gaps that a closing of the surface would bridge, by band of rows."""
    v = F.col("v")
    g = plane(spark, sf).select("y", "x", F.when(v % 3 == 0, 1).when(v % 7 == 0, 2).otherwise(0).alias("label"), F.least(F.lit(1.0), v / 300.0).alias("p"))
    gaps = regions.bridged_gaps(g, ("y", "x"), "label", 2).withColumn("ty", F.floor(F.col("y") / 16).cast("long"))
    return gaps.groupBy("ty").agg(F.count("*").alias("gaps"), F.round(F.avg("p"), 6).alias("loss"))


@query("""
SELECT round_even(value / 50, 0)::BIGINT AS z, user_id % 32 AS y, hour(ts) AS x, round(sum(value), 4) AS s, count(*) AS n FROM events GROUP BY ALL""")
def splat_confidence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    points = e.select((F.col("value") / 50).alias("pz"), (F.col("user_id") % 32).cast("double").alias("py"), F.hour("ts").cast("double").alias("px"), "value")
    return grids.splat(points, F.col("value")).withColumn("s", F.round("s", 4))


@query(f"""
WITH {VOX}, m AS (SELECT z, y, x, 1 / (1 + exp(-((v - 128) / 255.0) / 0.4)) AS m, v / 255.0 AS a FROM vox),
e AS (SELECT p.a AS aff, p.m * q.m AS g, 1 - 0.25 AS along FROM m p JOIN m q ON q.z = p.z AND q.y = p.y AND q.x = p.x + 1)
SELECT round(sum(g * along * (aff - 1) ** 2) / greatest(sum(g * along), 1), 6) AS grow,
       round(sum((1 - g) * aff ** 2) / greatest(sum(1 - g), 1), 6) AS air FROM e""")
def material_grow(spark: SparkSession, sf: str) -> DataFrame:
    m = voxels(spark, sf).select("z", "y", "x", losses.material_prob((F.col("v") - 128) / 255.0, 0.0, 0.4).alias("m"), (F.col("v") / 255.0).alias("a"))
    partner = m.select("z", "y", (F.col("x") - 1).alias("x"), F.col("m").alias("q"))
    edges = m.join(partner, ["z", "y", "x"]).select(F.col("a").alias("aff"), (F.col("m") * F.col("q")).alias("g"), F.lit(0.75).alias("along"))
    return losses.grow_air(edges, "aff", "g", "along").select(F.round("grow", 6).alias("grow"), F.round("air", 6).alias("air"))


@query(f"""
WITH {VOX}, c AS (SELECT floor(z / 4) AS cz, y // 16 AS cy, x // 16 AS cx, max(v) AS vmax FROM vox GROUP BY ALL)
SELECT v.z, v.y, v.x, v.v FROM vox v JOIN c ON cz = floor(z / 4) AND cy = y // 16 AND cx = x // 16
WHERE vmax >= 40 AND z >= 2 AND z < 11 AND y >= 5 AND y < 50 AND x >= 3 AND x < 30""")
def chunk_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A box of a table of chunks: chunks are pruned by number and by their largest value before their cells are unpacked."""
    return catalog.chunk_box(catalog.chunked(voxels(spark, sf)), (2, 11, 5, 50, 3, 30), least=40)


@query(f"""
WITH {VOX} SELECT z, y, x, v FROM vox WHERE v > 0 AND z >= 2 AND z < 11 AND y >= 5 AND y < 50 AND x >= 3 AND x < 30""")
def store_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A box of a chunk store, written here and read back by its data source: only the chunks of the box are opened."""
    folder = _steps(spark, "store")
    store.write_store(voxels(spark, sf), folder, (84, 64, 64), (8, 16, 16), voxel_um=9.0)
    spark.dataSource.register(store.ChunkStore)
    found = spark.read.format("voxlake_store").option("path", folder).option("box", "2:11,5:50,3:30").load()
    return found.where("v > 0").select(*(F.col(a).cast("long").alias(a) for a in "zyx"), F.col("v").cast("long").alias("v"))


@query(f"""
WITH {VOX}, l1 AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM vox GROUP BY 1, 2, 3),
l2 AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM l1 GROUP BY 1, 2, 3)
SELECT z, y, x, v FROM l2 WHERE v > 0""")
def store_level(spark: SparkSession, sf: str) -> DataFrame:
    """The second level of a store's pyramid, each level made from the one below."""
    folder = _steps(spark, "pyramid")
    store.write_store(voxels(spark, sf), folder, (84, 64, 64), (8, 16, 16), voxel_um=9.0, levels=3)
    spark.dataSource.register(store.ChunkStore)
    found = spark.read.format("voxlake_store").option("path", folder).option("level", "2").load()
    return found.where("v > 0").select(*(F.col(a).cast("long").alias(a) for a in "zyx"), F.col("v").cast("long").alias("v"))


def _steps(spark: SparkSession, name: str) -> str:
    import uuid

    from voxlake.operators.graph import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
WITH c AS (SELECT i // (64 * 64) + 198 AS z, i // 64 % 64 AS y, i % 64 AS x FROM range(4 * 64 * 64) r(i)),
f AS (SELECT *, 0.5 + 0.5 * sin(2 * pi() * (x * cos(0.35) + y * sin(0.35)) / 6.0) AS weave,
  0.55 + 0.10 * sin(2 * pi() * x / 1500.0) * sin(2 * pi() * y / 1700.0) AS ground,
  exp(-0.5 * ((z - 200) / 8.0) ** 2) * (0.5 + 0.5 * sin(2 * pi() * y / 140.0)) * (0.5 + 0.5 * tanh(3.0 * sin(2 * pi() * x / 55.0 + 2.0 * sin(y / 13.0)))) AS ink,
  0.6 + 0.4 * (0.5 + 0.5 * sin(2 * pi() * sqrt((x - 2000.0) ** 2 + (y - 3000.0) ** 2) / 48.0)) AS wraps FROM c)
SELECT z, y, x, floor(greatest(0, least(1, ground * (1 - 0.6 * ink * weave) * wraps)) * 255)::INTEGER AS v FROM f""")
def demo_block(spark: SparkSession, sf: str) -> DataFrame:
    return demo.read_box(spark, (198, 202, 0, 64, 0, 64))


@query()
def refine_passes(spark: SparkSession, sf: str) -> DataFrame:
    """Three passes of the stand-in scorer over the events plane, each a table; a rerun resumes."""
    grid = plane(spark, sf).withColumn("v", F.least(F.lit(255), F.col("v")).cast("long"))
    return refine.refine(grid, _steps(spark, "refine")).select("y", "x", "p")


@query()
def malis_maximin(spark: SparkSession, sf: str) -> DataFrame:
    """Constrained maximin losses for each depth of the grid, on edges to the right and downwards."""
    v = voxels(spark, sf).select("z", "y", "x", (F.col("y") * 64 + F.col("x")).alias("n"), (F.col("v") % 4).alias("label"), (F.col("v") / 255.0).alias("p"))
    ends = grids.shifted(v.withColumnsRenamed({"n": "a", "label": "label_a", "p": "pa"}), [(0, 1), (1, 0)], ("y", "x"))
    edges = ends.join(v.select("z", "y", "x", F.col("n").alias("b"), F.col("label").alias("label_b"), F.col("p").alias("pb")), ["z", "y", "x"])
    items = edges.select(F.col("z").alias("item"), "a", "b", ((F.col("pa") + F.col("pb")) / 2).alias("aff"), "label_a", "label_b")
    out = maximin_losses(items)
    return out.select("item", *(F.round(c, 9).alias(c) for c in ("positive", "negative", "loss")))


#: Layers around a block that its kernels see: four sigmas of the widest smoothing.
HALO = 12


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """One 12 x 64 x 64 block for each year of the grid, with HALO layers of its neighbours on either side (fewer at the ends)."""
    import numpy as np
    import pandas as pd

    first, last = 0, 84  # the months of the table

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        begin = 12 * int(key[0])
        low, high = max(first, begin - HALO), min(last, begin + 12 + HALO)
        block = np.zeros((high - low, 64, 64), "<f4")
        block[rows["z"] - low, rows["y"], rows["x"]] = rows["v"]
        return pd.DataFrame([(int(key[0]), high - low, 64, 64, begin - low, block.tobytes())], columns=["block_id", "dz", "dy", "dx", "skip", "data"])

    v = voxels(spark, sf).where((F.col("z") >= first) & (F.col("z") < last))
    near = F.sequence(F.floor((F.col("z") - HALO) / 12), F.floor((F.col("z") + HALO) / 12))
    v = v.withColumn("block_id", F.explode(near)).where((F.col("block_id") >= first // 12) & (F.col("block_id") < last // 12))
    v = v.where((F.col("z") >= 12 * F.col("block_id") - HALO) & (F.col("z") < 12 * F.col("block_id") + 12 + HALO))
    return v.groupBy("block_id").applyInPandas(pack, "block_id long, dz int, dy int, dx int, skip int, data binary")


@query()
def structure_tensor(spark: SparkSession, sf: str) -> DataFrame:
    def kernel(b, own):
        return {"coherence": float(fields.structure_tensor(b, 1.0, 2.0)["coherence"][own].mean().round(6))}

    return fields.over_blocks(_blocks(spark, sf), kernel, "coherence double")


@query()
def orientation_tensor(spark: SparkSession, sf: str) -> DataFrame:
    """Unit-trace tensors: the mean of each component over a block's own layers."""

    def kernel(b, own):
        t = fields.orientation(b, 1.0, 2.0)
        return {n: float(t[..., k][own].mean().round(6)) for k, n in enumerate(("zz", "yy", "xx", "zy", "zx", "yx"))}

    return fields.over_blocks(_blocks(spark, sf), kernel, "zz double, yy double, xx double, zy double, zx double, yx double")


@query()
def mask_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """Coherence of a binary mask's surfaces, and the share of the mask that is coherent."""

    def kernel(b, own):
        mask = b > 60
        c = fields.mask_coherence(mask)
        held = mask[own]
        return {"cells": int(held.sum()), "coherent": float((held & (c[own] > 0.88)).sum() / max(1, held.sum()))}

    return fields.over_blocks(_blocks(spark, sf), kernel, "cells long, coherent double")


@query()
def diffusion(spark: SparkSession, sf: str) -> DataFrame:
    def kernel(b, own):
        u = fields.diffused(b)[own]
        return {"mean": float(u.mean().round(4)), "spread": float(u.std().round(4))}

    return fields.over_blocks(_blocks(spark, sf), kernel, "mean double, spread double")


@query()
def edt_owner(spark: SparkSession, sf: str) -> DataFrame:
    def kernel(b, own):
        seeds = (b.astype(int) % 7 == 1) * (b.astype(int) // 7 + 1)
        m, owner = fields.crest(seeds)
        return {"crest": float(m[own].mean().round(6)), "owners": int(len(set(owner[own].ravel().tolist())))}

    return fields.over_blocks(_blocks(spark, sf), kernel, "crest double, owners long")


@query()
def streamlets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose seeds lie in a block's own layers, at the operator's stride and length."""

    def kernel(b, own):
        f = fields.structure_tensor(b, 1.0, 2.0)
        lines = fields.traced(f["fibre"], f["coherence"], layers=own)
        return {"lines": len(lines), "points": int(sum(map(len, lines)))}

    return fields.over_blocks(_blocks(spark, sf), kernel, "lines long, points long")


@query()
def plane_streamlets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stay in the plane of the normal and the fibre at their seed."""

    def kernel(b, own):
        f = fields.structure_tensor(b, 1.0, 2.0)
        lines = fields.traced(f["fibre"], f["coherence"], layers=own, plane=f["normal"])
        return {"lines": len(lines), "points": int(sum(map(len, lines)))}

    return fields.over_blocks(_blocks(spark, sf), kernel, "lines long, points long")


@query()
def compression_period(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np

    def kernel(b, own):
        return {"period": float(np.median(fields.local_period(b, 1.0, 2.0)[own]).round(6))}

    return fields.over_blocks(_blocks(spark, sf), kernel, "period double")
