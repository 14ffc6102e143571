"""Queries on the smaller operators: flags, levels, shards, crops, hashes, interpolation, seeded choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.operators import corpus, edits, grids, sampling
from voxlake.operators.histogram import quantiles
from voxlake.queries.grids import PLANE, VOX
from voxlake.queries.registry import query
from voxlake.sources.tables import plane, table, voxels


@query("""
WITH f AS (SELECT user_id AS k, bool_or(event_type = 'error') AS flag FROM events WHERE event_type IN ('error', 'view') GROUP BY 1)
SELECT c_custkey, coalesce(flag, true) AS renderable FROM customer LEFT JOIN f ON k = c_custkey""")
def segment_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "events").where(F.col("event_type").isin("error", "view")).groupBy(F.col("user_id").alias("c_custkey")).agg(F.bool_or(F.col("event_type") == "error").alias("flag"))
    return table(spark, sf, "customer").join(f, "c_custkey", "left").select("c_custkey", F.coalesce("flag", F.lit(True)).alias("renderable"))


@query("SELECT n_name AS scroll, min(c_acctbal) AS voxel FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT starts_with(n_name, 'I') GROUP BY 1 HAVING min(c_acctbal) BETWEEN -999 AND 0")
def in_band_scrolls(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").where(~F.col("n_name").startswith("I")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("scroll"))
    found = table(spark, sf, "customer").join(n, "c_nationkey").groupBy("scroll").agg(F.min("c_acctbal").alias("voxel"))
    return found.where(F.col("voxel").between(-999, 0))


@query("""
WITH l AS (SELECT p_partkey, p_size, unnest([0, 1, 2, 3]) AS level FROM part)
SELECT p_partkey, max(level) AS level FROM l WHERE 2 ** level <= greatest(1, p_size / 5.0) GROUP BY p_partkey""")
def pick_level(spark: SparkSession, sf: str) -> DataFrame:
    """The coarsest level that still has a pixel for each one shown."""
    l = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, range(4)))).alias("level"))
    return l.where(F.pow(F.lit(2.0), "level") <= F.greatest(F.lit(1.0), F.col("p_size") / 5.0)).groupBy("p_partkey").agg(F.max("level").alias("level"))


@query("""
WITH b AS (SELECT p_partkey, p_size * 37 AS y0, p_size * 37 + p_partkey % 500 + 1 AS y1 FROM part)
SELECT p_partkey, (greatest(0, least(1500, y0)) // 4)::BIGINT AS ly0, least(375, ceil(greatest(0, least(1500, y1)) / 4.0))::BIGINT AS ly1 FROM b""")
def read_region(spark: SparkSession, sf: str) -> DataFrame:
    """A full-resolution range on the grid of a level four times as coarse: down at the begin, up at the end, clipped."""
    y0 = F.col("p_size") * 37
    y1 = y0 + F.col("p_partkey") % 500 + 1
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(1500), c))
    return table(spark, sf, "part").select("p_partkey", F.floor(inside(y0) / 4).cast("long").alias("ly0"), F.least(F.lit(375), F.ceil(inside(y1) / 4)).cast("long").alias("ly1"))


@query("SELECT y // 16 AS ty, x // 16 AS tx, count(*) AS cells, min(y) * 4 AS y0, (max(y) + 1) * 4 AS y1 FROM (SELECT DISTINCT l_partkey % 64 AS y, l_suppkey % 64 AS x FROM lineitem) GROUP BY ALL")
def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").select((F.col("l_partkey") % 64).alias("y"), (F.col("l_suppkey") % 64).alias("x")).distinct()
    tile = lambda a: F.floor(F.col(a) / 16).cast("long").alias(f"t{a}")
    return cells.groupBy(tile("y"), tile("x")).agg(F.count("*").alias("cells"), (F.min("y") * 4).alias("y0"), ((F.max("y") + 1) * 4).alias("y1"))


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z = 40 AND y // 16 = 2 AND x // 16 = 1")
def read_tile(spark: SparkSession, sf: str) -> DataFrame:
    return grids.box(voxels(spark, sf), z=(40, 41), y=(32, 48), x=(16, 32)).select("z", "y", "x", "v")


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE y = 7 AND x BETWEEN 3 AND 5")
def depth_column(spark: SparkSession, sf: str) -> DataFrame:
    return grids.box(voxels(spark, sf), y=(7, 8), x=(3, 6)).select("z", "y", "x", "v")


@query(f"""
WITH {VOX}, c AS (SELECT DISTINCT z // 4 AS cz, y // 16 AS cy, x // 16 AS cx FROM vox)
SELECT cz, cy, cx FROM c WHERE cz BETWEEN 10 // 4 - 1 AND 29 // 4 + 1 AND cy BETWEEN 16 // 16 - 1 AND 31 // 16 + 1 AND cx BETWEEN 0 AND 15 // 16 + 1""")
def presync_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a region with one chunk around it."""
    chunk = [F.floor(F.col(a) / e).cast("long").alias(f"c{a}") for a, e in zip("zyx", (4, 16, 16))]
    return grids.box(voxels(spark, sf).select(*chunk).distinct(), cz=(1, 9), cy=(0, 3), cx=(0, 2))


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 4)::BIGINT AS shard FROM orders")
def export_shards(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", ((F.row_number().over(w) - 1) % 4).cast("long").alias("shard"))


@query("SELECT l_orderkey, count(*) AS channels FROM lineitem GROUP BY 1 HAVING count(*) = 1 + 3")
def copy_complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("channels")).where("channels = 1 + 3")


@query(f"""
WITH {PLANE}, b AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM plane WHERE v > 400)
SELECT y - y0 AS y, x - x0 AS x, v FROM plane, b WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""")
def export_owner_crop(spark: SparkSession, sf: str) -> DataFrame:
    p = plane(spark, sf)
    b = p.where("v > 400").agg(*(f(a).alias(f"{a}{k}") for a in "yx" for k, f in enumerate((F.min, F.max))))
    inside = p.crossJoin(F.broadcast(b)).where("y between y0 and y1 and x between x0 and x1")
    return inside.select((F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


@query("""
WITH s AS (SELECT source AS w, doc_id AS sheet FROM documents WHERE source <> 'news' OR doc_id % 3 = 0), b AS (SELECT source AS w, doc_id AS sheet, n_chars / 1000.0::DOUBLE AS score FROM documents WHERE doc_id % 3 > 0),
k AS (SELECT w, sheet, score, min(score) OVER (PARTITION BY w) AS least FROM s LEFT JOIN b USING (w, sheet))
SELECT w AS "window", sheet, CASE WHEN score IS NULL THEN 'manual' ELSE printf('%.4f', score) END AS quality, CASE WHEN least IS NULL THEN 'manual' ELSE printf('%.4f', round(least, 4)) END AS of_window FROM k""")
def edited_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets that an edit left alone keep their score, new ones are vouched for by hand."""
    d = table(spark, sf, "documents").select(F.col("source").alias("window"), F.col("doc_id").alias("sheet"), (F.col("n_chars") / 1000.0).alias("score"))
    return edits.edited_quality(d.where("window <> 'news' or sheet % 3 = 0"), d.where("sheet % 3 > 0"), "window")


@query("SELECT count_if(regexp_matches(name, '^\\d+$'))::BIGINT AS done FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'pass' || o_orderkey ELSE o_orderkey::VARCHAR END AS name FROM orders)")
def count_done(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("pass"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").agg(F.count_if(name.rlike(r"^\d+$")).alias("done"))


@query("SELECT page_id, sha1(url) AS key, url || '#' || page_id AS source FROM pages")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha1("url").alias("key"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("source"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def manifest_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""
WITH {PLANE}, q AS (SELECT event_id, value / 10 AS py, (event_id % 7000) / 10.0 AS px FROM events),
c AS (SELECT event_id, floor(py)::BIGINT + dy AS y, floor(px)::BIGINT + dx AS x,
  (CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w
  FROM q, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
SELECT event_id, round(sum(w * coalesce(v, 0)), 4) AS v FROM c LEFT JOIN plane USING (y, x) GROUP BY event_id""")
def bilinear_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 10).alias("py"), ((F.col("event_id") % 7000) / 10).alias("px"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1))))
    c = e.withColumn("c", corner)
    part = lambda a: F.when(F.col(f"c.d{a}") == 1, F.col(f"p{a}") - F.floor(f"p{a}")).otherwise(1 - (F.col(f"p{a}") - F.floor(f"p{a}")))
    c = c.select("event_id", *((F.floor(f"p{a}") + F.col(f"c.d{a}")).cast("long").alias(a) for a in "yx"), (part("y") * part("x")).alias("w"))
    return c.join(plane(spark, sf), ["y", "x"], "left").groupBy("event_id").agg(F.round(F.sum(F.col("w") * F.coalesce("v", F.lit(0))), 4).alias("v"))


@query("""
SELECT round(quantile_cont(l_extendedprice, 0.005), 2) AS p005, round(quantile_cont(l_extendedprice, 0.995), 2) AS p995,
       round(avg(l_extendedprice), 2) AS mean, round(stddev_samp(l_extendedprice), 2) AS spread FROM lineitem""")
def norm_params(spark: SparkSession, sf: str) -> DataFrame:
    v = "l_extendedprice"
    low, high = (F.round(F.lit(q).cast("double"), 2) for q in quantiles(table(spark, sf, "lineitem"), v, 0.005, 0.995))
    return table(spark, sf, "lineitem").agg(F.max(low).alias("p005"), F.max(high).alias("p995"), F.round(F.avg(v), 2).alias("mean"), F.round(F.stddev_samp(v), 2).alias("spread"))


@query("""
WITH r AS (SELECT i, unnest(['z', 'y', 'x']) AS a, unnest([400, 6000, 4000]) AS d FROM range(500) t(i))
SELECT i, max(CASE WHEN a = 'z' THEN v END) AS z, max(CASE WHEN a = 'y' THEN v END) AS y, max(CASE WHEN a = 'x' THEN v END) AS x FROM (
  SELECT i, a, 50 + floor(('0x' || substr(md5('11|' || i || '|' || a), 1, 8))::UBIGINT / 4294967296.0 * (d - 100))::BIGINT AS v FROM r) GROUP BY i""")
def sample_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sampled_windows(spark, 500, (400, 6000, 4000), 50, 11)


def _u(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::UBIGINT / 4294967296.0"


OCTANT = "(z >= 6)::INTEGER || '' || (y >= 6)::INTEGER || (x >= 6)::INTEGER"


@query(f"""
WITH {VOX}, c AS (SELECT z // 12 AS item, z % 12 AS z, y, x, v AS c0, (v * 7) % 256 AS c1 FROM vox),
o AS (SELECT *, item || '|' || {OCTANT} AS k FROM c)
SELECT item, z, y, x, CASE WHEN {_u("'4|' || k")} < 0.15 THEN 0 WHEN floor({_u("'3|' || k")} * 2) = 0 THEN c0 ELSE c1 END AS prev FROM o""")
def compose_prev(spark: SparkSession, sf: str) -> DataFrame:
    v = voxels(spark, sf)
    cells = v.select(F.floor(F.col("z") / 12).cast("long").alias("item"), (F.col("z") % 12).alias("z"), "y", "x", F.col("v").alias("c0"), ((F.col("v") * 7) % 256).alias("c1"), F.lit(6).alias("half"))
    return sampling.composed(cells, 2, 3).select("item", "z", "y", "x", F.col("prev").cast("long").alias("prev"))


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN abs(z * 0.5 + y * 0.0 + x * 0.75 - 40) <= 4 THEN 0 ELSE v END AS v FROM vox")
def fragment_prev(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.dropped(voxels(spark, sf), "v", (0.5, 0.0, 0.75), 40.0, 8.0).select("z", "y", "x", "v")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT ts::DATE) AS days FROM events GROUP BY user_id")
def distinct_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("""
SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank
FROM part QUALIFY rank <= 5""")
def top_by_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def skipped_steps(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return left.join(done, "l_orderkey", "left_anti")


@query("""
WITH b AS (SELECT s AS start, (row_number() OVER (ORDER BY s) - 1) // 4 AS block FROM (SELECT DISTINCT greatest(0, least(16 + k * 32, 2000 - 32)) AS s FROM range(-1, 64) r(k)))
SELECT block::BIGINT AS block, count(*) AS windows, min(start)::BIGINT AS first, (max(start) + 32)::BIGINT AS last FROM b GROUP BY block""")
def pass_blocks(spark: SparkSession, sf: str) -> DataFrame:
    from voxlake.plans.tiling import window_grid

    starts = window_grid(2000, 32, 16, 0, 2000)
    df = spark.createDataFrame([(s, i // 4) for i, s in enumerate(starts)], "start long, block long")
    return df.groupBy("block").agg(F.count("*").alias("windows"), F.min("start").alias("first"), (F.max("start") + 32).alias("last"))


@query("SELECT label, vec_id AS kept FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) = 1")
def nearest_representative(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.get("embedding", 0).alias("d"))
    return corpus.preferred(e, ("label",), F.desc("d"), F.col("vec_id")).select("label", F.col("vec_id").alias("kept"))
