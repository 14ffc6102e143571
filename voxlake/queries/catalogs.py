"""Queries on catalogs: names, choices, corpora, queues, labels and their losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import names
from voxlake.operators import corpus, edits, losses
from voxlake.queries.registry import query
from voxlake.sources import catalog, demo
from voxlake.sources.tables import table


@query("""
WITH h AS (
  SELECT DISTINCT l_suppkey AS supplier, p_partkey AS listed, p_size::DOUBLE AS um, p_brand || '_' || p_size || 'um' || lpad(p_partkey::VARCHAR, 12, '_') AS name
  FROM lineitem JOIN part ON p_partkey = l_partkey
)
SELECT supplier, listed, (row_number() OVER (
  PARTITION BY supplier ORDER BY (NOT (contains(lower(name), 'masked') OR contains(lower(name), 'standardized')))::INTEGER, um, name))::INTEGER AS rank FROM h""")
def rank_volumes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("listed"), F.concat("p_brand", F.lit("_"), "p_size", F.lit("um")).alias("name"))
    held = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("listed")).distinct()
    named = held.join(part, "listed").withColumn("name", F.concat("name", F.lpad(F.col("listed").cast("string"), 12, "_")))
    return catalog.ranked_volumes(named, "supplier", "name").select("supplier", "listed", "rank")


@query("""
WITH m AS (SELECT o_orderkey AS mesh_id, o_custkey % 100 AS scan, (o_totalprice / 5000)::BIGINT AS max_z FROM orders),
v AS (SELECT c_custkey AS listed, c_custkey % 100 AS scan, (c_acctbal / 100)::BIGINT AS dim_z, c_nationkey + 1 AS voxel FROM customer)
SELECT mesh_id, listed, voxel FROM m JOIN v ON v.scan = m.scan AND max_z < dim_z
QUALIFY row_number() OVER (PARTITION BY mesh_id ORDER BY voxel, listed) = 1""")
def fitting_scan(spark: SparkSession, sf: str) -> DataFrame:
    whole = lambda c, n: F.bround(F.col(c) / n, 0).cast("long")
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mesh_id"), (F.col("o_custkey") % 100).alias("scan"), whole("o_totalprice", 5000).alias("max_z"), F.lit(0).alias("max_y"))
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("listed"), (F.col("c_custkey") % 100).alias("scan"), whole("c_acctbal", 100).alias("dim_z"), F.lit(1).alias("dim_y"), (F.col("c_nationkey") + 1).alias("voxel"))
    return catalog.fitting_scan(m, v, "scan").select("mesh_id", "listed", "voxel")


@query("""
SELECT o_orderkey, l_linenumber, md5('7|' || o_orderkey || '|' || l_linenumber) AS h FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_discount >= 0.05 ORDER BY h LIMIT 1000""")
def positional_join_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The seeded sample is the operator: the first thousand joined places in the order of a hash."""
    o, l = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").where("l_discount >= 0.05")
    j = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_orderkey", "l_linenumber", F.md5(F.concat_ws("|", F.lit("7"), "o_orderkey", "l_linenumber")).alias("h")).orderBy("h").limit(1000)


@query("SELECT doc_id, ('0x' || substr(md5(source || '|' || coalesce(lang, '') || '|' || doc_id), 1, 8))::UBIGINT::BIGINT AS seed FROM documents")
def master_seed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", names.master_seed(F.col("source"), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("seed"))


URIS = """u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 's3://store/' || page_id || '.zarr/' WHEN 1 THEN url WHEN 2 THEN 'file:///data/' || page_id WHEN 3 THEN 'a/b' || page_id || '.zarr'
  WHEN 4 THEN 'scroll' || page_id ELSE '/mnt/' || page_id || '.tif' END AS uri FROM pages)"""


@query(f"""
WITH {URIS}
SELECT page_id, regexp_replace(regexp_extract(rtrim(uri, '/'), '([^/]*)$', 1), '\\.zarr$', '') AS label,
  CASE WHEN starts_with(uri, 'file://') THEN 'local' WHEN starts_with(uri, 's3://') OR starts_with(uri, 'http://') OR starts_with(uri, 'https://') THEN 'http'
       WHEN ends_with(rtrim(uri, '/'), '.zarr') OR starts_with(uri, '/') THEN 'local' ELSE 'scroll' END AS kind,
  regexp_extract(uri, '^https?://([^/]+)', 1) AS host FROM u""")
def regex_catalog(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    kinds = (F.concat(F.lit("s3://store/"), n, F.lit(".zarr/")), F.col("url"), F.concat(F.lit("file:///data/"), n), F.concat(F.lit("a/b"), n, F.lit(".zarr")), F.concat(F.lit("scroll"), n), F.concat(F.lit("/mnt/"), n, F.lit(".tif")))
    uri = F.get(F.array(*kinds), (F.col("page_id") % 6).cast("int"))
    u = table(spark, sf, "pages").select("page_id", uri.alias("uri"))
    return u.select("page_id", names.source_label(F.col("uri")).alias("label"), names.source_kind(F.col("uri")).alias("kind"), F.regexp_extract("uri", "^https?://([^/]+)", 1).alias("host"))


@query(r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace('00' || p_partkey || substr(p_brand, 1, 2) || p_size, '([A-Za-z])(\d)', '\1 \2', 'g'), '(\d)([A-Za-z])', '\1 \2', 'g'), '^0+(\d)', '\1')) AS name,
  nullif(regexp_extract('vol-' || p_size || '.5UM-x', '(?i)(\d+(?:\.\d+)?)\s*um', 1), '')::DOUBLE AS um FROM part""")
def pretty_names(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.lit("00"), F.col("p_partkey").cast("string"), F.substring("p_brand", 1, 2), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", names.pretty_name(code).alias("name"), names.voxel_um(F.concat(F.lit("vol-"), "p_size", F.lit(".5UM-x"))).alias("um"))


@query("SELECT o_orderkey, 's' || o_custkey || '_L' || (o_orderkey % 3) || '_z' || (o_orderkey % 7) || '_y' || (o_custkey % 5) || '_x' || (o_orderkey % 11) AS id FROM orders")
def window_ids(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", names.window_id(c.cast("string"), k % 3, k % 7, c % 5, k % 11).alias("id"))


@query("""
SELECT CASE WHEN o_orderkey % 3 = 1 THEN 'c' || o_custkey ELSE 'main' END AS scroll, o_orderkey % 9 AS z, o_custkey % 7 AS y, o_custkey AS x FROM orders WHERE o_orderkey % 5 > 0""")
def coords_lines(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    gap = F.when(k % 2 == 0, ", ").otherwise("  ")
    text = F.concat(F.lit(" "), F.when(k % 3 == 1, F.concat(F.lit("c"), c, gap)).otherwise(""), (k % 9).cast("string"), gap, (F.col("o_custkey") % 7).cast("string"), F.lit(","), c, F.lit(" "))
    lines = table(spark, sf, "orders").select(F.when(k % 10 == 0, F.lit("# a note, 1 2 3")).when(k % 10 == 5, F.lit("  ")).otherwise(text).alias("value"))
    return catalog.parse_coords(lines, "main")


@query("""
WITH a AS (SELECT doc_id, source, n_chars, doc_id % 7 = 0 AS edited, 0 AS i FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, 'second', n_chars + 1, doc_id % 5 = 0, 1 FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, source, n_chars, edited FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY edited DESC, i DESC) = 1""")
def corpus_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    first = d.where("doc_id % 3 <> 0").withColumn("edited", F.col("doc_id") % 7 == 0)
    second = d.where("doc_id % 2 = 0").select("doc_id", F.lit("second").alias("source"), (F.col("n_chars") + 1).alias("n_chars"), (F.col("doc_id") % 5 == 0).alias("edited"))
    return corpus.merged([first, second], ("doc_id",))


@query("""
WITH base AS (SELECT conv_id, turn, role, text FROM conversations), ch AS (SELECT conv_id, turn, 'changed' AS role, text FROM conversations WHERE conv_id % 4 = 0 AND turn % 2 = 1),
u AS (SELECT * FROM base ANTI JOIN ch USING (conv_id, turn) UNION ALL SELECT * FROM ch)
SELECT conv_id, turn, role FROM u WHERE conv_id % 9 <> 2""")
def upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    changes = base.where("conv_id % 4 = 0 and turn % 2 = 1").withColumn("role", F.lit("changed"))
    up = corpus.upserted(base, changes, ("conv_id", "turn"))
    return corpus.deleted(up, base.where("conv_id % 9 = 2").select("conv_id"), ("conv_id",)).select("conv_id", "turn", "role")


@query("""
SELECT d.source, count_if(q >= 0.85)::BIGINT AS passing FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 0.8 + (doc_id % 20) / 100.0 ELSE 0.1 END AS q FROM labels) l
JOIN documents d USING (doc_id) GROUP BY d.source HAVING count_if(q >= 0.85) >= 2""")
def window_gate(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.8 + (F.col("doc_id") % 20) / 100.0).otherwise(0.1).alias("q"))
    return corpus.gated(q.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id"), "source", "q", 0.85, 2)


@query("""
WITH p AS (SELECT page_id, length(html) AS size, page_id % 16 AS shard FROM pages),
s AS (SELECT *, sum(size) OVER (PARTITION BY shard) AS total, coalesce(sum(size) OVER (PARTITION BY shard ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  row_number() OVER (PARTITION BY shard ORDER BY page_id DESC) = 1 AS newest FROM p)
SELECT page_id, (total > 20000 AND total - gone > 18000 AND NOT newest)::INTEGER AS evicted FROM s""")
def lru_evict(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.length("html").alias("size"), (F.col("page_id") % 16).alias("shard"))
    return corpus.evicted(p, "size", ("page_id",), 20000, "shard").select("page_id", "evicted")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 3 THEN 'orphan' ELSE 'open' END AS state FROM orders WHERE o_orderstatus <> 'F'""")
def work_queue_remaining(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return corpus.remaining(o, o.where("o_orderstatus = 'F'"), o.where("o_orderkey % 11 = 3"), "o_orderkey")


@query("""
WITH b AS (SELECT p_brand AS scroll, p_size AS z, p_partkey % 20 AS y, avg(p_retailprice) AS score FROM part GROUP BY ALL)
SELECT scroll, z::BIGINT AS z, y, round(score, 4) AS score, row_number() OVER (PARTITION BY scroll ORDER BY round(score, 4) DESC, z, y)::INTEGER AS rank FROM b QUALIFY rank <= 18""")
def scout_rank(spark: SparkSession, sf: str) -> DataFrame:
    b = _scores(spark, sf)
    from pyspark.sql import Window

    w = Window.partitionBy("scroll").orderBy(F.desc("score"), "z", "y")
    return b.withColumn("rank", F.row_number().over(w)).where("rank <= 18").select("scroll", "z", "y", "score", "rank")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("scroll"), F.col("p_size").cast("long").alias("z"), (F.col("p_partkey") % 20).alias("y")).agg(F.round(F.avg("p_retailprice"), 4).alias("score"))


@query()
def scout_nms_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy picks at least three cells apart, 18 for each brand."""
    return corpus.spaced_picks(_scores(spark, sf).withColumn("x", F.lit(0).cast("long")), "scroll", "score", 3, 18)


JOINED = "j AS (SELECT doc_id, lang, source, quality, toxic, n_chars, (doc_id % 100) / 100.0 AS p, (doc_id % 7) / 7.0 AS u FROM labels JOIN documents USING (doc_id))"


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").withColumn("p", (F.col("doc_id") % 100) / 100.0).withColumn("u", (F.col("doc_id") % 7) / 7.0)


@query(f"WITH {JOINED} SELECT doc_id, round(1 - (1 - p) * (1 - u), 6) AS uncertainty, round(p * u * (1 - toxic * 0.5), 6) AS confidence FROM j")
def soft_or_confidence(spark: SparkSession, sf: str) -> DataFrame:
    j = _joined(spark, sf)
    return j.select("doc_id", F.round(corpus.soft_or(F.col("p"), F.col("u")), 6).alias("uncertainty"), F.round(corpus.combined_confidence(F.col("p"), F.col("u"), 1 - F.col("toxic") * 0.5), 6).alias("confidence"))


@query(f"""WITH {JOINED} SELECT doc_id, CASE WHEN quality = 0 THEN 2 WHEN p >= 0.5 AND u < 0.5 THEN 2 WHEN p >= 0.5 THEN 1 ELSE 0 END AS label FROM j""")
def surface_label_case(spark: SparkSession, sf: str) -> DataFrame:
    label = corpus.surface_label(F.col("p"), F.col("quality").cast("double"), F.col("u"), crest=0.5)
    return _joined(spark, sf).select("doc_id", label.alias("label"))


@query(f"WITH {JOINED} SELECT source, round((2 * sum(p * quality) + 1) / (sum(p) + sum(quality) + 1), 6) AS dice FROM j WHERE toxic = 0 GROUP BY source")
def dice_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return losses.dice(_joined(spark, sf), ("source",), "p", "quality", F.col("toxic") == 1).withColumn("dice", F.round("dice", 6))


@query(f"""
WITH {JOINED}, s AS (SELECT lang, sum(p * quality) AS tp, sum(p * (1 - quality)) AS fp, sum((1 - p) * quality) AS fn FROM j GROUP BY lang)
SELECT lang, round(1 - (tp + 1e-5) / (tp + 0.3 * fp + 0.7 * fn + 1e-5), 6) AS loss FROM s""")
def tversky(spark: SparkSession, sf: str) -> DataFrame:
    return losses.tversky(_joined(spark, sf), ("lang",), "p", "quality").withColumn("loss", F.round("loss", 6))


@query(f"WITH {JOINED} SELECT lang, round(1 - sum(p * quality) / greatest(sum(quality), 1e-6), 6) AS loss FROM j GROUP BY lang")
def skeleton_recall(spark: SparkSession, sf: str) -> DataFrame:
    return losses.recall_of(_joined(spark, sf), ("lang",), "p", "quality").withColumn("loss", F.round("loss", 6))


@query("""
WITH m AS (SELECT max(label) AS m FROM embeddings)
SELECT vec_id, CASE WHEN label IN (2, 5, 7) THEN 2 WHEN label = 4 AND vec_id % 20 < 7 THEN m + 2 WHEN label = 4 THEN m + 1 ELSE label END AS label FROM embeddings, m""")
def relabel_edits(spark: SparkSession, sf: str) -> DataFrame:
    """One label split in two new ones by the sides of its units, then three labels merged into the first."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("unit"), "label")
    sides = spark.range(20).select(F.col("id").alias("unit"), (F.col("id") < 7).cast("int").alias("side"))
    return corpus.relabelled(edits.sides_apart(e, 4, sides, keep=False), "label", [2, 5, 7]).select("vec_id", "label")


@query("""
WITH m AS (SELECT max(label) AS m FROM embeddings), s AS (SELECT count_if(label = 1) AS a, count_if(label = 3) AS b FROM embeddings),
p AS (SELECT vec_id, CASE WHEN label = 4 AND vec_id % 20 < 7 THEN m + 1 ELSE label END AS label FROM embeddings, m)
SELECT vec_id, CASE WHEN label IN (1, 3) THEN CASE WHEN a >= b THEN 1 ELSE 3 END ELSE label END AS label FROM p, s""")
def sheet_edits(spark: SparkSession, sf: str) -> DataFrame:
    """An edit that keeps ids: one side of a label gets a new one, and two labels become the larger of them."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("unit"), "label")
    sides = spark.range(20).select(F.col("id").alias("unit"), (F.col("id") < 7).cast("int").alias("side"))
    return edits.merged_sheets(edits.sides_apart(e, 4, sides, keep=True), 1, 3).select("vec_id", "label")


@query("""
WITH p AS (SELECT round_even(greatest(0, least(127, user_id % 150)), 0)::BIGINT AS y, round_even(greatest(0, least(99, value)), 0)::BIGINT AS x FROM events WHERE event_type = 'purchase'),
r AS (SELECT DISTINCT y + i AS y, x + j AS x FROM (SELECT DISTINCT y, x FROM p), range(-4, 5) a(i), range(-4, 5) b(j) WHERE abs(i) + abs(j) <= 4)
SELECT y, x FROM r WHERE y BETWEEN 0 AND 127 AND x BETWEEN 0 AND 99""")
def deleted_region(spark: SparkSession, sf: str) -> DataFrame:
    """The cells that a deleted unit's points leave without trust."""
    p = table(spark, sf, "events").select((F.col("user_id") % 150).cast("double").alias("py"), F.col("value").cast("double").alias("px"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"))
    return edits.deleted_sheets(p, [1], {"y": 128, "x": 100})[1]


@query("SELECT n_name, count(*) AS n, min(c_acctbal) AS finest FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def finest_voxel(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(n, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("finest"))


@query("""
WITH s AS (SELECT event_id, CASE event_id % 40 WHEN 0 THEN NULL WHEN 1 THEN 'infinity'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE (event_id * 37 % 9000) / 2.0 / (event_id % 3 * event_id % 90 + 1) END AS s FROM events),
r AS (SELECT event_id, s, CASE WHEN isfinite(s) THEN round_even(s, 0)::BIGINT END AS r FROM s)
SELECT event_id, CASE WHEN r IS NULL THEN '??' WHEN r >= 3600 THEN (r // 3600) || 'h' || lpad((r % 3600 // 60)::VARCHAR, 2, '0') || 'm'
  WHEN r >= 60 THEN (r // 60) || 'm' || lpad((r % 60)::VARCHAR, 2, '0') || 's' ELSE r || 's' END AS took FROM r""")
def duration_texts(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    s = F.when(e % 40 == 0, F.lit(None)).when(e % 40 == 1, float("inf")).when(e % 40 == 2, float("nan")).otherwise((e * 37 % 9000) / 2.0 / (e % 3 * e % 90 + 1))
    return table(spark, sf, "events").select("event_id", names.duration_text(s).alias("took"))


@query("""
SELECT s AS scroll_id, s || '-seg' || (100 + i) AS segment_id, round(1.5 + 0.7 * i, 1)::DOUBLE AS area_cm2, i::INTEGER AS seed
FROM (SELECT 'demo-1' AS s, unnest(range(4)) AS i UNION ALL SELECT 'demo-5', unnest(range(3)))""")
def demo_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return demo.catalog(spark).select("scroll_id", "segment_id", "area_cm2", "seed")


@query("SELECT * FROM (VALUES (0, 0.533333), (1, 0.266667), (2, 0.133333), (3, 0.066667), (4, 0.0)) t(level, weight)".replace("SELECT *", "SELECT level, weight::DOUBLE AS weight"))
def supervision_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(i, round(w, 6)) for i, w in enumerate(losses.supervision_weights(5))]
    return reduce(DataFrame.unionAll, [spark.range(1).select(F.lit(i).alias("level"), F.lit(w).cast("double").alias("weight")) for i, w in rows])


LISTING = """l AS (SELECT 'P' || lpad(s_suppkey::VARCHAR, 4, '0') || CASE WHEN s_suppkey % 7 = 0 THEN 'Cr' ELSE '' END AS code FROM supplier UNION ALL SELECT 'other' || r_regionkey FROM region),
v AS (SELECT 'P' || lpad(ps::VARCHAR, 4, '0') || CASE WHEN ps % 7 = 0 THEN 'Cr' ELSE '' END AS code, um FROM (SELECT DISTINCT l_suppkey AS ps, p_size + 0.25 AS um FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 3 > 0)),
f AS (SELECT n_nationkey::VARCHAR AS scroll, 'read' AS status, 'note on ' || n_name AS notes FROM nation WHERE n_nationkey IN (1, 2))"""


@query(f"""
WITH {LISTING}, m AS (SELECT code, min(um) AS um FROM v GROUP BY code),
c AS (SELECT code, um, CASE code WHEN 'P0005' THEN '1' WHEN 'P0009' THEN '2' WHEN 'P0004' THEN '3' ELSE code END AS scroll,
  'P ' || trim(regexp_replace(regexp_replace(regexp_replace(substr(code, 2), '([A-Za-z])(\\d)', '\\1 \\2', 'g'), '(\\d)([A-Za-z])', '\\1 \\2', 'g'), '^0+(\\d)', '\\1')) AS pretty
  FROM l LEFT JOIN m USING (code) WHERE starts_with(code, 'P')),
g AS (SELECT *, CASE WHEN scroll = '1' THEN 'read' WHEN scroll = '2' THEN 'ink' WHEN code IN ('P0003', 'P0008') THEN 'first_letters' ELSE '' END AS category,
  CASE WHEN scroll IN ('1', '2', '3') THEN 'Scroll ' || scroll || ' (' || pretty || ')' ELSE pretty END AS base FROM c)
SELECT scroll, code, base || CASE WHEN um IS NULL THEN '' ELSE ' (' || printf('%.2f', um::DOUBLE) || ' um)' END AS name, category,
  coalesce(f.status, CASE WHEN category = 'first_letters' THEN 'unread' END) AS status,
  coalesce(f.notes, CASE WHEN category = 'first_letters' THEN 'no text found yet: ' || pretty ELSE 'raw scan: ' || pretty END) AS notes, um::DOUBLE AS resolution_um,
  row_number() OVER (ORDER BY CASE WHEN scroll IN ('1', '2', '3') THEN scroll::INTEGER ELSE 1073741824 END, code) AS place
FROM g LEFT JOIN f USING (scroll)""")
def scroll_list(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog of scrolls from a listing, the names of their volumes and what is known of some."""
    from pyspark.sql import Window

    code = lambda c: F.concat(F.lit("P"), F.lpad(F.col(c).cast("string"), 4, "0"), F.when(F.col(c) % 7 == 0, "Cr").otherwise(""))
    others = table(spark, sf, "region").select(F.concat(F.lit("other"), F.col("r_regionkey").cast("string")).alias("code"))
    listing = table(spark, sf, "supplier").select(code("s_suppkey").alias("code")).unionAll(others)
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("volume-7-"), F.col("p_size").cast("string"), F.lit(".25um-x.zarr")).alias("volume"))
    volumes = table(spark, sf, "lineitem").where("l_suppkey % 3 > 0").select("l_suppkey", "l_partkey").join(sizes, "l_partkey").select(code("l_suppkey").alias("code"), "volume").distinct()
    facts = table(spark, sf, "nation").where("n_nationkey in (1, 2)").select(F.col("n_nationkey").cast("string").alias("scroll"), F.lit("read").alias("status"), F.concat(F.lit("note on "), "n_name").alias("notes"))
    found = catalog.scroll_list(listing, volumes, facts, "P", {"P0005": "1", "P0009": "2", "P0004": "3"}, ["1"], ["2"], ["P0003", "P0008"])
    return found.withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long"))  # a catalog, not a corpus


@query("""
WITH v AS (SELECT o_orderkey, 'volume-' || (o_orderkey % 40) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'um' END AS base, (o_orderkey % 40)::VARCHAR AS token FROM orders),
p AS (SELECT l_orderkey AS o_orderkey, l_linenumber * 1000000 + l_partkey AS listed, CASE WHEN l_partkey % 4 = 0 THEN 'ink-' || (l_partkey % 40) || '.PNG' ELSE 'other-' || l_returnflag END AS preview FROM lineitem)
SELECT o_orderkey, arg_min(preview, listed) AS preview FROM p JOIN v USING (o_orderkey) WHERE contains(lower(preview), token) OR contains(lower(preview), base) GROUP BY o_orderkey""")
def matching_preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first preview that was made from each volume."""
    o, p = F.col("o_orderkey"), F.col("l_partkey")
    volumes = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("s3://store/Volume-"), (o % 40).cast("string"), F.when(o % 3 == 0, "").otherwise("um"), F.lit(".zarr/")).alias("volume"))
    previews = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber").cast("long") * 1000000 + p).alias("listed"), F.when(p % 4 == 0, F.concat(F.lit("ink-"), (p % 40).cast("string"), F.lit(".PNG"))).otherwise(F.concat(F.lit("other-"), "l_returnflag")).alias("preview"))
    return catalog.matching_preview(previews, volumes, "o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '1') OR contains(lower(n_name), 'ru')")
def selected_scrolls(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.selected_scrolls(table(spark, sf, "nation"), "n_name", " 1, RU").select("n_nationkey", "n_name")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'R'
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linestatus <> 'O')::INTEGER, l_linenumber, l_partkey) = 1""")
def first_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first candidate in order that can be opened."""
    order = [(F.col("l_linestatus") != "O").cast("int"), F.col("l_linenumber"), F.col("l_partkey")]
    return catalog.first_found(table(spark, sf, "lineitem"), "l_orderkey", order, F.col("l_returnflag") != "R").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT p_partkey, greatest(0, least(p_partkey % 900 - p_size // 2, greatest(0, 800 - p_size)))::BIGINT AS begin,
  greatest(32, least(224, round_even(1500.0 / (p_size / 4.0), 0)))::INTEGER AS edge, greatest(16, least(128, round_even(500.0 / (p_size / 4.0), 0)))::INTEGER AS depth FROM part""")
def window_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Windows around centres, and their edges in voxels."""
    voxel = F.col("p_size") / 4.0
    return table(spark, sf, "part").select("p_partkey", catalog.clipped_window(F.col("p_partkey") % 900, F.col("p_size"), F.lit(800)).alias("begin"), names.window_pixels(voxel, 1500.0, 32, 224).alias("edge"), names.window_pixels(voxel, 500.0, 16, 128).alias("depth"))


@query("""
WITH l AS (SELECT o_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS d, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
b AS (SELECT o_orderkey, list(d ORDER BY l_linenumber, d, r) || list(r ORDER BY l_linenumber, d, r) AS bits FROM l GROUP BY o_orderkey),
y AS (SELECT o_orderkey, bits, unnest(range(0, (len(bits) + 7) // 8)) AS i FROM b),
h AS (SELECT o_orderkey, i, list_sum(list_transform(range(0, 8), lambda k: coalesce(bits[i * 8 + k + 1], 0) * (1 << (7 - k))))::INTEGER AS v FROM y)
SELECT b.o_orderkey, p.packed, array_to_string(bits, '') AS bits FROM b JOIN (SELECT o_orderkey, string_agg(printf('%02X', v), '' ORDER BY i) AS packed FROM h GROUP BY o_orderkey) p USING (o_orderkey)""")
def packed_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Masks as packed bits, and read back."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") >= 0.05).cast("int").alias("a"), (F.col("l_returnflag") == "R").cast("int").alias("b")))).alias("s"))
    l = l.select("o_orderkey", F.concat(F.transform("s", lambda x: x["a"]), F.transform("s", lambda x: x["b"])).alias("bits"))
    held = l.join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.size("bits").alias("n"), names.packed_bits(F.col("bits")).alias("packed"))
    return held.select("o_orderkey", "packed", F.array_join(names.unpacked_bits(F.col("packed"), F.col("n")).cast("array<string>"), "").alias("bits"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_size::DOUBLE * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 WHEN 2 THEN 1000.0 ELSE 1.0 END, 6) END AS um FROM part""")
def metadata_voxel(spark: SparkSession, sf: str) -> DataFrame:
    """Voxel sizes from the attributes of stores."""
    k = F.col("p_partkey")
    unit = F.get(F.array(F.lit("Micrometer"), F.lit("nm"), F.lit("millimeter"), F.lit("")), (k % 4).cast("int"))
    kind = F.when(k % 5 == 0, "translation").otherwise("scale")
    attributes = F.format_string('{"multiscales":[{"axes":[{"name":"z"},{"name":"y"},{"name":"x","unit":"%s"}],"datasets":[{"path":"0","coordinateTransformations":[{"type":"%s","scale":[1,1,%s]}]}]}]}', unit, kind, F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.round(names.voxel_um_from_metadata(attributes), 6).alias("um"))


@query("""
WITH m AS (SELECT DISTINCT doc_id % 40 AS z, doc_id % 9 AS y, doc_id % 7 AS x FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, m.z IS NOT NULL AS held FROM (SELECT doc_id, doc_id % 41 AS z, doc_id % 9 AS y, doc_id % 7 AS x FROM documents) a LEFT JOIN m ON m.z = a.z AND m.y = a.y AND m.x = a.x""")
def windows_held(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a corpus has a window."""
    at = lambda n: [F.lit("s").alias("scroll"), F.lit(0).alias("level"), (F.col("doc_id") % n).alias("z"), (F.col("doc_id") % 9).alias("y"), (F.col("doc_id") % 7).alias("x")]
    d = table(spark, sf, "documents")
    return corpus.windows_held(d.where("doc_id % 2 = 0").select(*at(40)), d.select("doc_id", *at(41))).select("doc_id", "held")


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 'second' ELSE source END AS origin FROM documents WHERE doc_id % 6 = 0 OR doc_id % 3 > 0""")
def imported_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of another corpus, byte for byte, on top of one's own."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("origin"))
    return corpus.imported(d.where("id % 3 > 0"), d.withColumn("origin", F.lit("second")), d.where("id % 6 = 0"))


@query("""SELECT * FROM (VALUES (0, '', ''), (1, 'z', ''), (2, 'y', ''), (3, 'zy', ''), (4, '', 'zx'), (5, '', 'zy')) t(i, mirror, swap)""")
def mirrored_views(spark: SparkSession, sf: str) -> DataFrame:
    """The views that a text asks for, plain first."""
    from voxlake.plans.tiling import mirrored_variants

    return spark.createDataFrame([(i, *v) for i, v in enumerate(mirrored_variants("y, z,rotate"))], "i int, mirror string, swap string")
