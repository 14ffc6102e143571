"""Queries on points, vectors and graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.functions.vectors import centroids as centroids_of
from voxlake.functions.vectors import dot, mutual_weight, slab_log_score
from voxlake.operators import clusters, edits, graph, spatial
from voxlake.queries.registry import query
from voxlake.sources.tables import table

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
#: Half the square of 1.13 on unit vectors.
NEAR = 1 - 1.13**2 / 2
PAIRS = f"""pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, {DOT.format(a='a.embedding', b='b.embedding')} AS dot
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


def _pairs(spark: SparkSession, sf: str, least: float = NEAR) -> DataFrame:
    return spatial.blocked_pairs(table(spark, sf, "embeddings"), least)


@query(f"WITH {PAIRS} SELECT a, b, round(dot, 6) AS dot FROM pairs WHERE dot >= {NEAR}")
def radius_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("a", "b", F.round("dot", 6).alias("dot"))


POINTS = "pts AS (SELECT event_id AS id, value / 10 AS px, hour(ts) + minute(ts) / 60.0 AS py FROM events WHERE event_type = 'purchase')"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("id"), (F.col("value") / 10).alias("px"), (F.hour("ts") + F.minute("ts") / 60.0).alias("py"))


@query(f"""
WITH {POINTS} SELECT a.id AS a, b.id AS b, round((a.px - b.px) ** 2 + (a.py - b.py) ** 2, 6) AS d2
FROM pts a JOIN pts b ON a.id < b.id WHERE (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 0.09""")
def grid_radius_join(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.radius_pairs(_points(spark, sf), ("px", "py"), 0.3).select("a", "b", F.round("d2", 6).alias("d2"))


KNN = f"""{PAIRS}, two AS (SELECT a, b, dot FROM pairs UNION ALL SELECT b, a, dot FROM pairs),
near AS (SELECT a, b, round(dot, 9) AS dot, row_number() OVER (PARTITION BY a ORDER BY round(dot, 9) DESC, b)::INTEGER AS rank FROM two QUALIFY rank <= 5)"""


def _knn(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest_vectors(table(spark, sf, "embeddings"), 5)


@query(f"WITH {KNN} SELECT a, b, rank, round(dot, 6) AS dot FROM near")
def knn_k(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf).select("a", "b", "rank", F.round("dot", 6).alias("dot"))


@query(f"WITH {KNN} SELECT n.a, n.b FROM near n JOIN near m ON m.a = n.b AND m.b = n.a WHERE n.a < n.b")
def mutual_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.mutual(_knn(spark, sf).select("a", "b"))


SLAB = """s AS (
  SELECT vec_id AS id, label, embedding[1]::DOUBLE * 10 AS z, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS x,
    embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings),
u AS (SELECT id, label, z, y, x, a / sqrt(a*a+b*b+c*c) AS nz, b / sqrt(a*a+b*b+c*c) AS ny, c / sqrt(a*a+b*b+c*c) AS nx FROM s),
q AS (
  SELECT p.id AS i, o.id AS j, o.z - p.z AS vz, o.y - p.y AS vy, o.x - p.x AS vx, p.nz, p.ny, p.nx, o.nz AS mz, o.ny AS my, o.nx AS mx
  FROM u p JOIN u o ON p.id < o.id AND p.label <> o.label WHERE (o.z-p.z)*(o.z-p.z)+(o.y-p.y)*(o.y-p.y)+(o.x-p.x)*(o.x-p.x) <= 0.25),
w AS (SELECT *, vz*nz+vy*ny+vx*nx AS ac, -(vz*mz+vy*my+vx*mx) AS bc, vz*vz+vy*vy+vx*vx AS vv FROM q),
t AS (SELECT *,
  -(greatest(vv - ac*ac, 0) / 2 + ac*ac / CASE WHEN ac >= 0 THEN 0.5 ELSE 0.8 END) AS sij,
  -(greatest(vv - bc*bc, 0) / 2 + bc*bc / CASE WHEN bc >= 0 THEN 0.5 ELSE 0.8 END) AS sji FROM w)"""


@query(f"WITH {SLAB} SELECT i, j, round(exp(greatest(-60, least(0, sij + sji))) / (1 + exp((abs(ac) * 30 - 30) / 12)), 6) AS weight FROM t")
def mutual_weight_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    at = lambda k: F.get("embedding", k).cast("double")
    size = F.sqrt(at(3) * at(3) + at(4) * at(4) + at(5) * at(5))
    u = e.select(F.col("vec_id").alias("id"), "label", *((at(k) * 10).alias(n) for k, n in enumerate(("pz", "py", "px"))), *((at(k + 3) / size).alias(n) for k, n in enumerate(("nz", "ny", "nx"))))
    pairs = spatial.radius_pairs(u, ("pz", "py", "px"), 0.5)
    side = lambda s, c: u.select(F.col("id").alias(c), *(F.col(n).alias(f"{n}_{s}") for n in u.columns if n != "id"))
    j = pairs.join(side("i", "a"), "a").join(side("j", "b"), "b").where("label_i <> label_j")
    chord = tuple(F.col(f"{n}_j") - F.col(f"{n}_i") for n in ("pz", "py", "px"))
    back = tuple(-c for c in chord)
    flat = [(F.lit(0.0),) * 3] * 3
    normal = lambda s: tuple(F.col(f"{n}_{s}") for n in ("nz", "ny", "nx"))
    across = sum((c * n for c, n in zip(chord, normal("i"))), F.lit(0.0))
    one, other = slab_log_score(chord, normal("i"), flat, 2.0, 0.5, 0.8), slab_log_score(back, normal("j"), flat, 2.0, 0.5, 0.8)
    return j.select(F.col("a").alias("i"), F.col("b").alias("j"), F.round(mutual_weight(one, other, across * 30), 6).alias("weight"))


CENTROIDS = """cent AS (
  SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL)"""


@query(f"WITH {CENTROIDS} SELECT label, i::INTEGER AS i, round(m, 6) AS m FROM cent")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = centroids_of(table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "m")).select("label", "i", F.round("m", 6).alias("m"))


@query("""
WITH l AS (SELECT o_custkey AS unit, max(o_custkey % 7) AS label FROM orders GROUP BY o_custkey)
SELECT c_custkey AS unit, coalesce(label, -1) AS label FROM customer LEFT JOIN l ON unit = c_custkey""")
def per_unit_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The label of each unit's points (one by construction); -1 for a unit without points."""
    units = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"))
    points = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), (F.col("o_custkey") % 7).alias("label"))
    return edits.unit_labels(units, points)


@query(f"""
WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE dot >= {NEAR} UNION ALL SELECT b, a FROM pairs WHERE dot >= {NEAR}),
r(id, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def cc_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connected_components(_pairs(spark, sf)).select("id", "component")


@query(f"""
WITH RECURSIVE {POINTS}, pr AS (
  SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id WHERE (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py) <= 0.09),
core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*) + 1 >= 4),
e AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
r(id, c) AS (SELECT id, id FROM core UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c),
k AS (SELECT id, min(c) AS cluster FROM r GROUP BY id),
border AS (SELECT pr.a AS id, min(cluster) AS cluster FROM pr JOIN k ON k.id = pr.b GROUP BY pr.a)
SELECT pts.id, (k.id IS NOT NULL)::INTEGER AS core, coalesce(k.cluster, border.cluster, -1) AS cluster
FROM pts LEFT JOIN k USING (id) LEFT JOIN border ON border.id = pts.id""")
def dbscan(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dbscan(_points(spark, sf), ("px", "py"), 0.3, 4).fillna(-1, ["cluster"])


@query(f"""
WITH {KNN}, known AS (SELECT vec_id AS b, label FROM embeddings WHERE vec_id % 5 <> 0),
v AS (SELECT n.a, k.label, count(*) AS n FROM near n JOIN known k ON k.b = n.b WHERE n.a % 5 = 0 GROUP BY ALL)
SELECT a, label FROM v QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1""")
def knn_vote_fill(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "embeddings").where("vec_id % 5 <> 0").select(F.col("vec_id").alias("b"), "label")
    return graph.vote_fill(_knn(spark, sf).where("a % 5 = 0").select("a", "b"), labels)


@query("""
WITH m AS (SELECT label, count(*) AS n, avg(embedding[1]::DOUBLE) AS pc FROM embeddings GROUP BY label),
big AS (SELECT * FROM m WHERE n >= (SELECT quantile_cont(n, 0.3) FROM m)),
o AS (SELECT label, n, lead(label) OVER w AS l2, lead(label, 2) OVER w AS l3, n + lead(n) OVER w + lead(n, 2) OVER w AS size
      FROM big WINDOW w AS (ORDER BY round(pc, 9), label))
SELECT label AS l1, l2, l3, size::BIGINT AS size FROM o WHERE l3 IS NOT NULL""")
def ordinal_runs(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg(F.get("embedding", 0).cast("double")).alias("pc"))
    least = m.agg(F.percentile("n", F.lit(0.3)).alias("t"))
    w = Window.orderBy(F.round("pc", 9), "label")  # over the labels only
    o = m.crossJoin(F.broadcast(least)).where("n >= t")
    ahead = lambda c, k: F.lead(c, k).over(w)
    o = o.select(F.col("label").alias("l1"), ahead("label", 1).alias("l2"), ahead("label", 2).alias("l3"), (F.col("n") + ahead("n", 1) + ahead("n", 2)).alias("size"))
    return o.where("l3 is not null")


@query(f"""SELECT vec_id, round(sqrt({DOT.format(a='embedding', b='embedding')}), 6) AS norm FROM embeddings""")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@query()
def density_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters of each label's vectors, size-penalised."""
    keep = clusters.soft_size_keep(50.0)
    return clusters.per_group(table(spark, sf, "embeddings"), "label", "embedding", "vec_id", lambda z: clusters.density_clusters(z[:, :8], 4, keep))


@query()
def forced_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every label in two along its clearest seam."""

    def side(z: np.ndarray) -> np.ndarray:
        found = clusters.split_side(z, z, force=True)
        return np.zeros(len(z), int) if found is None else found[0].astype(int)

    return clusters.per_group(table(spark, sf, "embeddings"), "label", "embedding", "vec_id", side)


@query()
def linkage_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Complete linkage of the first five dimensions within a label, cut at a distance."""

    def labels(z: np.ndarray) -> np.ndarray:
        d = np.zeros((len(z), len(z)))
        for x in z[:, :5].T:  # one matrix of distances at a time
            d += (x[:, None] - x) ** 2
        return clusters.complete_linkage(np.sqrt(d, out=d), 0.3)

    return clusters.per_group(table(spark, sf, "embeddings"), "label", "embedding", "vec_id", labels)


@query()
def embed_train(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding of each label's vectors from close and far pairs: the spread that is reached."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(rows.sort_values("vec_id")["embedding"].to_list()).astype(float)
        near, far = clusters.product_pairs(z, *clusters.product_quantiles(z, (0.9, 0.1))) if len(z) > 1 else (((), ()), ((), ()))
        e = clusters.embedded(len(z), near, far, steps=50)
        return pd.DataFrame([(int(rows["label"].iloc[0]), len(z), round(float(e.std()), 4))], columns=["label", "n", "spread"])

    return table(spark, sf, "embeddings").select("label", "vec_id", "embedding").repartition(64, "label").groupBy("label").applyInPandas(run, "label int, n long, spread double")


@query()
def mesh_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet through each label's first three dimensions: vertices, triangles, mean distance of points to the sheet."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.stack(rows.sort_values("vec_id")["embedding"].to_list()).astype(float)[:, :3] * 10
        g, foot = clusters.fitted_sheet(p, 0.5, rounds=25)
        d = np.sqrt(((p[:, None] - g.reshape(-1, 3)[None]) ** 2).sum(-1)).min(1)
        return pd.DataFrame([(int(rows["label"].iloc[0]), int(foot.size), len(clusters.triangles(foot)), round(float(d.mean()), 4))], columns=["label", "vertices", "triangles", "distance"])

    return table(spark, sf, "embeddings").select("label", "vec_id", "embedding").groupBy("label").applyInPandas(run, "label int, vertices long, triangles long, distance double")
