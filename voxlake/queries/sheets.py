"""Queries on membership in sheets: cells of normals, negatives, widths along rays, slabs, crests, congruence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import membership as ops
from voxlake.queries.grids import VOX
from voxlake.queries.registry import query
from voxlake.queries.spaces import SLAB, mutual_weight_pairs
from voxlake.sources.tables import table, voxels

#: Points with unit normals, spread over the middle of a 48 x 64 x 64 grid.
SHAPE = (48, 64, 64)
POINTS = """s AS (
  SELECT vec_id AS id, label, 24 + embedding[1]::DOUBLE * 40 AS pz, 32 + embedding[2]::DOUBLE * 60 AS py, 32 + embedding[3]::DOUBLE * 60 AS px,
    embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings),
u AS (SELECT id, label, pz, py, px, a / sqrt(a*a+b*b+c*c) AS nz, b / sqrt(a*a+b*b+c*c) AS ny, c / sqrt(a*a+b*b+c*c) AS nx FROM s)"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k: F.get("embedding", k).cast("double")
    size = F.sqrt(at(3) * at(3) + at(4) * at(4) + at(5) * at(5))
    place = (24 + at(0) * 40, 32 + at(1) * 60, 32 + at(2) * 60)
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label", *(c.alias(f"p{a}") for c, a in zip(place, "zyx")), *((at(k) / size).alias(f"n{a}") for k, a in enumerate("zyx", 3)))


CELLS = f"""{POINTS},
o AS (SELECT min(pz) AS z, min(py) AS y, min(px) AS x FROM u),
g AS (SELECT u.*, floor((pz - z) / 8)::BIGINT AS cz, floor((py - y) / 8)::BIGINT AS cy, floor((px - x) / 8)::BIGINT AS cx,
      z + (floor((pz - z) / 8) + 0.5) * 8 AS oz, y + (floor((py - y) / 8) + 0.5) * 8 AS oy, x + (floor((px - x) / 8) + 0.5) * 8 AS ox FROM u, o),
t AS (SELECT cz, cy, cx, count(*) AS n, min(oz) AS oz, min(oy) AS oy, min(ox) AS ox, sum(nz*nz) AS a, sum(ny*ny) AS b, sum(nx*nx) AS c, sum(nz*ny) AS d, sum(nz*nx) AS e, sum(ny*nx) AS f,
      first(id ORDER BY round((pz-oz)*(pz-oz)+(py-oy)*(py-oy)+(px-ox)*(px-ox), 9), id) AS rep FROM g GROUP BY cz, cy, cx),
q AS (SELECT *, (a+b+c)/3 AS q, sqrt(((a-(a+b+c)/3)**2 + (b-(a+b+c)/3)**2 + (c-(a+b+c)/3)**2 + 2*(d*d+e*e+f*f))/6) AS p FROM t),
r AS (SELECT *, q + 2*p*cos(acos(greatest(-1, least(1, ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / greatest(2*p*p*p, 1e-300))))/3) AS l FROM q),
w AS (SELECT *, [d*f-e*(b-l), e*d-(a-l)*f, (a-l)*(b-l)-d*d] AS w1, [d*(c-l)-e*f, e*e-(a-l)*(c-l), (a-l)*f-d*e] AS w2, [(b-l)*(c-l)-f*f, f*e-d*(c-l), d*f-(b-l)*e] AS w3 FROM r),
v AS (SELECT *, w1[1]**2+w1[2]**2+w1[3]**2 AS s1, w2[1]**2+w2[2]**2+w2[3]**2 AS s2, w3[1]**2+w3[2]**2+w3[3]**2 AS s3 FROM w),
b AS (SELECT *, CASE WHEN s1 >= s2 AND s1 >= s3 THEN w1 WHEN s2 >= s3 THEN w2 ELSE w3 END AS m, sqrt(greatest(s1, s2, s3)) AS size FROM v),
cells AS (SELECT cz, cy, cx, n, oz, oy, ox, rep, m[1] / size * sg AS mz, m[2] / size * sg AS my, m[3] / size * sg AS mx
  FROM (SELECT *, sign(CASE WHEN abs(m[1]) > 1e-9 * size THEN m[1] WHEN abs(m[2]) > 1e-9 * size THEN m[2] ELSE m[3] END) AS sg FROM b))"""


@query(f"WITH {CELLS} SELECT cz, cy, cx, n, rep, round(oz, 6) AS oz, round(mz, 5) AS mz, round(my, 5) AS my, round(mx, 5) AS mx FROM cells")
def normal_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with the mean direction of their normals, and their representative point."""
    c = ops.normal_cells(_points(spark, sf), 8.0)
    return c.select("cz", "cy", "cx", "n", "rep", F.round("oz", 6).alias("oz"), *(F.round(f"m{a}", 5).alias(f"m{a}") for a in "zyx"))


DRAW = "('0x' || substr(md5('{seed}|' || {key}), 1, 8))::UBIGINT / 4294967296.0"
NAME = "c.cz || ',' || c.cy || ',' || c.cx"


@query(f"""
WITH {CELLS}, p AS (SELECT * FROM cells c ORDER BY {DRAW.format(seed=0, key=f"({NAME})")}, cz, cy, cx LIMIT 4096),
m AS (SELECT c.cz, c.cy, c.cx, p.rep, abs((p.oz-c.oz)*c.mz + (p.oy-c.oy)*c.my + (p.ox-c.ox)*c.mx) AS absr,
      {DRAW.format(seed=1, key=f"({NAME}) || '|' || p.cz || ',' || p.cy || ',' || p.cx")} AS u, p.cz AS pz, p.cy AS py, p.cx AS px FROM cells c, p)
SELECT cz, cy, cx, rep, round(absr, 5) AS absr FROM m WHERE absr >= 10 QUALIFY row_number() OVER (PARTITION BY cz, cy, cx ORDER BY u, pz, py, px) <= 6""")
def corridor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Far cells along each cell's normal, by a seeded draw."""
    return ops.corridor_negatives(ops.normal_cells(_points(spark, sf), 8.0), 10.0, 6).withColumn("absr", F.round("absr", 5))


def _profiles(steps: int, step: float, name: str) -> str:
    moved = lambda a, n: f"greatest(0, least({n - 1}, p{a} + side * k * {step} * n{a}))"
    q = ", ".join(f"{moved(a, n)} AS q{a}" for a, n in zip("zyx", SHAPE))
    share = " * ".join(f"abs(1 - d{a} - (q{a} - floor(q{a})))" for a in "zyx")
    place = ", ".join(f"(floor(q{a}) + d{a})::BIGINT AS {a}" for a in "zyx")
    return f"""
{name}_r AS (SELECT id, side, k, {q} FROM u, (VALUES (1), (-1)) a(side), range(0, {steps + 1}) b(k)),
{name}_c AS (SELECT id, side, k, {place}, {share} AS w FROM {name}_r, (VALUES (0), (1)) a(dz), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dx)),
{name}_v AS (SELECT id, side, k, sum(w * coalesce(v, 0)) AS v FROM {name}_c LEFT JOIN vox USING (z, y, x) WHERE w > 0 GROUP BY id, side, k),
{name} AS (SELECT *, max(CASE WHEN k = 0 THEN v END) OVER (PARTITION BY id, side) AS v0 FROM {name}_v)"""


WIDTHS = f"""{VOX}, {POINTS}, {_profiles(20, 0.5, "ray")},
widths AS (SELECT id, side, greatest(8, least(25, 0.5 * 4.5 * coalesce(min(CASE WHEN v < 0.6 * greatest(v0, 1e-6) THEN k END), 20))) AS sigma FROM ray GROUP BY id, side)"""


@query(f"WITH {WIDTHS} SELECT id, side, round(sigma, 6) AS sigma FROM widths")
def ray_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided widths of the sheet at each point, by rays along its normal through the grid."""
    rays = ops.profiles(_points(spark, sf), voxels(spark, sf), SHAPE, 20, 0.5)
    return ops.widths(rays, 20, 4.5).select("id", "side", F.round("sigma", 6).alias("sigma"))


STEP = 2.0 / 9.0


@query(f"""
WITH {WIDTHS}, {_profiles(60, STEP, "far")},
x AS (SELECT id, side, k, sigma, k * 2.0 AS t, v / greatest(v0, 1e-6) AS rel, greatest(2.5 * sigma, 15) AS gate FROM far JOIN widths USING (id, side) WHERE sigma < 25 - 1e-3),
y AS (SELECT *, min(CASE WHEN t >= gate AND rel < 0.3 THEN k END) OVER (PARTITION BY id, side) AS dip FROM x),
f AS (SELECT id, side, gate, min(CASE WHEN k >= dip AND rel >= 0.5 THEN k END) AS up, min(CASE WHEN t >= gate THEN rel END) AS depth FROM y GROUP BY id, side, gate HAVING up IS NOT NULL),
c AS (SELECT f.*, u.label, pz, py, px, nz, ny, nx, pz + side * up * {STEP} * nz AS qz, py + side * up * {STEP} * ny AS qy, px + side * up * {STEP} * nx AS qx FROM f JOIN u USING (id)),
m AS (SELECT c.*, o.id AS other, o.label AS other_label, o.pz - c.pz AS dz, o.py - c.py AS dy, o.px - c.px AS dx,
      (o.pz - qz) ** 2 + (o.py - qy) ** 2 + (o.px - qx) ** 2 AS d2 FROM c, u o WHERE o.id <> c.id),
n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY d2, other) <= 48),
b AS (SELECT *, (dz * side * nz + dy * side * ny + dx * side * nx) * 9 AS proj FROM n WHERE label <> other_label),
e AS (SELECT *, sqrt(greatest((dz * dz + dy * dy + dx * dx) - (proj / 9) ** 2, 0)) * 9 AS perp FROM b),
w AS (SELECT id, side, other, exp(-greatest(depth, 0) / 0.3) * exp(-0.5 * (perp / 40) ** 2) * exp(-proj / 60) AS weight FROM e WHERE proj > gate AND proj < 120 AND perp < 100),
k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, other, side) <= 32)
SELECT id, side, other, round(least(1, weight / (SELECT quantile_cont(weight, 0.95) FROM k)), 6) AS weight FROM k""")
def gap_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Points of other units beyond a real gap along the normal."""
    return ops.gap_negatives(_points(spark, sf), "label", voxels(spark, sf), SHAPE, 9.0).withColumn("weight", F.round("weight", 6))


@query(f"""
WITH {POINTS}, j AS (SELECT vec_id AS id, list_transform(embedding[7:15], lambda x: x::DOUBLE * 0.2) AS j FROM embeddings),
s2 AS (SELECT u.*, j.j, oz, oy, ox, round_even(pz, 0)::BIGINT + oz AS z, round_even(py, 0)::BIGINT + oy AS y, round_even(px, 0)::BIGINT + ox AS x
  FROM u JOIN j USING (id), range(-3, 4) a(oz), range(-3, 4) b(oy), range(-3, 4) c(ox)),
a AS (SELECT *, oz*nz+oy*ny+ox*nx AS ac FROM s2 WHERE z BETWEEN 0 AND 47 AND y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63),
b AS (SELECT *, oz-ac*nz AS vz, oy-ac*ny AS vy, ox-ac*nx AS vx FROM a),
c AS (SELECT *, greatest(vz*vz+vy*vy+vx*vx, 0) AS i2, vz*(j[1]*vz+j[2]*vy+j[3]*vx)+vy*(j[4]*vz+j[5]*vy+j[6]*vx)+vx*(j[7]*vz+j[8]*vy+j[9]*vx) AS bend FROM b),
d AS (SELECT *, -bend / greatest(i2, 1e-9) AS kap FROM c),
e AS (SELECT *, (ac - 0.5*kap*i2) / sqrt(1 + kap*kap*i2) AS off FROM d)
SELECT z, y, x, round(sum(exp(greatest(-60, -(i2 / 8.0 + off*off / CASE WHEN ac >= 0 THEN 0.5 ELSE 0.8 END)))), 6) AS mass FROM e GROUP BY z, y, x""")
def slab_field(spark: SparkSession, sf: str) -> DataFrame:
    """Mass of every point's curved slab on the cells around it."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), *((F.get("embedding", 6 + k).cast("double") * 0.2).alias(f"j{k}") for k in range(9)))
    jacobian = [tuple(F.col(f"j{3 * r + c}") for c in range(3)) for r in range(3)]
    return ops.slab_field(_points(spark, sf).join(e, "id"), jacobian, SHAPE, 3, 8.0, 0.5, 0.8).withColumn("mass", F.round("mass", 6))


@query(f"""
WITH {SLAB}, p AS (SELECT i, j, round(exp(greatest(-60, least(0, sij + sji))) / (1 + exp((abs(ac) * 30 - 30) / 12)), 6) AS weight FROM t),
b AS (SELECT i AS id, weight FROM p UNION ALL SELECT j, weight FROM p)
SELECT id, count_if(weight > 0.3)::BIGINT AS n FROM b GROUP BY id""")
def available_partners(spark: SparkSession, sf: str) -> DataFrame:
    """Partners whose mutual weight is high enough, by point."""
    return ops.available(mutual_weight_pairs(spark, sf), 0.3)


@query(f"""
WITH {POINTS}, s2 AS (SELECT u.*, 1.0 + label % 3 AS half, round_even(pz, 0)::BIGINT + oz AS z, round_even(py, 0)::BIGINT + oy AS y, round_even(px, 0)::BIGINT + ox AS x
  FROM u, range(-3, 4) a(oz), range(-3, 4) b(oy), range(-3, 4) c(ox)),
d AS (SELECT z, y, x, label, half, round(sqrt((z-pz)*(z-pz)+(y-py)*(y-py)+(x-px)*(x-px)), 9) AS d, abs((z-pz)*nz+(y-py)*ny+(x-px)*nx) AS plane
  FROM s2 WHERE z BETWEEN 0 AND 47 AND y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY z, y, x, label ORDER BY d, half, plane) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY d, label) AS r FROM n),
p AS (SELECT a.*, b.d AS bd, greatest(a.half, 0.5) + greatest(b.half, 0.5) AS env FROM (SELECT * FROM r WHERE r = 1) a LEFT JOIN (SELECT * FROM r WHERE r = 2) b USING (z, y, x)),
m AS (SELECT *, exp(-pow(plane / greatest(least(0.325 * greatest(half, 0.5), coalesce(0.35 * bd, 'infinity'::DOUBLE)), 0.5), 3)) AS mag FROM p)
SELECT z, y, x, label AS owner, round(mag, 6) AS magnitude, round(CASE WHEN bd IS NULL THEN 0 ELSE greatest(0, least(1, (env - bd) / greatest(env, 1e-6))) END, 6) AS overlap FROM m WHERE mag >= 0.05""")
def crest_field(spark: SparkSession, sf: str) -> DataFrame:
    """Owner, magnitude and overlap of sheets around their medial points."""
    medials = _points(spark, sf).withColumn("half", 1.0 + F.col("label") % 3)
    c = ops.crest_field(medials, SHAPE, 3)
    return c.select("z", "y", "x", "owner", F.round("magnitude", 6).alias("magnitude"), F.round("overlap", 6).alias("overlap"))


@query(f"""
WITH {VOX}, {POINTS}, f AS (SELECT z, y, x, v % 7 - 3 AS fz, v % 5 - 2 AS fy, v % 3 + 1 AS fx, v / 255.0 AS coh FROM vox),
j AS (SELECT label, abs(nz*fz + ny*fy + nx*fx) / (sqrt(fz*fz + fy*fy + fx*fx) + 1e-9) AS c, CASE WHEN coh > 0.05 THEN least(1, coh) ELSE 0 END AS w, coh
  FROM u JOIN f ON z = round_even(pz, 0)::BIGINT AND y = round_even(py, 0)::BIGINT AND x = round_even(px, 0)::BIGINT)
SELECT label, round(CASE WHEN sum(w) > 1e-6 THEN sum(c * w) / sum(w) ELSE avg(c) END, 6) AS score, count(*) AS vertices, round(avg(coh), 6) AS coherence FROM j GROUP BY label""")
def field_congruence(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of each label's normals with a field on the grid."""
    v = F.col("v")
    field = voxels(spark, sf).select("z", "y", "x", (v % 7 - 3).alias("fz"), (v % 5 - 2).alias("fy"), (v % 3 + 1).alias("fx"), (v / 255.0).alias("coherence"))
    c = ops.field_congruence(_points(spark, sf), field)
    return c.select("label", F.round("score", 6).alias("score"), "vertices", F.round("coherence", 6).alias("coherence"))


@query("""
WITH e AS (SELECT vec_id, embedding[1:6] AS e FROM embeddings), o AS (SELECT * FROM (VALUES (0, 1, 0, 0), (1, 1, 1, 0), (2, 0, 2, 3)) t(c, z, y, x))
SELECT vec_id, c, round(greatest(0, least(1, (e[1]::DOUBLE*z*z + e[2]::DOUBLE*y*y + e[3]::DOUBLE*x*x + 2*e[4]::DOUBLE*z*y + 2*e[5]::DOUBLE*z*x + 2*e[6]::DOUBLE*y*x) / (z*z+y*y+x*x))), 6) AS across FROM e, o""")
def across_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """How far three offsets go across the sheet of each tensor."""
    tensor = tuple(F.get("embedding", k).cast("double") for k in range(6))
    found = [F.struct(F.lit(c).alias("c"), F.round(ops.across(tensor, o), 6).alias("across")) for c, o in enumerate(((1, 0, 0), (1, 1, 0), (0, 2, 3)))]
    return table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*found)).alias("s")).select("vec_id", "s.c", "s.across")
