"""Addresses of regions and windows, volume choice, chunk tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.functions.names import pretty_name, scroll_category, scroll_name, source_label, volume_token, voxel_um


def parse_region(spec: str | None) -> tuple[int, int, int, int, int, int] | None:
    """`z0:z1,y0:y1,x0:x1` as six numbers, each range in order; None, the whole volume, for an empty text."""
    if not spec:
        return None
    parts = [p.split(":") for p in spec.split(",")]
    if len(parts) != 3 or any(len(p) != 2 for p in parts):
        raise ValueError(f"a region is z0:z1,y0:y1,x0:x1, not {spec!r}")
    box = tuple(int(x) for p in parts for x in p)
    if any(box[i] >= box[i + 1] for i in (0, 2, 4)):
        raise ValueError(f"empty range in {spec!r}")
    return box


def parse_coords(lines: DataFrame, default_scroll: str | None, column: str = "value") -> DataFrame:
    """(scroll, z, y, x) of lines of three numbers, or of a scroll and three; commas and white space part them.

    Lines that are empty or begin with `#` are left out; other forms fail, and so do three numbers without a default scroll.
    """
    text = F.trim(F.regexp_replace(column, r"\s+", " "))
    kept = lines.select(text.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    parts = kept.select("t", F.filter(F.split("t", "[, ]+"), lambda x: x != "").alias("p"))
    bad = F.raise_error(F.concat(F.lit("not a coordinate line: "), F.col("t"))).cast("string")
    n = F.size("p")
    number = lambda back: F.element_at("p", -back).cast("long")
    alone = F.lit(default_scroll) if default_scroll else bad
    scroll = F.when(n == 4, F.get("p", 0)).when(n == 3, alone).otherwise(bad)
    return parts.select(scroll.alias("scroll"), number(3).alias("z"), number(2).alias("y"), number(1).alias("x"))


def ranked_volumes(volumes: DataFrame, scroll: str, name: str) -> DataFrame:
    """volumes with their rank in a scroll: masked or standardised ones first, then the finest, unknown sizes last."""
    lower = F.lower(name)
    first = F.when(lower.contains("masked") | lower.contains("standardized"), 0).otherwise(1)
    w = Window.partitionBy(scroll).orderBy(first, F.coalesce(voxel_um(F.col(name)), F.lit(1e9)), name)
    return volumes.withColumn("rank", F.row_number().over(w))


def fitting_scan(meshes: DataFrame, volumes: DataFrame, on: str) -> DataFrame:
    """For each mesh the finest volume of its scan whose shape holds the mesh's box; the first listed on ties.

    Only volumes that no finer (or equal and earlier) volume of the scan holds within its own shape can be chosen; where a
    scan has many, this leaves few rows to join.
    """
    own = F.struct("voxel", "listed")
    best = volumes.groupBy(on, "dim_z", "dim_y").agg(F.min(own).alias("_own"))
    other = best.select(on, F.col("dim_z").alias("_z"), F.col("dim_y").alias("_y"), F.col("_own").alias("_o"))
    beaten = best.join(other, on).where((F.col("_z") >= F.col("dim_z")) & (F.col("_y") >= F.col("dim_y")) & (F.col("_o") < F.col("_own"))).select(on, "dim_z", "dim_y").distinct()
    left = volumes.withColumn("_own", own).join(best, [on, "dim_z", "dim_y", "_own"], "left_semi").join(beaten, [on, "dim_z", "dim_y"], "left_anti").drop("_own")
    met = meshes.join(left, on).where((F.col("max_z") < F.col("dim_z")) & (F.col("max_y") < F.col("dim_y")))
    columns = [c for c in met.columns if c != "mesh_id"]
    first = met.groupBy("mesh_id").agg(F.min(F.struct("voxel", "listed", *(c for c in columns if c not in ("voxel", "listed")))).alias("_f"))
    return first.select("mesh_id", *(f"_f.{c}" for c in columns))


def matching_preview(previews: DataFrame, volumes: DataFrame, key: str) -> DataFrame:
    """(key, preview): of each volume's previews (key, listed, preview) the first listed that names its number or its name."""
    name = F.lower(source_label(F.col("volume")))
    met = previews.join(volumes.select(key, name.alias("_base"), volume_token(F.col("volume")).alias("_token")), key)
    lower = F.lower("preview")
    said = (F.col("_token").isNotNull() & lower.contains(F.col("_token"))) | ((F.col("_base") != "") & lower.contains(F.col("_base")))
    return met.where(said).groupBy(key).agg(F.min_by("preview", "listed").alias("preview"))


def scroll_list(listing: DataFrame, volumes: DataFrame, facts: DataFrame, prefix: str, numbered: dict[str, str], read: list[str], inked: list[str], sought: list[str]) -> DataFrame:
    """(scroll, code, name, category, status, notes, resolution_um, place): the catalog of scrolls.

    listing: (code) of folders; volumes: (code, volume) whose names tell the voxel size; facts: (scroll, status, notes).
    place: scrolls with a number first, by number, then by code.
    """
    finest = volumes.groupBy("code").agg(F.min(voxel_um(F.col("volume"))).alias("resolution_um"))
    codes = listing.where(F.col("code").startswith(prefix)).join(finest, "code", "left")
    known = F.create_map(*(F.lit(x) for pair in numbered.items() for x in pair))
    named = codes.withColumn("scroll", F.coalesce(F.try_element_at(known, F.col("code")), F.col("code")))
    pretty = F.concat(F.lit(prefix + " "), pretty_name(F.col("code"), prefix))
    base = scroll_name(F.col("scroll"), pretty, list(numbered.values()))
    found = named.join(facts, "scroll", "left").withColumn("category", scroll_category(F.col("scroll"), F.col("code"), read, inked, sought))
    sought_after = F.col("category") == "first_letters"
    return found.select(
        "scroll", "code",
        F.when(F.col("resolution_um").isNotNull(), F.concat(base, F.lit(" ("), F.format_string("%.2f", "resolution_um"), F.lit(" um)"))).otherwise(base).alias("name"),
        "category",
        F.coalesce("status", F.when(sought_after, "unread")).alias("status"),
        F.coalesce("notes", F.when(sought_after, F.concat(F.lit("no text found yet: "), pretty)).otherwise(F.concat(F.lit("raw scan: "), pretty))).alias("notes"),
        "resolution_um",
        F.struct(F.when(F.col("scroll").isin(list(numbered.values())), F.col("scroll").cast("int")).otherwise(1 << 30).alias("number"), "code").alias("place"),
    )


def selected_scrolls(scrolls: DataFrame, column: str, spec: str) -> DataFrame:
    """Scrolls that hold any of the comma-separated tokens, in either case; all of them for `all`."""
    tokens = [t.strip().lower() for t in spec.split(",") if t.strip()]
    if "all" in tokens:
        return scrolls
    lower = F.lower(column)
    return scrolls.where(reduce(lambda a, t: a | lower.contains(t), tokens, F.lit(False)))


def first_found(candidates: DataFrame, key: str, order: list[Column], ok: Column) -> DataFrame:
    """Of each key's candidates the first in order that holds; keys without one are left out."""
    held = candidates.where(ok)
    return held.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def clipped_window(centre: Column, size: Column, dim: Column) -> Column:
    """The begin of a window of `size` around a centre, moved into the axis."""
    return F.greatest(F.lit(0), F.least(centre - F.floor(size / 2), F.greatest(F.lit(0), dim - size))).cast("long")


def chunked(grid: DataFrame, edge: tuple[int, int, int] = (4, 16, 16)) -> DataFrame:
    """Chunk table of a long grid: (cz, cy, cx, vmax, cells); box scans prune by chunk numbers, air by vmax."""
    keys = [F.floor(F.col(a) / e).cast("long").alias(f"c{a}") for a, e in zip("zyx", edge)]
    return grid.groupBy(*keys).agg(F.max("v").alias("vmax"), F.collect_list(F.struct("z", "y", "x", "v")).alias("cells"))


def chunk_box(chunks: DataFrame, box: tuple[int, int, int, int, int, int], edge: tuple[int, int, int] = (4, 16, 16), least: int = 0) -> DataFrame:
    """Cells of a box from a chunk table: chunks first by number and vmax, then cells."""
    for i, a in enumerate("zyx"):
        chunks = chunks.where(F.col(f"c{a}").between(box[2 * i] // edge[i], (box[2 * i + 1] - 1) // edge[i]))
    cells = chunks.where(F.col("vmax") >= least).select(F.explode("cells").alias("s")).select("s.*")
    inside: Column = F.lit(True)
    for i, a in enumerate("zyx"):
        inside = inside & (F.col(a) >= box[2 * i]) & (F.col(a) < box[2 * i + 1])
    return cells.where(inside)


def region_list(spark: SparkSession, path: str) -> DataFrame:
    """(scroll, z, y, x, size) of a list of `SCROLL,Z,Y,X,SIZE` lines."""
    return spark.read.csv(path, schema="scroll string, z long, y long, x long, size long", comment="#")
