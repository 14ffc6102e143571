"""A procedural volume: every voxel follows from its coordinates, so any box can be read without a store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxlake.functions.vectors import clip
from voxlake.plans.tiling import pyramid_shapes

SHAPES = {"deep": (400, 6000, 4000), "surface": (65, 6000, 4000)}
LEVELS = 4


def catalog(spark: SparkSession) -> DataFrame:
    """The demo's fixed values: two scrolls and their segments."""
    scrolls = [("demo-1", 54, 7.91, "read", 4), ("demo-5", 53, 3.24, "ink", 3)]
    rows = [(s, e, um, c, f"{s}-seg{100 + i}", round(1.5 + 0.7 * i, 1), "demo", i) for s, e, um, c, n in scrolls for i in range(n)]
    return spark.createDataFrame(rows, "scroll_id string, energy int, resolution_um double, category string, segment_id string, area_cm2 double, author string, seed int")


def voxel(z: Column, y: Column, x: Column, shape: tuple[int, int, int], seed: int = 0, fade: float = 1.0) -> Column:
    """The byte at full-resolution coordinates: weave, ink strokes at mid depth, and wraps around the middle."""
    two_pi, theta = F.lit(2) * F.pi(), 0.35 + 0.25 * seed
    wave = lambda c, p: F.sin(two_pi * c / p)
    weave = 0.5 + 0.5 * fade * wave(x * F.cos(F.lit(theta)) + y * F.sin(F.lit(theta)), 6.0 + 1.5 * seed)
    ground = 0.55 + 0.10 * wave(x, 1500.0) * wave(y, 1700.0)
    depth = (z - shape[0] // 2) / 8.0
    strokes = 0.5 + 0.5 * F.tanh(3.0 * F.sin(two_pi * x / 55.0 + 2.0 * F.sin(y / 13.0)))
    ink = F.exp(-0.5 * depth * depth) * (0.5 + 0.5 * wave(y, 140.0)) * strokes
    radius = F.sqrt((x - shape[2] / 2.0) * (x - shape[2] / 2.0) + (y - shape[1] / 2.0) * (y - shape[1] / 2.0))
    wraps = 0.6 + 0.4 * (0.5 + 0.5 * wave(radius, 48.0))
    return F.floor(clip(ground * (1.0 - 0.6 * ink * weave) * wraps, 0.0, 1.0) * 255).cast("int")


def read_box(spark: SparkSession, box: tuple[int, int, int, int, int, int], level: int = 0, kind: str = "deep", seed: int = 0) -> DataFrame:
    """(z, y, x, v) of a box of a level, clipped to the level's shape; rows are dealt by Spark from a range of numbers."""
    shapes = pyramid_shapes(SHAPES[kind], LEVELS)
    z0, z1, y0, y1, x0, x1 = (max(0, min(b, shapes[level][i // 2])) for i, b in enumerate(box))
    nz, ny, nx = max(0, z1 - z0), max(0, y1 - y0), max(0, x1 - x0)
    cell = spark.range(nz * ny * nx)
    cell = cell.select((F.floor(F.col("id") / max(1, ny * nx)) + z0).alias("z"), (F.floor(F.col("id") / max(1, nx)) % max(1, ny) + y0).alias("y"), (F.col("id") % max(1, nx) + x0).alias("x"))
    full = [F.col(a) * (s0 / s) for a, s0, s in zip("zyx", shapes[0], shapes[level])]
    return cell.withColumn("v", voxel(*full, shapes[0], seed))


class DemoVolume(DataSource):
    """spark.read.format("voxlake_demo").option("box", "0:4,0:64,0:64"): one partition for each depth layer."""

    @classmethod
    def name(cls) -> str:
        return "voxlake_demo"

    def schema(self) -> str:
        return "z long, y long, x long, v int"

    def reader(self, schema) -> DataSourceReader:
        return _DemoReader(self.options)


class _DemoReader(DataSourceReader):
    def __init__(self, options) -> None:
        from voxlake.sources.catalog import parse_region

        self.box, self.seed = parse_region(options.get("box", "0:1,0:64,0:64")), int(options.get("seed", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(z) for z in range(self.box[0], min(self.box[1], SHAPES["deep"][0]))]

    def read(self, partition: InputPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shape, z = SHAPES["deep"], float(partition.value)
        y, x = (g.ravel().astype(float) for g in np.meshgrid(np.arange(self.box[2], min(self.box[3], shape[1])), np.arange(self.box[4], min(self.box[5], shape[2])), indexing="ij"))
        wave = lambda c, p: np.sin(2 * np.pi * c / p)
        theta = 0.35 + 0.25 * self.seed
        weave = 0.5 + 0.5 * wave(x * np.cos(theta) + y * np.sin(theta), 6.0 + 1.5 * self.seed)
        ink = np.exp(-0.5 * ((z - shape[0] // 2) / 8.0) ** 2) * (0.5 + 0.5 * wave(y, 140.0)) * (0.5 + 0.5 * np.tanh(3 * np.sin(2 * np.pi * x / 55.0 + 2 * np.sin(y / 13.0))))
        wraps = 0.6 + 0.4 * (0.5 + 0.5 * wave(np.hypot(x - shape[2] / 2, y - shape[1] / 2), 48.0))
        v = (np.clip((0.55 + 0.10 * wave(x, 1500.0) * wave(y, 1700.0)) * (1 - 0.6 * ink * weave) * wraps, 0, 1) * 255).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), int(z))), pa.array(y.astype(np.int64)), pa.array(x.astype(np.int64)), pa.array(v)], names=["z", "y", "x", "v"])
