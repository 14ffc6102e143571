"""Chunk stores: a volume as a folder of raw chunks, one file each, with levels and a description.

    <store>/meta.json                 shape, chunk, levels, voxel size, kind of the values
    <store>/level=<k>/cz=<>/<cy>_<cx>.raw   little-endian bytes of a chunk, cut off at the volume's end

A chunk that is air is not written; a missing chunk reads as zeros. A box is read by opening only the chunks that it meets. Stores lie on a path that all machines share.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxlake.plans.tiling import pyramid_shapes
from voxlake.sources.catalog import parse_region

AXES = ("z", "y", "x")
Shape = tuple[int, int, int]


def describe(path: str) -> dict:
    """A store's description; fails where there is none."""
    with open(f"{path}/meta.json", encoding="utf-8") as f:
        return json.load(f)


def levels_of(path: str) -> list[int]:
    """Levels of a store, as it says, or found one after another where it does not; empty for no store."""
    try:
        told = describe(path).get("levels")
    except OSError:
        return []
    if told:
        return list(range(told))
    return list(itertools.takewhile(lambda k: os.path.isdir(f"{path}/level={k}"), itertools.count()))


def _chunk_path(path: str, level: int, at: tuple[int, ...]) -> str:
    return f"{path}/level={level}/cz={at[0]}/{at[1]}_{at[2]}.raw"


def write_level(grid: DataFrame, path: str, level: int, shape: Shape, chunk: Shape) -> int:
    """Writes a long grid (z, y, x, v: bytes) as chunks, each from one task; the number of chunks that hold something.

    A chunk is written beside its place and moved there, so a task that is run again changes nothing.
    """

    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = tuple(map(int, key))
        begin = [a * c for a, c in zip(at, chunk)]
        block = np.zeros([min(c, n - b) for b, c, n in zip(begin, chunk, shape)], np.uint8)
        block[tuple(rows[a].to_numpy() - b for a, b in zip(AXES, begin))] = rows["v"]
        if block.any():
            target = _chunk_path(path, level, at)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            beside = f"{target}.{os.getpid()}"
            block.tofile(beside)
            os.replace(beside, target)
        return pd.DataFrame([(*at, int(block.max(initial=0)))], columns=["cz", "cy", "cx", "top"])

    keys = [F.floor(F.col(a) / c).cast("long").alias(f"c{a}") for a, c in zip(AXES, chunk)]
    inside = grid
    for a, n in zip(AXES, shape):
        inside = inside.where((F.col(a) >= 0) & (F.col(a) < n))
    return inside.groupBy(*keys).applyInPandas(put, "cz long, cy long, cx long, top int").where("top > 0").count()


def write_store(grid: DataFrame, path: str, shape: Shape, chunk: Shape, voxel_um: float, levels: int = 1) -> None:
    """A new store of a grid, with a pyramid of largest values; fails where a store is. The description is written last."""
    from voxlake.operators.grids import pooled

    if os.path.exists(f"{path}/meta.json"):
        raise ValueError(f"{path} is a store already")
    os.makedirs(path, exist_ok=True)
    shapes = pyramid_shapes(shape, levels)
    spark = grid.sparkSession
    spark.dataSource.register(ChunkStore)
    for k, s in enumerate(shapes):
        if k:  # from the level below, as written
            below = spark.read.format("voxlake_store").option("path", path).option("level", str(k - 1)).option("meta", json.dumps({"shape": shape, "chunk": chunk, "levels": levels})).load()
            grid = pooled(below, AXES, "v", "max")
        write_level(grid.select(*AXES, "v"), path, k, s, chunk)
    with open(f"{path}/meta.json", "w", encoding="utf-8") as f:
        json.dump({"shape": shape, "chunk": chunk, "levels": levels, "voxel_um": voxel_um, "dtype": "uint8"}, f)


class ChunkStore(DataSource):
    """spark.read.format("voxlake_store").option("path", p).option("level", 1).option("box", "0:4,0:64,0:64"): cells that are not air."""

    @classmethod
    def name(cls) -> str:
        return "voxlake_store"

    def schema(self) -> str:
        return "z int, y int, x int, v int"

    def reader(self, schema) -> DataSourceReader:
        return _StoreReader(self.options)


#: Chunks that one task reads.
TOGETHER = 16


class _Chunks(InputPartition):
    def __init__(self, places: list[tuple[int, ...]]):
        self.places = places


class _StoreReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.level = options["path"], int(options.get("level", 0))
        meta = json.loads(options["meta"]) if "meta" in options else describe(self.path)
        if not 0 <= self.level < meta["levels"]:
            raise ValueError(f"{self.path} has no level {self.level}")
        self.shape, self.chunk = pyramid_shapes(tuple(meta["shape"]), meta["levels"])[self.level], tuple(meta["chunk"])
        asked = parse_region(options.get("box", "")) or tuple(x for n in self.shape for x in (0, n))
        self.box = [(max(0, asked[2 * i]), min(n, asked[2 * i + 1])) for i, n in enumerate(self.shape)]

    def partitions(self) -> list[InputPartition]:
        met = [range(low // c, -(-high // c)) if low < high else range(0) for (low, high), c in zip(self.box, self.chunk)]
        return [_Chunks(list(places)) for places in itertools.batched(itertools.product(*met), TOGETHER)] or [_Chunks([])]

    def read(self, partition: _Chunks) -> Iterator:
        for at in partition.places:
            path = _chunk_path(self.path, self.level, at)
            if os.path.exists(path):  # else air
                yield self._cells(path, at)

    def _cells(self, path: str, at: tuple[int, ...]):
        import pyarrow as pa

        begin = [a * c for a, c in zip(at, self.chunk)]
        block = np.fromfile(path, np.uint8).reshape([min(c, n - b) for b, c, n in zip(begin, self.chunk, self.shape)])
        cut = tuple(slice(max(0, low - b), max(0, high - b)) for (low, high), b in zip(self.box, begin))
        part = block[cut]
        where = np.nonzero(part)
        columns = [(w + b + s.start).astype(np.int32) for w, b, s in zip(where, begin, cut)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, part[where].astype(np.int32))], names=[*AXES, "v"])
