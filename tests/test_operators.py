"""Operators against NumPy and hand-made cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.functions import names
from voxlake.operators import clusters, corpus, fields, graph, grids, spatial
from voxlake.plans import refine, tiling
from voxlake.sources import catalog, demo
from voxlake.streaming import manifest


@given(st.integers(1, 300), st.integers(1, 64), st.integers(1, 64), st.integers(0, 32))
@settings(max_examples=60, deadline=None)
def test_overlap_grid_covers_the_axis(dim, size, stride, offset):
    stride = min(stride, size)
    starts = tiling.overlap_grid(dim, size, stride, offset)
    assert starts[0] == 0 and starts[-1] == max(0, dim - size)
    covered = {i for s in starts for i in range(s, s + size)}
    assert set(range(dim)) <= covered


@given(st.integers(1, 300), st.integers(1, 64), st.integers(0, 64))
@settings(max_examples=60, deadline=None)
def test_axis_tiles_are_disjoint_and_whole(dim, size, offset):
    tiles = tiling.axis_tiles(dim, size, offset)
    assert tiles[0][0] == 0 and tiles[-1][1] == dim
    assert all(a[1] == b[0] for a, b in zip(tiles, tiles[1:]))
    assert all(0 <= w <= max(0, dim - size) for _, _, w in tiles)


def test_short_axis_has_one_window():
    assert tiling.overlap_grid(5, 8, 4, 2) == [0] == tiling.window_grid(5, 8, 0, 0, 5)


def test_passes():
    assert tiling.resolve_passes("last", 4) == {3} and tiling.resolve_passes("0,-1", 4) == {0, 3} and tiling.resolve_passes("no", 2) == set()
    with pytest.raises(ValueError):
        tiling.resolve_passes("7", 3)


def test_demo_box_and_source_agree(spark):
    box = (198, 200, 0, 16, 0, 16)
    made = demo.read_box(spark, box).toPandas().sort_values(["z", "y", "x"])
    spark.dataSource.register(demo.DemoVolume)
    read = spark.read.format("voxlake_demo").option("box", "198:200,0:16,0:16").load().toPandas().sort_values(["z", "y", "x"])
    assert len(made) == 2 * 16 * 16 and made["v"].tolist() == read["v"].tolist()
    assert demo.read_box(spark, (0, 4, 0, 64, 0, 64)).count() == 4 * 64 * 64
    assert demo.read_box(spark, (399, 500, 5990, 7000, 3990, 9000)).count() == 10 * 10


def test_region_and_coords(spark):
    assert catalog.parse_region("0:1,2:3,4:9") == (0, 1, 2, 3, 4, 9)
    with pytest.raises(ValueError):
        catalog.parse_region("3:1,0:1,0:1")
    assert catalog.parse_region("") is None and catalog.parse_region(None) is None
    lines = spark.createDataFrame([("# note",), (" 1,2,3 ",), ("7 8 9",), ("s7, 4,5,6",), ("s8 4 5\t6",), ("",)], "value string")
    assert sorted(map(tuple, catalog.parse_coords(lines, "main").collect())) == [("main", 1, 2, 3), ("main", 7, 8, 9), ("s7", 4, 5, 6), ("s8", 4, 5, 6)]
    for text, scroll in (("1,2,3 # here", "main"), ("1,2,3", None)):
        with pytest.raises(Exception, match="not a coordinate line"):
            catalog.parse_coords(spark.createDataFrame([(text,)], "value string"), scroll).collect()
    with pytest.raises(Exception, match="not a coordinate line"):
        catalog.parse_coords(spark.createDataFrame([("1,2",)], "value string"), "main").collect()


def test_exact_quantiles(spark):
    from voxlake.operators.histogram import order_values, quantiles

    rng = np.random.default_rng(6)
    v = np.concatenate([rng.lognormal(0, 2, 3000), np.full(2000, 1.5)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    assert np.allclose(quantiles(df, "v", 0.0, 0.01, 0.5, 0.99, 1.0), np.percentile(v, [0, 1, 50, 99, 100]))
    assert order_values(df, "v", [0, 2500, 4999], bins=8, few=10) == {r: np.sort(v)[r] for r in (0, 2500, 4999)}
    assert quantiles(df.limit(0), "v", 0.5) == [None]


def test_names(spark):
    row = spark.range(1).select(names.pretty_name(F.lit("0172Cr3")), names.voxel_um(F.lit("a 7.91 UM x")), names.master_seed(F.lit("a"), F.lit("b")), names.duration_text(F.lit(3725.4))).first()
    assert tuple(row) == ("172 Cr 3", 7.91, 3497157185, "1h02m")
    texts = spark.createDataFrame([(45.2,), (723.0,), (3840.0,), (None,), (float("inf"),), (59.5,)], "s double").select(names.duration_text(F.col("s")))
    assert [r[0] for r in texts.collect()] == ["45s", "12m03s", "1h04m", "??", "??", "1m00s"]


def test_radius_pairs_match_brute_force(spark):
    rng = np.random.default_rng(0)
    p = rng.random((300, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, z double, y double, x double")
    got = {(r.a, r.b) for r in spatial.radius_pairs(df, ("z", "y", "x"), 0.15).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= 0.15**2}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, graph.connected_components(edges).collect()))
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def test_maximin_three_cases():
    nodes = pd.DataFrame({"id": range(6), "label": [1, 1, 1, 2, 2, 2]})
    edges = pd.DataFrame({"a": [0, 1, 3, 4, 2], "b": [1, 2, 4, 5, 3], "aff": [1.0, 1.0, 1.0, 1.0, 0.0]})
    assert graph.maximin_loss(nodes, edges, True)[0] == 0 == graph.maximin_loss(nodes, edges, False)[0]  # perfect
    merged = edges.assign(aff=[1, 1, 1, 1, 0.9])
    assert graph.maximin_loss(nodes, merged, False)[0] == pytest.approx(0.81)  # a merge is pushed down
    split = edges.assign(aff=[1, 0.2, 1, 1, 0])
    assert graph.maximin_loss(nodes, split, True)[0] > 0  # a split is pushed up


def test_distance_owner_is_exact():
    rng = np.random.default_rng(1)
    seeds = np.where(rng.random((7, 8, 9)) < 0.02, rng.integers(1, 5, (7, 8, 9)), 0)
    d, owner = fields.distance_owner(seeds)
    at = np.argwhere(seeds)
    every = ((np.argwhere(np.ones_like(seeds))[:, None] - at[None]) ** 2).sum(-1)
    assert np.array_equal(d.ravel(), every.min(1))
    assert all(seeds[tuple(at[k])] in {seeds[tuple(at[j])] for j in np.flatnonzero(e == e.min())} for e, k in zip(every, every.argmin(1)))


def test_structure_tensor_finds_planes():
    z = np.arange(24)[:, None, None] * np.ones((24, 24, 24))
    f = fields.structure_tensor(np.sin(z * 2 * np.pi / 8), 1.0, 2.0)
    assert np.abs(f["normal"][12, 12, 12, 0]) > 0.99 and f["coherence"][12, 12, 12] > 0.9
    assert abs(np.median(fields.local_period(np.sin(z * 2 * np.pi / 8))[8:16, 8:16, 8:16]) - 8) < 1


def test_three_planes_three_clusters():
    rng = np.random.default_rng(2)
    z = np.concatenate([rng.normal((10 * k, 0, 0), 0.3, (40, 3)) for k in range(3)])
    labels = clusters.density_clusters(z, 5)
    assert len({*labels.tolist()} - {-1}) == 3
    assert all(len({*labels[40 * k : 40 * k + 40].tolist()} - {-1}) == 1 for k in range(3))


def test_split_and_linkage():
    rng = np.random.default_rng(3)
    e = np.concatenate([rng.normal(0, 0.1, (40, 4)), rng.normal(3, 0.1, (40, 4))])
    side, gap = clusters.split_side(e, e)
    assert gap > 1 and len({*side[:40].tolist()}) == 1 and side[0] != side[-1]
    assert clusters.split_side(rng.normal(0, 1, (5, 2)), e[:, :2], force=True) is not None
    assert clusters.complete_linkage(np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0.0]]), 2).tolist() == [0, 0, 1]


def test_sheet_and_triangles():
    u, v = np.meshgrid(np.arange(10.0), np.arange(10.0))
    p = np.stack([u.ravel(), v.ravel(), 0 * u.ravel()], 1)
    g, foot = clusters.sheet_grid(p, 2.0)
    assert foot.any() and np.abs(g[..., 2]).max() < 1e-9
    assert len(clusters.triangles(np.ones((3, 4), bool))) == 2 * 2 * 3
    assert clusters.triangles(np.array([[1, 1], [1, 0]])).tolist() == [[0, 2, 1]] and clusters.triangles(np.array([[0, 1], [1, 1]])).tolist() == [[2, 3, 1]]
    assert np.abs(clusters.vertex_normals(g)[..., 2]).min() > 0.99


def test_edits_and_merge(spark):
    a = spark.createDataFrame([(1, "a", False), (2, "a", True)], "id long, v string, edited boolean")
    b = spark.createDataFrame([(1, "b", False), (2, "b", False), (3, "b", False)], "id long, v string, edited boolean")
    assert {(r.id, r.v) for r in corpus.merged([a, b], ("id",)).collect()} == {(1, "b"), (2, "a"), (3, "b")}
    empty = a.limit(0)
    assert corpus.upserted(a, empty, ("id",)).count() == 2 and corpus.deleted(a, empty, ("id",)).count() == 2


def test_pyramid_of_odd_axis(spark):
    df = spark.createDataFrame([(y, x, y * 5 + x) for y in range(5) for x in range(5)], "y long, x long, v long")
    top = {(r.y, r.x): r.v for r in grids.pyramid(df, ("y", "x"), "v", 3).where("level = 1").collect()}
    assert len(top) == 9 and top[(2, 2)] == 24 and top[(0, 0)] == 6


def test_refine_resumes(spark, tmp_path):
    grid = spark.createDataFrame([(y, x, 200 if x > 20 else 0) for y in range(32) for x in range(40)], "y long, x long, v long")
    once = refine.refine(grid, str(tmp_path / "a"), passes=2).toPandas()
    refine.refine(grid, str(tmp_path / "b"), passes=1)
    more = refine.refine(grid, str(tmp_path / "b"), passes=2).toPandas()
    key = ["y", "x"]
    assert once.sort_values(key)["p"].tolist() == more.sort_values(key)["p"].tolist()
    assert once[once.x < 4]["p"].max() == 0


def test_manifest_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(([(1, "a", 0), (2, "a", 0)], [(2, "b", 1), (3, "b", 1)])):
        spark.createDataFrame(rows, "id long, v string, at int").coalesce(1).write.mode("append").parquet(source)
    manifest.follow(spark, source, "id long, v string, at int", out, ("id",), "at", str(tmp_path / "ck")).awaitTermination()
    assert {(r.id, r.v) for r in manifest.latest(spark, out).collect()} == {(1, "a"), (2, "b"), (3, "b")}


def test_linkage_of_whole_tables(spark):
    from voxlake.queries import spaces

    def rescanned(d, cut):
        groups = [[i] for i in range(len(d))]
        while len(groups) > 1:
            h, x, y = min((max(d[i, j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
            if h > cut:
                break
            groups[x] += groups.pop(y)
        return {frozenset(g) for g in groups}

    rng = np.random.default_rng(6)
    for k in range(30):
        p = rng.integers(0, 6, (14, 2)) if k % 2 else rng.normal(size=(14, 2))
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        got = clusters.complete_linkage(d, 2.5)
        assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == rescanned(d, 2.5)
    want = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert spaces.linkage_clusters(spark, "/root/testdata/sf0.001").count() == want
