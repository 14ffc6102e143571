"""Sheets, streamlets, stores and tilings against NumPy and hand-made cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.functions import names
from voxlake.operators import clusters, edits, fields, grids, membership, regions, spatial, streamlets
from voxlake.plans import tiling
from voxlake.sources import store


@given(st.integers(1, 200), st.integers(1, 40), st.integers(1, 40), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_begins_of_windows_by_their_rule(dim, size, stride, offset):
    last = dim - size
    low, high = -offset // stride - 2, (dim + offset) // stride + 2
    want = {min(max(offset + k * stride, 0), last) for k in range(low, high + 1)} if last > 0 else {0}
    assert tiling.overlap_grid(dim, size, stride, offset) == sorted(want)


def test_views():
    plain = ("", "")
    assert tiling.mirrored_variants("none") == [plain] == tiling.mirrored_variants("")
    assert len(tiling.mirrored_variants("mirror")) == 8 and len(tiling.mirrored_variants("all")) == 10 and tiling.mirrored_variants("all")[0] == plain
    assert tiling.mirrored_variants("x,rotate") == [plain, ("x", ""), ("", "zx"), ("", "zy")]
    with pytest.raises(ValueError):
        tiling.mirrored_variants("w")


def test_vectors_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK_NUMBERS", 16 * 20)  # several blocks
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 16))
    v[7] = v[3]
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)] + [(None, [1.0] * 16), (500, None)], "vec_id long, embedding array<double>")
    dots = v @ v.T
    got = {(r.a, r.b) for r in spatial.blocked_pairs(df, 6.0).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if dots[i, j] >= 6.0}
    near = {(r.a, r["rank"]): r.b for r in spatial.nearest_vectors(df, 4).collect()}
    np.fill_diagonal(dots, -np.inf)
    for i in range(90):
        want = sorted(range(90), key=lambda j: (-round(dots[i, j], 9), j))[:4]
        assert [near[i, k + 1] for k in range(4)] == want


def test_mean_directions_are_eigenvectors(spark):
    rng = np.random.default_rng(2)
    n = rng.normal(size=(200, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    p = rng.random((200, 3)) * 20
    df = spark.createDataFrame([(i, *map(float, [*a, *b])) for i, (a, b) in enumerate(zip(p, n))], "id long, pz double, py double, px double, nz double, ny double, nx double")
    cells = np.floor((p - p.min(0)) / 10).astype(int)
    for r in membership.normal_cells(df, 10.0).collect():
        own = (cells == (r.cz, r.cy, r.cx)).all(1)
        top = np.linalg.eigh(n[own].T @ n[own])[1][:, 2]
        assert r.n == own.sum() and abs(abs(top @ (r.mz, r.my, r.mx)) - 1) < 1e-6


def test_smoothing_is_that_of_a_dense_grid(spark):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((14, 30)) < 0.1, rng.random((14, 30)), 0)
    cells = spark.createDataFrame([(int(y), int(x), float(dense[y, x])) for y, x in np.argwhere(dense)], "y long, x long, v double")
    got = np.zeros(dense.shape)
    for r in regions.smoothed(cells, {"y": 14, "x": 30}, ("v",), 1.5).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, fields.smooth(dense, 1.5))
    with pytest.raises(ValueError):
        regions.smoothed(cells, {"y": 14, "x": 5}, ("v",), 1.5)


def test_soft_skeleton_of_a_grid(spark):
    rng = np.random.default_rng(4)
    v = rng.random((9, 11))
    cells = spark.createDataFrame([(y, x, float(v[y, x])) for y in range(9) for x in range(11)], "y long, x long, v double")
    got = {(r.y, r.x): r.skeleton for r in regions.soft_skeleton(cells, ("y", "x"), "v", 2).collect()}
    want = fields.soft_skeleton(v, 2)
    assert all(abs(got[y, x] - want[y, x]) < 1e-12 for y in range(9) for x in range(11))


def test_gap_between_two_surfaces(spark):
    cells = spark.createDataFrame([(y, x, 1 if x in (3, 6) else 0) for y in range(12) for x in range(14)], "y long, x long, label int")
    assert {r.x for r in regions.bridged_gaps(cells, ("y", "x"), "label", 2).collect()} == {4, 5}


def test_magnified_is_linear(spark):
    coarse = spark.createDataFrame([(y, x, float(3 * y + x)) for y in range(3) for x in range(4)], "y long, x long, v double")
    got = {(r.y, r.x): r.v for r in regions.magnified(coarse, ("y", "x"), "v", {"y": 3, "x": 4}, {"y": 9, "x": 7}).collect()}
    assert len(got) == 63 and all(abs(v - (3 * y / 4 + x / 2)) < 1e-9 for (y, x), v in got.items())


def test_store_round_trip(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = np.where(rng.random((9, 13, 21)) < 0.2, rng.integers(1, 256, (9, 13, 21)), 0)
    v[:4, :4, :8] = 0  # a chunk of air
    grid = spark.createDataFrame([(int(z), int(y), int(x), int(v[z, y, x])) for z, y, x in np.argwhere(v)], "z long, y long, x long, v long")
    path = str(tmp_path / "s")
    assert store.levels_of(path) == []
    store.write_store(grid, path, v.shape, (4, 4, 8), 7.9, levels=2)
    with pytest.raises(ValueError):
        store.write_store(grid, path, v.shape, (4, 4, 8), 7.9)
    assert store.levels_of(path) == [0, 1] and store.describe(path)["voxel_um"] == 7.9
    spark.dataSource.register(store.ChunkStore)
    read = lambda **o: spark.read.format("voxlake_store").options(path=path, **o).load()
    box = {(r.z, r.y, r.x): r.v for r in read(box="2:7,3:13,5:99").collect()}
    assert box == {(z, y, x): v[z, y, x] for z, y, x in np.argwhere(v) if 2 <= z < 7 and 3 <= y < 13 and x >= 5}
    pad = np.zeros((10, 14, 22), int)
    pad[:9, :13, :21] = v
    half = pad.reshape(5, 2, 7, 2, 11, 2).max((1, 3, 5))
    assert {(r.z, r.y, r.x): r.v for r in read(level="1").collect()} == {tuple(map(int, k)): half[tuple(k)] for k in np.argwhere(half)}
    assert read(box="0:4,0:4,0:8").count() == 0 and not (tmp_path / "s" / "level=0" / "cz=0" / "0_0.raw").exists()


def test_units_of_metadata(spark):
    said = ['{"multiscales":[{"axes":[{"name":"x","unit":"Nanometer"}],"datasets":[{"path":"0","coordinateTransformations":[{"type":"translation"},{"type":"scale","scale":[9,9,2400]}]}]}]}', '{"multiscales":[{"datasets":[{"path":"0","coordinateTransformations":[{"type":"scale","scale":[2.0]}]}]}]}', "{}", "no json", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in said], "t string").select(names.voxel_um_from_metadata(F.col("t"))).collect()]
    assert got[0] == pytest.approx(2.4) and got[1:] == [2.0, None, None, None]


def test_capped_unions():
    spans = {k: (float(k), float(k)) for k in range(6)}
    chain = [(k, k + 1) for k in range(5)]
    assert streamlets.capped_unions(list(spans), chain, spans, 2.0) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert set(streamlets.capped_unions(list(spans), chain, spans, 99.0).values()) == {0}


def test_flow_and_linkage_of_three_lines(spark):
    lines = {1: [(x, 0.0) for x in range(10)], 2: [(x, 0.5) for x in range(10)], 3: [(12 + x, 0.0) for x in range(10)], 4: [(x, 9.0) for x in range(10)], 5: [(0.1, 1.0 + y) for y in range(8)]}
    points = spark.createDataFrame([(l, k, float(x), float(y)) for l, p in lines.items() for k, (x, y) in enumerate(p)], "line long, k long, x double, y double")
    phi = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.2), (4, 9.0), (5, 4.0)], "line long, phi double")
    links = streamlets.fragment_links(points, phi, 1.0, 4.0, 30.0, 3.0, 0.4)
    assert {tuple(r) for r in links.collect()} == {(1, 2), (1, 3), (2, 3)}  # 5 crosses, 4 is far away
    label = lambda df: {r.line: r.label for r in df.collect()}
    assert label(streamlets.flow_labels(links, phi, 5.0)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert label(streamlets.flow_labels(links, phi, 0.3)) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert label(streamlets.linked_clusters(links, phi, ["phi"], 0.25)) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_runs_that_share_nothing(spark):
    runs = spark.createDataFrame([(1, 2, 9), (2, 3, 8), (3, 4, 7), (5, 6, 1)], "a int, b int, size int")
    assert {tuple(r) for r in streamlets.disjoint_runs(runs, ["a", "b"], "size", 2).collect()} == {(1, 2, 9), (3, 4, 7)}


def test_edits_keep_other_labels(spark):
    rows = [(0, 0, 1, 1.0, 1.0), (1, 0, 1, 2.0, 2.0), (2, 1, 1, 6.0, 6.0), (3, 2, 2, 9.0, 9.0), (4, 9, -1, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, unit long, label int, py double, px double")
    sides = spark.createDataFrame([(1, 1)], "unit long, side int")
    label = lambda df: [r.label for r in df.orderBy("id").collect()]
    assert label(edits.sides_apart(points, 1, sides, keep=True)) == [1, 1, 3, 2, -1]
    assert label(edits.sides_apart(points, 1, sides, keep=False)) == [3, 3, 4, 2, -1]
    assert label(edits.merged_sheets(points, 2, 1)) == [1, 1, 1, 1, -1]
    left, region = edits.deleted_sheets(points, [2], {"y": 12, "x": 10}, steps=1)
    assert label(left) == [1, 1, 1, -1, -1] and {tuple(r) for r in region.collect()} == {(9, 9), (8, 9), (10, 9), (9, 8)}


def test_jacobians_of_a_cylinder():
    u, v = np.meshgrid(np.linspace(-0.5, 0.5, 41), np.linspace(0, 3, 20), indexing="ij")
    radius = 4.0
    g = np.stack([radius * np.cos(u), radius * np.sin(u), v], -1)
    j = clusters.vertex_jacobians(g)[20, 10]
    assert np.allclose(np.abs(np.linalg.eigvals(j)).max(), 1 / radius, rtol=0.01) and abs(j[2, 2]) < 1e-9
    fine = clusters.refined(g, 3)
    assert fine.shape == (123, 60, 3) and np.allclose(fine[0, 0], g[0, 0]) and np.allclose(fine[-1, -1], g[-1, -1])


def test_orientation_has_unit_trace():
    z = np.arange(20)[:, None, None] * np.ones((20, 20, 20))
    t = fields.orientation(np.sin(z * 2 * np.pi / 8))
    assert np.allclose(t[6:14, 6:14, 6:14, :3].sum(-1), 1, atol=1e-3) and (t[6:14, 6:14, 6:14, 0] > 0.99).all()


def test_lines_stay_in_their_plane():
    fibre, normal = np.zeros((20, 20, 20, 3)), np.zeros((20, 20, 20, 3))
    fibre[..., 2], fibre[..., 1], normal[..., 0] = 1.0, 0.3 * np.sin(np.arange(20) / 3), 1.0
    lines = fields.traced(fibre, np.ones((20, 20, 20)), stride=7, plane=normal)
    assert lines
    for line in lines:
        flat = line - line.mean(0)
        assert np.linalg.svd(flat)[1][1] < 1e-6 * np.linalg.svd(flat)[1][0] + 1e-6  # normal and fibre span the plane, the rest is off


def test_halo_is_seen_and_left_out(spark):
    block = np.arange(8 * 2 * 2, dtype="<f4").reshape(8, 2, 2)
    df = spark.createDataFrame([(0, 8, 2, 2, 3, bytearray(block.tobytes()))], "block_id long, dz int, dy int, dx int, skip int, data binary")
    got = fields.over_blocks(df, lambda b, own: {"first": float(b[own][0, 0, 0]), "n": len(b[own])}, "first double, n long", layers=4).first()
    assert (got.first, got.n) == (12.0, 4) if not callable(got.first) else (got["first"], got["n"]) == (12.0, 4)


def test_packed_bits_round_trip(spark):
    rows = [(list(bits),) for n in (0, 1, 7, 8, 9, 17) for bits in itertools.islice(itertools.product((0, 1), repeat=n), 3, None, max(1, 2**n // 4))]
    df = spark.createDataFrame([*rows, ([],)], "bits array<int>").withColumn("p", names.packed_bits(F.col("bits")))
    for r in df.withColumn("back", names.unpacked_bits(F.col("p"), F.size("bits"))).collect():
        assert r.back == r.bits and r.p == np.packbits(np.array(r.bits, np.uint8)).tobytes().hex().upper()


def test_pooled_levels_hold_the_largest(spark):
    df = spark.createDataFrame([(0, 0, 3), (0, 1, 7), (3, 3, 2)], "y long, x long, v long")
    assert {tuple(r) for r in grids.pooled(df, ("y", "x"), "v", "max").collect()} == {(0, 0, 7), (1, 1, 2)}
