"""Joins in space: radius pairs through a grid of cells, nearest neighbours, theta pairs of few representatives."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.vectors import squared_distance


def celled(points: DataFrame, axes: tuple[str, ...], edge: float) -> DataFrame:
    return points.withColumns({f"_c{a}": F.floor(F.col(a) / edge).cast("long") for a in axes})


def radius_pairs(points: DataFrame, axes: tuple[str, ...], radius: float, id_col: str = "id") -> DataFrame:
    """(a, b, d2), a < b, for points within the radius.

    Cells are as wide as the radius; each point meets its own cell and half of the neighbours, so a pair is made once. The
    join is an equi-join on the cell, which Spark may split where one cell is crowded.
    """
    cells = [f"_c{a}" for a in axes]
    kept = celled(points.select(id_col, *axes), axes, radius)
    half = [o for o in itertools.product((-1, 0, 1), repeat=len(axes)) if o >= (0,) * len(axes)]
    moves = F.explode(F.array(*(F.struct(*(F.lit(d).cast("long").alias(c) for c, d in zip(cells, o))) for o in half)))
    left = kept.withColumn("_m", moves).select(F.col(id_col).alias("a"), *(F.col(x).alias(f"a_{x}") for x in axes), *((F.col(c) + F.col(f"_m.{c}")).alias(c) for c in cells), F.greatest(*(F.abs(F.col(f"_m.{c}")) for c in cells)).alias("_far"))
    right = kept.select(F.col(id_col).alias("b"), *axes, *cells)
    d2 = sum(((F.col(f"a_{x}") - F.col(x)) * (F.col(f"a_{x}") - F.col(x)) for x in axes), F.lit(0.0))
    met = left.join(right, cells).withColumn("d2", d2).where((F.col("d2") <= radius * radius) & (F.col("a") != F.col("b")) & ((F.col("_far") > 0) | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d2")


def within(left: DataFrame, right: DataFrame, axes: dict[str, str], radius: float) -> DataFrame:
    """Rows of left with the rows of right within the radius, and d2; axes: columns of left by columns of right.

    Both go to cells as wide as the radius; a row of left meets its own cell and all neighbours in an equi-join on the cell.
    """
    cells = [f"_k{i}" for i in range(len(axes))]
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    moves = F.explode(F.array(*(F.struct(*(F.lit(d).alias(c) for c, d in zip(cells, o))) for o in itertools.product((-1, 0, 1), repeat=len(axes)))))
    near = left.withColumn("_m", moves).withColumns({c: cell(a) + F.col(f"_m.{c}") for c, a in zip(cells, axes)})
    met = near.drop("_m").join(right.withColumns({c: cell(b) for c, b in zip(cells, axes.values())}), cells).drop(*cells)
    d2 = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in axes.items()), F.lit(0.0))
    return met.withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def expanded(rows: np.ndarray, first: np.ndarray, stop: np.ndarray, most: int = 1 << 20):
    """(row, member) of each row with the members first..stop - 1, in bounded pieces."""
    some = stop > first
    rows, first, size = rows[some], first[some], (stop - first)[some]
    ends = np.cumsum(size)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = size[at:to]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(rows[at:to], n), np.repeat(first[at:to], n) + inner
        at = to


def disc_counts(qx: np.ndarray, qy: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, radius: float, strips: int = 40) -> np.ndarray:
    """The weight of the points within the radius of each query.

    Points lie in narrow strips, sorted along each. The part of a strip that is surely inside is the difference of two running
    sums; only points between the inner and the outer chord are measured.
    """
    out = np.zeros(len(qx), np.int64)
    if not len(x) or not len(qx):
        return out
    width, base, slack = radius / strips, min(x.min(), qx.min()), 1e-6 * radius
    strip = np.floor((x - base) / width).astype(np.int64)
    order = np.lexsort((y, strip))
    x, y, weight, strip = x[order], y[order], weight[order], strip[order]
    low = min(y.min(), qy.min()) - 2 * radius
    span = max(y.max(), qy.max()) + 2 * radius - low
    slack += 1e-12 * span * (strip[-1] + 2 * strips + 2)  # what the keys below may be off
    key, total = strip * span + (y - low), np.r_[0, np.cumsum(weight)]
    at = np.lexsort((qy, qx))
    qx, qy = qx[at], qy[at]
    mine, rows = np.floor((qx - base) / width).astype(np.int64), np.arange(len(qx))
    found = np.zeros(len(qx), np.int64)
    for k in range(-strips - 1, strips + 2):
        s = mine + k
        left, right = base + s * width - qx, base + (s + 1) * width - qx
        least = np.maximum(np.maximum(left, -right), 0) - slack
        most = np.maximum(np.abs(left), np.abs(right)) + slack
        outer = np.where((least <= radius) & (s >= 0) & (s <= strip[-1]), np.sqrt(np.maximum(radius**2 - np.maximum(least, 0) ** 2, 0)) + slack, -1.0)
        use = outer >= 0
        q, r, own = qy[use] - low + s[use] * span, outer[use], rows[use]
        inner = np.where(most[use] < radius, np.sqrt(np.maximum(radius**2 - most[use] ** 2, 0)) - slack, -1.0)
        from_, to = np.searchsorted(key, q - r, "left"), np.searchsorted(key, q + r, "right")
        sure = inner > 0
        a, b = from_.copy(), from_.copy()
        a[sure], b[sure] = np.searchsorted(key, (q - inner)[sure], "left"), np.searchsorted(key, (q + inner)[sure], "right")
        found[own] += total[b] - total[a]
        for lo, hi in ((from_, a), (b, to)):
            for i, j in expanded(own, lo, hi):
                dx, dy = qx[i] - x[j], qy[i] - y[j]
                np.add.at(found, i, weight[j] * (dx * dx + dy * dy <= radius * radius))
    out[at] = found
    return out


#: Different places that a tile of a count holds on average.
TILE_PLACES = 50_000


def counts_within(left: DataFrame, right: DataFrame, key: str, axes: dict[str, str], radius: float) -> DataFrame:
    """(key, n): how many rows of right lie within the radius of each row of left in the plane, without rows that have none; axes:
    columns of left by columns of right. No pairs are made: tiles of places with a margin are counted strip by strip."""
    finite = lambda names: " AND ".join(f"abs({c}) < double('inf')" for c in names)
    q = left.select(F.col(key).alias("_key"), *(F.col(a).cast("double").alias(f"_{k}") for k, a in enumerate(axes))).where(finite(("_0", "_1")))
    p = right.select(*(F.col(b).cast("double").alias(f"_{k}") for k, b in enumerate(axes.values()))).where(finite(("_0", "_1")))
    n, *ends = p.agg(F.count("*"), *(f(f"_{k}") for k in (0, 1) for f in (F.min, F.max))).first()
    area = (ends[1] - ends[0] + radius) * (ends[3] - ends[2] + radius) if n else 1.0
    tile = max(3 * radius, (area * TILE_PLACES / max(1, n)) ** 0.5)
    cell = lambda c: F.floor(c / tile).cast("long")
    q = q.withColumns({f"_t{k}": cell(F.col(f"_{k}")) for k in (0, 1)})
    p = p.groupBy("_0", "_1").agg(F.count("*").alias("_n"))
    for k in (0, 1):
        p = p.withColumn(f"_t{k}", F.explode(F.sequence(cell(F.col(f"_{k}") - radius * 1.000001), cell(F.col(f"_{k}") + radius * 1.000001))))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        at = a[["_0", "_1"]].drop_duplicates()
        n = at.assign(n=disc_counts(at["_0"].to_numpy(), at["_1"].to_numpy(), b["_0"].to_numpy(), b["_1"].to_numpy(), b["_n"].to_numpy(), radius))
        return a.merge(n, on=["_0", "_1"])[["_key", "n"]].query("n > 0").rename(columns={"_key": key})

    kind = dict(left.dtypes)[key]
    return q.groupBy("_t0", "_t1").cogroup(p.groupBy("_t0", "_t1")).applyInPandas(count, f"{key} {kind}, n long")


def ball_neighbours(q: np.ndarray, own: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, d2): the k nearest p within the radius of each q, ties to the smaller id, without the id in `own`.

    Queries of a cell look at the cells around that hold enough points, then at as many more as their furthest find asks for.
    """
    order = np.argsort(ids, kind="stable")
    ids, p = ids[order], p[order]
    most = min(k + 1, len(ids))
    edge = radius / min(24, max(1, round(1.5 * (len(ids) / k) ** (1 / 3))))
    base = np.minimum(p.min(0), q.min(0))
    cell, place = (np.floor((v - base) / edge).astype(np.int64) for v in (p, q))
    shape = np.maximum(cell.max(0), place.max(0)) + 1
    flat = lambda c: (c[:, 0] * shape[1] + c[:, 1]) * shape[2] + c[:, 2]
    sort = np.argsort(flat(cell), kind="stable")
    first = np.searchsorted(flat(cell)[sort], np.arange(shape.prod() + 1))
    last = int(np.ceil(radius / edge)) + 1

    def around(c: np.ndarray, s: int) -> np.ndarray:
        if s > 8:
            return np.arange(len(ids))
        lo, hi = np.maximum(c - s, 0), np.minimum(c + s, shape - 1)
        rows = (np.arange(lo[0], hi[0] + 1)[:, None] * shape[1] + np.arange(lo[1], hi[1] + 1)).ravel() * shape[2]
        parts = [j for _, j in expanded(rows, first[rows + lo[2]], first[rows + hi[2] + 1])]
        return np.sort(sort[np.concatenate(parts)]) if parts else np.empty(0, np.int64)

    keys, by = flat(place), np.argsort(flat(place), kind="stable")
    out = []
    for rows in np.split(by, np.flatnonzero(np.diff(keys[by])) + 1):
        c, s = place[rows[0]], 1
        while len(found := around(c, s)) < most and s <= 8:
            s += 1
        wide = max(1, (1 << 19) // max(1, len(ids)))
        for at in range(0, len(rows), wide):
            some = rows[at : at + wide]
            away = lambda j: sum(((q[some, None, a] - p[None, j, a]) ** 2 for a in range(3)), 0.0)  # noqa: E731, B023
            near, d = found, away(found)
            limit = np.partition(d, most - 1, 1)[:, most - 1]
            more = min(last, int(np.ceil(np.sqrt(limit.max()) / edge * (1 + 1e-9))))
            if more > s and len(near) < len(ids):
                near = around(c, more)
                d = away(near)
                limit = np.partition(d, most - 1, 1)[:, most - 1] if len(near) >= most else np.full(len(some), np.inf)
            i, j = np.nonzero((d <= limit[:, None]) & (d <= radius * radius) & (ids[near][None] != own[some][:, None]))
            d = d[i, j]
            rank = np.lexsort((near[j], d, i))
            i, j, d = i[rank], j[rank], d[rank]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((some[i[keep]], ids[near[j[keep]]], d[keep]))
    return tuple(np.concatenate(o) for o in zip(*out))


def nearest_within(left: DataFrame, right: DataFrame, keys: tuple[str, str], axes: dict[str, str], k: int, radius: float, id_col: str) -> DataFrame:
    """(keys, id_col, d2): the k nearest rows of right within the radius of each row of left in space, ties to the smaller id; a row
    does not meet its own id, which is the first of the keys (all longs). Cubes with a margin; no more than k pairs a row are made."""
    finite = " AND ".join(f"abs(_{i}) < double('inf')" for i in range(3))
    cell = lambda c: F.floor(c / radius).cast("long")
    q = left.select(*(F.col(c).cast("long").alias(c) for c in keys), *(F.col(a).cast("double").alias(f"_{i}") for i, a in enumerate(axes))).where(finite)
    p = right.select(F.col(id_col).cast("long").alias(id_col), *(F.col(b).cast("double").alias(f"_{i}") for i, b in enumerate(axes.values()))).where(finite)
    q = q.withColumns({f"_t{i}": cell(F.col(f"_{i}")) for i in range(3)})
    for i in range(3):
        p = p.withColumn(f"_t{i}", F.explode(F.sequence(cell(F.col(f"_{i}")) - 1, cell(F.col(f"_{i}")) + 1)))

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in (*keys, id_col, "d2")})
        at = ["_0", "_1", "_2"]
        row, other, d2 = ball_neighbours(a[at].to_numpy(), a[keys[0]].to_numpy(), b[at].to_numpy(), b[id_col].to_numpy(), k, radius)
        return pd.DataFrame({c: a[c].to_numpy()[row] for c in keys} | {id_col: other, "d2": d2})

    tiles = [f"_t{i}" for i in range(3)]
    return q.groupBy(*tiles).cogroup(p.groupBy(*tiles)).applyInPandas(find, ", ".join(f"{c} long" for c in (*keys, id_col)) + ", d2 double")


#: Components that a block of vectors may hold in a task, about 16 MB as doubles.
BLOCK_NUMBERS = 1 << 21


def _block_pairs(vectors: DataFrame, id_col: str, vec_col: str, names: str, both: bool, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """kernel(ids, matrix, ids, matrix) over pairs of blocks of rows; both: every ordered pair of blocks, else the upper half.

    No grid helps in many dimensions. The number of blocks follows the table, so a task holds two blocks whatever that holds;
    a block is sent once for each of its partners.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")).where("id is not null and v is not null")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n * max(1, dims or 1) / BLOCK_NUMBERS))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    first, last = F.lit(0), F.lit(blocks - 1)
    left = rows.withColumn("o", F.explode(F.sequence(first if both else F.col("k"), last))).select(F.col("k").alias("p"), F.col("o").alias("q"), F.col("id").alias("ia"), F.col("v").alias("va"))
    right = rows.withColumn("o", F.explode(F.sequence(first, last if both else F.col("k")))).select(F.col("o").alias("p"), F.col("k").alias("q"), F.col("id").alias("ib"), F.col("v").alias("vb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = kernel(a["ia"].to_numpy(), np.stack(a["va"].to_list()), b["ib"].to_numpy(), np.stack(b["vb"].to_list())) if len(a) and len(b) else ([], [], [])
        return pd.DataFrame(dict(zip("ab", found[:2])) | {"dot": found[2]}, columns=["a", "b", "dot"])

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(run, names)


def blocked_pairs(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, dot), a < b, of vectors whose inner product is at least `least`: products of blocks, of the upper half only."""

    def kernel(ia: np.ndarray, a: np.ndarray, ib: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        same = len(ia) == len(ib) and set(ia.tolist()) == set(ib.tolist())
        i, j, d = [], [], []
        for at in range(0, len(a), 512):
            dots = a[at : at + 512] @ b.T
            x, y = np.nonzero(dots >= least)
            x, y, dots = x + at, y, dots[x, y]
            keep = ia[x] < ib[y] if same else ia[x] != ib[y]
            i.append(np.minimum(ia[x], ib[y])[keep]), j.append(np.maximum(ia[x], ib[y])[keep]), d.append(dots[keep])
        return tuple(map(np.concatenate, (i, j, d)))

    return _block_pairs(vectors, id_col, vec_col, "a long, b long, dot double", False, kernel)


def nearest_vectors(vectors: DataFrame, k: int, digits: int = 9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, dot, rank): the k largest inner products (rounded to `digits`) of each vector with others, ties to the smaller b.

    Each pair of blocks gives its k best for each row, so the ranking sees k rows for each row and block, not all pairs.
    """

    def kernel(ia: np.ndarray, a: np.ndarray, ib: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(ib)
        ib, b = ib[order], b[order]
        i, j, d = [], [], []
        for at in range(0, len(a), 512):
            dots = np.round(a[at : at + 512] @ b.T, digits)
            dots[ia[at : at + 512, None] == ib[None]] = -np.inf
            best = np.argsort(-dots, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(dots, best, 1)
            keep = np.isfinite(value)
            i.append(np.broadcast_to(ia[at : at + 512, None], best.shape)[keep]), j.append(ib[best][keep]), d.append(value[keep])
        return tuple(map(np.concatenate, (i, j, d)))

    found = _block_pairs(vectors, id_col, vec_col, "a long, b long, dot double", True, kernel)
    order = Window.partitionBy("a").orderBy(F.desc("dot"), "b")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def both_ways(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in "ab"]
    return pairs.select("a", "b", *rest).unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def nearest(pairs: DataFrame, k: int, order: Column) -> DataFrame:
    """The k first partners of each a, ties to the smaller b; the limit by group is taken before and after the shuffle."""
    w = Window.partitionBy("a").orderBy(order, "b")
    return both_ways(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """Pairs (a < b) that are in each other's lists."""
    other = neighbours.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return neighbours.join(other, ["a", "b"], "left_semi").where("a < b")


def covered_by(tiles: DataFrame, windows: DataFrame, size: int, bucket: int) -> DataFrame:
    """Interval join of tiles [t0, t1) with windows [s, s + size): both go to the buckets they touch."""
    to = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket).cast("long"), F.floor((hi - 1) / bucket).cast("long")))
    left = tiles.withColumn("_k", to(F.col("t0"), F.col("t1")))
    right = windows.withColumn("_k", to(F.col("s"), F.col("s") + size))
    return left.join(right, "_k").where((F.col("s") < F.col("t1")) & (F.col("s") + size > F.col("t0"))).drop("_k").distinct()
