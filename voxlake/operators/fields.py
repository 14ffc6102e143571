"""Stencil kernels on dense blocks: orientation fields, diffusion, distances, tracing.

Blocks are rows (block_id, z0, y0, x0, dz, dy, dx, data) with little-endian float32 data and a halo that the caller gave;
a kernel maps one block at a time (mapInPandas), so memory is a block's whatever the volume holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def gaussian_kernel(sigma: float, reach: float = 4.0) -> np.ndarray:
    r = max(1, int(reach * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def along(v: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Convolution along one axis with mirrored edges."""
    r = len(kernel) // 2
    p = np.pad(v, [(r, r) if a == axis else (0, 0) for a in range(v.ndim)], mode="symmetric" if v.shape[axis] >= r else "edge")
    return sum(w * np.take(p, np.arange(i, i + v.shape[axis]), axis) for i, w in enumerate(kernel))


def smooth(v: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian_kernel(sigma)
    for axis in range(v.ndim):
        v = along(v, k, axis)
    return v


def slope_kernel(sigma: float, reach: float = 4.0) -> np.ndarray:
    """The derivative of a Gaussian; along() with it gives the slope of the smoothed values."""
    r = max(1, int(reach * sigma + 0.5))
    return gaussian_kernel(sigma, reach) * np.arange(-r, r + 1) / sigma**2


def slopes(v: np.ndarray, sigma: float) -> list[np.ndarray]:
    """Derivatives along each axis, by the derivative of a Gaussian there and a Gaussian along the others."""
    g, d = gaussian_kernel(sigma), slope_kernel(sigma)
    out = []
    for axis in range(v.ndim):
        s = v.astype(float)
        for other in range(v.ndim):
            s = along(s, d if other == axis else g, other)
        out.append(s)
    return out


def structure_tensor(v: np.ndarray, sigma_grad: float = 1.0, sigma_tensor: float = 4.0) -> dict[str, np.ndarray]:
    """normal (largest eigenvector), fibre (smallest), coherence = 1 - least / largest eigenvalue, of smoothed gradients."""
    g = slopes(v, sigma_grad)
    t = np.empty((*v.shape, 3, 3))
    for i in range(3):
        for j in range(i, 3):
            t[..., i, j] = t[..., j, i] = smooth(g[i] * g[j], sigma_tensor)
    values, vectors = np.linalg.eigh(t)
    return {"normal": vectors[..., 2], "fibre": vectors[..., 0], "coherence": 1 - values[..., 0] / np.maximum(values[..., 2], 1e-12)}


def orientation(v: np.ndarray, sigma_grad: float = 1.0, sigma_tensor: float = 3.0, eps: float = 1e-6) -> np.ndarray:
    """Structure tensors over their trace, as (zz, yy, xx, zy, zx, yx): no sign, no eigenvectors."""
    g = slopes(v, sigma_grad)
    t = np.stack([smooth(g[i] * g[j], sigma_tensor) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))], -1)
    return t / (t[..., :3].sum(-1, keepdims=True) + eps)


def mask_coherence(mask: np.ndarray, sigma: float = 1.0, sigma_tensor: float = 4.0) -> np.ndarray:
    """Coherence of the surfaces of a binary mask: near 1 where they turn slowly, low where they are ragged or merge."""
    return structure_tensor(smooth(mask * 255.0, sigma), 1.0, sigma_tensor)["coherence"]


def local_period(v: np.ndarray, sigma_grad: float = 1.0, sigma_tensor: float = 4.0) -> np.ndarray:
    """2 pi over the frequency that second and first derivatives along the normal give."""
    n = structure_tensor(v, sigma_grad, sigma_tensor)["normal"]
    first = sum(n[..., i] * d for i, d in enumerate(np.gradient(smooth(v.astype(float), sigma_grad))))
    second = sum(n[..., i] * d for i, d in enumerate(np.gradient(first)))
    return 2 * np.pi * np.sqrt(smooth(first**2, sigma_tensor) / np.maximum(smooth(second**2, sigma_tensor), 1e-12))


def diffused(v: np.ndarray, iters: int = 10, dt: float = 0.12, alpha: float = 0.02, sheet: bool = True) -> np.ndarray:
    """Coherence-enhancing diffusion: flow across the normal (or off the fibre) is damped to alpha."""
    u, field = v.astype(float), structure_tensor(v)
    n = field["normal" if sheet else "fibre"]
    for _ in range(iters):
        g = np.stack(np.gradient(u), -1)
        across = (g * n).sum(-1, keepdims=True) * n
        flux = g - (1 - alpha) * across if sheet else alpha * g + (1 - alpha) * across
        u = u + dt * sum(np.gradient(flux[..., i], axis=i) for i in range(3))
    return u


def distance_owner(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, owner) of the nearest labelled cell, exactly, one axis after another."""
    d = np.where(seeds > 0, 0.0, np.inf)
    owner = seeds.astype(np.int64)
    for axis in range(seeds.ndim):
        n = seeds.shape[axis]
        dm, om = np.moveaxis(d, axis, -1), np.moveaxis(owner, axis, -1)
        off = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2
        best, to = np.full(dm.shape, np.inf), np.zeros(dm.shape, np.int64)
        for j in range(n):
            via = dm[..., j : j + 1] + off[j]
            less = via < best
            best, to = np.where(less, via, best), np.where(less, om[..., j : j + 1], to)
        d, owner = np.moveaxis(best, -1, axis), np.moveaxis(to, -1, axis)
    return d, owner


def crest(seeds: np.ndarray, sigma: float = 3.0, power: float = 3.0, band: float = 3.0, least: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(magnitude, owner): a super-Gaussian bump of the distance to the nearest medial cell."""
    d2, owner = distance_owner(seeds)
    d = np.sqrt(d2)
    m = np.exp(-((d / sigma) ** power))
    return np.where((d <= band * sigma) & (m >= least), m, 0.0), owner


def soft_skeleton(v: np.ndarray, iters: int) -> np.ndarray:
    def pool(u: np.ndarray, f) -> np.ndarray:
        p = np.pad(u, 1, mode="edge")
        return f.reduce([p[tuple(slice(o, o + n) for o, n in zip(off, u.shape))] for off in np.ndindex(*(3,) * u.ndim)])

    out = np.zeros_like(v)
    for _ in range(iters + 1):
        low = pool(v, np.minimum)
        rest = np.maximum(v - pool(low, np.maximum), 0)
        out = out + np.maximum(rest - out * rest, 0)
        v = low
    return out


def trilinear(field: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Values of field (Z, Y, X[, C]) at points (N, 3), clamped to the block."""
    top = np.array(field.shape[:3]) - 1
    p = np.clip(p, 0, top - 1e-6 * (top > 0))
    i = np.floor(p).astype(int)
    f = p - i
    out = 0.0
    for corner in np.ndindex(2, 2, 2):
        c = np.array(corner)
        w = np.prod(np.where(c, f, 1 - f), axis=1)
        at = np.minimum(i + c, top)
        v = field[at[:, 0], at[:, 1], at[:, 2]]
        out = out + (w[:, None] * v if v.ndim > 1 else w * v)
    return out


def traced(fibre: np.ndarray, gate: np.ndarray, stride: int = 5, step: float = 1.0, most: int = 60, seed_least: float = 0.1, least: float = 0.05, gaps: int = 8, layers: slice = slice(None), plane: np.ndarray | None = None) -> list[np.ndarray]:
    """Streamlines of a sign-free direction field by midpoint steps; all seeds advance together.

    layers: where seeds may lie along the first axis. plane: normals; a line then stays in the plane of the fibre and the
    normal at its seed, as sheets are traced in 2.5 dimensions.
    """
    grid = np.stack(np.meshgrid(np.arange(gate.shape[0])[layers][::stride], *(np.arange(0, n, stride) for n in gate.shape[1:]), indexing="ij"), -1).reshape(-1, 3).astype(float)
    seeds = grid[trilinear(gate, grid) >= seed_least]
    frozen = None
    if plane is not None:
        frozen = np.cross(trilinear(plane, seeds), trilinear(fibre, seeds))
        frozen /= np.maximum(np.linalg.norm(frozen, axis=1, keepdims=True), 1e-9)
    halves = []
    for sign in (1.0, -1.0):
        p, before, alive, misses = seeds.copy(), sign * trilinear(fibre, seeds), np.ones(len(seeds), bool), np.zeros(len(seeds), int)
        path, valid = [], []
        for _ in range(most):
            def heading(q: np.ndarray) -> np.ndarray:
                d = trilinear(fibre, q)
                if frozen is not None:
                    d = d - (d * frozen).sum(1, keepdims=True) * frozen
                d = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9)
                return np.where((d * before).sum(1, keepdims=True) < 0, -d, d)

            mid = heading(p + 0.5 * step * heading(p))
            new = p + step * mid
            inside = ((new >= 0) & (new <= np.array(gate.shape) - 1)).all(1)
            hit = trilinear(gate, new) >= least
            misses = np.where(hit, 0, misses + 1)
            alive &= inside & (misses <= gaps)
            if not alive.any():
                break
            p, before = np.where(alive[:, None], new, p), np.where(alive[:, None], mid, before)
            path.append(p.copy())
            valid.append(alive & hit)
        halves.append((np.array(path), np.array(valid)))
    lines = []
    for k, seed in enumerate(seeds):
        parts = [path[: (int(np.flatnonzero(ok[:, k])[-1]) + 1) if len(ok) and ok[:, k].any() else 0, k] if len(path) else np.zeros((0, 3)) for path, ok in halves]
        line = np.concatenate([parts[1][::-1], seed[None], parts[0]])
        if len(line) >= 3:
            lines.append(line)
    return lines


def over_blocks(blocks: DataFrame, kernel: Callable[[np.ndarray, slice], dict[str, float]], columns: str, layers: int = 12) -> DataFrame:
    """(block_id, ...) from a kernel that turns a block and the slice of its own layers into named numbers.

    `skip` layers before its own `layers`, and those after, are the halo: the kernel sees them, the numbers leave them out.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                found = kernel(np.frombuffer(r.data, "<f4").reshape(r.dz, r.dy, r.dx), slice(r.skip, r.skip + layers))
                rows.append((r.block_id, *(found[n] for n in names)))
            yield pd.DataFrame(rows, columns=["block_id", *names])

    return blocks.mapInPandas(run, f"block_id long, {columns}")
