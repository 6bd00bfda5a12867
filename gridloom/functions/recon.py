"""Reconstruction kernels: kriging, thin plates, hole filling, greedy block choice, phase kernels."""

from __future__ import annotations

import numpy as np


def variogram(h: np.ndarray, sill: float, reach: float, nugget: float = 0.0) -> np.ndarray:
    """Exponential model; 0 at distance 0."""
    return np.where(h == 0, 0.0, nugget + sill * (1 - np.exp(-h / reach)))


def krige(xy: np.ndarray, z: np.ndarray, at: np.ndarray, sill: float, reach: float, nugget: float = 0.0, drift: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Universal kriging with a linear drift (or ordinary): estimates and variances."""
    centre = xy.mean(0)
    basis = lambda p: np.column_stack([np.ones(len(p)), *((p - centre).T if drift else ())])
    far = lambda p, q: np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    f, n = basis(xy), len(xy)
    k = f.shape[1]
    left = np.zeros((n + k, n + k))
    left[:n, :n], left[:n, n:], left[n:, :n] = variogram(far(xy, xy), sill, reach, nugget), f, f.T
    right = np.concatenate([variogram(far(xy, at), sill, reach, nugget), basis(at).T])
    w = np.linalg.lstsq(left, right, rcond=None)[0]
    return z @ w[:n], np.maximum((w * right).sum(0), 0)


def fill_holes(z: np.ndarray, order: int = 1) -> np.ndarray:
    """NaN nodes replaced by the harmonic (order 1) or biharmonic (order 2) surface through the others.
    Only what lies within three nodes of a hole's box matters, so only that is solved."""
    out = z.astype(np.float64)
    if not (holes := np.isnan(out)).any():
        return out
    box = tuple(slice(max(0, at.min() - 3), at.max() + 4) for at in np.nonzero(holes))
    part, hole = out[box], holes[box].ravel()
    cell = np.arange(part.size).reshape(part.shape)
    pairs = np.concatenate([np.stack([cell[:, :-1].ravel(), cell[:, 1:].ravel()]), np.stack([cell[:-1].ravel(), cell[1:].ravel()])], 1)
    lap = np.zeros((part.size, part.size))
    for p, q in (pairs, pairs[::-1]):
        np.add.at(lap, (p, p), 1)
        lap[p, q] -= 1
    rows = lap[hole] if order == 1 else lap[hole] @ lap
    known = np.where(hole, 0.0, part.ravel())
    solved = known.copy()
    solved[hole] = np.linalg.solve(rows[:, hole], -rows @ known)
    out[box] = solved.reshape(part.shape)
    return out


def _bilaplacian(u: np.ndarray) -> np.ndarray:
    def lap(v: np.ndarray) -> np.ndarray:
        p = np.pad(v, 1, mode="edge")
        return 4 * v - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]

    return lap(lap(u))


def thin_plate(shape: tuple[int, int], cells: np.ndarray, z: np.ndarray, stiff: float = 1e-3, tol: float = 1e-8, most: int = 4000) -> np.ndarray:
    """The smooth surface near samples at flat `cells`: (W + stiff B) u = W z by conjugate gradients."""
    w = np.zeros(shape)
    w.flat[cells] = 1
    right = np.zeros(shape)
    right.flat[cells] = z - z.mean()
    op = lambda u: w * u + stiff * _bilaplacian(u)
    u = np.zeros(shape)
    r = right - op(u)
    p, rr = r.copy(), float((r * r).sum())
    stop = tol * tol * max(rr, 1e-300)
    for _ in range(most):
        if rr <= stop:
            break
        ap = op(p)
        step = rr / float((p * ap).sum())
        u, r = u + step * p, r - step * ap
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    return u + z.mean()


def choose_blocks(z: np.ndarray, side: int, apart: int, count: int, seed: list[int], window: int, grid: int = 8, margin: int = 8) -> list[tuple[int, int, int, float]]:
    """(row, col, stratum, relief) of blocks: candidates lie on a grid where a window around them fits.

    Relief is the range of heights in the block and `margin` cells around it, its thirds are strata,
    and each gives a third of the blocks in a seeded order; what keeping `apart` costs one of them
    the others make up.
    """
    reach = window // 2 - side // 2
    rows, cols = (np.arange(reach, n - reach - side, grid) for n in z.shape)
    places = np.stack(np.meshgrid(rows, cols, indexing="ij"), -1).reshape(-1, 2)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(z, margin, mode="edge"), (side + 2 * margin,) * 2)
    seen = around[places[:, 0], places[:, 1]]
    relief = seen.max((1, 2)) - seen.min((1, 2))
    stratum = np.searchsorted(np.quantile(relief, [1 / 3, 2 / 3]), relief, "right")
    rng, taken = np.random.default_rng(seed), np.zeros(0, int)
    shares = [(np.nonzero(stratum == s)[0], (count + 2 - s) // 3) for s in range(3)]
    for pool, share in [*shares, (np.arange(len(places)), count)]:
        goal = min(count, len(taken) + share)
        for k in rng.permutation(pool):
            if len(taken) < goal and (np.abs(places[taken] - places[k]).max(1, initial=0) >= apart).all():
                taken = np.append(taken, k)
    return [(int(places[k, 0]), int(places[k, 1]), int(stratum[k]), float(relief[k])) for k in taken]


def _near(coarse: np.ndarray, reach: int) -> np.ndarray:
    """The neighbourhood of every coarse node, mirrored at the edges: (rows, cols, k, k)."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(coarse, reach, mode="reflect"), (2 * reach + 1,) * 2)


def phase_sums(coarse: np.ndarray, fine: np.ndarray, factor: int, reach: int = 1) -> np.ndarray:
    """For each phase the sums that a fit needs, of neighbourhoods and targets less the neighbourhood's
    mean: (factor, factor, k * k, k * k + 1). Sums of several fields add up."""
    k2, out = (2 * reach + 1) ** 2, np.zeros((factor, factor, (2 * reach + 1) ** 2, (2 * reach + 1) ** 2 + 1))
    near = _near(coarse.astype(np.float64), reach)
    for a in range(factor):
        for b in range(factor):
            t = fine[a::factor, b::factor]
            x = near[: t.shape[0], : t.shape[1]].reshape(-1, k2)
            mean = x.mean(1, keepdims=True)
            both = np.column_stack([x, t[: near.shape[0], : near.shape[1]].ravel()]) - mean
            out[a, b] = both[:, :-1].T @ both
    return out


def phase_kernels(sums: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Kernels (factor, factor, k * k) that add up to one, by least squares."""
    k2 = sums.shape[2]
    gram, right = sums[..., :k2], sums[..., k2:]
    hold = ridge * np.trace(gram, axis1=2, axis2=3)[..., None, None] / k2 * np.eye(k2)
    w = np.linalg.solve(gram + hold, right)[..., 0]
    return w + (1 - w.sum(-1, keepdims=True)) / k2


def brought_up(coarse: np.ndarray, kernels: np.ndarray, reach: int = 1) -> np.ndarray:
    """The fine field of (n - 1) * factor + 1 nodes a side that the kernels give."""
    factor = kernels.shape[0]
    out = np.zeros([(n - 1) * factor + 1 for n in coarse.shape])
    near = _near(coarse.astype(np.float64), reach).reshape(*coarse.shape, -1)
    for a in range(factor):
        for b in range(factor):
            part = out[a::factor, b::factor]
            part[:] = near[: part.shape[0], : part.shape[1]] @ kernels[a, b]
    return out


def axis_matrix(axis: list[tuple[int, int, float]]) -> np.ndarray:
    """The matrix of an axis' weights (out, src, w)."""
    out = np.zeros((1 + max(o for o, _, _ in axis), 1 + max(s for _, s, _ in axis)))
    for o, s, w in axis:
        out[o, s] += w
    return out


def unseen(v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """What of v an observation rows * v * cols' does not see: v less its least-norm part with the same image."""
    image = rows @ v @ cols.T
    return v - np.linalg.pinv(rows) @ image @ np.linalg.pinv(cols).T


def area_kernels(weights: np.ndarray, factor: int, sill: float, reach: float, nugget: float = 0.0, side: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Simple kriging of a point from side * side observations that average an area, for each of the
    factor * factor places of a point between them: (factor, factor, side, side) and the variances.

    `weights` are those of the observation on an axis, around its node; covariance falls
    exponentially with distance, and the nugget is a point's own.
    """
    half, first = len(weights) // 2, -((side - 1) // 2)
    taps = np.arange(len(weights)) - half
    cover = lambda h: sill * np.exp(-h / reach) + nugget * (h == 0)
    w2 = np.multiply.outer(weights, weights)
    nodes = (np.arange(side) + first) * factor
    at = np.stack(np.meshgrid(nodes, nodes, indexing="ij"), -1).reshape(-1, 2)
    spread = np.stack(np.meshgrid(taps, taps, indexing="ij"), -1).reshape(-1, 2)
    fine = at[:, None, :] + spread  # (areas, taps, 2)
    far = lambda p, q: np.hypot(*np.moveaxis(p[..., :, None, :] - q[..., None, :, :], -1, 0))
    flat, n = w2.ravel(), len(at)
    among = np.array([[flat @ cover(far(fine[i], fine[j])) @ flat for j in range(n)] for i in range(n)])
    kernels, variance = np.zeros((factor, factor, side, side)), np.zeros((factor, factor))
    for a, b in np.ndindex(factor, factor):
        to = cover(np.hypot(*(fine - np.array([a, b])).reshape(-1, 2).T)).reshape(n, -1) @ flat
        own = np.linalg.solve(among, to)
        kernels[a, b], variance[a, b] = own.reshape(side, side), max(0.0, float(cover(np.zeros(1))[0] - own @ to))
    return kernels, variance


def radial_covariance(z: np.ndarray, most: int) -> np.ndarray:
    """Autocovariance at distances 0 to `most`, averaged over the shifts that round to each."""
    f, sums = z - z.mean(), [[] for _ in range(most + 1)]
    rows, cols = f.shape
    for a in range(most + 1):
        for b in range(-most, most + 1):
            if (h := int(np.rint(np.hypot(a, b)))) <= most and (a > 0 or b >= 0):
                left, right = f[: rows - a, max(0, -b) : cols - max(0, b)], f[a:, max(0, b) : cols + min(0, b)]
                sums[h].append(float((left * right).mean()))
    return np.array([np.mean(s) for s in sums])
