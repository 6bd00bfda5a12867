"""Routing kernels on one dense field; they run inside grouped functions, a field a task."""

from __future__ import annotations

import math

import numpy as np

#: What a filled cell lies above the level that reached it, and the neighbours' order.
LIFT = 1e-6
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))

#: Sweeps in each direction before fronts are relaxed, and rows from which they pay for themselves.
SWEEPS, WIDE = 12, 256


def border(shape: tuple[int, int]) -> np.ndarray:
    out = np.ones(shape, bool)
    out[1:-1, 1:-1] = False
    return out


def filled(z: np.ndarray, lift: float = LIFT, seeds: np.ndarray | None = None) -> np.ndarray:
    """Every pit raised to its spill level, from the border or from `seeds`.

    The level is the least solution of "a cell stands at its own height if that is above its lowest
    neighbour, else `lift` above that neighbour". It is reached from above: by sweeps of whole rows
    and columns in all four directions, and where those leave something, by relaxing fronts, in which
    only the neighbours of cells that just fell are looked at again.
    """
    z = np.pad(z.astype(np.float64), 1, constant_values=np.nan)
    rows, cols = z.shape
    start = np.pad(border((rows - 2, cols - 2)) if seeds is None else seeds, 1)
    level = np.where(start, z, np.inf)
    hold = start | np.isnan(z)
    own = np.where(np.isnan(z), np.inf, z)
    for _ in range(SWEEPS if rows > WIDE else 0):
        before = level.copy()
        _swept(level, own, hold, lift)
        _swept(level[::-1], own[::-1], hold[::-1], lift)
        _swept(level.T, own.T, hold.T, lift)
        _swept(level.T[::-1], own.T[::-1], hold.T[::-1], lift)
        if np.array_equal(before, level):
            break
    # what the sweeps have left: cells that a neighbour still reaches at less
    level, own, hold = level.ravel(), own.ravel(), hold.ravel()
    shifts = np.array([a * cols + b for a, b in NEIGHBOURS])
    inner = np.arange(rows * cols).reshape(rows, cols)[1:-1, 1:-1].ravel()
    least = np.min([level[inner + s] for s in shifts], 0)
    better = ~hold[inner] & (np.where(own[inner] > least, own[inner], least + lift) < level[inner])
    level[inner[better]] = np.where(own[inner[better]] > least[better], own[inner[better]], least[better] + lift)
    front = inner[better]
    while front.size:
        to = (front[:, None] + shifts).ravel()
        reached = np.repeat(level[front], len(shifts))
        there = own[to]
        new = np.where(there > reached, there, reached + lift)
        better = ~hold[to] & (new < level[to])
        to, new = to[better], new[better]
        np.minimum.at(level, to, new)
        front = np.unique(to)
    return level.reshape(z.shape)[1:-1, 1:-1].copy()


def _swept(level: np.ndarray, own: np.ndarray, hold: np.ndarray, lift: float) -> None:
    """Each row in turn from the one before it, in place: a level falls to what reaches it from there."""
    for k in range(2, len(level) - 1):
        up = level[k - 1]
        least = up.copy()
        np.minimum(least[1:], up[:-1], out=least[1:])
        np.minimum(least[:-1], up[1:], out=least[:-1])
        new = np.where(own[k] > least, own[k], least + lift)
        np.minimum(new, level[k], out=new)
        np.copyto(level[k], new, where=~hold[k])


def forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, root, taken) of n nodes joined by edges (a, b, w), w being whole and at least 0: the least
    height that a path to a fixed node has to climb, that node (`n` where none is to be reached), and the
    edges of a least spanning forest whose trees grow from nodes that are not fixed.

    In each round every component without a fixed node takes its least edge; see operators.spill.
    """
    k = np.argsort(w, kind="stable")
    a, b, node = a[k], b[k], np.arange(n)
    steps, taken = [], []
    while k.size:
        # edges lie in order, so the one that is put down last is the least
        least, place = np.full(n, k.size), np.arange(k.size)[::-1]
        least[a[::-1]] = place
        other = np.full(n, k.size)
        other[b[::-1]] = place
        least = np.where(fixed, k.size, np.minimum(least, other))
        at = np.flatnonzero(least < k.size)
        least = least[at]
        to = node.copy()
        to[at] = a[least] + b[least] - at
        lesser = np.flatnonzero((to[to] == node) & (node < to))  # of two that point at each other
        to[lesser] = lesser
        while not np.array_equal(further := to[to], to):
            to = further
        taken.append(k[np.unique(least)])
        moved = to[at] != at
        steps.append((at[moved], to[at[moved]], w[k[least[moved]]]))
        a, b = to[a], to[b]
        apart = (a != b) & ~(fixed[a] & fixed[b])
        a, b, k = a[apart], b[apart], k[apart]
    level, root = np.full(n, -1), np.where(fixed, node, n)
    for at, to, height in reversed(steps):
        level[at], root[at] = np.maximum(height, level[to]), root[to]
    return level, root, np.concatenate([np.empty(0, np.int64), *taken])


def contracted(z: np.ndarray, there: np.ndarray, rim: np.ndarray, meets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, end, links) of a part of a field, given whole heights of at least 0. Where `there` is
    false there is no cell; water leaves the field from `rim`, and other parts touch the cells `meets`.

    `level` is what a cell has to climb to get out of the part or the field, `end` where it then is: a
    cell of `meets`, z.size for outside, z.size + 1 for nowhere. `links`, rows (end, end, height), are a
    least spanning forest of the ends, by ways within the part.
    """
    cell, outside = np.arange(z.size).reshape(z.shape), z.size
    pairs = [(cell[:, :-1], cell[:, 1:]), (cell[:-1], cell[1:]), (cell[:-1, :-1], cell[1:, 1:]), (cell[:-1, 1:], cell[1:, :-1])]
    a, b = (np.concatenate([p[side].ravel() for p in pairs]) for side in (0, 1))
    z, there, leaves = z.ravel(), there.ravel(), np.flatnonzero(rim & there)
    both = there[a] & there[b]
    a, b = np.concatenate([a[both], leaves]), np.concatenate([b[both], np.full(leaves.size, outside)])
    z = np.append(z, 0)
    w = np.maximum(z[a], z[b])
    fixed = np.append(meets.ravel() & there, True)
    level, end, _ = forest(outside + 1, a, b, w, fixed)
    level = np.where(fixed, z, level)
    low, high, w = end[a], end[b], np.maximum(level[a], level[b])
    apart = (low != high) & (low <= outside)
    low, high, w = low[apart], high[apart], w[apart]
    _, _, taken = forest(outside + 1, low, high, w, np.zeros(outside + 1, bool))
    return level[:outside], end[:outside], np.stack([low[taken], high[taken], w[taken]], 1)


def lowest_edge(z: np.ndarray) -> np.ndarray:
    """A mask of the lowest cell of the edge, the first in row order on a tie."""
    out = np.zeros(z.shape, bool)
    out.flat[np.where(border(z.shape), z, np.inf).argmin()] = True
    return out


def receivers(z: np.ndarray, spacing: float = 1.0) -> np.ndarray:
    """Flat index of the steepest lower neighbour, the first in order on a tie; -1 for none."""
    rows, cols = z.shape
    padded = np.pad(z, 1, constant_values=np.inf)
    best, out = np.zeros(z.shape), np.full(z.shape, -1, np.int64)
    cell = np.arange(z.size).reshape(z.shape)
    for a, b in NEIGHBOURS:
        drop = (z - padded[1 + a : 1 + a + rows, 1 + b : 1 + b + cols]) / (math.hypot(a, b) * spacing)
        better = drop > best
        best[better], out[better] = drop[better], (cell + a * cols + b)[better]
    return out


class Drainage:
    """Cells in order of their distance from the outlet, in steps, so that whole steps are done at once."""

    def __init__(self, to: np.ndarray):
        self.to = to.ravel()
        at, steps = np.where(self.to < 0, np.arange(self.to.size), self.to), (self.to >= 0).astype(np.int64)
        while (more := steps[at]).any():  # distances and targets of twice as many steps each time
            steps, at = steps + more, at[at]
        self.shape, self.outlet = to.shape, at
        order = np.argsort(steps, kind="stable")
        self.steps = np.split(order, np.cumsum(np.bincount(steps))[:-1])

    def upstream(self) -> np.ndarray:
        """Cells whose path passes each cell, itself included."""
        total = np.ones(self.to.size, np.int64)
        for cells in self.steps[:0:-1]:  # the farthest first; the outlets themselves send nothing on
            np.add.at(total, self.to[cells], total[cells])
        return total.reshape(self.shape)


#: How far below all others the cells lie that have no height.
SUNK = 1000.0
#: Where water leaves, by policy.
OUTLETS = {"edges": lambda z: border(z.shape), "lowest-edge": lowest_edge}


def route(z: np.ndarray, spacing: float = 1.0, policy: str = "edges", holes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """fill, receivers, accumulation and outlets. Water leaves at `edges` or at the `lowest-edge` cell;
    with `edges`, `holes` marks cells without a height, which take water too and lie below all others."""
    if policy not in OUTLETS:
        raise ValueError(f"unknown policy {policy}")
    if holes is None or not holes.any():
        seeds = OUTLETS[policy](z)
    elif policy != "edges":
        raise ValueError("only edges go with holes")
    else:
        z = np.where(holes, z[~holes].min() - SUNK, z)
        seeds = holes | border(z.shape)
    f = filled(z, seeds=seeds)
    to = receivers(f, spacing)
    paths = Drainage(to)
    return {"fill": f, "receiver": to, "upstream": paths.upstream(), "outlet": paths.outlet.reshape(z.shape)}


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    out = mask
    for _ in range(radius):
        p = np.pad(out, 1)
        out = np.logical_or.reduce([p[1 + a : 1 + a + mask.shape[0], 1 + b : 1 + b + mask.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float | None:
    either = int((a | b).sum())
    return None if either == 0 else int((a & b).sum()) / either
