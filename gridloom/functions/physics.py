"""Simulation kernels: landscape evolution with a volume ledger, diffusion scenarios, synthetic terrain."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable

import numpy as np

from . import hydro


def diffusion(z: np.ndarray, spacing: float, k: float, critical: float | None = None, boundary: str = "closed") -> np.ndarray:
    """dz/dt of (non)linear diffusion in flux form; boundary closed, periodic or fixed (edges stay)."""
    def flux(d: np.ndarray) -> np.ndarray:
        g = d / spacing
        return k * g if critical is None else k * g / (1 - np.minimum(np.abs(g) / critical, 0.99) ** 2)

    out = np.zeros_like(z)
    for axis in (0, 1):
        d = np.roll(z, -1, axis) - z
        f = flux(d)
        if boundary != "periodic":
            last = [slice(None), slice(None)]
            last[axis] = -1
            f[tuple(last)] = 0
        out += (f - np.roll(f, 1, axis)) / spacing
    if boundary == "fixed":
        out[[0, -1], :] = 0
        out[:, [0, -1]] = 0
    return out


def stable_step(spacing: float, k: float, critical: float | None = None) -> float:
    most = k if critical is None else k / (1 - 0.99**2)
    return 0.2 * spacing * spacing / most


def steps(years: float, dt: float) -> list[float]:
    """Whole steps and what is left over; a part in 1e9 of a step is rounding."""
    whole, rest = divmod(years, dt)
    close = round(years / dt)
    if abs(years - close * dt) <= 1e-9 * dt:
        whole, rest = close, 0.0
    return [dt] * int(whole) + [rest] * (rest > 0)


def evolve(z: np.ndarray, years: float, dt: float, uplift: float, k_stream: float, k_slope: float, spacing: float = 1.0, m: float = 0.5, n: float = 1.0, base: str | None = "fixed-edges", router: Callable = hydro.route, ledger: list[dict] | None = None) -> tuple[np.ndarray, list[dict]]:
    """Uplift, stream power incision and diffusion, all taken from the heights at a step's start.

    Water is routed over the filled surface, whose drops and slopes drive the incision; none cuts
    deeper than its drop. No material crosses the edges by diffusion. With base "fixed-edges" the
    edges keep their heights, with None the system is closed. The ledger of each step has what came
    in, what was cut, moved, and what the heights say. Steps that diffusion makes unstable are refused.
    `router` gives fill, receiver and upstream of a field. A run that was cut off goes on from its
    heights and its `ledger` to the same end.
    """
    if k_slope > 0 and dt > spacing * spacing / (4 * k_slope):
        raise ValueError("the step is longer than diffusion allows")
    free = np.ones(z.shape, bool) if base is None else ~hydro.border(z.shape)
    z, ledger, area = z.astype(np.float64), list(ledger or ()), spacing * spacing
    plan = steps(years, dt)
    if [r["dt"] for r in ledger] != plan[: len(ledger)]:
        raise ValueError("the ledger is of another run")
    for h in plan[len(ledger) :]:
        routed = router(z, spacing)
        fill, to = routed["fill"].ravel(), routed["receiver"].ravel()
        lower = np.where(to < 0, np.arange(to.size), to)
        gap = np.hypot(*(np.subtract(x, y) for x, y in zip(np.divmod(lower, z.shape[1]), np.divmod(np.arange(to.size), z.shape[1]), strict=True))) * spacing
        drop = fill - fill[lower]
        slope = np.divide(drop, gap, out=np.zeros_like(drop), where=gap > 0)
        wish = k_stream * (routed["upstream"].ravel() * area) ** m * slope**n * h
        terms = {
            "uplift": np.where(free, uplift * h, 0.0),
            "cut": np.where(free, np.minimum(wish, drop).reshape(z.shape), 0.0),
            "moved": np.where(free, diffusion(z, spacing, k_slope) * h, 0.0),
        }
        after = z + terms["uplift"] - terms["cut"] + terms["moved"]
        ledger.append({"dt": h} | {k: float(v.sum() * area) for k, v in terms.items()} | {"change": float((after.sum() - z.sum()) * area)})
        z = after
    return z, ledger


def closes(ledger: list[dict], tol: float = 1e-6) -> bool:
    return all(abs(r["uplift"] - r["cut"] + r["moved"] - r["change"]) <= tol * max(1.0, abs(r["uplift"])) for r in ledger)


def terrain(side: int, seed: int, beta: float = 2.2, relief: float = 100.0) -> np.ndarray:
    """A random surface whose power falls with frequency to the power beta, scaled to its relief."""
    rng = np.random.default_rng(seed)
    fy, fx = np.fft.fftfreq(side)[:, None], np.fft.rfftfreq(side)[None, :]
    f = np.hypot(fx, fy)
    f[0, 0] = np.inf
    phase = rng.uniform(0, 2 * np.pi, f.shape)
    z = np.fft.irfft2(f ** (-beta / 2) * np.exp(1j * phase), (side, side))
    return (z - z.min()) / (z.max() - z.min()) * relief


def saved(z: np.ndarray, ledger: list[dict], settings: dict) -> bytes:
    """A run as it stands, with a digest of its settings and of all that is in it."""
    out = io.BytesIO()
    np.savez(out, z=z, run=np.frombuffer(json.dumps([ledger, settings], sort_keys=True).encode(), np.uint8))
    return hashlib.sha256(out.getvalue()).digest() + out.getvalue()


def restored(blob: bytes, settings: dict) -> tuple[np.ndarray, list[dict]]:
    """Heights and ledger of a saved run; ValueError if it is damaged or was made with other settings."""
    if hashlib.sha256(blob[32:]).digest() != blob[:32]:
        raise ValueError("the saved run is damaged")
    with np.load(io.BytesIO(blob[32:])) as held:
        ledger, made = json.loads(held["run"].tobytes())
        if made != json.loads(json.dumps(settings)):
            raise ValueError("the saved run has other settings")
        return held["z"], ledger
