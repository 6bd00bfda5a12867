"""Statistical kernels: bootstrap, convergence diagnostics, likelihoods, Metropolis sampling."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np


def bootstrap_ratio(logs: np.ndarray, draws: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """exp of the mean, and the 2.5 and 97.5 percentiles over resampled means."""
    rng = np.random.default_rng(seed)
    means = logs[rng.integers(0, len(logs), (draws, len(logs)))].mean(1)
    low, high = np.quantile(means, [0.025, 0.975])
    return float(np.exp(logs.mean())), float(np.exp(low)), float(np.exp(high))


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[inverse]


def _z(x: np.ndarray) -> np.ndarray:
    """Rank-normalised values, all chains together."""
    r = average_ranks(x.ravel())
    inv = NormalDist().inv_cdf
    return np.array([inv((k - 0.375) / (x.size + 0.25)) for k in r]).reshape(x.shape)


def _split(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return np.concatenate([x[:, :half], x[:, x.shape[1] - half :]])


def _rhat(x: np.ndarray) -> float:
    n = x.shape[1]
    within, between = x.var(1, ddof=1).mean(), n * x.mean(1).var(ddof=1)
    if within == 0:  # chains that stand still: in one place, or each in its own
        return 1.0 if between == 0 else float("inf")
    return float(np.sqrt(((n - 1) / n * within + between / n) / within))


def rhat(chains: np.ndarray) -> float:
    """The larger of the rank-normalised split statistic of values and of their folded distances."""
    x = _split(chains)
    return max(_rhat(_z(x)), _rhat(_z(np.abs(x - np.median(x)))))


def _ess(x: np.ndarray) -> float:
    """Effective sample size by Geyer's initial monotone sequence of paired autocorrelations."""
    m, n = x.shape
    c = x - x.mean(1, keepdims=True)
    f = np.fft.rfft(c, 2 * n)
    acov = np.fft.irfft(f * np.conj(f), 2 * n)[:, :n] / n
    within = (acov[:, 0] * n / (n - 1)).mean()
    total = within * (n - 1) / n + (x.mean(1).var(ddof=1) if m > 1 else 0.0)
    if total <= 0:
        return float("nan")
    rho = 1 - (within - acov.mean(0)) / total
    rho[0] = 1
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    stop = np.argmax(pairs < 0) if (pairs < 0).any() else len(pairs)
    mono = np.minimum.accumulate(pairs[:stop])
    return float(min(m * n / max(2 * mono.sum() - 1, 1e-12), m * n * np.log10(m * n)))


def ess_bulk(chains: np.ndarray) -> float:
    return _ess(_z(_split(chains)))


def ess_tail(chains: np.ndarray) -> float:
    x = _split(chains)
    return min(_ess((x <= np.quantile(x, q)).astype(float)) for q in (0.05, 0.95))


def log_likelihood(residual: np.ndarray, cov: np.ndarray) -> float:
    """Of correlated Gaussian noise, by a Cholesky factor."""
    low = np.linalg.cholesky(cov)
    u = np.linalg.solve(low, residual)
    return float(-0.5 * (u @ u) - np.log(np.diag(low)).sum() - 0.5 * len(residual) * np.log(2 * np.pi))


def grouped_log_likelihood(mean: np.ndarray, n: np.ndarray, m2: np.ndarray, cov: np.ndarray, noise: float) -> float:
    """The same of single residuals whose covariance is that of their groups, with independent noise
    on each: from every group's mean, count and sum of squares around the mean."""
    own = log_likelihood(mean, cov + np.diag(noise / n))
    return float(own - 0.5 * (m2.sum() / noise + (n.sum() - len(n)) * np.log(2 * np.pi * noise) + np.log(n).sum()))


def metropolis(log_p, start: np.ndarray, scale: np.ndarray, draws: int, seed: int) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    x, lp, out, kept = start.astype(float), log_p(start), np.empty((draws, len(start))), 0
    for k in range(draws):
        y = x + scale * rng.normal(size=len(x))
        if np.log(rng.random()) < (ly := log_p(y)) - lp:
            x, lp, kept = y, ly, kept + 1
        out[k] = x
    return out, kept / draws
