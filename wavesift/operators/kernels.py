"""Distances and lower bounds of many windows at once, in NumPy: rows of `x` are windows."""

from __future__ import annotations

import numpy as np

from wavesift.model import Query
from wavesift.plans.planner import envelope


def euclidean(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of squared differences."""
    d = x - q
    return np.einsum("ij,ij->i", d, d)


def normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, mean, deviation): z-normalised rows; constant rows have a deviation of 0 and z 0."""
    mu = x.mean(axis=-1, keepdims=True)
    sd = x.std(axis=-1, keepdims=True)
    flat = sd <= 1e-12 * np.maximum(1.0, np.abs(mu))
    z = np.where(flat, 0.0, (x - mu) / np.where(flat, 1.0, sd))
    return z, mu[..., 0], np.where(flat, 0.0, sd)[..., 0]


def dtw(x: np.ndarray, q: np.ndarray, rho: int, most: float = np.inf) -> np.ndarray:
    """Squared costs of the best warping of each row to q within the band |i - j| <= rho;
    infinite where every path's cost passes `most`. One loop over cells, vectorised over rows;
    rows that can't end under `most` are left on the way."""
    m = len(q)
    out = np.full(len(x), np.inf)
    live = np.arange(len(x))
    last = np.full((len(x), 2 * rho + 3), np.inf)  # row i of the matrix at places j - i + rho + 1
    for i in range(m):
        row = np.full_like(last, np.inf)
        for j in range(max(0, i - rho), min(m, i + rho + 1)):
            k = j - i + rho + 1
            d = (x[:, i] - q[j]) ** 2
            if i == 0 and j == 0:
                row[:, k] = d
            else:  # (i - 1, j - 1) is at the same place of the last row, (i - 1, j) one after
                row[:, k] = d + np.minimum(np.minimum(last[:, k], last[:, k + 1]), row[:, k - 1])
        last = row
        if i % 16 == 15 and np.isfinite(most):
            keep = row.min(axis=1) <= most
            if not keep.all():
                x, last, live = x[keep], last[keep], live[keep]
                if not len(live):
                    return out
    out[live] = last[:, rho + 1]
    return out


def lb_kim(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """From the first and last three points: any warping has the end pairs, and near each end
    one of the pairs of its second and of its third points."""
    m = len(q)
    d = lambda i, j: (x[:, i] - q[j]) ** 2
    out = d(0, 0) + (d(m - 1, m - 1) if m > 1 else 0)
    if m >= 6:
        for at in (lambda k: k, lambda k: m - 1 - k):
            for k in (1, 2):
                pairs = [d(at(k), at(i)) for i in range(k + 1)] + [d(at(i), at(k)) for i in range(k)]
                out = out + np.minimum.reduce(pairs)
    return out


def lb_keogh(x: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares by which rows lie outside lower .. upper."""
    over, under = np.maximum(x - upper, 0), np.maximum(lower - x, 0)
    return (over * over + under * under).sum(axis=1)


def lb_paa(x: np.ndarray, lower: np.ndarray, upper: np.ndarray, pieces: int) -> np.ndarray:
    """The same on the means of `pieces` pieces, weighed by their lengths: a bound that is
    cheaper and looser. With lower = upper = q it bounds the Euclidean distance."""
    edges = np.linspace(0, x.shape[1], min(pieces, x.shape[1]) + 1).astype(int)
    n = np.diff(edges)
    mean = lambda v: np.add.reduceat(v, edges[:-1], axis=-1) / n
    s, lo, up = mean(x), mean(lower), mean(upper)
    gap = np.maximum(np.maximum(s - up, lo - s), 0)
    return (gap * gap * n).sum(axis=1)


def distances(x: np.ndarray, q: np.ndarray, query: Query, pieces: int = 0) -> np.ndarray:
    """The distance of each row that answers the query, NaN for others. Warped distances are
    computed for rows that pass a cascade of lower bounds, the cheapest first; pieces: with a
    bound on piecewise means before all."""
    most = query.eps**2
    ok = np.ones(len(x), dtype=bool)
    if query.normal:
        zq, mq, sq = normalised(q[None])
        if sq[0] == 0:
            return np.full(len(x), np.nan)
        x, mu, sd = normalised(x)
        ok &= sd > 0
        if query.constrained:
            share = sd / sq[0]
            ok &= (np.abs(mu - mq[0]) <= query.beta) & (share >= 1 / query.alpha) & (share <= query.alpha)
        q = zq[0]
    rho = query.band(len(q))
    lower, upper = envelope(q, rho)
    slack = 1 + 1e-12  # bounds are summed in another order than distances
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(ok)
    if pieces:
        at = at[lb_paa(x[at], lower, upper, pieces) <= most * slack]
    if not query.warped:
        d = euclidean(x[at], q)
    else:
        at = at[lb_kim(x[at], q) <= most * slack]
        at = at[lb_keogh(x[at], lower, upper) <= most * slack]
        own = envelope(x[at], rho)
        at = at[lb_keogh(q[None], *own) <= most * slack]
        d = dtw(x[at], q, rho, most * slack)
    near = d <= most
    out[at[near]] = np.sqrt(d[near])
    return out
