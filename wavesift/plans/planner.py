"""Cuts a query into disjoint windows of the index's lengths, by estimated selectivity.

Runs on the driver over the collected statistics, a row for each bucket."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, replace
from math import floor, inf, log, log2, sqrt

import numpy as np
from pyspark.sql import DataFrame

from wavesift.model import BASIC, MAX_SEGMENTS, WINDOWS, Query


@dataclass(frozen=True)
class Segment:
    """Query values first .. first + w - 1 (from 0): the mean of the query there, or of its
    lower and upper envelope, the means of data windows that an answer can have, and how many
    intervals of the index these are."""

    first: int
    w: int
    low_mean: float
    high_mean: float
    lo: float
    hi: float
    intervals: int


class Statistics:
    """The statistics of one series' index, by width: sorted bucket edges and running counts."""

    def __init__(self, rows: list):
        self.by: dict[int, tuple] = {}
        for w in sorted({r["w"] for r in rows}):
            own = sorted((r for r in rows if r["w"] == w), key=lambda r: r["key"])
            self.by[w] = ([r["lo"] for r in own], [r["hi"] for r in own], np.concatenate([[0], np.cumsum([r["n_int"] for r in own])]))

    @classmethod
    def of(cls, meta: DataFrame, series_id: str = "s") -> Statistics:
        return cls([r.asDict() for r in meta.where(meta.series_id == series_id).collect()])

    def intervals(self, w: int, lo: float, hi: float) -> int:
        """Intervals in buckets that touch [lo, hi]."""
        los, his, cum = self.by[w]
        a, b = bisect_left(his, lo), bisect_right(los, hi)
        return int(cum[b] - cum[a]) if b > a else 0

    def nearest(self, w: int, low: float, high: float) -> float:
        """How far the bucket nearest to [low, high] is from it."""
        los, his, _ = self.by[w]
        if self.intervals(w, low, high):
            return 0.0
        a = bisect_left(his, low)
        return min(los[a] - high if a < len(los) else inf, low - his[a - 1] if a else inf)

    def total(self, w: int) -> int:
        return int(self.by[w][2][-1])


def envelope(q: np.ndarray, rho: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper): least and greatest within rho places, cut off at the ends."""
    lower, upper = q.copy(), q.copy()
    for k in range(1, rho + 1):
        for a, b in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            lower[..., a] = np.minimum(lower[..., a], q[..., b])
            upper[..., a] = np.maximum(upper[..., a], q[..., b])
    return lower, upper


def disjoint_sums(q: np.ndarray, w: int = BASIC) -> np.ndarray:
    """Sums of consecutive windows; a shorter rest at the end is left out."""
    return q[: len(q) // w * w].reshape(-1, w).sum(axis=1)


def mean_range(query: Query, q: np.ndarray, w: int, low: float, high: float) -> tuple[float, float]:
    """The means that a window of an answer can have where the query's, or its envelope's,
    are low .. high: windows of equal place differ by the square of their means' difference,
    times w, at most by eps squared. For cNSM the query's window is scaled by up to alpha
    either way, around the means, and moved by up to beta."""
    r = query.eps / sqrt(w)
    if not query.constrained:
        return low - r, high + r
    mu, sd = q.mean(), q.std()
    ends = [(a * low + (1 - a) * mu - a * sd * r, a * high + (1 - a) * mu + a * sd * r) for a in (1 / query.alpha, query.alpha)]
    return min(e[0] for e in ends) - query.beta, max(e[1] for e in ends) + query.beta


def segment(query: Query, q: np.ndarray, stats: Statistics, first: int, w: int, low: float, high: float) -> Segment:
    """low, high: the means of the query there, or of its envelope."""
    lo, hi = mean_range(query, q, w, low, high)
    slack = 1e-9 * max(1.0, abs(lo), abs(hi))  # a sum in another order never dismisses an answer
    return Segment(first, w, low, high, lo - slack, hi + slack, stats.intervals(w, lo - slack, hi + slack))


def plan(query: Query, q: np.ndarray, stats: Statistics, widths: tuple[int, ...] = WINDOWS, most: int = MAX_SEGMENTS) -> list[Segment]:
    """Disjoint segments of the least mean log selectivity, the most selective first.

    A dynamic program over the basic windows of the query: best[j][i] is the least sum of log
    selectivities of j segments in the first i basic windows, each place left out or ended by
    a segment; of the sums the one with the least mean is taken, ties to more segments. At
    least (floor(log2 m) - 1) / 2 segments are asked for, as far as the query has room. A query
    shorter than a basic window has no segment, and so no index use."""
    n = len(q) // BASIC
    if not n:
        return []
    most = min(n, most)
    least = max(1, min((floor(log2(len(q))) - 1) // 2, most))
    usable = [w for w in widths if w in stats.by and w % BASIC == 0]
    cost: dict[tuple[int, int], tuple[float, Segment]] = {}
    sums = [np.concatenate([[0.0], np.cumsum(disjoint_sums(e))]) for e in envelope(q, query.band(len(q)))]
    for i in range(1, n + 1):
        for w in usable:
            if w // BASIC <= i:
                low, high = (float(c[i] - c[i - w // BASIC]) / w for c in sums)
                s = segment(query, q, stats, (i - w // BASIC) * BASIC, w, low, high)
                cost[i, w] = (log(max(s.intervals, 0.5) / max(stats.total(w), 1)), s)
    best = [[0.0] * (n + 1)] + [[inf] * (n + 1) for _ in range(most)]
    took: dict[tuple[int, int], tuple[int, Segment]] = {}
    for j in range(1, most + 1):
        for i in range(1, n + 1):
            best[j][i] = best[j][i - 1]
            for w in usable:
                if (i, w) in cost and best[j - 1][i - w // BASIC] + cost[i, w][0] < best[j][i]:
                    best[j][i] = best[j - 1][i - w // BASIC] + cost[i, w][0]
                    took[j, i] = (i - w // BASIC, cost[i, w][1])
    counts = [j for j in range(least, most + 1) if best[j][n] < inf] or [j for j in range(1, most + 1) if best[j][n] < inf]
    if not counts:
        return []
    j, i, out = min(counts, key=lambda j: (best[j][n] / j, -j)), n, []
    while j:
        while (j, i) not in took or best[j][i] == best[j][i - 1]:
            i -= 1
        at, s = took[j, i]
        out.append(s)
        i, j = at, j - 1
    return sorted(out, key=lambda s: (s.intervals, s.first))


def tightened(plan: list[Segment], query: Query, q: np.ndarray, stats: Statistics) -> list[Segment]:
    """The plan with ranges cut, for raw distances, by what the other segments take at least:
    w times the square of how far the nearest bucket of the index is from the query's mean
    there. All bounds add up to eps squared at most, so no answer is lost."""
    if query.normal:
        return plan
    takes = [s.w * stats.nearest(s.w, s.low_mean, s.high_mean) ** 2 for s in plan]
    out = []
    for s, own in zip(plan, takes, strict=True):
        left = max(query.eps**2 * (1 + 1e-9) + 1e-9 - (sum(takes) - own), 0.0)
        cut = segment(query.at(eps=sqrt(left)), q, stats, s.first, s.w, s.low_mean, s.high_mean)
        lo, hi = max(s.lo, cut.lo), min(s.hi, cut.hi)
        out.append(replace(s, lo=lo, hi=hi, intervals=stats.intervals(s.w, lo, hi)))
    return sorted(out, key=lambda s: (s.intervals, s.first))
