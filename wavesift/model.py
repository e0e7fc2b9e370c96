"""What a query asks, and the shapes of the tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Window lengths of the index, and the basic window, its least. Fixed values.
WINDOWS = (25, 50, 100, 200, 400)
BASIC = WINDOWS[0]
#: Points in a stored row of a series. Fixed value.
CHUNK = 1000
#: Segments of a plan at most. Fixed value.
MAX_SEGMENTS = 30

SERIES = "series_id string, pos long, value double"
CHUNKS = "series_id string, chunk long, start long, vals array<double>"
ANSWER = "series_id string, pos long, dist double"

KINDS = ("RSM-ED", "RSM-DTW", "NSM-ED", "cNSM-ED", "cNSM-DTW")


@dataclass(frozen=True)
class Query:
    """One of KINDS with its thresholds, all inclusive. Distances: Euclidean (ED) or banded
    dynamic time warping (DTW, |i - j| <= rho), of raw values (RSM) or of z-normalised windows
    and query (NSM); cNSM also asks |mean - query mean| <= beta and 1 / alpha <= deviation /
    query deviation <= alpha. Deviations are those of a population."""

    kind: str
    eps: float
    rho: int = 0
    alpha: float = 1.0
    beta: float = 0.0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind} is none of {', '.join(KINDS)}")
        if not self.eps >= 0:
            raise ValueError("eps must be 0 or more")
        if self.rho < 0:
            raise ValueError("rho must be 0 or more")
        if self.constrained and (self.alpha < 1 or self.beta < 0):
            raise ValueError("alpha must be 1 or more, beta 0 or more")

    @property
    def normal(self) -> bool:
        return "NSM" in self.kind

    @property
    def constrained(self) -> bool:
        return self.kind.startswith("cNSM")

    @property
    def warped(self) -> bool:
        return self.kind.endswith("DTW")

    def band(self, m: int) -> int:
        """rho for a query of m points: a band as wide as the query is the widest there is."""
        return min(self.rho, m - 1) if self.warped else 0

    def at(self, **changes) -> Query:
        return replace(self, **changes)


def band_of(share: float, m: int) -> int:
    """rho as a share of the query's length, rounded down; over 1 it is a width already."""
    return int(share * m) if share <= 1 else int(share)
