"""Index probing: a plan's segments to candidate starts."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavesift.model import Query
from wavesift.plans.planner import Segment

#: Starts of a block, in which the intervals of all segments meet.
BLOCK = 1 << 14
#: Parts that [-beta, beta] is cut into.
PARTS = 4


def range_union(plan: list[Segment]) -> dict[int, list[tuple[float, float]]]:
    """The ranges of means that a plan reads, by width, overlapping ones as one, so that no row
    is asked for twice."""
    out: dict[int, list[tuple[float, float]]] = {}
    for s in sorted(plan, key=lambda s: (s.w, s.lo)):
        own = out.setdefault(s.w, [])
        if own and s.lo <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], s.hi))
        else:
            own.append((s.lo, s.hi))
    return out


def _apart(a, b, lo, hi) -> Column:
    """How far the ranges a .. b and lo .. hi are from each other, 0 where they touch."""
    return F.greatest(a - hi, lo - b, F.lit(0.0))


def shifts(query: Query, q: np.ndarray, parts: int = PARTS) -> list[tuple[float, float]]:
    """For cNSM, ranges that hold the mean of an answer: parts of +-beta around the query's.
    None where there is nothing to tell them by: other kinds, and constant queries."""
    if not query.constrained or q.std() < 1e-12:
        return []
    slack = 1e-9 * max(1.0, abs(q.mean()))
    edges = np.linspace(q.mean() - query.beta - slack, q.mean() + query.beta + slack, (parts if query.beta else 1) + 1)
    return [(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False)]


def _bounds(s: Segment, query: Query, q: np.ndarray, parts: list[tuple[float, float]]) -> dict[str, Column]:
    """Lower bounds of an index row for a segment, which add up over segments: of the squared
    raw distance, or, for each range of the answer's mean, of the squared normalised distance
    (d) and of the answer's variance times its length (v)."""
    lo, hi = F.col("lo"), F.col("hi")
    square = lambda x: s.w * x * x
    if not parts:
        return {"lb": square(_apart(F.lit(s.low_mean), F.lit(s.high_mean), lo, hi))}
    mu, sd = float(q.mean()), float(q.std())
    ends = (sd / query.alpha * (1 - 1e-9), sd * query.alpha * (1 + 1e-9))  # of the answer's deviation
    out = {}
    for i, (a, b) in enumerate(parts):
        least, most = F.least(*[(lo - b) / e for e in ends]), F.greatest(*[(hi - a) / e for e in ends])
        out[f"d{i}"] = square(_apart(F.lit((s.low_mean - mu) / sd), F.lit((s.high_mean - mu) / sd), least, most))
        out[f"v{i}"] = square(_apart(F.lit(a), F.lit(b), lo, hi))
    return out


def hits(index: DataFrame, plan: list[Segment], query: Query, q: np.ndarray, parts: int = PARTS, series_id: str = "s") -> DataFrame:
    """(series_id, seg, left, right, bounds): the intervals of query starts that each segment of
    the plan allows. One scan of the index, of the widths and ranges that some segment asks for."""
    ranges = range_union(plan)
    asked = reduce(or_, [(F.col("w") == w) & reduce(or_, [(F.col("hi") >= lo) & (F.col("lo") <= hi) for lo, hi in own]) for w, own in ranges.items()])
    rows = index.where((F.col("series_id") == series_id) & asked)
    cut, per = shifts(query, q, parts), []
    for i, s in enumerate(plan):
        bounds = [c.alias(n) for n, c in _bounds(s, query, q, cut).items()]
        one = F.struct(F.lit(i).alias("seg"), (F.col("left") - s.first).alias("left"), (F.col("right") - s.first).alias("right"), *bounds)
        per.append(F.when((F.col("w") == s.w) & (F.col("hi") >= s.lo) & (F.col("lo") <= s.hi), one))
    return rows.select("series_id", F.explode(F.filter(F.array(*per), lambda x: x.isNotNull())).alias("x")).select("series_id", "x.*")


def candidates(index: DataFrame, plan: list[Segment], query: Query, n: int, m: int, series_id: str = "s", q: np.ndarray | None = None, parts: int = PARTS) -> DataFrame:
    """(series_id, start, lb): starts inside 1 .. n - m + 1 that every segment allows, and whose
    lower bounds add up to eps squared at most: for cNSM (where q is asked for) those within one
    of the parts that the answer's mean can be in, and there the least variance that the
    segments' means leave must be within the query's, too.

    Intervals, not starts, are shuffled, cut to blocks of starts; inside a block, starts are
    taken one by one. Intervals of one segment are disjoint, so a start with a row of each is
    in their intersection."""
    q = np.zeros(m) if q is None else np.asarray(q, dtype=float)
    got = hits(index, plan, query, q, parts, series_id)
    got = got.withColumn("left", F.greatest("left", F.lit(1).cast("long"))).withColumn("right", F.least("right", F.lit(n - m + 1).cast("long"))).where("left <= right")
    names = [c for c in got.columns if c not in ("series_id", "seg", "left", "right")]
    got = got.withColumn("block", F.explode(F.sequence(F.floor(F.col("left") / BLOCK), F.floor(F.col("right") / BLOCK)))).repartition("series_id", "block")
    left, right = F.greatest(F.col("left"), F.col("block") * BLOCK), F.least(F.col("right"), F.col("block") * BLOCK + BLOCK - 1)
    starts = got.select("series_id", "block", *names, F.explode(F.sequence(left, right)).alias("start"))
    both = starts.groupBy("series_id", "block", "start").agg(F.count("*").alias("k"), *[F.sum(c).alias(c) for c in names]).where(F.col("k") == len(plan))
    within = lambda c, most: F.col(c) <= most * (1 + 1e-9) + 1e-9
    cut = range(len(names) // 2)
    if cut:
        most = m * query.alpha**2 * float(q.var())
        both = both.withColumn("lb", F.least(*[F.when(within(f"v{i}", most), F.col(f"d{i}")) for i in cut], F.lit(float("inf"))))
    if cut or not query.normal:
        both = both.where(within("lb", query.eps**2))
    return both.select("series_id", "start", "lb")
