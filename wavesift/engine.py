"""The engine: queries over a series, by its index or by a full scan."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.model import BASIC, MAX_SEGMENTS, Query
from wavesift.operators import answers, index, probe, verify
from wavesift.plans import planner
from wavesift.sources import series as source


@dataclass
class Result:
    """ANSWER, nearest first, and what was done for it; counts are taken when they are asked for."""

    found: DataFrame
    plan: list[planner.Segment] = field(default_factory=list)
    candidates: DataFrame | None = None
    started: float = field(default_factory=time.time)

    def metrics(self) -> dict:
        """seconds, candidates (null for scans), answers, segments read from the index."""
        n = self.found.count()
        cand = self.candidates.count() if self.candidates is not None else None
        return {"seconds": time.time() - self.started, "candidates": cand, "answers": n, "segments": len(self.plan)}

    def exists(self) -> bool:
        return answers.exists(self.found)

    def best(self):
        return answers.best(self.found).first()


class Engine:
    """Answers queries over one series of a table (series_id, pos, value).

    With an index, a query of a basic window or more is planned over the index's statistics,
    its candidates are looked up and verified; without one, or where no window fits or helps,
    it is a full scan. Both give the same answers."""

    def __init__(self, table: DataFrame, series_id: str = "s", index_rows: DataFrame | None = None, meta: DataFrame | None = None):
        self.table, self.series_id = table.where(F.col("series_id") == series_id), series_id
        self.index = index_rows
        self.stats = None
        if index_rows is not None:
            self.stats = planner.Statistics.of(meta if meta is not None else index.statistics(index_rows), series_id)
        self._n: int | None = None

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.table.agg(F.max("pos")).first()[0] or 0
        return self._n

    def cut(self, offset: int, m: int) -> np.ndarray:
        """The m values of the series from offset on, from 1."""
        if not 1 <= offset <= self.n:
            raise ValueError(f"offset must be in 1 .. {self.n}")
        if m < 1 or offset + m - 1 > self.n:
            raise ValueError("the query goes over the end of the series")
        return source.fetch(self.table, offset, m, self.series_id)

    def query(self, query: Query, values=None, offset: int | None = None, length: int | None = None, use_index: bool = True, most: int = MAX_SEGMENTS) -> Result:
        """Every window within the query's thresholds of the values, or of the series' own at
        offset .. offset + length - 1."""
        q = self.cut(offset, length) if values is None else np.asarray(values, dtype=float)
        if len(q) < 1:
            raise ValueError("an empty query")
        helps = use_index and self.stats is not None and len(q) >= BASIC and query.kind != "NSM-ED"
        plan = planner.tightened(planner.plan(query, q, self.stats, most=most), query, q, self.stats) if helps else []
        if not plan:
            return Result(answers.ordered(verify.scan(self.table, q, query)))
        if len(q) > self.n:
            return Result(answers.ordered(verify.scan(self.table, q, query)), plan)
        cand = probe.candidates(self.index, plan, query, self.n, len(q), self.series_id, q)
        return Result(answers.ordered(verify.check(self.table, cand, q, query)), plan, cand)
