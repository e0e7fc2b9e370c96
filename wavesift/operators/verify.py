"""Distances of windows: of all (full scans), or of candidate starts only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.model import Query
from wavesift.operators import kernels
from wavesift.plans.planner import envelope
from wavesift.sources.series import to_chunks, with_halo

#: Points that a scan's chunk owns: many times the longest queries, so that halos are cheap.
SCAN = 16_384
ROWS = 2048  # windows in a kernel's hands at once, for bounded memory


def chunks_for(series: DataFrame, m: int, size: int = SCAN) -> DataFrame:
    """Chunks of the series with the m - 1 values that follow each."""
    return with_halo(to_chunks(series, size), size, m - 1)


def _kernel(m: int, emit, names: list[str], starts: bool):
    """Over rows (series_id, start, vals[, starts]): emit(windows, sids, positions) by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                vals = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                if len(vals) < m:
                    continue
                sid, first = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                win = np.lib.stride_tricks.sliding_window_view(vals, m)
                at = np.unique(b.column(3)[i].values.to_numpy()) - first if starts else np.arange(min(len(win), b.column(3)[i].as_py()))
                at = at[(at >= 0) & (at < len(win))]
                for k in range(0, len(at), ROWS):
                    some = at[k : k + ROWS]
                    cols = emit(win[some], first + some)
                    if len(cols[0]):
                        yield pa.RecordBatch.from_arrays([pa.array([sid] * len(cols[0])), *map(pa.array, cols)], names)

    return run


def _answers(q: np.ndarray, query: Query, pieces: int):
    def emit(x: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        d = kernels.distances(x, q, query, pieces)
        ok = ~np.isnan(d)
        return [pos[ok], d[ok]]

    return emit


def scan(series: DataFrame, q: np.ndarray, query: Query, pieces: int = 0, size: int = SCAN) -> DataFrame:
    """ANSWER of every window of the series: no index. pieces: with a bound on means first.
    A query longer than a series has no answers there."""
    q = np.asarray(q, dtype=float)
    rows = chunks_for(series, len(q), size).select("series_id", "start", "vals", F.lit(size).alias("own"))
    return rows.mapInArrow(_kernel(len(q), _answers(q, query, pieces), ["series_id", "pos", "dist"], False), "series_id string, pos long, dist double")


#: Candidate chunks up to this number are listed on the driver, so that only their ranges of
#: positions are read: 64 x 16,384 starts at most.
LISTED = 64


def check(series: DataFrame, candidates: DataFrame, q: np.ndarray, query: Query, size: int = SCAN) -> DataFrame:
    """ANSWER among candidates (series_id, start): only points of chunks that have some, and of
    the chunks that their windows reach into, are read or shuffled, and a kernel computes only
    the candidates' windows. For few chunks the ranges are filters of the series' own scan; for
    many, a semi join on chunks cuts the series before it is shuffled."""
    q = np.asarray(q, dtype=float)
    chunk = F.floor((F.col("start") - 1) / size).cast("long")
    wanted = candidates.select("series_id", chunk.alias("chunk"), "start").groupBy("series_id", "chunk").agg(F.collect_set("start").alias("starts"))
    reach = -(-(len(q) - 1) // size)
    found = wanted.limit(LISTED + 1).collect()
    if len(found) <= LISTED:
        shape = "series_id string, chunk long, starts array<long>"
        wanted = F.broadcast(candidates.sparkSession.createDataFrame(found, shape).coalesce(1))
        near = F.lit(False)
        for r in found:
            last = max(max(r.starts) + len(q) - 1, (r.chunk + 1) * size)
            near |= (F.col("series_id") == r.series_id) & F.col("pos").between(r.chunk * size + 1, last)
        own = series.where(near)
    else:
        need = wanted.select("series_id", F.explode(F.sequence(F.col("chunk"), F.col("chunk") + reach)).alias("_chunk")).distinct()
        own = series.withColumn("_chunk", F.floor((F.col("pos") - 1) / size).cast("long")).join(need, ["series_id", "_chunk"], "left_semi").drop("_chunk")
    rows = chunks_for(own, len(q), size).join(wanted, ["series_id", "chunk"]).select("series_id", "start", "vals", "starts")
    return rows.mapInArrow(_kernel(len(q), _answers(q, query, 0), ["series_id", "pos", "dist"], True), "series_id string, pos long, dist double")


def bounds(series: DataFrame, q: np.ndarray, rho: int, pieces: int = 8, size: int = SCAN) -> DataFrame:
    """(series_id, pos, kim, keogh_query, keogh_data, paa, dtw): the squared lower bounds of
    every window, and the squared distance that they bound."""
    q = np.asarray(q, dtype=float)
    rho = min(rho, len(q) - 1)
    lower, upper = envelope(q, rho)

    def emit(x: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        return [
            pos, kernels.lb_kim(x, q), kernels.lb_keogh(x, lower, upper), kernels.lb_keogh(q[None], *envelope(x, rho)),
            kernels.lb_paa(x, lower, upper, pieces), kernels.dtw(x, q, rho),
        ]

    names = ["series_id", "pos", "kim", "keogh_query", "keogh_data", "paa", "dtw"]
    rows = chunks_for(series, len(q), size).select("series_id", "start", "vals", F.lit(size).alias("own"))
    return rows.mapInArrow(_kernel(len(q), emit, names, False), "series_id string, pos long, " + ", ".join(f"{n} double" for n in names[2:]))
