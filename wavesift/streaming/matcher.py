"""Matching on points as they arrive: per series, the last m - 1 points are kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from wavesift.model import Query
from wavesift.operators.kernels import distances


def match_stream(stream: DataFrame, q, query: Query) -> DataFrame:
    """ANSWER of a stream (series_id, pos, value), in append mode: a window is judged in the
    trigger that brings its last point. Points of a trigger may come in any order; such as are
    at or before the last position already seen are late, and ignored. A gap in the positions
    starts the series anew behind it, since no window reaches over it."""
    q = np.asarray(q, dtype=float)
    m = len(q)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, tail = state.get if state.exists else (0, [])
        new = pd.concat(list(frames)).drop_duplicates("pos").sort_values("pos")
        if last:
            new = new[new.pos > last]
        if not len(new):
            return
        pos = np.concatenate([np.arange(last - len(tail) + 1, last + 1), new.pos.to_numpy()])
        vals = np.concatenate([tail, new.value.to_numpy(dtype=float)])
        breaks = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)]
        found: list[tuple] = []
        for a, b in zip(breaks, breaks[1:], strict=False):
            if b - a >= m:
                win = np.lib.stride_tricks.sliding_window_view(vals[a:b], m)
                for k in range(0, len(win), 2048):
                    d = distances(win[k : k + 2048], q, query)
                    found += [(key[0], int(pos[a + k + i]), float(d[i])) for i in np.flatnonzero(~np.isnan(d))]
        keep = min(m - 1, len(pos) - breaks[-2])
        state.update((int(pos[-1]), vals[len(vals) - keep :].tolist() if keep else []))
        if found:
            yield pd.DataFrame(found, columns=["series_id", "pos", "dist"])

    return stream.groupBy("series_id").applyInPandasWithState(
        step, "series_id string, pos long, dist double", "last long, tail array<double>", "append", GroupStateTimeout.NoTimeout,
    )
