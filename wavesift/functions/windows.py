"""Sliding windows over long series: frames inside chunks that carry a halo, so that no task
needs a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points that a window task owns.
SPAN = 16_384


def spread(series: DataFrame, before: int, after: int, span: int = SPAN) -> DataFrame:
    """series with the column `span_no` of the tasks that need each point: the one that owns
    it, and those whose first or last windows reach `after` points on or `before` points back.
    `own` marks the owner's copy."""
    owner = F.floor((F.col("pos") - 1) / span)
    lo = F.floor((F.greatest(F.col("pos") - after, F.lit(1)) - 1) / span)
    hi = F.floor((F.col("pos") - 1 + before) / span)
    sent = series.withColumn("span_no", F.explode(F.sequence(lo, hi)))
    return sent.withColumn("own", F.col("span_no") == owner)


def _frame(lo: int, hi: int):
    return Window.partitionBy("series_id", "span_no").orderBy("pos").rowsBetween(lo, hi)


def sliding(series: DataFrame, widths: tuple[int, ...], scale: int | None = None, span: int = SPAN) -> DataFrame:
    """(series_id, span_no, pos, w, mean, std, total) of every whole window that starts at pos.

    All widths share one shuffle and one sort. std is that of a population. With scale, values
    are taken as whole numbers of 1 / scale and total is their exact sum, from which bucket
    keys don't depend on the order of additions; else total is null."""
    s = spread(series, 0, max(widths) - 1, span)
    whole = F.round(F.col("value") * scale).cast("long") if scale else None
    cols = []
    for w in widths:
        f = _frame(0, w - 1)
        total = F.sum(whole).over(f) if scale else F.lit(None).cast("long")
        cols.append(F.when(F.count("*").over(f) == w, F.struct(F.lit(w).alias("w"), F.avg("value").over(f).alias("mean"), F.stddev_pop("value").over(f).alias("std"), total.alias("total"))))
    got = s.select("series_id", "span_no", "pos", "own", F.array(*cols).alias("all")).where("own")
    return got.select("series_id", "span_no", "pos", F.explode(F.filter("all", lambda x: x.isNotNull())).alias("x")).select("series_id", "span_no", "pos", "x.*")


def envelope(series: DataFrame, rho: int, span: int = SPAN) -> DataFrame:
    """(series_id, pos, value, lower, upper): least and greatest of the points within rho,
    cut off at the ends of the series."""
    f = _frame(-rho, rho)
    s = spread(series, rho, rho, span)
    got = s.select("series_id", "pos", "own", "value", F.min("value").over(f).alias("lower"), F.max("value").over(f).alias("upper"))
    return got.where("own").drop("own")


def window_values(series: DataFrame, m: int, span: int = SPAN) -> DataFrame:
    """(series_id, pos, vals): the m values of every whole window, for expressions on few or
    short windows; scans of long ones use the kernels on chunks."""
    s = spread(series, 0, m - 1, span)
    got = s.select("series_id", "pos", "own", F.collect_list("value").over(_frame(0, m - 1)).alias("vals"))
    return got.where("own").where(F.size("vals") == m).drop("own")


def excess(values: Column, lower: Column, upper: Column) -> Column:
    """The sum of squares by which values lie outside lower .. upper: the Keogh bound."""
    over = F.zip_with(values, upper, lambda v, u: F.greatest(v - u, F.lit(0.0)))
    under = F.zip_with(values, lower, lambda v, lo: F.greatest(lo - v, F.lit(0.0)))
    return F.aggregate(F.zip_with(over, under, lambda x, y: x * x + y * y), F.lit(0.0), lambda s, x: s + x)
