"""The index: for each window length, the buckets of sliding means and the intervals of
positions that fall into each; and its statistics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.functions.windows import sliding
from wavesift.model import WINDOWS

INDEX = "series_id string, w int, key long, lo double, hi double, left long, right long"


def bucketed(windows: DataFrame, d: float, scale: int | None = None) -> DataFrame:
    """windows with `key`, the bucket [key d, (key + 1) d) of their mean; exact with scale."""
    exact = F.col("total") / (F.col("w") * F.lit(float(round(d * scale)))) if scale else F.col("mean") / F.lit(d)
    return windows.withColumn("key", F.floor(exact).cast("long"))


def islands(windows: DataFrame) -> DataFrame:
    """(series_id, w, key, left, right): runs of consecutive positions of one bucket.

    Runs are found inside the spans that the windows were computed in, without a shuffle, and
    only runs, not points, travel to be joined where they go on in the next span."""
    own = Window.partitionBy("series_id", "span_no", "w").orderBy("pos")
    new = F.coalesce(F.col("key") != F.lag("key").over(own), F.lit(True)).cast("int")
    runs = windows.withColumn("run", F.sum(new).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("series_id", "span_no", "w", "run", "key").agg(F.min("pos").alias("left"), F.max("pos").alias("right"))
    return coalesce(runs.select("series_id", "w", "key", "left", "right"), ["series_id", "w", "key"])


def coalesce(intervals: DataFrame, by: list[str], gap: int = 1, block: int = 1 << 20) -> DataFrame:
    """The union of intervals (by, left, right): overlapping ones, and such as follow within
    `gap`, 1 at least, become one.

    Intervals are cut to blocks of positions and each block is merged on its own; only pieces at
    the ends of blocks, two a block at most and far fewer than positions, meet in one task."""

    def merge(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("left", "right")
        reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.coalesce(F.col("left") > reach + gap, F.lit(True)).cast("int")
        marked = rows.withColumn("_n", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "_n").agg(F.min("left").alias("left"), F.max("right").alias("right")).drop("_n")

    first, last = F.col("_block") * block, F.col("_block") * block + block - 1
    cut = intervals.withColumn("_block", F.explode(F.sequence(F.floor(F.col("left") / block), F.floor(F.col("right") / block))))
    cut = cut.withColumn("left", F.greatest("left", first)).withColumn("right", F.least("right", last))
    own = merge(cut, [*by, "_block"])
    at_end = (F.col("left") < first + gap) | (F.col("right") > last - gap)
    return own.where(~at_end).drop("_block").unionByName(merge(own.where(at_end).drop("_block"), by))


def split(intervals: DataFrame, most: int = 255) -> DataFrame:
    """Intervals cut to `most` positions, as formats with a byte for a length need them."""
    at = F.explode(F.sequence("left", "right", F.lit(most).cast("long")))
    return intervals.withColumn("_at", at).withColumn("right", F.least("right", F.col("_at") + most - 1)).withColumn("left", F.col("_at")).drop("_at")


def build(series: DataFrame, widths: tuple[int, ...] = WINDOWS, d: float = 0.5, scale: int | None = None) -> DataFrame:
    """INDEX of all widths in one job."""
    got = islands(bucketed(sliding(series, widths, scale), d, scale))
    return got.select("series_id", F.col("w").cast("int").alias("w"), "key", (F.col("key") * d).alias("lo"), ((F.col("key") + 1) * d).alias("hi"), "left", "right")


def statistics(index: DataFrame) -> DataFrame:
    """(series_id, w, key, lo, hi, n_int, n_off, cum_int, cum_off): intervals and positions of
    each bucket, and their running sums by key."""
    rows = index.groupBy("series_id", "w", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n_int"), F.sum(F.col("right") - F.col("left") + 1).alias("n_off"))
    w = Window.partitionBy("series_id", "w").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", F.sum("n_int").over(w).alias("cum_int"), F.sum("n_off").over(w).alias("cum_off"))


def row_summary(meta: DataFrame) -> DataFrame:
    """(series_id, w, rows, average, least, most) intervals of a bucket."""
    return meta.groupBy("series_id", "w").agg(F.count("*").alias("n_rows"), F.avg("n_int").alias("average"), F.min("n_int").alias("least"), F.max("n_int").alias("most"))


def merge_rows(index: DataFrame, few: float = 1.2, gain: float = 0.8) -> DataFrame:
    """INDEX with buckets of few intervals merged into the one above, from the top down: when a
    bucket has under few x the average number, and the union has under gain x the intervals of
    both. A merged bucket has the least key and the greatest upper edge. Only pruning changes.

    The fold goes over statistics: the buckets' numbers, and how often an interval of one
    bucket goes on in another, whose intervals the union then joins; these are far fewer than
    intervals, and each series and width is a group of its own."""
    meta = statistics(index).select("series_id", "w", "key", "n_int", F.lit(None).cast("long").alias("other"), F.lit(0).cast("long").alias("joins"))
    nxt = index.select("series_id", "w", F.col("key").alias("other"), (F.col("left") - 1).alias("right"))
    touch = index.join(nxt, ["series_id", "w", "right"]).where("key != other")
    touch = touch.groupBy("series_id", "w", F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other")).agg(F.count("*").alias("joins"))
    both = meta.unionByName(touch.select("series_id", "w", "key", F.lit(None).cast("long").alias("n_int"), "other", "joins"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows[rows.other.isna()].set_index("key").n_int.sort_index(ascending=False)
        joins: dict[int, list] = {}
        for k, o, j in rows[rows.other.notna()][["key", "other", "joins"]].itertuples(index=False):
            joins.setdefault(int(k), []).append((int(o), int(j)))
        average, out, group, size = n.mean(), [], None, 0
        for key, own in n.items():
            if group is not None:
                shared = sum(j for o, j in joins.get(int(key), ()) if o <= top)
                union = size + own - shared
                if own < few * average and union < gain * (size + own):
                    group, size = [*group, key], union
                    continue
                out += [(k, min(group)) for k in group]
            group, size, top = [key], own, int(key)
        out += [(k, min(group)) for k in group or ()]
        got = pd.DataFrame(out, columns=["key", "to"])
        got["series_id"], got["w"] = rows.series_id.iloc[0], rows.w.iloc[0]
        return got[["series_id", "w", "key", "to"]]

    to = both.groupBy("series_id", "w").applyInPandas(fold, "series_id string, w int, key long, to long")
    moved = index.join(to, ["series_id", "w", "key"])
    edges = moved.groupBy("series_id", "w", "to").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    union = coalesce(moved.select("series_id", "w", "to", "left", "right"), ["series_id", "w", "to"])
    return union.join(edges, ["series_id", "w", "to"]).select("series_id", "w", F.col("to").alias("key"), "lo", "hi", "left", "right")


def save(index: DataFrame, path: str) -> None:
    """By width, in ranges of keys sorted by key: a probe reads the row groups it needs."""
    parted = index.repartitionByRange("w", "series_id", "key").sortWithinPartitions("w", "series_id", "key", "left")
    parted.write.mode("overwrite").partitionBy("w").parquet(f"{path}/index")
    saved = load(index.sparkSession, path)[0]
    statistics(saved).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    index = spark.read.parquet(f"{path}/index")
    try:
        return index, spark.read.parquet(f"{path}/meta")
    except Exception as e:  # not saved yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return index, None


def read_keys(index: DataFrame, w: int, lo: int, hi: int, series_id: str = "s") -> DataFrame:
    """The rows of a range of keys, both ends included; pushed down to a saved index."""
    return index.where((F.col("w") == w) & (F.col("series_id") == series_id) & F.col("key").between(lo, hi))


def stitch(parts: list[DataFrame]) -> DataFrame:
    """Statistics of parts of an index, made apart, as those of the whole."""
    first, *rest = parts
    for p, _ in zip(rest, count(), strict=False):
        first = first.unionByName(p)
    rows = first.groupBy("series_id", "w", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n_int").alias("n_int"), F.sum("n_off").alias("n_off"))
    w = Window.partitionBy("series_id", "w").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", F.sum("n_int").over(w).alias("cum_int"), F.sum("n_off").over(w).alias("cum_off"))


def decode_compact(data: bytes) -> Iterator[tuple[int, int]]:
    """Intervals of a compact row, for importers: blocks of a big-endian int32 left end, a
    count byte and the first length, then pairs of a gap and a length; bytes less 128."""
    at = 0
    while at < len(data):
        left = int.from_bytes(data[at : at + 4], "big", signed=True)
        n = int.from_bytes(data[at + 4 : at + 5], "big", signed=True) + 128
        length = int.from_bytes(data[at + 5 : at + 6], "big", signed=True) + 128
        at += 6
        yield left, left + length
        right = left + length
        for _ in range(n):
            gap, length = (int.from_bytes(data[at + i : at + i + 1], "big", signed=True) + 128 for i in (0, 1))
            at += 2
            left, right = right + gap, right + gap + length
            yield left, right
