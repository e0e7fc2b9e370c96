"""What is done with answers: order, the best, removal of overlaps, statistics."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block, in which runs of answers are found.
BLOCK = 1 << 20


def ordered(answers: DataFrame) -> DataFrame:
    return answers.orderBy("dist", "series_id", "pos")


def top_k(answers: DataFrame, k: int) -> DataFrame:
    """The k nearest, ties to the first position."""
    return ordered(answers).limit(k)


def best(answers: DataFrame) -> DataFrame:
    return top_k(answers, 1)


def exists(answers: DataFrame) -> bool:
    return not answers.isEmpty()


def without_overlap(answers: DataFrame, m: int) -> DataFrame:
    """Greedy: the nearest answer stays, and all within m - 1 positions of one that stays go.

    Answers m or more apart from the next on a side can't touch, so each run of answers with
    smaller gaps is settled on its own, and a run is a group of its own task. Runs are found
    inside blocks of positions; only a row of each block is put in order for a whole series."""
    size = max(m, BLOCK)
    own = Window.partitionBy("series_id", "_block").orderBy("pos")
    before = Window.partitionBy("series_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    a = answers.select("series_id", "pos", "dist", F.floor(F.col("pos") / size).alias("_block"))
    ends = a.groupBy("series_id", "_block").agg(F.max("pos").alias("_end"))
    a = a.join(ends.select("series_id", "_block", F.max("_end").over(before).alias("_before")), ["series_id", "_block"])
    new = F.coalesce(F.col("pos") - F.coalesce(F.lag("pos").over(own), "_before") >= m, F.lit(True))
    a = a.withColumn("_first", F.when(new, F.col("pos")))  # runs are named by their first positions
    firsts = a.groupBy("series_id", "_block").agg(F.max("_first").alias("_last"))
    a = a.join(firsts.select("series_id", "_block", F.max("_last").over(before).alias("_open")), ["series_id", "_block"])
    run = F.coalesce(F.max("_first").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_open")
    runs = a.select("series_id", "pos", "dist", run.alias("run"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left, insort

        kept: list[int] = []
        out = []
        for r in rows.sort_values(["dist", "pos"]).itertuples(index=False):
            i = bisect_left(kept, r.pos)
            if (i == 0 or r.pos - kept[i - 1] >= m) and (i == len(kept) or kept[i] - r.pos >= m):
                insort(kept, r.pos)
                out.append((r.series_id, r.pos, r.dist))
        return pd.DataFrame(out, columns=["series_id", "pos", "dist"])

    return runs.groupBy("series_id", "run").applyInPandas(settle, "series_id string, pos long, dist double")


def summary(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """(by, n, total, average, least, most, last) of a column: last by `order`."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, order).alias("last"),
    )


def by_selectivity(runs: DataFrame, n: int, value: str, order: str) -> DataFrame:
    """Statistics of runs (answers, value) by decade: -floor(log10(answers / n))."""
    decade = (-F.floor(F.log10(F.greatest(F.col("answers"), F.lit(1)) / F.lit(float(n))))).cast("int")
    return summary(runs.withColumn("decade", decade), value, ["decade"], order)


def workload(spark, offsets: list[int], lengths: list[int], epsilons: list[float], alphas: list[float] = (1.0,), betas: list[float] = (0.0,), share: float = 0.05) -> DataFrame:
    """(offset, m, eps, alpha, beta, rho): every combination of some parameters, a small table."""
    rows = [(o, m, float(e), float(a), float(b), int(share * m)) for o, m, e, a, b in product(offsets, lengths, epsilons, alphas, betas)]
    return spark.createDataFrame(rows, "offset long, m int, eps double, alpha double, beta double, rho int").coalesce(1)


def write_metrics(rows: DataFrame, path: str) -> None:
    """Statistics of runs as CSV files with a header, added to those there."""
    rows.write.mode("append").option("header", True).csv(path)
