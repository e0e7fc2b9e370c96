"""Seeded synthetic series. The same seed and length give the same values at any partitioning:
noise comes from hashes of the position."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.sources.series import running_sum, to_chunks


def uniform(lo: float, hi: float, seed: int, *key: Column | str) -> Column:
    """A uniform value in [lo, hi), a function of the seed and the key."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return lo + (hi - lo) * u


def normal(mean: Column | float, deviation: Column | float, seed: int, *key: Column | str) -> Column:
    r = F.sqrt(-2.0 * F.log(1.0 - uniform(0, 1, seed, *key)))
    return F.lit(mean) + F.lit(deviation) * r * F.cos(2 * pi * uniform(0, 1, seed + 1, *key))


def _positions(spark: SparkSession, n: int, series: str) -> DataFrame:
    return spark.range(1, n + 1).select(F.lit(series).alias("series_id"), F.col("id").alias("pos"))


def random_walk(spark: SparkSession, n: int, start=(-5.0, 5.0), step=(0.0, 1.0), seed: int = 1, series: str = "walk") -> DataFrame:
    """From a uniform start on, steps of a random sign and a uniform size."""
    sign = F.when(uniform(0, 1, seed, "pos") < 0.5, -1.0).otherwise(1.0)
    move = F.when(F.col("pos") == 1, uniform(*start, seed + 2, F.lit(0))).otherwise(sign * uniform(*step, seed + 1, "pos"))
    return running_sum(_positions(spark, n, series).withColumn("value", move))


def gaussian(spark: SparkSession, n: int, mean=(-5.0, 5.0), deviation=(0.0, 2.0), seed: int = 1, series: str = "gauss") -> DataFrame:
    """Normal values of one uniform mean and one uniform deviation."""
    value = normal(uniform(*mean, seed, F.lit(0)), uniform(*deviation, seed + 1, F.lit(0)), seed + 2, "pos")
    return _positions(spark, n, series).withColumn("value", value)


def _sine(pos: Column, length: Column, frequency, amplitude, mean, seed: int, *key: Column | str) -> Column:
    a = uniform(*amplitude, seed, *key)
    phase = uniform(0, 2 * pi, seed + 1, *key)
    clean = uniform(*mean, seed + 2, *key) + a * F.sin(2 * pi * pos * uniform(*frequency, seed + 3, *key) / length + phase)
    return clean + a * uniform(-0.05, 0.05, seed + 4, *key, pos)


def sine(spark: SparkSession, n: int, frequency=(2.0, 10.0), amplitude=(2.0, 10.0), mean=(-5.0, 5.0), seed: int = 1, series: str = "sine") -> DataFrame:
    """So many waves over the length, with noise of a twentieth of the amplitude."""
    return _positions(spark, n, series).withColumn("value", _sine(F.col("pos"), F.lit(float(n)), frequency, amplitude, mean, seed, F.lit(0)))


def mixed(spark: SparkSession, n: int, seed: int = 1, series: str = "mixed") -> DataFrame:
    """Segments of a hundredth of the length, 1000 points at least and each cut at a random
    place, that are by chance a walk, normal values or a sine."""
    size = max(1000, n // 100)
    cut = uniform(0.2, 1.0, seed, F.floor((F.col("pos") - 1) / size))
    p = _positions(spark, n, series).withColumn("_block", F.floor((F.col("pos") - 1) / size))
    p = p.withColumn("_seg", 2 * F.col("_block") + F.when((F.col("pos") - 1) % size < cut * size, 0).otherwise(1))
    kind = F.floor(uniform(0, 3, seed + 1, "_seg"))
    step = F.when(uniform(0, 1, seed + 2, "pos") < 0.5, -1.0).otherwise(1.0) * uniform(0, 1, seed + 3, "pos")
    walk = running_sum(p.select(F.concat_ws(":", "series_id", "_seg").alias("series_id"), (F.col("pos") - F.col("_block") * size).alias("pos"), step.alias("value")), size)
    walk = walk.select(F.split_part("series_id", F.lit(":"), F.lit(2)).cast("long").alias("_seg"), F.col("pos").alias("_at"), F.col("value").alias("_walk"))
    got = p.withColumn("_at", F.col("pos") - F.col("_block") * size).join(walk, ["_seg", "_at"])
    value = (
        F.when(kind == 0, uniform(-5, 5, seed + 4, "_seg") + F.col("_walk"))
        .when(kind == 1, normal(uniform(-5, 5, seed + 5, "_seg"), uniform(0, 2, seed + 6, "_seg"), seed + 7, "pos"))
        .otherwise(_sine(F.col("_at"), F.lit(float(size)), (2, 10), (2, 10), (-5, 5), seed + 9, "_seg"))
    )
    return got.select("series_id", "pos", value.alias("value"))


def load(series: DataFrame, path: str) -> None:
    """A generated series into its stored chunks."""
    to_chunks(series).repartitionByRange("series_id", "chunk").sortWithinPartitions("series_id", "chunk").write.mode("overwrite").parquet(path)
