"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hide(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[str]]:
    """docs with all columns but `keep` under names that clash with nothing, and these names."""
    names = [c if c in keep else f"other{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset and all
    runs on this machine, as in tests, a temporary folder is made and kept for the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wavesift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/wavesift-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: this cuts the lineage
    with a table that survives the loss of executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wavesift_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by materialize()."""
    path = getattr(df, "_wavesift_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def id_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def sums_before(df: DataFrame, number: str, order: list[str], value: str, out: str, block: int = 1024) -> DataFrame:
    """df with `out`, the sum of `value` over all rows before each in `order`, which begins with
    `number`, a whole number from 0. Rows are summed by blocks of `block` numbers and these in
    one task, so that task has a `block`-th of the numbers as rows."""
    b = df.withColumn("_block", F.floor(F.col(number) / block))
    before = lambda col, w: F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = b.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", before("_sum", Window.orderBy("_block")).alias("_before"))
    inside = before(value, Window.partitionBy("_block").orderBy(*order))
    return b.withColumn("_in", inside).join(totals, "_block").withColumn(out, F.col("_before") + F.col("_in")).drop("_block", "_in", "_before")


def join_unique(rows: DataFrame, unique: DataFrame, key: str, total: int, count: str = "_n", how: str = "inner") -> DataFrame:
    """rows joined with `unique`, which has each key once and in `count` how many rows have it.

    Keys of over a thousandth of all `total` rows, a thousand at most, are broadcast, so a hot
    key's rows stay where they are; the rest is shuffled. how: inner or left."""
    hot = unique.where(F.col(count) > F.lit(max(1, total // 1000)))
    most = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(unique.where(F.col(count) <= F.lit(max(1, total // 1000))), key, how)
    return most.unionByName(rows.join(F.broadcast(hot), key)).drop(count)
