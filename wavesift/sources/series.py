"""Series as tables (series_id, pos, value), positions from 1 and without gaps, and as stored
chunks; importers and exporters of the older file formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.model import CHUNK
from wavesift.sources.scratch import materialize


def from_table(df: DataFrame, value: str | Column, pos: str | Column, series: str | Column | None = None) -> DataFrame:
    """A series of a table that has its positions."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    name = F.lit("s") if series is None else col(series).cast("string")
    return df.select(name.alias("series_id"), col(pos).cast("long").alias("pos"), col(value).cast("double").alias("value"))


def numbered(df: DataFrame, value: str, order: list[str], series: str | None = None) -> DataFrame:
    """A series of a table that has only an order. With no series column the whole table is
    one series: it is range-partitioned by the order, numbered inside each partition and
    shifted by the sizes of those before, so no task sees it all. The numbered partitions are
    written once: sizes and rows are those of the same partitions, since ranges are sampled
    and a second shuffle could draw others."""
    if series:
        w = Window.partitionBy(series).orderBy(*order)
        return from_table(df.withColumn("_pos", F.row_number().over(w)), value, "_pos", series)
    parted = df.select(F.col(value).cast("double").alias("_value"), *order).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    local = materialize(parted.select("_value", F.spark_partition_id().alias("_part"), at.alias("_at")), "numbered")
    sizes = local.groupBy("_part").agg(F.count("*").alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return from_table(local.join(sizes.select("_part", before.alias("_before")), "_part"), "_value", F.col("_before") + F.col("_at") + 1)


def running_sum(series: DataFrame, chunk: int = 8192) -> DataFrame:
    """The running sum of a series, by chunks: sums inside each, shifted by the totals before."""
    c = series.withColumn("_chunk", F.floor((F.col("pos") - 1) / chunk))
    totals = c.groupBy("series_id", "_chunk").agg(F.sum("value").alias("_sum"))
    w = Window.partitionBy("series_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("series_id", "_chunk", F.coalesce(F.sum("_sum").over(w), F.lit(0.0)).alias("_before"))
    inside = F.sum("value").over(Window.partitionBy("series_id", "_chunk").orderBy("pos"))
    c = c.withColumn("_in", inside).join(totals, ["series_id", "_chunk"])
    return c.select("series_id", "pos", (F.col("_before") + F.col("_in")).alias("value"))


def to_chunks(series: DataFrame, size: int = CHUNK) -> DataFrame:
    """(series_id, chunk, start, vals): rows of `size` consecutive values, the stored form."""
    c = series.withColumn("chunk", F.floor((F.col("pos") - 1) / size).cast("long"))
    got = c.groupBy("series_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return got.select("series_id", "chunk", (F.col("chunk") * size + 1).alias("start"), F.col("p.value").alias("vals"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    at = chunks.select("series_id", "start", F.posexplode("vals").alias("i", "value"))
    return at.select("series_id", (F.col("start") + F.col("i")).alias("pos"), "value")


def with_halo(chunks: DataFrame, size: int, more: int) -> DataFrame:
    """chunks with their vals extended by the `more` values that follow, if there are so many.

    Each chunk goes to itself and, cut to what is needed, to the chunks before it whose halo it
    is in: an equal join's worth of shuffle, with more / size of the data as its overhead."""
    reach = -(-more // size)
    own = chunks.select("series_id", "chunk", "start", "vals")
    if not more:
        return own
    back = F.explode(F.sequence(F.lit(0), F.least(F.lit(reach).cast("long"), F.col("chunk")))).alias("back")
    sent = own.select("*", back)
    need = F.least(F.lit(more) - (F.col("back") - 1) * size, F.lit(size)).cast("int")
    vals = F.when(F.col("back") == 0, F.col("vals")).otherwise(F.slice("vals", 1, F.greatest(need, F.lit(0))))
    sent = sent.select("series_id", (F.col("chunk") - F.col("back")).alias("chunk"), "back", vals.alias("vals"))
    got = sent.groupBy("series_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("back", "vals"))).alias("p"))
    return got.select("series_id", "chunk", (F.col("chunk") * size + 1).alias("start"), F.flatten("p.vals").alias("vals"))


def read_range(series: DataFrame, left: int, length: int, series_id: str = "s") -> DataFrame:
    """Values left .. left + length - 1; a filter that reaches the scan of a stored series."""
    if left < 1 or length < 1:
        raise ValueError("a range starts at 1 or later and has a value at least")
    return series.where((F.col("series_id") == series_id) & F.col("pos").between(left, left + length - 1))


def fetch(series: DataFrame, offset: int, m: int, series_id: str = "s") -> np.ndarray:
    """The m values from offset on, to the driver: a query. Fails if there are fewer."""
    rows = read_range(series, offset, m, series_id).orderBy("pos").select("value").collect()
    if len(rows) < m:
        raise ValueError(f"no {m} values from {offset} on in series {series_id}")
    return np.array([r.value for r in rows])


def write(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The stored form, sorted by position in files of position ranges, for pruned reads."""
    parted = series.repartitionByRange("series_id", "pos").sortWithinPartitions("series_id", "pos")
    parted.write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# CSV: a value a line


def from_csv(spark: SparkSession, path: str, series: str = "s") -> DataFrame:
    """One value a line, in the order of the lines of the files in the order of their names.

    Spark deals files and their blocks to tasks by size, so a line's place is its file, its
    block there and, since a task reads a block in order, a number that grows within the task."""
    rows = spark.read.schema("value double").csv(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return numbered(rows.withColumn("_id", F.monotonically_increasing_id()), "value", ["_file", "_start", "_id"]).withColumn("series_id", F.lit(series))


# raw files of big-endian float64 or float32


def from_binary(spark: SparkSession, path: str, kind: str = ">f8") -> DataFrame:
    """Files of numbers without a header; a series each, named by its file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(data.as_py(), kind).astype(np.float64)
                for k in range(0, len(v), 65536):
                    some = v[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(some)), pa.array(np.arange(k + 1, k + 1 + len(some))), pa.array(some)], ["series_id", "pos", "value"])

    return files.mapInArrow(run, "series_id string, pos long, value double")


def to_binary_rows(series: DataFrame, size: int = CHUNK, kind: str = ">f8") -> DataFrame:
    """(series_id, key, data): chunks as blobs under 13-digit keys, as key-value stores have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ends = b.column(2).values.to_numpy(zero_copy_only=False), b.column(2).offsets.to_numpy()
            data = [v[i:j].astype(kind).tobytes() for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["series_id", "key", "data"])

    chunks = to_chunks(series, size).select("series_id", F.lpad(F.col("start").cast("string"), 13, "0").alias("key"), "vals")
    return chunks.mapInArrow(run, "series_id string, key string, data binary")


def export_query(values: np.ndarray, eps: float) -> bytes:
    """eps as float32, the length as int32, the values: big-endian."""
    return np.array([eps], ">f4").tobytes() + np.array([len(values)], ">i4").tobytes() + np.asarray(values, ">f8").tobytes()


def read_workload(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Workload files without a header: a column that isn't used, offset, length, eps, and for
    cNSM alpha and beta. rho is 5 % of the length where distances are warped."""
    names = ["unused", "m_offset", "m", "eps"] + (["alpha", "beta"] if kind.startswith("cNSM") else [])
    schema = ", ".join(f"{n} {'string' if n == 'unused' else 'double'}" for n in names)
    got = spark.read.schema(schema).csv(path)
    out = got.select(F.col("m_offset").cast("long").alias("offset"), F.col("m").cast("int").alias("m"), "eps", *names[4:])
    return out.withColumn("rho", F.floor(0.05 * F.col("m")).cast("int")) if kind.endswith("DTW") else out


def decode_intervals(data: bytes) -> list[tuple[int, int]]:
    """Intervals of a plain row: big-endian int pairs (left, right)."""
    return [tuple(x) for x in np.frombuffer(data, ">i4").reshape(-1, 2).tolist()]


def encode_intervals(intervals: list[tuple[int, int]]) -> bytes:
    return np.array(intervals, ">i4").reshape(-1, 2).tobytes()
