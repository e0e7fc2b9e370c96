"""Embedding near-duplicates by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.llm.common import join_unique, materialize
from wavesift.llm.components import connected_components


def collision_chance(distance: float, width: float, window: float, grids: int) -> float:
    """The chance that two points at this distance fall into one cell of every grid and within
    the window of the sorted projection, over Gaussian directions and random grid offsets."""
    r = width / distance
    cell = 1 - (1 - erf(r / sqrt(2))) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))
    return cell**grids * erf(window / distance / sqrt(2))


def calibrated_count(tables: int, chance: float, recall: float) -> int:
    """The greatest count that a pair reaches with probability `recall` at least; 1 if none."""
    below, count = 0.0, 0
    for c in range(tables + 1):
        below += comb(tables, c) * chance**c * (1 - chance) ** (tables - c)
        if 1 - below < recall:
            break
        count = c + 1
    return max(1, count)


def _unit(rows: pa.Array) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(dim: int, tables: int, grids: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((tables, grids + 1, dim)), rng.uniform(0, width, (tables, grids))


def _project(tables: int, grids: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            for dim in np.unique(sizes).tolist():  # vectors of other lengths have other directions and so no link
                own = b.filter(pa.array(sizes == dim))
                to, shift = _directions(dim, tables, grids, width, seed)
                for k in range(0, own.num_rows, 2048):
                    x = _unit(own.column(1).slice(k, 2048))
                    cid = own.column(0).slice(k, 2048).to_numpy()
                    for t in range(tables):
                        p = x @ to[t].T
                        cells = np.floor((p[:, :grids] + shift[t]) / width).astype(np.int64)
                        key = np.full(len(x), dim * 1_000_003 + t, dtype=np.uint64)
                        for c in cells.T:
                            key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(29)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key.view(np.int64)), pa.array(p[:, grids]), pa.array(cid)], ["t", "cell", "at", "cid"])

    return run


def _collide(window: float):
    """Pairs within the window in rows (t, cell, duo, at, part, cid) sorted by the first four;
    of two different parts if duo stands for two."""

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, cell, duo, at, part, cid = cols
        n = len(t)
        new = np.ones(n, dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (cell[1:] != cell[:-1]) | (duo[1:] != duo[:-1])
        group = np.cumsum(new) - 1
        line = group * (4 * window + np.ptp(at)) + at - at.min()
        right = np.searchsorted(line, line + window, side="right")
        count = right - np.arange(n) - 1
        for lo in range(0, n, 1024):  # so many pairs at once, for bounded memory
            c = count[lo : lo + 1024]
            total = int(c.sum())
            if not total:
                continue
            i = np.repeat(np.arange(lo, lo + len(c)), c)
            j = i + 1 + np.arange(total) - np.repeat(np.cumsum(c) - c, c)
            ok = (duo[i] < 0) | (part[i] != part[j])
            i, j = i[ok], j[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from emit([c[:cut] for c in cols])
            left = [c[cut:] for c in cols]
        if left is not None and len(left[0]) > 1:
            yield from emit(left)

    return run


#: Full cells up to this number are broadcast; more are joined by a shuffle.
FULL_CELLS = 50_000


def collisions(classes: DataFrame, window: float, tables: int, grids: int, width: float, seed: int, chunk: int = 2048) -> DataFrame:
    """(a, b, n): pairs of classes (cid, embedding) and the tables in which they collide."""
    rows = classes.select("cid", "embedding").mapInArrow(_project(tables, grids, width, seed), "t int, cell long, at double, cid long")
    rows = materialize(rows, "projections")
    full = rows.groupBy("t", "cell").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    full = materialize(full, "full-cells")  # counted before anything is dealt out, so a full cell's rows stay spread
    if full.count() <= FULL_CELLS:
        full = F.broadcast(full)
    few = rows.join(full.select("t", "cell"), ["t", "cell"], "left_anti").select("t", "cell", F.lit(-1).alias("duo"), "at", F.lit(0).alias("part"), "cid")
    few = few.repartition("t", "cell").sortWithinPartitions("t", "cell", "at").mapInArrow(_collide(window), "a long, b long")
    # a fuller cell is dealt out: every two of its chunks meet in a group of their own
    parts = F.ceil(F.col("n") / F.lit(chunk / 2)).cast("int")
    many = rows.join(full, ["t", "cell"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    duos = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.when(o == F.col("part"), -1 - o).otherwise(F.least(o, F.col("part")) * F.col("parts") + F.greatest(o, F.col("part"))),
    )
    many = many.select("t", "cell", F.explode(duos.cast("array<int>")).alias("duo"), "at", "part", "cid")
    many = many.repartition("t", "cell", "duo").sortWithinPartitions("t", "cell", "duo", "at").mapInArrow(_collide(window), "a long, b long")
    return few.unionByName(many).groupBy("a", "b").agg(F.count("*").alias("n"))


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = np.asarray(b.column(2).value_lengths()) == np.asarray(b.column(3).value_lengths())
            b = b.filter(pa.array(same))
            sizes = np.asarray(b.column(2).value_lengths())
            for dim in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == dim))
                for k in range(0, own.num_rows, 8192):
                    s = own.slice(k, 8192)
                    x, y = (s.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(s), -1) for i in (2, 3))
                    c = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    yield pa.RecordBatch.from_arrays([*s.columns[:2], pa.array(c)], ["a", "b", "cosine"]).filter(pa.array(c >= cosine))

    return run


def classes_of(vectors: DataFrame) -> DataFrame:
    """(embedding, low, copies, cid): the distinct usable vectors, with the smallest vec_id and
    the number of rows of each. Null, empty and zero vectors, and such as hold null, NaN or
    infinite components, are none."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.where(e.isNotNull() & ~bad & F.exists(e, lambda v: v != 0))
    found = usable.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    return materialize(found.withColumn("cid", F.monotonically_increasing_id()), "classes")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, tables: int = 96, grids: int = 14, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Equal vectors are one class. In each of `tables`, the classes are sorted by the cells of
    `grids` projections, six link distances wide, and then by one more projection; a class
    collides with those in its cells and within its window there. Pairs that collide in so
    many tables as a pair at the very threshold does with probability `recall` are verified in
    double precision; nearer pairs collide more. Unusable vectors have no links and are their
    own component. A null vec_id never names a component; such a row isn't kept.
    """
    r = sqrt(2 - 2 * cosine)
    width, window = 6 * r, 2.5 * r
    least = calibrated_count(tables, collision_chance(r, width, window, grids), recall)
    classes = classes_of(vectors)
    pairs = collisions(classes, window, tables, grids, width, seed).where(F.col("n") >= least)
    x = classes.select(F.col("cid").alias("a"), F.col("embedding").alias("x"))
    y = classes.select(F.col("cid").alias("b"), F.col("embedding").alias("y"))
    pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    links = materialize(pairs.mapInArrow(_verify(cosine), "a long, b long, cosine double"), "links")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("cid").alias("b"), F.col("copies").alias("m"))
    linked = both.join(size, "b").groupBy("a").agg(F.sum("m").alias("more"))
    comp = connected_components(links.select("a", "b")).select(F.col("node").alias("cid"), "component")
    of = classes.join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(low, "component").join(linked, F.col("cid") == F.col("a"), "left")
    of = of.select("embedding", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("found"), F.col("copies").alias("_n"))
    out = join_unique(vectors.select("vec_id", "embedding"), of, "embedding", vectors.count(), how="left")
    own = F.when(F.col("found").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
