"""Packing into fixed windows: bounded-space best fit per partition, then merged leftovers."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavesift.llm.common import materialize, sums_before
from wavesift.llm.tokens import ChunkEncoder

SHAPE = "doc_id {0}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """A fixed number of open windows. A piece goes to the window that it fills best; when
    none has room, the fullest is emitted, topped up from the piece if its gap is worth a cut."""

    def __init__(self, size: int, windows: int, min_cut: int):
        self.size, self.windows, self.min_cut = size, windows, min_cut
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def _put(self, at: int, room: int, piece: tuple) -> list:
        """Adds a piece to the window at place `at` of free; gives the window if it is full."""
        window = self.free.pop(at)[1]
        self.held[window].append(piece)
        if room == piece[2]:
            return [self.held.pop(window)]
        insort(self.free, (room - piece[2], window))
        return []

    def add(self, doc: int, length: int) -> list[list[tuple[int, int, int]]]:
        """Places a document of `length` ids; gives the windows that it completes, as lists
        of (doc, start, length)."""
        out, start = [], 0
        while length - start >= self.size:
            out.append([(doc, start, self.size)])
            start += self.size
        while start < length:
            rest = length - start
            at = bisect_left(self.free, (rest, -1))
            if at < len(self.free):
                return out + self._put(at, self.free[at][0], (doc, start, rest))
            if len(self.free) < self.windows:
                self.held[self.next] = [(doc, start, rest)]
                insort(self.free, (self.size - rest, self.next))
                self.next += 1
                return out
            room, window = self.free[0]
            if room >= self.min_cut:
                out += self._put(0, room, (doc, start, room))
                start += room
            else:
                self.free.pop(0)
                out.append(self.held.pop(window))
        return out

    def left(self) -> list[list[tuple[int, int, int]]]:
        return [self.held[w] for _, w in self.free]


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, windows: int = 64, min_cut: int = 16) -> DataFrame:
    """The pieces of sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian unsigned 32-bit integers), from docs (doc_id, text).

    A document's ids are those of its text and end_id; null and empty texts give end_id alone.
    Each partition packs its rows in their order, with no shuffle: documents of a window or
    more give whole windows, the rest goes best-fit to one of `windows` open ones, and an
    emitted window lacks under min_cut ids. Windows still open at a partition's end are laid
    end to end over all partitions and cut every `size` ids; what remains at the very end is
    cut to powers of two, so it needs no padding. Repeated rows and ids are packed as they
    come; null ids stay null; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = ChunkEncoder.of(vocabulary), Packer(size, windows, min_cut)
        part, n, doc = TaskContext.get().partitionId() << 32, 0, 0
        held: dict[int, list] = {}  # doc number: doc_id, its bytes, ids not yet emitted
        rows: list[tuple] = []
        weight = 0

        def emit(window: list, whole: bool) -> None:
            nonlocal n, weight
            offset = 0
            for d, start, length in window:
                x = held[d]
                data = x[1][4 * start : 4 * (start + length)]
                rows.append((x[0], start, length, len(x[1]) // 4, part + n, offset, data, part >> 32, whole))
                offset += length
                weight += length
                x[2] -= length
                if not x[2]:
                    del held[d]
            n += 1

        def batch() -> pa.RecordBatch:
            nonlocal weight
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            weight = 0
            return out

        names, kinds = [], []
        for b in batches:
            if not names:
                names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "part", "whole"]
                kinds = [b.schema.field(0).type, *[pa.int64()] * 5, pa.binary(), pa.int64(), pa.bool_()]
            for begin, end, flat, lengths in encoder.slices(b.column(1)):
                ends = np.cumsum(lengths)
                flat = np.insert(flat, ends, end_id).astype("<u4").tobytes()
                ends += np.arange(1, len(ends) + 1)
                for i, n_ids, stop in zip(b.column(0).slice(begin, end - begin).to_pylist(), (lengths + 1).tolist(), ends.tolist(), strict=True):
                    held[doc] = [i, flat[4 * (stop - n_ids) : 4 * stop], n_ids]
                    for window in packer.add(doc, n_ids):
                        emit(window, True)
                    doc += 1
                    if weight > 1_000_000:
                        yield batch()
        for window in packer.left():
            emit(window, False)
        if rows:
            yield batch()

    packed = docs.select("doc_id", "text").mapInArrow(run, SHAPE.format(kind) + ", part long, whole boolean")
    packed = materialize(packed, "packed")
    out = [c for c in packed.columns if c not in ("part", "whole")]
    done, left = packed.where("whole").select(out), packed.where("not whole")

    parts = left.groupBy("part").agg(F.sum("length").alias("n"))
    parts = materialize(sums_before(parts, "part", ["part"], "n", "base"), "left")  # a row a partition
    total = parts.agg(F.sum("n")).first()[0] or 0
    ends, at = [], total // size * size
    while at < total:  # the powers of two that make up the rest, largest first
        step = 1 << ((total - at).bit_length() - 1)
        ends.append((at, at + step))
        at += step
    w = Window.partitionBy("part").orderBy("sequence_id", "offset").rowsBetween(Window.unboundedPreceding, -1)
    g = left.join(parts.select("part", "base"), "part").withColumn("g", F.col("base") + F.coalesce(F.sum("length").over(w), F.lit(0)))
    last = F.lit(total // size * size)
    range_of = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    whole = F.when(
        F.col("g") < last,
        F.transform(F.sequence(F.floor(F.col("g") / size), F.floor((F.least(F.col("g") + F.col("length"), last) - 1) / size)), lambda k: range_of(k * size, k * size + size)),
    ).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    rest = F.array(*[range_of(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in ends]).cast("array<struct<lo:bigint,hi:bigint>>")
    rest = F.filter(rest, lambda r: (r["lo"] < F.col("g") + F.col("length")) & (r["hi"] > F.col("g")))
    cut = g.withColumn("r", F.explode(F.concat(whole, rest)))
    lo, hi = F.greatest(F.col("g"), F.col("r.lo")), F.least(F.col("g") + F.col("length"), F.col("r.hi"))
    cut = cut.select(
        "doc_id", (F.col("start") + lo - F.col("g")).alias("start"), (hi - lo).alias("length"), "doc_tokens",
        (F.lit(1 << 62) + F.col("r.lo")).alias("sequence_id"), (lo - F.col("r.lo")).alias("offset"),
        F.substring("ids", (4 * (lo - F.col("g")) + 1).cast("int"), (4 * (hi - lo)).cast("int")).alias("ids"),
    )
    return done.unionByName(cut)
