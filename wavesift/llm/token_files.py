"""Token ids in files of patched frame-of-reference blocks, written and read by Spark tasks.

A file holds whole documents:

    8 s   magic WSPFOR01
    6 u8  block size, ids, documents, blocks, byte of the documents, byte of the index
    blocks: u4 minimum, u2 width, u2 exceptions, the low `width` bits of every id less the
            minimum, then the exceptions: u2 places, u4 high bits
    documents: i8 doc_id, u1 whether it is null, u4 ids
    index: u8 the byte at which each block starts, and the end of the last

All little-endian. The width is that of the percentile of the block, so a few large ids go to
the exception list and don't widen all others; the index gives any block in one seek.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.llm.common import materialize, scratch_path, sums_before
from wavesift.llm.tokens import ChunkEncoder

MAGIC = b"WSPFOR01"
BLOCK, PERCENTILE = 4096, 95.0


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers under 2 ** width as rows of bytes."""
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    if width == 8 * kind.itemsize:
        return low.astype(kind).view(np.uint8).reshape(len(low), -1)
    bits = np.unpackbits(low.astype(kind).view(np.uint8).reshape(*low.shape, kind.itemsize), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(low), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    if not width:
        return np.zeros((len(packed), n), dtype=np.uint32)
    if width == 8 * kind.itemsize:
        return np.ascontiguousarray(packed).view(kind).astype(np.uint32)
    bits = np.unpackbits(packed, axis=1, count=n * width, bitorder="little").reshape(len(packed), n, width)
    full = np.zeros((len(packed), n, kind.itemsize * 8), dtype=np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view(kind)[:, :, 0].astype(np.uint32)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The bytes of a file; ids are those of all its documents, in order. block: 65536 at most."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = -(-len(ids) // block)
    parts: list[bytes] = [b""] * n
    for at in range(0, n, 256):  # so many blocks at once, for bounded memory
        some = ids[at * block : (at + 256) * block]
        whole = len(some) // block
        groups = [(at, some[: whole * block].reshape(whole, block))] if whole else []
        if len(some) > whole * block:
            groups.append((at + whole, some[whole * block :].reshape(1, -1)))
        for first, v in groups:
            low = v.min(axis=1)
            d = v - low[:, None]
            k = min(v.shape[1] - 1, int(np.ceil(percentile / 100 * v.shape[1])) - 1)
            widths = np.ceil(np.log2(np.partition(d, k, axis=1)[:, k].astype(float) + 1)).astype(int)
            for w in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == w)
                packed = _pack(d[rows] & np.uint32((1 << w) - 1), w) if w else np.zeros((len(rows), 0), np.uint8)
                high = (d[rows].astype(np.uint64) >> np.uint64(w)).astype("<u4")
                for r, p, h in zip(rows.tolist(), packed, high, strict=True):
                    odd = np.flatnonzero(h)
                    head = np.array([low[r]], "<u4").tobytes() + np.array([w, len(odd)], "<u2").tobytes()
                    parts[first + r] = head + p.tobytes() + odd.astype("<u2").tobytes() + h[odd].tobytes()
    starts = np.cumsum([8 + 48, *map(len, parts)], dtype=np.uint64)
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes() + np.asarray(lengths, "<u4").tobytes()
    head = np.array([block, len(ids), len(doc_ids), n, starts[-1], int(starts[-1]) + len(docs)], "<u8")
    return b"".join([MAGIC, head.tobytes(), *parts, docs, starts.astype("<u8").tobytes()])


def decode_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, doc_ids, lengths) of a file's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    block, n_ids, n_docs, n, at, index = np.frombuffer(data, "<u8", 6, 8).tolist()
    starts = np.frombuffer(data, "<u8", n + 1, index).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(n_ids, dtype=np.uint32)
    groups: dict[tuple[int, int], list[int]] = {}
    for b in range(n):
        w = int.from_bytes(data[starts[b] + 4 : starts[b] + 6], "little")
        groups.setdefault((w, min(block, n_ids - b * block)), []).append(b)
    for (w, size), blocks in groups.items():
        bytes_ = -(-size * w // 8)
        for k in range(0, len(blocks), 256):
            some = blocks[k : k + 256]
            v = _unpack(np.stack([raw[starts[b] + 8 : starts[b] + 8 + bytes_] for b in some]), w, size)
            for b, row in zip(some, v, strict=True):
                s = starts[b]
                odd = int.from_bytes(data[s + 6 : s + 8], "little")
                if odd:
                    places = np.frombuffer(data, "<u2", odd, s + 8 + bytes_)
                    row[places] |= np.frombuffer(data, "<u4", odd, s + 8 + bytes_ + 2 * odd) << np.uint32(w)
                out[b * block : b * block + size] = row + np.frombuffer(data, "<u4", 1, s)
    ids = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, "u1", n_docs, at + 8 * n_docs)
    return out, [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)], np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, file_ids: int = 2_000_000, part_bytes: int = 24_000_000) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order, null ids first, and writes the
    ids, end_id after each document, to files of about file_ids ids under path. Returns the
    manifest (file, part, seq, n_docs, n_ids), which is also written, under path/manifest.

    Rows of equal id follow in the order of a hash of their text. Null texts are empty, an
    empty text gives its end id alone, an empty table no file. Every attempt of a task writes
    files of its own name, and only those in the manifest, which Spark commits, are read: a
    repeated or lost task changes nothing. Nothing is renamed.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.select("doc_id", "text").repartitionByRange(max(1, -(-total // part_bytes)), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        part, seq = TaskContext.get().partitionId(), 0
        fs, folder = FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        held: list[np.ndarray] = []
        lengths: list[int] = []
        ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            name = f"{part:07d}-{seq:05d}-{TaskContext.get().taskAttemptId()}.pfor"
            whole = np.concatenate(held)
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(encode_file(whole, ids, np.array(lengths)))
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "seq": seq, "n_docs": len(ids), "n_ids": len(whole)}], schema=shape)

        shape = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        encoder = ChunkEncoder.of(vocabulary)
        size = 0
        for b in batches:
            for begin, end, flat, n in encoder.slices(b.column(1)):
                own = b.column(0).slice(begin, end - begin)
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, end_id)
                at = 0  # documents of this slice that are in files or held already
                for stop in [*np.flatnonzero(np.diff((size + ends + np.arange(1, len(n) + 1)) // file_ids, prepend=size // file_ids)).tolist(), None]:
                    stop = len(n) if stop is None else stop + 1
                    first, last = (ends[at - 1] + at if at else 0), (ends[stop - 1] + stop if stop else 0)
                    ids += own.slice(at, stop - at).to_pylist()
                    lengths += (n[at:stop] + 1).tolist()
                    held.append(flat[first:last])
                    size += int(last - first)
                    if size >= file_ids:
                        yield flush()
                        seq, size, held, lengths, ids = seq + 1, 0, [], [], []
                    at = stop
        if ids:
            yield flush()

    manifest = ordered.mapInArrow(run, "file string, part int, seq int, n_docs long, n_ids long")
    return materialize(manifest, "manifest", f"{path}/manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the manifest's files: start counts
    the ids of all documents before it, ids are little-endian unsigned 32-bit integers."""
    spark = manifest.sparkSession
    named = sums_before(manifest.select("file", "part", "seq", "n_ids"), "part", ["part", "seq"], "n_ids", "base").select("file", "base")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(named, "file").select("base", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, doc_ids, lengths = decode_file(data.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                flat = ids.astype("<u4").tobytes()
                for k in range(0, len(doc_ids), 1024):
                    part = slice(k, k + 1024)
                    values = [flat[4 * s : 4 * e] for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[part], pa.int64()), pa.array(base + starts[part]), pa.array(lengths[part].astype(np.int64)), pa.array(values, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, vocabulary: str, path: str | None = None, **how) -> DataFrame:
    """Writes the files, under path or in the shared folder, and reads them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, vocabulary, **how), path)
