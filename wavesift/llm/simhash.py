"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance.

`simhash_components` links 64-bit fingerprints at a few bits, exactly. `drop_near_copies` finds
texts by the similarity of their shingle sets: a similarity of 0.8 is about ten bits of 64, too
many for short fingerprints to be cut into blocks, so it takes longer ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from wavesift.llm.common import LOWER, WORD, discard, hide, join_unique, materialize
from wavesift.llm.components import connected_components

SEED = 42


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text's word shingles; no word gives zero."""
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < words else map(" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long), a row for each row of docs, no shuffle.

    Null and empty texts have fingerprint zero; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint_of(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


def _parts(places: list[int], blocks: int) -> list[int]:
    """Bit masks of `blocks` blocks, as even as can be, of these bit places."""
    edges = [round(i * len(places) / blocks) for i in range(blocks + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def block_masks(blocks: int, distance: int, bits: int = 64, fixed: int = 0) -> list[int]:
    """Masks of every choice of blocks - distance blocks: two fingerprints that differ in at
    most `distance` bits agree on all bits of one mask at least. Bits that are `fixed`, on
    which they are known to agree, are in every mask and the rest is cut into blocks."""
    parts = _parts([i for i in range(bits) if not fixed >> i & 1], blocks)
    return [fixed | sum(c) for c in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(f: np.ndarray, distance: int) -> tuple[list, list]:
    """Links, as places, of each member of a bucket to the first member of its component there."""
    a, b, rest = [], [], np.arange(len(f))
    while len(rest) > 1:
        root, todo, rest = int(rest[0]), [rest[0]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(f[rest] ^ f[todo.pop()]) <= distance
            if near.any():
                got = rest[near]
                a += [root] * len(got)
                b += got.tolist()
                todo += list(got)
                rest = rest[~near]
    return a, b


def _forest(names: np.ndarray, f: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), names: a spanning forest of the links in each bucket; buckets begin at starts."""
    size = np.diff(np.append(starts, len(f)))
    two = starts[size == 2]
    two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= distance]
    a, b = [names[two]], [names[two + 1]]
    for s, n in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        p, q = _stars(f[s : s + n], distance)
        a.append(names[s : s + n][p])
        b.append(names[s : s + n][q])
    return np.concatenate(a), np.concatenate(b)


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    new = np.any([c[1:] != c[:-1] for c in keys], axis=0)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _linker(distance: int, n_key: int):
    """Over rows sorted by their first n_key columns (the bucket), then a name and a
    fingerprint: the names of a spanning forest of each bucket's links, so at most one row for
    each row read."""

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = _forest(cols[n_key], cols[n_key + 1].view(np.uint64), _starts(cols[:n_key]), distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(n_key + 2)]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(_starts(cols[:n_key])[-1])  # the last bucket may go on
            left = [c[cut:] for c in cols]
            if cut:
                yield from emit([c[:cut] for c in cols])
        if left is not None and len(left[0]) > 1:
            yield from emit(left)

    return run


#: Hot buckets up to this number are broadcast; more are joined, salted.
BROADCAST_BUCKETS = 50_000


def _split_hot(keyed: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """keyed (fingerprint, mask, bucket) as the rows of buckets of at most `chunk` members and,
    if there are any, the rest. Buckets are counted before they are dealt out, and the rows of
    a hot one stay spread."""
    hot = materialize(keyed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("mask", "bucket"), "hot")
    n = hot.count()
    if not n:
        return keyed, None
    on = ["mask", "bucket"]
    if n <= BROADCAST_BUCKETS:
        return keyed.join(F.broadcast(hot), on, "left_anti"), keyed.join(F.broadcast(hot), on, "left_semi")
    salts = 32
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)))
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return tuple(salted.join(hot, [*on, "salt"], how).drop("salt") for how in ("left_anti", "left_semi"))


def link_fingerprints(values: DataFrame, distance: int = 3, blocks: int = 6, chunk: int = 2048) -> DataFrame:
    """Distinct longs `fingerprint` to links (a, b) that connect what chains of pairs within
    `distance` bits connect.

    Each fingerprint goes to a bucket for each choice of blocks - distance blocks (20 buckets
    of about 32 bits for 6 and 3), and each bucket's links are verified and cut down to a
    spanning forest. Members of a bucket of over `chunk` agree on its bits, so their links
    agree on a choice of blocks of the other bits, too: they are dealt out again by those, and
    again, until ten bits are free at most. So no group of a task is over `chunk` or 1024, and
    a row is sent 20 times a level and not once for each other chunk of its bucket.
    """
    spark, out = values.sparkSession, []
    masks = block_masks(blocks, distance)
    keyed = values.select("fingerprint", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while keyed is not None:
        keyed = keyed.select("fingerprint", "mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bucket"))
        free = 64 - min(m.bit_count() for m in masks)
        few, hot = (keyed, None) if free <= 10 or 1 << free <= chunk else _split_hot(keyed, chunk)
        few = few.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket")
        out.append(few.select("mask", "bucket", F.col("fingerprint").alias("a"), "fingerprint").mapInArrow(_linker(distance, 2), "a long, b long"))
        keyed = None
        if hot is not None:
            finer = sorted({(m, f) for m in masks for f in block_masks(blocks, distance, fixed=m)})
            masks = sorted({f for _, f in finer})
            table = spark.createDataFrame([(_signed(m), _signed(f)) for m, f in finer], "mask long, finer long")
            keyed = hot.select("fingerprint", "mask").join(F.broadcast(table), "mask")  # 20 rows for each mask, whatever the data
            keyed = materialize(keyed.select("fingerprint", F.col("finer").alias("mask")), "finer")
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links


def simhash_components(docs: DataFrame, distance: int = 3, words: int = 3, blocks: int = 6, chunk: int = 2048) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for each row of docs.

    component_id is the smallest doc_id among the texts that chains of links reach. Equal
    fingerprints are one class before anything is paired, so exact copies cost one row.
    Rows with a null doc_id are linked too, but never name a component: where no row of it
    has an id, component_id is null. An empty table gives no rows.
    """
    fp = materialize(fingerprints(docs, words), "simhash")
    classes = materialize(fp.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count("*").alias("_n")), "simhash-classes")
    comp = connected_components(link_fingerprints(classes.select("fingerprint"), distance, blocks, chunk))
    comp = comp.select(F.col("node").alias("fingerprint"), "component")
    linked = classes.join(comp, "fingerprint")
    low = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(low, "component").select("fingerprint", "component_id")
    named = classes.join(linked, "fingerprint", "left")
    named = named.select("fingerprint", F.coalesce("component_id", "low").alias("component_id"), "_n")
    return join_unique(fp, named, "fingerprint", fp.count()).select("doc_id", "fingerprint", "component_id")


# near copies by the similarity of their shingle sets

LANES, LEAST_RECALL = 8, 0.97
_DRAW = np.random.default_rng(SEED)
_PLACE = _DRAW.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = _DRAW.integers(0, 1 << 63, (2, LANES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """64 bits of hash of each word, with A to Z as a to z."""
    w = WORD.findall((text or "").translate(LOWER))
    return np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in w), dtype=np.uint64, count=len(w))


def shingles(h: np.ndarray, words: int = 5) -> np.ndarray:
    """The distinct hashes, ascending, of runs of `words` words; of a shorter text, of all its words."""
    k = min(words, len(h))
    if not k:
        return h
    s = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * _PLACE[i]
    s = (s ^ s >> np.uint64(32)) * _PLACE[-1]
    return np.unique(s ^ s >> np.uint64(29))


def wide_fingerprint(s: np.ndarray) -> bytes:
    """LANES x 64 bits of SimHash of a set of shingle hashes: in each lane another mix of them."""
    ones = np.zeros(LANES * 64, dtype=np.int64)
    for i in range(0, len(s), 255):
        x = s[i : i + 255, None] * _LANE[0]
        x = (x ^ x >> np.uint64(32)) * _LANE[1]
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(s)).tobytes()


def bit_agreement(jaccard: float) -> float:
    """The chance that a SimHash bit agrees for equally large sets of this Jaccard similarity."""
    return 1 - acos(2 * jaccard / (1 + jaccard)) / pi


def plan_blocks(n: int, least: float, recall: float = LEAST_RECALL) -> tuple[int, int, int]:
    """(bits of a block, number of blocks, Hamming radius of the first 64 bits) for n texts.

    Blocks are so long that two unlike texts share one with a chance of a quarter of 1 / n, and
    so many that a pair at the threshold shares one with the chance `recall` by calculation;
    the radius loses one in 500 of such pairs. More texts take longer and so more blocks."""
    width = min(40, max(12, ceil(log2(max(n, 1))) + 2))
    agree = bit_agreement(least)
    blocks = ceil(log(1 - recall) / log(1 - agree**width))
    below, radius = 0.0, -1
    while below < 0.998:
        radius += 1
        below += comb(64, radius) * (1 - agree) ** radius * agree ** (64 - radius)
    return width, blocks, radius


@cache
def _orders(width: int, blocks: int) -> np.ndarray:
    """The bit places of each block: all bits, shuffled, are cut into blocks, and shuffled again
    for more, so within one shuffle close pairs can't differ in every block."""
    rng = np.random.default_rng([SEED, width])
    each = LANES * 64 // width
    return np.concatenate([rng.permutation(LANES * 64)[: each * width].reshape(each, width) for _ in range(-(-blocks // each))])[:blocks]


#: Of rows of one block in a batch, such as are more than this are linked there and send on one.
LOCAL = 64
ROW = "key long, node long, f long, kind int"


def _block_rows(width: int, blocks: int, radius: int):
    """Rows (node, wide) to ROW: one for each block, kind 0; where a block of a batch has over
    LOCAL rows, they are linked at once (kind 2: node and f are linked, key is any) and each
    component sends on one row, kind 1, for all."""
    powers = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                some = b.slice(k, 4096)
                if not some.num_rows:
                    continue
                raw = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(len(some), -1)
                bits = np.unpackbits(raw, axis=1)
                node, f = some.column(0).to_numpy(), np.ascontiguousarray(raw[:, :8]).view("<i8")[:, 0]
                key, kind, links = [], [], []
                for j, places in enumerate(_orders(width, blocks)):
                    own = bits[:, places] @ powers + (j << 44)
                    order = np.argsort(own, kind="stable")
                    starts = _starts([own[order]])
                    sizes = np.diff(np.append(starts, len(order)))
                    stay, sort = np.ones(len(own), bool), np.zeros(len(own), np.int32)
                    for s, n in zip(starts[sizes > LOCAL].tolist(), sizes[sizes > LOCAL].tolist(), strict=True):
                        at = order[s : s + n]
                        p, q = _stars(f[at].view(np.uint64), radius)
                        links.append(np.c_[node[at[p]], node[at[q]]])
                        sort[at[p]], stay[at[q]] = 1, False
                    key.append(np.where(stay, own, -1))
                    kind.append(sort)
                key, kind = np.stack(key, 1).ravel(), np.stack(kind, 1).ravel()
                cols = [key, np.repeat(node, blocks), np.repeat(f, blocks), kind]
                cols = [c[key >= 0] for c in cols]
                if links:
                    got = np.concatenate(links)
                    cols = [np.concatenate(x) for x in zip(cols, (got[:, 1], got[:, 0], got[:, 1], np.full(len(got), 2, np.int32)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "f", "kind"])

    return run


def _join_blocks(radius: int):
    """ROWs sorted by key to candidate links (a, b): rows of a block within the radius, and all of
    a block with a row that stands for many. Of a block of over 4096 rows the rest hangs on the
    first ones, unverified, so memory is bounded; whatever is linked here is compared exactly."""

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, f, kind = cols
        starts = _starts([key])
        many = np.add.reduceat((kind == 1).astype(np.int64), starts) > 0
        head = np.repeat(starts, np.diff(np.append(starts, len(key))))
        hung = np.flatnonzero(np.repeat(many, np.diff(np.append(starts, len(key)))) & (head != np.arange(len(key))))
        a, b = _forest(node, f.view(np.uint64), starts, radius)
        a, b = np.concatenate([a, node[head[hung]]]), np.concatenate([b, node[hung]])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            done = cols[3] == 2
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][done]), pa.array(cols[2][done])], ["a", "b"])
                cols = [c[~done] for c in cols]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(_starts([cols[0]])[-1])
            left = [c[cut:] for c in cols]
            if cut:
                yield from emit([c[:cut] for c in cols])
            if len(left[0]) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(left[1][:1], len(left[1]) - 1)), pa.array(left[1][1:])], ["a", "b"])
                left = [c[:1] for c in left]
                left[3] = np.ones(1, np.int32)
        if left is not None and len(left[0]) > 1:
            yield from emit(left)

    return run


def candidate_links(classes: DataFrame, least: float) -> DataFrame:
    """(a, b) of nodes of classes (node, wide) that connect all candidates for a similarity of
    `least` or more."""
    width, blocks, radius = plan_blocks(classes.count(), least)
    rows = classes.select("node", "wide").mapInArrow(_block_rows(width, blocks, radius), ROW)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_join_blocks(radius), "a long, b long")


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """docs with _node, the hash of its words, and _wide; none where a text has no word."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, wide = [], []
            for t in b.column(at).to_pylist():
                h = word_hashes(t)
                node.append(xxhash.xxh3_64_intdigest(h.tobytes(), SEED) - (1 << 63))
                wide.append(wide_fingerprint(shingles(h, words)) if len(h) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node, pa.int64()), pa.array(wide, pa.binary())], [*b.schema.names, "_node", "_wide"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_node", LongType()), StructField("_wide", BinaryType())]))


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of each set to the first one of its component: sets are joined by chains of pairs
    of a Jaccard similarity of `least` or more, each one computed exactly."""
    size = np.array([len(s) for s in sets])
    alive = np.ones(len(sets), dtype=bool)
    out = []
    for root in range(len(sets)):
        if not alive[root]:
            continue
        alive[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            fit = np.flatnonzero(alive & (size >= least * size[x]) & (size[x] >= least * size))
            if not len(fit):
                continue
            flat = np.concatenate([sets[i] for i in fit])
            place = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
            starts = np.concatenate([[0], np.cumsum(size[fit])[:-1]])
            both = np.add.reduceat((sets[x][place] == flat).astype(np.int64), starts)
            got = fit[both / (size[fit] + size[x] - both) >= least].tolist()
            alive[got] = False
            out += [(root, i) for i in got]
            todo += got
    return out


def _verified(pieces: DataFrame, least: float) -> DataFrame:
    """(a, b) of rows (component, duo, node, s) that are sorted by group."""

    def emit(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        links = similar_links(sets, least)
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in x], pa.int64()) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []
        for b in batches:
            group = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            flat, ends = b.column(3).values.to_numpy().view(np.uint64), b.column(3).offsets.to_numpy()
            for i, (k, node) in enumerate(zip(group, b.column(2).to_pylist(), strict=True)):
                if k != key:
                    yield from emit(nodes, sets)
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(flat[ends[i] : ends[i + 1]])
        yield from emit(nodes, sets)

    return pieces.select("component", "duo", "node", "s").mapInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, chunk: int = 1024) -> DataFrame:
    """Of each component of texts that chains of pairs connect, whose sets of `words`-word
    shingles have a Jaccard similarity of `least` or more, the row with the smallest doc_id.

    Candidates share a block of their long SimHash and are within a radius of its first 64 bits:
    a pair at `least` is one with a chance of LEAST_RECALL by calculation, a closer one with
    more. Whatever becomes a candidate is compared exactly. Each text goes once to the group of
    all it may be linked with by chains of candidates; a group of over `chunk` texts is dealt
    out, so that every two of its chunks meet and no task holds more than two of them. Equal
    texts, those without a word among them, are one class before anything is paired. Exactly
    one row of each component stays, also where ids repeat or are null (null comes last). All
    columns stay as they are, whatever their names; an empty table gives no rows.
    """
    own, names = hide(docs)
    marked = _marked(own, words).withColumn("_row", F.monotonically_increasing_id())
    marked = materialize(marked, "similar")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_row").alias("row"))
    classes = marked.groupBy(F.col("_node").alias("node")).agg(F.min(first).alias("low"), F.first("_wide").alias("wide"))
    classes = materialize(classes, "similar-classes")
    group = materialize(connected_components(candidate_links(classes.where("wide is not null"), least)), "similar-groups")
    sized = group.join(group.groupBy("component").agg(F.ceil(F.count("*") / F.lit(chunk / 2)).cast("int").alias("parts")), "component")
    sized = sized.select("node", F.col("component").alias("_group"), F.when(F.col("parts") > 2, F.col("parts")).otherwise(1).alias("_parts"))
    roster = classes.select("node", F.col("low.row").alias("_row")).join(sized, "node", "left").withColumnRenamed("node", "_name")
    # one row of each class goes on, so texts are dealt once; those in no group are done
    ones = materialize(marked.drop("_node", "_wide").join(roster, "_row"), "similar-ones")
    discard(marked)
    texts = ones.where("_group is not null").select("text", F.col("_group").alias("component"), F.col("_parts").alias("parts"), F.col("_name").alias("node"))
    texts = texts.select("text", "component", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                c = b.slice(k, 512)
                s = [shingles(word_hashes(t), words).view(np.int64) for t in c.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*c.columns[1:], pa.array(s, pa.list_(pa.int64()))], [*c.schema.names[1:], "s"])

    sets = texts.mapInArrow(cut, "component long, parts int, part int, node long, s array<long>")
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("part")) * F.col("parts") + F.greatest(o, F.col("part")))
    pieces = sets.select("component", F.explode(other).alias("duo"), "node", "s")
    pieces = pieces.repartition("component", "duo").sortWithinPartitions("component", "duo")
    comp = connected_components(_verified(pieces, least))
    named = classes.select("node", "low").join(group.select("node"), "node").join(comp, "node", "left")
    keep = named.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("low").alias("low"))
    keep = materialize(keep.select(F.col("low.row").alias("_row")), "similar-keep")
    discard(classes)
    discard(group)
    kept = ones.where("_group is not null").join(keep, "_row", "left_semi")
    return ones.where("_group is null").select(*names).unionByName(kept.select(*names)).toDF(*docs.columns)
