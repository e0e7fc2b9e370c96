"""Katz backoff: Good-Turing discounted n-gram counts, exact backoff weights, any order.

The corpus is turned into batches of about a million tokens, each with the 64-bit hashes of
its distinct words and its texts as codes of them. A batch sends its distinct n-grams of each
length, counted, to the partition of the count table that their hash belongs to; the partition
adds up the batches and answers each with the whole corpus's counts. So a common n-gram costs
an entry for each batch and not one for each use, no partition grows with one key, and what
travels is packed. The backoff weights are gathered by history in the same way, of the
histories that a text to be scored outside the training rows has: only there can an n-gram be
unknown.

Keys travel with 20 bits more than the corpus's tokens need, so a key falls together with
another with a chance of 2 ** -20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavesift.llm.common import discard, id_remainder, materialize

#: Hashes that stand for the end of a text and for what is before its first token.
END, START = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
TOP = 5  # counts over this aren't discounted


def packed(x: np.ndarray) -> bytes:
    """An array as zstd of its byte planes."""
    x = np.ascontiguousarray(x)
    return pa.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(data, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind)[:, 0]


def packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, "u8"), dtype=np.uint64)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each pair of word hashes; the order counts."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(29))) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def key_bits(tokens: int) -> int:
    return min(64, max(1, tokens).bit_length() + 20)


def bounds(sorted_keys: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Where each of `parts` equal ranges of keys of so many bits begins in sorted keys, and the end."""
    edges = np.array([(i << bits) // parts for i in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_keys, edges), len(sorted_keys))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, their number in each): A-Z lower-cased, split at ASCII
    white space; a null text has none."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = cut.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    return flat.filter(pa.array(full)), np.diff(ends[offsets])


STORE = "bid long, n_tokens long, n_words long, doc_ids array<{0}>, held binary, lengths binary, words binary, codes binary"


def batches_of(docs: DataFrame, held: Column, batch_tokens: int) -> DataFrame:
    """Rows of STORE: the texts of docs (doc_id, text) in batches of about batch_tokens tokens;
    a text is never split. held: whether a row is kept from training."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 24
        for b in rows:
            size = np.cumsum(np.asarray(pc.binary_length(pc.fill_null(b.column(1), ""))) + 1)
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 6 * batch_tokens, side="right")))
                some = b.slice(at, end - at)
                words, n = words_of(some.column(1))
                coded = words.dictionary_encode()
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
                hashes = np.append(hashes, END)
                order = np.argsort(hashes)
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                codes = np.insert(rank[coded.indices.to_numpy()], np.cumsum(n), rank[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([seq]), pa.array([len(codes)]), pa.array([len(order)]), pa.array([some.column(0).to_pylist()], pa.list_(b.schema.field(0).type)),
                        *(pa.array([x], pa.binary()) for x in (packed(some.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)), packed(n + 1), packed_sorted(hashes[order]), packed(codes))),
                    ],
                    ["bid", "n_tokens", "n_words", "doc_ids", "held", "lengths", "words", "codes"],
                )
                seq, at = seq + 1, end

    return docs.select("doc_id", "text", held.alias("held")).mapInArrow(run, STORE.format(kind))


class Batch:
    """A row of STORE, unpacked, and for each length n up to `order` its distinct n-grams in the
    order of their keys: at[n], the one that ends at each token; hist[n], its first n - 1
    tokens, and lower[n], its last, as places in the n-grams of length n - 1. Before a text
    stand START tokens; the history of these only has the place behind the last."""

    def __init__(self, row: dict, order: int):
        n_docs = len(row["doc_ids"])
        self.bid, self.doc_ids, self.order = row["bid"], row["doc_ids"], order
        self.held = unpacked(row["held"], n_docs, "u1").astype(bool)
        self.lengths = unpacked(row["lengths"], n_docs, "i8")
        words = unpacked_sorted(row["words"], row["n_words"])
        codes = unpacked(row["codes"], row["n_tokens"], "u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        self.keys, self.at, self.hist, self.lower, self.asked = {1: words}, {1: codes}, {}, {}, {}
        for n in range(2, order + 1):
            last, own = len(self.keys[n - 1]), self.at[n - 1]
            prev = np.empty_like(own)
            prev[1:] = own[:-1]
            prev[self.starts] = last
            both, some, at = np.unique(prev * len(words) + codes, return_index=True, return_inverse=True)
            hist, word = np.divmod(both, len(words))
            keys = pair_keys(np.append(self.keys[n - 1], START)[hist], words[word])
            by_key = np.argsort(keys)
            place = np.empty(len(by_key), np.int32)
            place[by_key] = np.arange(len(by_key), dtype=np.int32)
            self.keys[n], self.at[n], self.hist[n], self.lower[n] = keys[by_key], place[at].astype(np.int64), hist[by_key], own[some[by_key]]
            self.asked[n - 1] = np.zeros(last + 1, bool)  # histories of texts outside training
            self.asked[n - 1][prev[~self.train]] = True

    def counts(self, n: int) -> np.ndarray:
        """How often training texts of the batch use each n-gram."""
        return np.bincount(self.at[n][self.train], minlength=len(self.keys[n])).astype(np.uint32)


def _send(parts: int, order: int, bits: int):
    names = ["level", "p", "bid", "n", "keys", "counts", "asked"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for row in b.to_pylist():
                x = Batch(row, order)
                for level in range(1, order + 1):
                    keys = x.keys[level] >> np.uint64(64 - bits)
                    counts, at, out = x.counts(level), bounds(keys, parts, bits), []
                    asked = x.asked[level] if level < order else np.zeros(len(keys) + 1, bool)
                    for p in np.flatnonzero(np.diff(at)).tolist():
                        some = slice(at[p], at[p + 1])
                        out.append((level, p, x.bid, int(at[p + 1] - at[p]), packed_sorted(keys[some]), packed(counts[some]), packed(np.packbits(asked[some]))))
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _count(table: pa.Table) -> pa.Table:
    """A partition of the count table: the batches' counts added up. Answers each batch with
    the corpus's counts of its keys, whether the key is its own to report (1), that of the
    first batch which trains on it, and whether any batch asks for it as a history (2). The
    row without a batch has N, V and how many keys have the counts 1 to TOP + 1."""
    rows = sorted(table.to_pylist(), key=lambda r: r["bid"])
    keys, at = np.unique(np.concatenate([unpacked_sorted(r["keys"], r["n"]) for r in rows]), return_inverse=True)
    own = np.concatenate([unpacked(r["counts"], r["n"], "u4") for r in rows]).astype(np.int64)
    total = np.bincount(at, own, len(keys)).astype(np.int64)
    uses = np.flatnonzero(own)
    asked = np.concatenate([np.unpackbits(unpacked(r["asked"], -(-r["n"] // 8), "u1"), count=r["n"]) for r in rows])
    first = (np.bincount(at, asked, len(keys)) > 0).astype(np.uint8)[at] * np.uint8(2)
    first[uses[np.unique(at[uses], return_index=True)[1]]] += 1
    stats = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist()]
    out, last = [], 0
    for r in rows:
        some = slice(last, last + r["n"])
        last += r["n"]
        out.append((r["level"], r["p"], r["bid"], r["n"], packed(total[at[some]].astype(np.uint32)), packed(first[some]), None))
    out.append((rows[0]["level"], rows[0]["p"], None, 0, None, None, stats))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["level", "p", "bid", "n", "counts", "own", "stats"])


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for counts r = 0 .. TOP + 1 (which stands for all above): Katz's, from the numbers
    n[0], n[1] .. of keys with counts 1, 2 ..; over the greatest range of counts for which all
    are over 0 and under 1. Where there is none, half a count is taken off."""
    d = np.ones(TOP + 2)
    d[0] = 0
    for k in range(TOP, 0, -1):
        if all(n[: k + 1]):
            a = (k + 1) * n[k] / n[0]
            got = [((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) if a != 1 else 0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in got):
                d[1 : k + 1] = got
                return d
    d[1 : TOP + 1] = 1 - 0.5 / np.arange(1, TOP + 1)
    return d


class Model:
    """Totals of the training corpus, known to every task: they don't grow with it.

    P(w) = d c(w) / (N + spare), the rest for all unknown words as one;
    P(w | h) = d c(hw) / (c(h) + spare) for known n-grams, else alpha(h) P(w | h less its first
    token), where alpha makes the sum over all words 1. spare keeps some mass even where
    nothing is discounted. A history never trained on backs off with weight 1."""

    def __init__(self, stats: dict[int, list[int]], order: int, texts: int, spare: float):
        zero = [0] * (TOP + 3)
        uni = stats.get(1, zero)
        self.n, self.v, self.texts, self.spare, self.order = uni[0], uni[1], texts, spare, order
        self.d = {n: discounts(stats.get(n, zero)[2:]) for n in range(1, order + 1)}
        kept = (np.array(uni[2 : 2 + TOP]) * np.arange(1, TOP + 1) * (1 - self.d[1][1 : TOP + 1])).sum()
        self.unknown = (kept + spare) / (self.n + spare)

    def known(self, n: int, c: np.ndarray, history: np.ndarray | None = None) -> np.ndarray:
        """The probability of known n-grams with counts c after histories with these counts."""
        return self.d[n][np.minimum(c, TOP + 1)] * c / ((self.n if n == 1 else history) + self.spare)

    def taken(self, n: int, c: np.ndarray) -> np.ndarray:
        """What the discount takes off an n-gram's count."""
        return (1 - self.d[n][np.minimum(c, TOP + 1)]) * c

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def _score(model: Model, parts: int, bits: int):
    """A batch and its answers: the scores of its texts but for backoff weights (kind 0), and
    what the partitions of the weight table need: of each history that is asked for its count,
    what is taken off its own n-grams and their lower probability (kind 1), and the uses of
    backoff by texts (kind 2)."""
    names = ["kind", "level", "p", "bid", "doc", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n", "keys", "a", "b", "c"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows = sorted(right.to_pylist(), key=lambda r: (r["level"], r["p"]))
        for row in left.to_pylist():
            x = Batch(row, model.order)
            c, flags, of = {}, {}, {}
            for n in range(1, model.order + 1):
                got = [r for r in rows if r["level"] == n]
                c[n] = np.concatenate([unpacked(r["counts"], r["n"], "u4") for r in got]).astype(np.int64)
                flags[n] = np.append(np.concatenate([unpacked(r["own"], r["n"], "u1") for r in got]), np.uint8(2))
                if n > 1:
                    of[n] = np.append(c[n - 1], model.texts)[x.hist[n]]  # the count of each history

            p = {1: np.where(c[1] > 0, model.known(1, c[1]), model.unknown)}
            log_p = np.log10(p[1])
            for n in range(2, model.order + 1):  # as if every weight were 1
                p[n] = model.known(n, c[n], of[n])
                with np.errstate(divide="ignore"):
                    log_p = np.where(c[n] > 0, np.log10(p[n]), log_p[x.lower[n]])
            sums = [np.add.reduceat(v, x.starts) for v in ((c[1] > 0)[x.at[1]].astype(np.int64), model.base(c[1])[x.at[1]], log_p[x.at[model.order]])]
            for i, v in enumerate(zip(x.doc_ids, x.held.tolist(), x.lengths.tolist(), *(s.tolist() for s in sums), strict=True)):
                out.append((0, None, None, x.bid, i, *v, None, None, None, None, None))

            def send(kind: int, n: int, h: np.ndarray, *values: np.ndarray) -> None:
                """values of histories h to the partitions of their keys"""
                keys = np.append(x.keys[n - 1], START)[h] >> np.uint64(64 - bits)
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], [v[order] for v in values]
                cut = bounds(keys, parts, bits)
                for q in np.flatnonzero(np.diff(cut)).tolist():
                    s = slice(cut[q], cut[q + 1])
                    some = [packed(v[s]) for v in values] + [None] * (3 - len(values))
                    out.append((kind, n, q, x.bid, *[None] * 7, int(cut[q + 1] - cut[q]), packed_sorted(keys[s]), *some))

            left_over = np.flatnonzero(~x.train)  # tokens whose n-gram isn't known at any greater length
            doc = np.searchsorted(x.starts, left_over, side="right") - 1
            for n in range(model.order, 1, -1):
                own = np.flatnonzero((flags[n][:-1] & 1 > 0) & (flags[n - 1][x.hist[n]] & 2 > 0))
                h, at = np.unique(x.hist[n][own], return_inverse=True)
                taken, lower = np.bincount(at, model.taken(n, c[n][own]), len(h)), np.bincount(at, p[n - 1][x.lower[n][own]], len(h))
                send(1, n, h, taken, lower, np.append(c[n - 1], model.texts)[h])
                lost = c[n][x.at[n][left_over]] == 0
                left_over, doc = left_over[lost], doc[lost]
                gram = x.at[n][left_over]
                back = of[n][gram] > 0
                use, times = np.unique(x.hist[n][gram[back]] * len(x.doc_ids) + doc[back], return_counts=True)
                h, at = np.divmod(use, len(x.doc_ids))
                send(2, n, h, at.astype(np.uint32), times.astype(np.uint32))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), left.schema.field("doc_ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 16, kinds, strict=True)], names=names)

    return run


def _weigh(model: Model):
    """A partition of the weight table: alpha of each history; and for each batch that backs off
    through it, a row with the sum of their logs for each of its texts, packed."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["kind", "bid", "n", "keys", "a", "b", "c"]).to_pylist(), key=lambda r: (r["kind"], r["bid"]))
        given, asked = [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == 2]
        get = lambda some, f: np.concatenate([f(r) for r in some]) if some else np.empty(0)
        keys, at = np.unique(get(given, lambda r: unpacked_sorted(r["keys"], r["n"])).astype(np.uint64), return_inverse=True)
        taken = np.bincount(at, get(given, lambda r: unpacked(r["a"], r["n"], "f8")), len(keys))
        lower = np.bincount(at, get(given, lambda r: unpacked(r["b"], r["n"], "f8")), len(keys))
        count = np.zeros(len(keys))
        count[at] = get(given, lambda r: unpacked(r["c"], r["n"], "i8"))
        alpha = (taken + model.spare) / (count + model.spare) / np.maximum(1 - lower, 1e-15)
        out = []
        for r in asked:
            log = np.log10(alpha[np.searchsorted(keys, unpacked_sorted(r["keys"], r["n"]))]) * unpacked(r["b"], r["n"], "u4")
            doc, i = np.unique(unpacked(r["a"], r["n"], "u4"), return_inverse=True)
            out.append((r["bid"], len(doc), packed(doc), packed(np.bincount(i, log, len(doc)))))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["bid", "n", "docs", "logs"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """A batch's rows of the weight table: the sum of all logs for each text."""
    rows = table.to_pylist()
    docs = np.concatenate([unpacked(r["docs"], r["n"], "u4") for r in rows])
    logs = np.concatenate([unpacked(r["logs"], r["n"], "f8") for r in rows])
    doc, at = np.unique(docs, return_inverse=True)
    sums = np.bincount(at, logs, len(doc))
    return pa.table([pa.array(np.full(len(doc), rows[0]["bid"], np.int64)), pa.array(doc.astype(np.int64)), pa.array(sums)], names=["bid", "doc", "more"])


def katz_scores(docs: DataFrame, order: int = 3, batch_tokens: int = 1_000_000, part_tokens: int = 1_500_000, spare: float = 0.01) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of
    docs (doc_id, text); logs are of base 10. An n-gram of `order` tokens that training lacks
    backs off to shorter ones, down to single words.

    Learns from the rows whose crc32(doc_id as text) mod 10 isn't 0 and scores all. Null and
    empty texts are their end token; a null id counts as the text '', so it is held out.
    Repeated rows count and score as often as they come. Without rows to learn from, all words
    are unknown, with probability 1.
    """
    held = id_remainder(F.col("doc_id"), 10) == 0
    store = materialize(batches_of(docs, held, batch_tokens), "tokens")
    got = store.select(F.sum("n_tokens").alias("n")).first()
    parts, bits = max(1, -(-(got.n or 0) // part_tokens)), key_bits(got.n or 0)
    sent = store.mapInArrow(_send(parts, order, bits), "level int, p int, bid long, n long, keys binary, counts binary, asked binary")
    answers = sent.groupBy("level", "p").applyInArrow(_count, "level int, p int, bid long, n long, counts binary, own binary, stats array<long>")
    answers = materialize(answers, "counts")
    sums = answers.where("bid is null").groupBy("level").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(TOP + 3)])
    stats = {r["level"]: list(r)[1:] for r in sums.collect()}  # a row for each length
    texts = docs.where(~held).count()
    model = Model(stats, order, texts, spare)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"kind int, level int, p int, bid long, doc long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n long, keys binary, a binary, b binary, c binary"
    scored = store.groupBy("bid").cogroup(answers.where("bid is not null").groupBy("bid")).applyInArrow(_score(model, parts, bits), shape)
    scored = materialize(scored, "scored")
    discard(store)
    discard(answers)
    weights = scored.where("kind > 0").groupBy("level", "p").applyInArrow(_weigh(model), "bid long, n long, docs binary, logs binary")
    more = weights.groupBy("bid").applyInArrow(_added, "bid long, doc long, more double")
    own = scored.where("kind = 0").join(more, ["bid", "doc"], "left")
    return own.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
