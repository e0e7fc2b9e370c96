"""Substring dedup: sliding runs of sentences, and runs of words wherever they start, are hashed
and joined over all documents, and what lies under any run but its first occurrence is removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wavesift.llm.common import WORD, hide

SENTENCE = re.compile(r"(?:[^\n.!?]+|[.!?]+(?![\s.!?]|\Z))*[.!?]*(?:\s+|\Z)")
ADDED = ["n_sentences", "n_removed"]
SPAN = "first int, last int, h long, h2 int"
#: Of every RUN_STARTS word runs in a row one is hashed: 34 + 18 - 1 = 51 words hold one at least.
RUN_WORDS, RUN_STARTS = 34, 18
_PLACE = np.random.default_rng(42).integers(0, 1 << 63, (2, RUN_WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sentences(text: str | None) -> list[str]:
    """The text cut after . ! or ? before white space, and after line ends; nothing is lost."""
    return [x for x in SENTENCE.findall(text or "") if x]


def runs(parts: list[str], many: int = 3, pair_words: int = 25, long_words: int = 50) -> list[tuple[int, int, int, int]]:
    """(first, last, hash, more hash) of the runs of a text's sentences.

    Every run of `many` sentences in a row, however short; every two with pair_words words in
    all, and each alone with long_words. So of a passage of over 2 * pair_words words in whole
    sentences every sentence lies in a run inside it, whatever stands around it. Words are
    compared as they are, the space between them isn't; a run without words is none.
    """
    words = [WORD.findall(p) for p in parts]
    size = [len(w) for w in words]
    spans = {(i, i) for i, n in enumerate(size) if n >= long_words}
    spans |= {(i, i + 1) for i in range(len(parts) - 1) if size[i] + size[i + 1] >= pair_words}
    spans |= {(i, i + many - 1) for i in range(len(parts) - many + 1) if any(size[i : i + many])}
    text = [" ".join(w) for w in words]
    out = []
    for i, j in sorted(spans):
        h = xxhash.xxh3_128_intdigest(" ".join(t for t in text[i : j + 1] if t))
        out.append((i, j, (h & (1 << 64) - 1) - (1 << 63), (h >> 64 & (1 << 32) - 1) - (1 << 31)))
    return out


def word_runs(text: str | None) -> np.ndarray:
    """Rows (first word, -1, hash, more hash) of a text's runs of RUN_WORDS words that have the
    least hash of RUN_STARTS runs in a row. The choice depends on the words alone, so of any 51
    words that occur twice the same run is hashed in both places, whatever stands around it."""
    w = WORD.findall(text or "")
    n = len(w) - RUN_WORDS + 1
    if n < RUN_STARTS:
        return np.empty((0, 4), dtype=np.int64)
    x = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in w), dtype=np.uint64, count=len(w))
    h, h2 = np.zeros((2, n), dtype=np.uint64)
    for i in range(RUN_WORDS):
        h += x[i : n + i] * _PLACE[0, i]
        h2 += x[i : n + i] * _PLACE[1, i]
    h = (h ^ h >> np.uint64(32)) * _PLACE[0, 0]
    h ^= h >> np.uint64(29)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, RUN_STARTS).argmin(1) + np.arange(n - RUN_STARTS + 1))
    out = np.full((len(at), 4), -1, dtype=np.int64)
    out[:, 0], out[:, 2], out[:, 3] = at, h[at].view(np.int64), (h2[at] >> np.uint64(32)).astype(np.int64) - (1 << 31)
    return out


def spans_of(docs: DataFrame, **how) -> DataFrame:
    """(d, t, first, last, h, h2, salt) of docs (d, t, text): the runs of each text, with 96
    bits of hash; last is -1 where first is a word and not a sentence. Runs of words count
    once a text: only those in another text are repeats of them. salt is 0 but for runs that occur before, by (d, t, first), in the same
    batch of rows: these are repeats whatever the other batches hold, and so very common runs
    send on a row for each batch under their hash, and not one for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for k in range(0, b.num_rows, 512):
                texts = b.column(2).slice(k, 512).to_pylist()
                found = [np.r_[np.array(runs(sentences(t), **how), dtype=np.int64).reshape(-1, 4), word_runs(t)] for t in texts]
                flat = np.concatenate(found)
                parts.append(np.c_[np.repeat(np.arange(k, k + len(found)), [len(f) for f in found]), flat])
            if not parts:
                continue
            at, first, last, h, h2 = np.concatenate(parts).T
            d, t = (b.column(i).to_numpy()[at] for i in (0, 1))
            word, place = last < 0, np.where(last < 0, 0, first)
            order = np.lexsort((place, t, d, word, h2, h))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]  # first place of the run
            again = np.zeros(len(h), dtype=bool)
            again[order] = (d[order] != d[lead]) | (t[order] != t[lead]) | (place[order] != place[lead])
            salt = np.where(again, 1 + np.arange(len(h)), 0)
            cols = [pa.array(c).cast(k) for c, k in zip((d, t, first, last, h, h2, salt), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["d", "t", "first", "last", "h", "h2", "salt"])

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    return docs.select("d", "t", "text").mapInArrow(run, f"d long, t int, {SPAN}, salt int")


def repeats(docs: DataFrame, **how) -> DataFrame:
    """(d, t, cuts) of docs (d, t, text): the runs of a text that occur before it or before in it."""
    w = Window.partitionBy("h", "h2", F.col("last") < 0, "salt").orderBy("d", "t", F.when(F.col("last") < 0, 0).otherwise(F.col("first")))
    hits = spans_of(docs, **how).withColumn("n", F.rank().over(w)).where("n > 1 or salt > 0")
    return hits.groupBy("d", "t").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with its texts cut, and n_sentences and n_removed: a sentence goes when it lies in
    a run that occurs before, in an earlier place of the same text or in a text that comes
    first by doc_id (rows of one id by the hash of their text, null ids last).

    Of a passage that starts or ends inside a sentence, the words under hashed runs of words
    go from the sentences that stay: all but at most 17 words at each end. n_removed counts
    sentences that lose words, too.

    Every row stays, if with an empty text; null stays null with no sentences. Rows that repeat
    id and text are one occurrence and are cut alike. Other columns, whatever their names but
    n_sentences and n_removed, stay as they are.
    """
    own, names = hide(docs)
    d, t = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.hash("text")
    cuts = repeats(own.select(d.alias("d"), t.alias("t"), "text"), **how)
    cut = _cut(own.withColumns({"d": d, "t": t}).join(cuts, ["d", "t"], "left").select(*names, "cuts"), names.index("text"))
    stay = [(o, n) for o, n in zip(names, docs.columns, strict=True) if n not in ADDED]
    return cut.select(*[o for o, _ in stay], *ADDED).toDF(*[n for _, n in stay], *ADDED)


def _without(parts: list[str], drop: set[int], words: set[int]) -> tuple[str, int]:
    """The text without the sentences `drop` and the words `words`, each with the space after
    it, and how many sentences lost anything."""
    out, lost, at = [], len(drop), 0
    for i, p in enumerate(parts):
        if not words:
            out.append("" if i in drop else p)
            continue
        found = list(WORD.finditer(p))
        gone = {k for k in range(len(found)) if at + k in words}
        at += len(found)
        if i in drop:
            continue
        if gone:
            lost += 1
            ends = [m.start() for m in found[1:]] + [len(p)]
            end = "\n" if len(found) - 1 in gone and p.endswith("\n") else ""
            p = p[: found[0].start()] + "".join(p[m.start() : e] for k, (m, e) in enumerate(zip(found, ends, strict=True)) if k not in gone) + end
        out.append(p)
    return "".join(out), lost


def _cut(rows: DataFrame, at: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, gone = [], [], []
            for t, cuts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                parts = sentences(t)
                drop, words = set(), set()
                for c in cuts or ():
                    if c["last"] < 0:
                        words.update(range(c["first"], c["first"] + RUN_WORDS))
                    else:
                        drop.update(range(c["first"], c["last"] + 1))
                left, lost = _without(parts, drop, words)
                texts.append(left if lost else t)
                n.append(len(parts))
                gone.append(lost)
            cols = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "n_sentences", "n_removed"])

    fields = list(rows.schema.fields[:-1])
    fields[at] = StructField("text", StringType())
    return rows.mapInArrow(run, StructType([*fields, StructField("n_sentences", LongType()), StructField("n_removed", LongType())]))
