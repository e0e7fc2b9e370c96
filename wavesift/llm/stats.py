"""Word statistics of whole texts, the inputs of the learned quality operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wavesift.llm.common import WORD

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_chars", "n_lines", "n_upper", "n_distinct", "n_same", "n_bang", "n_pipe"]
WINDOW, LONG = 5, 200_000


def repeated_words(w: list[str], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that the text has twice or more."""
    if len(w) <= size:
        return 0
    if len(w) > LONG:  # the same count over numbered windows: tuples of a huge text don't fit
        codes: dict[str, int] = {}
        ids = np.fromiter((codes.setdefault(x, len(codes)) for x in w), dtype=np.int64, count=len(w))
        win = ids
        for k in range(1, size):
            win = np.unique(win[:-1] * len(codes) + ids[k:], return_inverse=True)[1]
        twice = np.flatnonzero(np.bincount(win)[win] > 1)
    else:
        wins = list(zip(*(w[k:] for k in range(size)), strict=False))
        if len(set(wins)) == len(wins):
            return 0
        seen = Counter(wins)
        twice = [i for i, x in enumerate(wins) if seen[x] > 1]
    total = end = 0
    for i in twice:
        total += i + size - max(i, end)
        end = i + size
    return int(total)


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; null counts as a text without words."""
    t = text or ""
    w = WORD.findall(t)
    lines = t.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for x in lines:
            if x in seen:
                dup += bool(WORD.search(x))
            seen.add(x)
    return (
        len(w), sum(map(len, w)), sum(map(t.count, SYMBOLS)), dup, repeated_words(w), len(t), len(lines),
        sum(map(str.isupper, w)), len(set(w)), sum(map(eq, w, w[1:])), t.count("!"), t.count("|"),
    )


def with_statistics(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the COUNTS of its column text, under prefix + name, and no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics_of(t) for t in b.column(at).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, np.ascontiguousarray(rows.T))], [*b.schema.names, *(prefix + c for c in COUNTS)])

    schema = StructType([*docs.schema.fields, *(StructField(prefix + c, LongType()) for c in COUNTS)])
    return docs.mapInArrow(run, schema)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS) for each row of docs; other columns are ignored."""
    return with_statistics(docs.select("doc_id", "text")).drop("text")


def features(prefix: str = "") -> dict[str, Column]:
    """What the learners may look at: ratios of the counts, never ids, labels or sources."""

    def _share(top: str, bottom: str) -> Column:
        return F.col(prefix + top) / F.greatest(F.col(prefix + bottom), F.lit(1)).cast("double")

    return {
        "f_words": F.col(prefix + "n_words").cast("double"),
        "f_word_length": _share("word_chars", "n_words"),
        "f_symbols": _share("n_symbols", "n_text_chars"),
        "f_dup_lines": _share("n_dup_lines", "n_lines"),
        "f_repeats": _share("n_repeat_words", "n_words"),
        "f_upper": _share("n_upper", "n_words"),
        "f_distinct": _share("n_distinct", "n_words"),
        "f_same": _share("n_same", "n_words"),
        "f_bang": _share("n_bang", "n_words"),
        "f_pipe": _share("n_pipe", "n_words"),
    }


def labelled_ids(labels: DataFrame, label: str, max_rows: int, where: Column | None = None) -> DataFrame:
    """(doc_id, _y): at most max_rows labelled ids, the ones with the least hash, so the same at
    any partitioning. Null ids and labels other than 0 and 1 are left out; of a repeated id
    the smallest label counts."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if where is not None:
        own = own.where(where)
    own = own.groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, max_rows: int, where: Column | None = None):
    """(X, y): features and 0/1 labels of the rows of labelled_ids(); of a repeated id its
    first row by statistics."""
    own = labelled_ids(labels, label, max_rows, where)
    names = features()
    rows = stats.join(F.broadcast(own), "doc_id")  # max_rows small rows at most
    rows = rows.select("doc_id", "_y", *[c.alias(n) for n, c in names.items()])
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("_y", *names)).alias("r")).select("r.*").toPandas()
    rows = rows.sort_values([*names, "_y"], ignore_index=True)
    return rows[[*names]].to_numpy(dtype=float).reshape(-1, len(names)), rows["_y"].to_numpy(dtype=int)


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 thresholds, each midway between two neighbouring distinct values."""
    u = np.unique(values)
    if len(u) < 2:
        return u[:0]
    at = np.searchsorted(u, np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]), side="right")
    at = np.unique(np.clip(at, 1, len(u) - 1))
    return (u[at - 1] + u[at]) / 2
