"""Near copies of the pipeline against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from wavesift.llm import simhash
from wavesift.llm.common import LOWER, WORD


def slow_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def slow_kept(rows):
    """Ids of rows (id, text): the smallest of each component of pairs at 0.8 or more."""
    sets = [slow_set(t) for _, t in rows]
    low = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if low[i] != low[j] and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((low[i], low[j]))
                low = [x if k == y else k for k in low]
    best = {}
    for (d, _), k in zip(rows, low, strict=True):
        best[k] = min(best.get(k, d), d)
    return sorted(best.values())


def prose(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, w, n):
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"n{rng.randint(0, 10**6)}"
    return w


@pytest.mark.parametrize("chunk", [8, 1024])
def test_near_copies_of_the_stage(spark, chunk):
    """Copies on both sides of 0.8, chains, exact copies, short and empty texts."""
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.randint(60, 300))
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.06):
            rows.append(" ".join(edited(rng, base, int(share * len(base)))))
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, max(1, len(chain) // 70))
            rows.append(" ".join(chain))
    rows += [rows[0], rows[0].upper(), "", None, " \n", "one two", "One  two", "one three", "a b c d e", "a b c d f"]
    docs = [(i * 37 % 1009, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(d, t, None) for d, t in docs], "doc_id long, text string, d string").repartition(3)
    got = simhash.drop_near_copies(df, chunk=chunk)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == slow_kept(docs)
    if chunk == 1024:
        stage = corpus_pipeline.near_dedup(spark, df, "")
        assert sorted(r.doc_id for r in stage.collect()) == slow_kept(docs)
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_repeated_and_null_ids_keep_one_row_a_component(spark):
    a, b, c = ("x1 x2 x3 x4 x5 x6", "y1 y2 y3 y4 y5 y6", "z1 z2 z3 z4 z5 z6")
    rows = [(1, a), (1, b), (1, a), (2, a), (None, b), (None, c), (None, c)]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", a), ("1", b), ("None", c)]


def test_recall_of_the_blocks_at_the_threshold():
    rng = np.random.default_rng(9)
    width, blocks, radius = simhash.plan_blocks(200_000, 0.8)
    assert width == 20 and 85 < blocks < 110 and 15 < radius < 22
    sets = [rng.integers(0, 1 << 63, 1100, dtype=np.uint64) for _ in range(400)]
    a, b = (np.stack([np.unpackbits(np.frombuffer(simhash.wide_fingerprint(np.unique(x[s])), np.uint8)) for x in sets]) for s in (slice(0, 990), slice(110, 1100)))  # 880 of 1100 are shared
    assert abs((a == b).mean() - simhash.bit_agreement(0.8)) < 0.01
    same = np.stack([(a[:, o] == b[:, o]).all(1) for o in simhash._orders(width, blocks)]).any(0)
    assert (same & ((a != b)[:, :64].sum(1) <= radius)).mean() >= 0.93


def test_close_pairs_share_a_block_of_one_shuffle():
    rng = random.Random(3)
    each = simhash._orders(20, 25)
    assert len({p for o in each for p in o.tolist()}) == 500
    for _ in range(100):
        flip = set(rng.sample(range(512), 24))
        assert any(not flip & set(o.tolist()) for o in each)


def test_crowded_blocks_lose_no_candidate(spark):
    """A ball of many near fingerprints in several batches: one component, by local links too."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 64, dtype=np.uint8)
    rows = []
    for i in range(5000):
        x = np.unpackbits(base)
        x[rng.integers(0, 512, 20)] ^= 1
        rows.append((i, bytearray(np.packbits(x).tobytes())))
    rows += [(10_000 + i, bytearray(rng.bytes(64))) for i in range(300)]
    df = spark.createDataFrame(rows, "node long, wide binary").repartition(6)
    links = [(r.a, r.b) for r in simhash.candidate_links(df, 0.8).collect()]
    low = list(range(10_300))
    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    assert len({root(i) for i in range(5000)}) == 1


def test_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 5, "x", "y", 7), (2, "a b c d e f", 6, "x", "y", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node long, _row string, _group string, Wide long")
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [rows[0]]
