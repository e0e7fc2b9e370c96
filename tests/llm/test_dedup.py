"""Near-duplicates, substrings, embeddings and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from wavesift.llm import embeddings, simhash, substrings
from wavesift.llm.common import LOWER, WORD
from wavesift.llm.components import connected_components

DOCS = "doc_id long, text string, fingerprint string, component string, d string"


def closure(n, links):
    low = list(range(n))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return [root(i) for i in range(n)]


def words(rng, n):
    return " ".join(rng.choice(["ab", "Cd", "ef", "gh,", "ij", "kl", "mn", "op", "qr", "st", "uv", "wx", "yz"]) + str(rng.randint(0, 9)) for _ in range(n))


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(31, 30), (30, 31), (5, 5)], [(i, i // 2) for i in range(50) if i % 7]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = closure(60, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_components_ignore_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, 3)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(df).collect()} == {(2, 2), (3, 2)}


def slow_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [w] if len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    for t in [None, "", " \n", "one", "One two", "a b c", "É x\x0bY\x1cz w", *(words(rng, rng.randint(1, 60)) for _ in range(40)), "x y " * 9000]:
        assert simhash.fingerprint_of(t) == slow_fingerprint(t)
    assert simhash._signed(1 << 63) == -(1 << 63)


def test_every_close_pair_shares_a_block():
    rng = random.Random(2)
    masks = simhash.block_masks(6, 3)
    assert len(masks) == 20
    for _ in range(300):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not flip & m for m in masks)


@pytest.mark.parametrize("chunk", [8, 2048])
def test_links_of_a_crowded_neighbourhood(spark, chunk):
    """One dense ball of fingerprints, chains that only connect over others, and strangers."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)}
    values |= {base ^ (1 << b) - 1 for b in range(0, 40, 3)} | {0, 1}
    values = sorted(values)
    want = closure(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fingerprint long")
    at = {simhash._signed(v): i for i, v in enumerate(values)}
    links = [(at[r.a], at[r.b]) for r in simhash.link_fingerprints(df, chunk=chunk).collect()]
    assert all(want[a] == want[b] for a, b in links)
    assert closure(len(values), links) == want


def test_simhash_components(spark):
    rng = random.Random(4)
    long = [words(rng, 300) for _ in range(6)]
    rows = []
    for t in long:
        rows += [t, t, t.replace("ab", "ab ", 1), t + " end", t.upper()]
    rows += ["", None, " ", "short", "short one", "Short", "x" * 50_000]
    docs = [(i * 3 % 101 + 1, t, "f", "c", None) for i, t in enumerate(rows)] + [(None, long[0], "f", "c", "d"), (None, "nobody's text " * 30, "f", "c", "d")]
    df = spark.createDataFrame(docs, DOCS)
    f = [slow_fingerprint(d[1]) for d in docs]
    comp = closure(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
    low = {}
    for c, d in zip(comp, docs, strict=True):
        if d[0] is not None:
            low[c] = min(low.get(c, 1000), d[0])
    want = sorted((str(d[0]), simhash._signed(x), str(low.get(c))) for d, x, c in zip(docs, f, comp, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_components(df).collect())
    assert got == want
    assert simhash.simhash_components(df.limit(0)).count() == 0


# substrings


def slow_cut(rows):
    """Rows (id, text) in order: the texts without sentences of runs that occur before."""
    seen, out = set(), {}
    for d, t in rows:
        parts = substrings.sentences(t)
        n = [len(WORD.findall(p)) for p in parts]
        spans = {(i, j) for i in range(len(parts)) for j in range(i, min(i + 3, len(parts))) if sum(n[i : j + 1]) >= (50, 25, 1)[j - i]}
        gone = set()
        for i, j in sorted(spans):
            key = " ".join(w for p in parts[i : j + 1] for w in WORD.findall(p))
            if key in seen:
                gone |= set(range(i, j + 1))
            seen.add(key)
        out[d] = ("".join(p for i, p in enumerate(parts) if i not in gone) if gone else t, len(parts), len(gone))
    return out


def test_substrings(spark):
    rng = random.Random(6)
    sent = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n)) + rng.choice([". ", "!\n", "? "])
    passage = ["".join(sent(rng.randint(3, 30)) for _ in range(rng.randint(3, 7))) for _ in range(4)] + [sent(60), sent(30) + sent(30)]
    rows = [(i, "".join(rng.choice([sent(rng.randint(1, 20)), rng.choice(passage), "ok. "]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, "no end"), (64, "a. " * 3000), (65, "w " * 30000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, d string, h int").repartition(5)
    want = slow_cut(rows)
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in substrings.remove_repeats(df).collect()}
    assert got == want
    assert sum(x[2] for x in got.values()) > 50 and got[62][0] == ""
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_substrings_of_repeated_ids_and_null_ids(spark):
    t = "one two three four five six seven eight nine ten. " * 4 + "alpha beta gamma delta epsilon zeta eta theta iota kappa. "
    rows = [(1, t), (1, t), (None, t), (2, t)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in got) == sorted([("1", t[:50] + t[200:], 3), ("1", t[:50] + t[200:], 3), ("2", "", 5), ("None", "", 5)])


def test_substrings_keep_columns_of_any_name(spark):
    t = "one two three four five. six seven. eight nine ten. "
    df = spark.createDataFrame([(1, t, "a", 2, "c", 4), (2, t, "b", 3, "d", 5)], "doc_id long, text string, _d string, _t long, _cuts string, D long")
    got = substrings.remove_repeats(df)
    assert got.columns == [*df.columns, "n_sentences", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, t, "a", 2, "c", 4, 3, 0), (2, "", "b", 3, "d", 5, 3, 3)]


def test_passages_are_caught_wherever_they_stand():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randint(1, 24) for _ in range(30)]
        inner = [f"{'q%d ' % i * n}end. " for i, n in enumerate(sizes)]
        while sum(len(WORD.findall(x)) for x in inner) > 60:
            inner.pop()
        if sum(len(WORD.findall(x)) for x in inner) <= 50 or len(inner) < 2:
            continue
        spans = {h: (i, j) for i, j, h, _ in substrings.runs(inner)}
        around = [f"z{k} z. " for k in range(5)] + inner + ["y y. "] * 4
        hit = {k for i, j, h, _ in substrings.runs(around) if h in spans for k in range(i, j + 1)}
        assert hit >= set(range(5, 5 + len(inner)))


# embeddings


def test_calibration():
    chance = embeddings.collision_chance(0.3162, 4 * 0.3162, 2.5 * 0.3162, 10)
    assert 0.09 < chance < 0.12
    r = embeddings.sqrt(2 - 2 * 0.95)
    assert embeddings.calibrated_count(96, embeddings.collision_chance(r, 6 * r, 2.5 * r, 14), 0.99) >= 5
    rng = np.random.default_rng(0)
    q = rng.normal(size=(20000, 11)) * 0.3162
    shift = rng.uniform(0, 1.2648, (20000, 10))
    same = (np.floor((q[:, :10] + shift) / 1.2648) == np.floor(shift / 1.2648)).all(1) & (np.abs(q[:, 10]) <= 0.7905)
    assert abs(same.mean() - chance) < 0.01
    assert embeddings.calibrated_count(64, chance, 0.99) == 2 and embeddings.calibrated_count(1, 0.1, 0.99) == 1


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 32))
    x = np.concatenate([base[rng.integers(0, 40)] + rng.normal(size=(1, 32)) * rng.choice([0.05, 0.2, 0.3]) for _ in range(300)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, x[5].tolist()) for i in range(30)]
    odd = [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [float("inf")] * 32, [1.0, 2.0], (2 * x[7]).tolist()]
    rows += [(400 + i, v) for i, v in enumerate(odd)] + [(None, x[5].tolist())]
    df = spark.createDataFrame([(i, v, None, 1) for i, v in rows], "vec_id long, embedding array<float>, a string, cid int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in ok])
    near = u @ u.T >= 0.95
    found = sum(got[i].n_links for i, _ in ok)
    assert found <= near.sum() - len(ok) and found >= 0.98 * (near.sum() - len(ok))
    for i in (5, 7, 330 - 1):
        at = next(k for k, (j, _) in enumerate(ok) if j == i)
        assert got[i].n_links == near[at].sum() - 1
    for i in range(400, 407):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].kept is False and got[None].n_links == got[5].n_links
    assert got[407].component_id == got[7].component_id
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id is not None)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_crowded_cells_give_the_same_pairs(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(1, 16)) + rng.normal(size=(150, 16)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cid long, embedding array<float>")
    how = dict(window=0.8, tables=3, grids=2, width=1.2, seed=1)
    rows = [sorted(tuple(r) for r in embeddings.collisions(df, chunk=c, **how).collect()) for c in (10, 5000)]
    assert rows[0] == rows[1] and len(rows[0]) > 1000
