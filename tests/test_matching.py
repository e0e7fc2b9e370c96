"""Answers against NumPy brute force, and indexed against scanned."""

import numpy as np
import pytest

from wavesift.engine import Engine
from wavesift.functions import windows
from wavesift.model import Query, band_of
from wavesift.operators import answers, index, kernels, probe, verify
from wavesift.plans import planner
from wavesift.sources import series


def table(spark, values, name="s"):
    return spark.createDataFrame([(name, i + 1, float(v)) for i, v in enumerate(values)], "series_id string, pos long, value double")


def slow_dtw(a, b, rho):
    m = len(b)
    c = np.full((m + 1, m + 1), np.inf)
    c[0, 0] = 0
    for i in range(1, m + 1):
        for j in range(max(1, i - rho), min(m, i + rho) + 1):
            c[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    return c[m, m]


def brute(values, q, query):
    m, out = len(q), {}
    for p in range(len(values) - m + 1):
        x, y = np.asarray(values[p : p + m], float), np.asarray(q, float)
        if query.normal:
            if x.std() < 1e-12 or y.std() < 1e-12:
                continue
            if query.constrained and not (abs(x.mean() - y.mean()) <= query.beta and 1 / query.alpha <= x.std() / y.std() <= query.alpha):
                continue
            x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        d = slow_dtw(x, y, query.band(m)) if query.warped else ((x - y) ** 2).sum()
        if d <= query.eps**2:
            out[p + 1] = np.sqrt(d)
    return out


def same(found, want):
    got = {r.pos: r.dist for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-6 for p in want)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(5)
    v = np.cumsum(rng.normal(0, 0.3, 900))
    v[300:330] = v[300]  # a constant run
    v[500:560] = v[100:160] + 0.01
    return v.round(4)


CASES = [
    Query("RSM-ED", 6.0), Query("NSM-ED", 5.0), Query("cNSM-ED", 5.0, alpha=1.6, beta=1.0), Query("cNSM-ED", 4.0, alpha=1.0, beta=20.0),
    Query("RSM-DTW", 3.0, rho=3), Query("cNSM-DTW", 3.0, rho=2, alpha=1.5, beta=2.0), Query("RSM-DTW", 3.0, rho=0), Query("RSM-ED", 0.0),
]


@pytest.mark.parametrize("query", CASES, ids=str)
@pytest.mark.parametrize("m", [25, 54])
def test_scan_and_index_agree_with_brute_force(spark, walk, query, m):
    s = table(spark, walk)
    q = walk[99 : 99 + m]
    want = brute(walk, q, query)
    assert want.get(100) == pytest.approx(0, abs=1e-9)  # a query cut from the series finds itself
    same(verify.scan(s, q, query, size=64), want)
    rows = index.build(s, (25, 50))
    got = Engine(s, index_rows=rows).query(query, q)
    same(got.found, want)
    if query.kind != "NSM-ED":
        assert got.plan
        assert {r.start for r in got.candidates.collect()} >= want.keys()


@pytest.mark.parametrize("m", [31, 32, 49, 50, 51, 70])
def test_lengths_around_the_windows(spark, walk, m):
    s = table(spark, walk)
    rows = index.build(s, (25, 50))
    query = Query("RSM-ED", 4.0)
    same(Engine(s, index_rows=rows).query(query, offset=len(walk) - m + 1, length=m).found, brute(walk, walk[-m:], query))


def test_index_with_merged_rows_gives_the_same_answers(spark, walk):
    s = table(spark, walk)
    rows = index.build(s, (25, 50))
    merged = index.merge_rows(rows)
    assert merged.groupBy("w", "key").count().count() < rows.groupBy("w", "key").count().count()
    for kind in ("left", "right"):
        assert merged.selectExpr(f"min({kind})").first() == rows.selectExpr(f"min({kind})").first()
    query = Query("RSM-ED", 5.0)
    same(Engine(s, index_rows=merged).query(query, offset=100, length=60).found, brute(walk, walk[99:159], query))


def test_islands_cover_every_window_once(spark, walk):
    s = table(spark, walk)
    rows = index.build(s, (25, 400)).collect()
    for w in (25, 400):
        at = sorted(p for r in rows if r.w == w for p in range(r.left, r.right + 1))
        assert at == list(range(1, len(walk) - w + 2))
        for r in rows:
            if r.w == w:
                means = [walk[p - 1 : p - 1 + w].mean() for p in range(r.left, r.right + 1)]
                assert all(r.lo - 1e-9 <= x < r.hi + 1e-9 for x in means)


def test_saved_index(spark, walk, tmp_path):
    s = table(spark, walk)
    index.save(index.build(s, (25, 50)), str(tmp_path))
    rows, meta = index.load(spark, str(tmp_path))
    assert meta.selectExpr("max(cum_off)").first()[0] == len(walk) - 24
    query = Query("RSM-ED", 5.0)
    same(Engine(s, index_rows=rows, meta=meta).query(query, offset=7, length=77).found, brute(walk, walk[6:83], query))


def test_bucket_edges_of_negative_means(spark):
    got = index.bucketed(windows.sliding(table(spark, [-0.5, -1.4, -1.9, 0.0, 0.5, 0.49]), (1,), 100), 0.5, 100)
    assert [r.key * 0.5 for r in got.orderBy("pos").collect()] == [-0.5, -1.5, -2.0, 0.0, 0.5, 0.0]


def test_lower_bounds_are_below_the_distance(spark, walk):
    for rho in (0, 1, 4, 19, 40):
        for r in verify.bounds(table(spark, walk[:200]), walk[50:70], rho, size=32).collect():
            assert max(r.kim, r.keogh_query, r.keogh_data, r.paa) <= r.dtw + 1e-9


def test_dtw_kernel():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(40, 23)), rng.normal(size=23)
    for rho in (0, 1, 5, 22):
        want = [slow_dtw(a, q, rho) for a in x]
        np.testing.assert_allclose(kernels.dtw(x, q, rho), want)
        most = float(np.median(want))
        got = kernels.dtw(x, q, rho, most)
        np.testing.assert_allclose(got[np.array(want) <= most], [w for w in want if w <= most])
    np.testing.assert_allclose(kernels.dtw(x, q, 0), kernels.euclidean(x, q))


def test_query_longer_than_the_series_or_equal(spark):
    s = table(spark, range(30))
    assert Engine(s, index_rows=index.build(s, (25,))).query(Query("RSM-ED", 100.0), np.arange(31.0)).found.count() == 0
    assert Engine(s).query(Query("RSM-ED", 1.0), np.arange(30.0)).found.count() == 1
    assert index.build(table(spark, range(10)), (25,)).count() == 0
    with pytest.raises(ValueError):
        Engine(s).query(Query("RSM-ED", 1.0), offset=20, length=12)
    with pytest.raises(ValueError):
        Engine(s).query(Query("RSM-ED", 1.0), offset=0, length=5)


def test_query_checks():
    for bad in (dict(kind="XX", eps=1), dict(kind="RSM-ED", eps=-1), dict(kind="cNSM-ED", eps=1, alpha=0.5), dict(kind="RSM-DTW", eps=1, rho=-1)):
        with pytest.raises(ValueError):
            Query(**bad)
    assert Query("RSM-DTW", 1, rho=99).band(10) == 9
    assert band_of(0.05, 100) == 5 and band_of(1, 30) == 30 and band_of(7, 30) == 7


def test_overlap_removal(spark):
    rows = [("s", 1, 5.0), ("s", 10, 1.0), ("s", 19, 2.0), ("s", 20, 3.0), ("s", 29, 2.5), ("t", 11, 9.0)]
    a = spark.createDataFrame(rows, "series_id string, pos long, dist double")
    got = sorted((r.series_id, r.pos) for r in answers.without_overlap(a, 10).collect())
    assert got == [("s", 10), ("s", 20), ("t", 11)] or got == [("s", 10), ("s", 29), ("t", 11)]
    want, kept = [r for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[0] == "s"], []
    for r in want:
        if all(abs(r[1] - k) >= 10 for k in kept):
            kept.append(r[1])
    assert sorted(p for s, p in got if s == "s") == sorted(kept)


def test_plan_is_disjoint_and_ordered(spark, walk):
    stats = planner.Statistics.of(index.statistics(index.build(table(spark, walk), (25, 50, 100))))
    plan = planner.plan(Query("RSM-ED", 5.0), walk[:256], stats)
    assert len(plan) >= 3
    used = sorted((s.first, s.first + s.w) for s in plan)
    assert all(a[1] <= b[0] for a, b in zip(used, used[1:], strict=False)) and used[-1][1] <= 256
    assert [s.intervals for s in plan] == sorted(s.intervals for s in plan)
    assert planner.plan(Query("RSM-ED", 5.0), walk[:20], stats) == []


@pytest.mark.parametrize("query", [Query("cNSM-ED", 4.0, alpha=1.2, beta=3.0), Query("cNSM-DTW", 2.5, rho=2, alpha=1.2, beta=3.0), Query("cNSM-ED", 4.0, alpha=1.0, beta=0.0)], ids=str)
def test_bounds_by_parts_of_beta_keep_what_can_match(spark, walk, query):
    q = walk[100:175]
    rows = index.build(table(spark, walk), (25, 50))
    stats = planner.Statistics.of(index.statistics(rows))
    plan = planner.plan(query, q, stats)
    want = brute(walk, q, query).keys()
    by_ranges = None
    for s in plan:
        own = {p - s.first for r in rows.where(f"w = {s.w}").collect() if r.hi >= s.lo and r.lo <= s.hi for p in range(r.left, r.right + 1)}
        by_ranges = own if by_ranges is None else by_ranges & own
    by_ranges = {p for p in by_ranges if 1 <= p <= len(walk) - len(q) + 1}
    sizes = [len(by_ranges)]
    for parts in (1, 4, 16):
        got = {r.start for r in probe.candidates(rows, plan, query, len(walk), len(q), q=q, parts=parts).collect()}
        assert want <= got <= by_ranges
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True) and (sizes[-1] < sizes[0] or not query.beta)
    assert probe.range_union([plan[0], plan[0]]) == {plan[0].w: [(plan[0].lo, plan[0].hi)]}


@pytest.mark.parametrize("kind", ["RSM-ED", "RSM-DTW"])
def test_ranges_cut_by_the_other_segments_lose_no_answer(spark, walk, kind):
    at = min(max(int(walk.argmax()) - 37, 0), len(walk) - 75)
    q = walk[at : at + 75].copy()
    q[25:50] = walk.max() + 1.2  # no bucket of the index is near the mean here
    query = Query(kind, 1.05 * float(np.sqrt(((q - walk[at : at + 75]) ** 2).sum())), rho=2)
    s = table(spark, walk)
    rows = index.build(s, (25,))
    stats = planner.Statistics.of(index.statistics(rows))
    want = brute(walk, q, query)
    assert want
    same(Engine(s, index_rows=rows).query(query, q).found, want)
    whole = [planner.segment(query, q, stats, i, 25, *(float(e[i : i + 25].mean()) for e in planner.envelope(q, query.band(75)))) for i in (0, 25, 50)]
    cut = planner.tightened(whole, query, q, stats)
    assert sum(x.hi - x.lo for x in cut) < sum(x.hi - x.lo for x in whole)
    assert {r.start for r in probe.candidates(rows, cut, query, len(walk), 75).collect()} >= want.keys()


def test_plan_has_the_least_mean_log_selectivity(spark, walk):
    """Against every way to cut a short query."""
    stats = planner.Statistics.of(index.statistics(index.build(table(spark, walk), (25, 50, 100))))
    for m, at in ((100, 0), (151, 240), (200, 480)):
        query, q = Query("RSM-ED", 3.0), walk[at : at + m]
        n = m // 25

        def ways(i, q=q, query=query, n=n):
            if i >= n:
                yield []
                return
            yield from ways(i + 1)
            for w in (25, 50, 100):
                if i + w // 25 <= n:
                    mean = float(q[i * 25 : i * 25 + w].mean())
                    lo, hi = mean - query.eps / w**0.5, mean + query.eps / w**0.5
                    k = sum(int(c) for c, a, b in zip(np.diff(stats.by[w][2]), *stats.by[w][:2], strict=True) if b >= lo and a <= hi)
                    for rest in ways(i + w // 25):
                        yield [np.log(max(k, 0.5) / stats.total(w)), *rest]

        least = max(1, min((int(np.log2(m)) - 1) // 2, n))
        best = min(np.mean(x) for x in ways(0) if len(x) >= least)
        got = planner.plan(query, q, stats)
        assert len(got) >= least
        assert np.mean([np.log(max(s.intervals, 0.5) / stats.total(s.w)) for s in got]) == pytest.approx(best)


@pytest.mark.parametrize("few, gain", [(1.2, 0.8), (3.0, 0.95)])
def test_row_merge_against_a_fold_over_intervals(spark, walk, few, gain):
    """The rule on the intervals themselves, from the greatest key down, a width at a time."""
    rows = index.build(table(spark, walk), (25, 50))
    got = {(r.w, r.key, r.lo, r.hi, r.left, r.right) for r in index.merge_rows(rows, few, gain).collect()}
    want = set()
    for w in (25, 50):
        by: dict = {}
        for r in rows.where(f"w = {w}").collect():
            by.setdefault(r.key, []).append((r.left, r.right))
        average = sum(map(len, by.values())) / len(by)
        done: list = []  # [least key, greatest key, intervals]
        for key in sorted(by, reverse=True):
            own = by[key]
            if done:
                union: list = []
                for a, b in sorted(done[-1][2] + own):
                    if union and a <= union[-1][1] + 1:
                        union[-1] = (union[-1][0], max(b, union[-1][1]))
                    else:
                        union.append((a, b))
                if len(own) < few * average and len(union) < gain * (len(done[-1][2]) + len(own)):
                    done[-1] = [key, done[-1][1], union]
                    continue
            done.append([key, key, own])
        want |= {(w, k, k * 0.5, top * 0.5 + 0.5, a, b) for k, top, x in done for a, b in x}
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 64])
def test_union_over_ends_of_blocks(spark, block):
    rng = np.random.default_rng(block)
    rows = [(s, int(a), int(a + n)) for s in "st" for a, n in zip(rng.integers(1, 300, 40), rng.integers(0, 9, 40), strict=True)] + [("t", 50, 180)]
    for gap in (1, 3):
        got = {tuple(r) for r in index.coalesce(spark.createDataFrame(rows, "series_id string, left long, right long"), ["series_id"], gap, block + gap).collect()}
        want: list = []
        for s, a, b in sorted(rows):
            if want and want[-1][0] == s and a <= want[-1][2] + gap:
                want[-1] = (s, want[-1][1], max(b, want[-1][2]))
            else:
                want.append((s, a, b))
        assert got == set(want)


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_overlap_removal_over_ends_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(answers, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(s, int(p), float(d)) for s in "st" for p, d in zip(rng.choice(600, 90, replace=False), rng.integers(0, 50, 90), strict=True)]
    got = {(r.series_id, r.pos) for r in answers.without_overlap(spark.createDataFrame(rows, "series_id string, pos long, dist double"), 12).collect()}
    kept: list = []
    for s, p, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if all(s != t or abs(p - k) >= 12 for t, k in kept):
            kept.append((s, p))
    assert got == set(kept)


def test_metrics_are_added_to_those_there(spark, walk, tmp_path):
    s = table(spark, walk)
    path = str(tmp_path / "runs")
    for eps in (2.0, 5.0):
        run = Engine(s, index_rows=index.build(s, (25,))).query(Query("RSM-ED", eps), offset=100, length=60).metrics()
        answers.write_metrics(spark.createDataFrame([run]), path)
    got = spark.read.option("header", True).option("inferSchema", True).csv(path).orderBy("answers").collect()
    assert [r.answers for r in got] == [len(brute(walk, walk[99:159], Query("RSM-ED", e))) for e in (2.0, 5.0)]
    assert all(r.candidates >= r.answers for r in got)


def test_chunks_and_halos(spark):
    s = table(spark, range(1, 101))
    for size, more in ((10, 25), (7, 0), (64, 3), (100, 50)):
        rows = series.with_halo(series.to_chunks(s, size), size, more).collect()
        for r in rows:
            assert r.vals == [float(x) for x in range(r.start, min(r.start + size + more, 101))]
        assert sorted(r.start for r in rows) == list(range(1, 101, size))


@pytest.mark.parametrize("listed", [64, 0])
def test_only_chunks_with_candidates_are_verified(spark, monkeypatch, listed):
    """Candidates in few of many chunks, windows over chunk ends: as brute force."""
    monkeypatch.setattr(verify, "LISTED", listed)
    rng = np.random.default_rng(2)
    x = rng.normal(size=5000).cumsum()
    table = spark.createDataFrame([("s", i + 1, float(v)) for i, v in enumerate(x)], "series_id string, pos long, value double")
    q = x[990:1230]
    starts = [1, 95, 100, 101, 991, 1000, 3333, 4761]
    cand = spark.createDataFrame([("s", s) for s in starts], "series_id string, start long")
    got = {r.pos: r.dist for r in verify.check(table, cand, q, Query("RSM-ED", 1e6), size=100).collect()}
    want = {s: float(np.sqrt(((x[s - 1 : s + 239] - q) ** 2).sum())) for s in starts}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    plan = verify.check(table, cand, q, Query("RSM-ED", 1.0), size=100)._jdf.queryExecution().toString()
    assert "left_semi" in plan.lower().replace(" ", "_") or "LeftSemi" in plan or listed
