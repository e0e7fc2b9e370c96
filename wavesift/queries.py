"""Queries over the test tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.engine import Engine
from wavesift.functions import windows
from wavesift.model import WINDOWS, Query
from wavesift.operators import answers, index, probe, verify
from wavesift.plans import planner
from wavesift.sources import generators, series
from wavesift.sources.scratch import materialize

OFFSET, SCALE, D = 201, 10_000, 0.5
#: Line numbers repeat in some orders, so an order of lines takes more columns.
LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of events, in the order of their ids."""
    return series.from_table(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", F.col("event_id") + 1)


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their running sum of (value - 50) / 100, exact to four decimals."""
    cents = events(spark, sf_dir).withColumn("value", F.round(F.col("value") * 100) - 5000)
    return series.running_sum(cents).withColumn("value", F.col("value") / SCALE)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each user, in the order of time."""
    return series.numbered(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["ts", "event_id"], "user_id")


def _found(df: DataFrame) -> DataFrame:
    return df.select("pos", F.round("dist", 6).alias("dist"))


SER = "ser AS (SELECT event_id + 1 AS pos, value FROM events)"
WALK = "ser AS (SELECT event_id + 1 AS pos, CAST(SUM(CAST(round(value * 100) AS BIGINT) - 5000) OVER (ORDER BY event_id) AS BIGINT) / 10000.0 AS value FROM events)"

#: name: series, kind, m, eps, and more of Query.
MATCHES = {
    "rsm_ed": ("events", "RSM-ED", 128, dict(eps=690.0)),
    "rsm_ed_walk": ("walk", "RSM-ED", 128, dict(eps=14.03)),
    "nsm_ed": ("events", "NSM-ED", 64, dict(eps=8.6)),
    "cnsm_ed": ("events", "cNSM-ED", 64, dict(eps=8.6, alpha=1.5, beta=10.0)),
    "cnsm_ed_walk": ("walk", "cNSM-ED", 128, dict(eps=4.03, alpha=1.5, beta=2.0)),
    "rsm_dtw": ("events", "RSM-DTW", 32, dict(eps=210.0, rho=1)),
    "rsm_dtw_walk": ("walk", "RSM-DTW", 50, dict(eps=4.03, rho=2)),
    "cnsm_dtw": ("events", "cNSM-DTW", 32, dict(eps=3.5, rho=1, alpha=1.5, beta=10.0)),
    "cnsm_dtw_walk": ("walk", "cNSM-DTW", 50, dict(eps=1.53, rho=2, alpha=1.5, beta=2.0)),
}


def _query(name: str) -> tuple[Callable, int, Query]:
    of, kind, m, more = MATCHES[name]
    return globals()[of], m, Query(kind, **more)


def _scan(name: str, pieces: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        of, m, query = _query(name)
        s = of(spark, sf_dir)
        return _found(verify.scan(s, series.fetch(s, OFFSET, m), query, pieces))

    return run


def _indexed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        of, m, query = _query(name)
        s = of(spark, sf_dir)
        rows = materialize(index.build(s, (25, 50), D, SCALE), "index")
        return _found(Engine(s, index_rows=rows).query(query, offset=OFFSET, length=m).found)

    return run


def _match_sql(name: str) -> str:
    of, kind, m, more = MATCHES[name]
    query = Query(kind, **more)
    ser = WALK if of == "walk" else SER
    eps2 = repr(query.eps**2)
    q = f"q AS (SELECT pos - {OFFSET} AS j, value FROM ser WHERE pos BETWEEN {OFFSET} AND {OFFSET + m - 1})"
    stats = f"""st AS (SELECT pos, avg(value) OVER f AS mu, stddev_pop(value) OVER f AS sd, count(*) OVER f AS n FROM ser
        WINDOW f AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)), qs AS (SELECT mu AS mq, sd AS sq FROM st WHERE pos = {OFFSET})"""
    keep = "n = " + str(m) + " AND sd > 1e-12"
    if query.constrained:
        keep += f" AND abs(mu - mq) <= {query.beta!r} AND sd / sq BETWEEN {1 / query.alpha!r} AND {query.alpha!r}"
    starts = f"ok AS (SELECT pos, mu, sd, mq, sq FROM st, qs WHERE {keep})" if query.normal else f"ok AS (SELECT pos, 0.0 AS mu, 1.0 AS sd, 0.0 AS mq, 1.0 AS sq FROM st, qs WHERE n = {m})"
    if not query.warped:
        return f"""WITH {ser}, {q}, {stats}, {starts}
            SELECT ok.pos AS pos, round(sqrt(sum(power((s.value - mu) / sd - (q.value - mq) / sq, 2))), 6) AS dist
            FROM ok CROSS JOIN q JOIN ser s ON s.pos = ok.pos + q.j GROUP BY ok.pos
            HAVING sum(power((s.value - mu) / sd - (q.value - mq) / sq, 2)) <= {eps2}"""
    rho = query.band(m)
    cell = "power(a[i] - b[d + 1 - i], 2)"
    step = f"""list_transform(range(1, {m + 1}), lambda i: CASE WHEN d + 1 - i BETWEEN 1 AND {m} AND abs(2 * i - d - 1) <= {rho}
        THEN least(coalesce(p1[i - 1], 1e20), p1[i], coalesce(p2[i - 1], 1e20)) + {cell} ELSE 1e20 END)"""
    return f"""WITH RECURSIVE {ser}, {q}, {stats}, {starts},
        w AS (SELECT ok.pos, list((s.value - mu) / sd ORDER BY s.pos) AS a FROM ok JOIN ser s ON s.pos BETWEEN ok.pos AND ok.pos + {m - 1} GROUP BY ok.pos),
        b AS (SELECT list((value - mq) / sq ORDER BY j) AS b FROM q, {"qs" if query.normal else "(SELECT 0.0 AS mq, 1.0 AS sq)"}),
        dia AS (
            SELECT pos, a, b, 2 AS d, list_transform(range(1, {m + 1}), lambda i: CASE WHEN i = 1 THEN power(a[1] - b[1], 2) ELSE 1e20 END) AS p1,
                list_transform(range(1, {m + 1}), lambda i: 1e20) AS p2 FROM w, b
            UNION ALL SELECT pos, a, b, d + 1, {step}, p1 FROM dia WHERE d < {2 * m})
        SELECT pos, round(sqrt(p1[{m}]), 6) AS dist FROM dia WHERE d = {2 * m} AND p1[{m}] <= {eps2}"""


# sliding windows


def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.sliding(events(spark, sf_dir), WINDOWS)
    return got.select("w", "pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = index.bucketed(windows.sliding(events(spark, sf_dir), (50,), 100), D, 100)
    return got.groupBy("key").agg(F.count("*").alias("n"))


def _islands_sql(widths: tuple[int, ...], ser: str = WALK, scale: int = SCALE) -> str:
    each = " UNION ALL ".join(
        f"SELECT {w} AS w, pos, CAST(floor(sum(CAST(round(value * {scale}) AS BIGINT)) OVER f{w} / {float(round(w * D * scale))}) AS BIGINT) AS key, count(*) OVER f{w} AS n FROM ser WINDOW f{w} AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
        for w in widths
    )
    return f"""{ser}, win AS (SELECT * FROM ({each}) WHERE n = w),
        grp AS (SELECT w, key, pos, pos - row_number() OVER (PARTITION BY w, key ORDER BY pos) AS g FROM win),
        isl AS (SELECT w, key, min(pos) AS lft, max(pos) AS rgt FROM grp GROUP BY w, key, g)"""


def index_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(walk(spark, sf_dir), WINDOWS, D, SCALE).select("w", "key", "left", "right")


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(index.build(walk(spark, sf_dir), WINDOWS, D, SCALE)).select("w", "key", "n_int", "n_off", "cum_int", "cum_off")


def index_row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = index.row_summary(index.statistics(index.build(walk(spark, sf_dir), WINDOWS, D, SCALE)))
    return got.select("w", "n_rows", F.round("average", 6).alias("average"), "least", "most")


def index_row_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(index.build(walk(spark, sf_dir), WINDOWS, D, SCALE), "index")
    return index.merge_rows(rows).select("w", "key", "lo", "hi", "left", "right")


def index_range_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.build(walk(spark, sf_dir), (50,), D, SCALE)
    gap = F.greatest(F.lit(1.25) - F.col("hi"), F.col("lo") - F.lit(1.25), F.lit(0.0))
    return index.read_keys(rows, 50, -4, 6).select("key", "left", "right", F.round(50 * gap * gap, 6).alias("lb"))


def _two_segments() -> list[planner.Segment]:
    return [planner.Segment(0, 50, 0.0, 0.0, -3.0, 4.0, 0), planner.Segment(50, 25, 0.5, 0.5, -2.0, 3.0, 0)]


def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = walk(spark, sf_dir)
    rows = index.build(s, (25, 50), D, SCALE)
    n = s.agg(F.max("pos")).first()[0]
    got = probe.candidates(rows, _two_segments(), Query("RSM-ED", eps=20.0), n, 75)
    return got.select("start", F.round("lb", 6).alias("lb"))


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.build(walk(spark, sf_dir), (25,), D, SCALE)
    return index.coalesce(rows.where("key between -4 and 3").select("series_id", "left", "right"), ["series_id"]).select("left", "right")


def interval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.split(index.build(walk(spark, sf_dir), (400,), D, SCALE), 20).select("key", "left", "right")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.envelope(events(spark, sf_dir), 5).select("pos", "lower", "upper")


BOUND_M, BOUND_RHO, BOUND_PIECES = 16, 2, 4


def lower_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir)
    got = verify.bounds(s, series.fetch(s, OFFSET, BOUND_M), BOUND_RHO, BOUND_PIECES)
    return got.select("pos", *[F.round(c, 6).alias(c) for c in ("kim", "keogh_query", "keogh_data", "paa", "dtw")])


def keogh_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Keogh bound as a column expression, without a kernel."""
    s = events(spark, sf_dir)
    lower, upper = planner.envelope(series.fetch(s, OFFSET, BOUND_M), BOUND_RHO)
    w = windows.window_values(s, BOUND_M)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return w.select("pos", F.round(windows.excess(F.col("vals"), lit(lower), lit(upper)), 6).alias("keogh_query"))


def _bounds_sql(cols: str) -> str:
    m, rho = BOUND_M, BOUND_RHO
    env = lambda f, v: f"list_transform(range(1, {m + 1}), lambda i: list_{f}({v}[greatest(i - {rho}, 1):least(i + {rho}, {m})]))"
    over = lambda v, lo, up: f"list_sum(list_transform(range(1, {m + 1}), lambda i: power(greatest({v}[i] - {up}[i], {lo}[i] - {v}[i], 0), 2)))"
    piece = m // BOUND_PIECES
    mean = lambda v: f"list_transform(range(0, {BOUND_PIECES}), lambda k: list_avg({v}[k * {piece} + 1:k * {piece} + {piece}]))"
    d = lambda i, j: f"power(a[{i}] - b[{j}], 2)"
    kim = [d(1, 1), d(m, m)]
    for at in (lambda k: k + 1, lambda k: m - k):
        for k in (1, 2):
            kim.append("least(" + ", ".join([d(at(k), at(i)) for i in range(k + 1)] + [d(at(i), at(k)) for i in range(k)]) + ")")
    return f"""WITH RECURSIVE {SER},
        b AS (SELECT list(value ORDER BY pos) AS b FROM ser WHERE pos BETWEEN {OFFSET} AND {OFFSET + m - 1}),
        w AS (SELECT pos, list(value) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS a FROM ser),
        e AS (SELECT pos, a, b, {env("min", "b")} AS lq, {env("max", "b")} AS uq, {env("min", "a")} AS ls, {env("max", "a")} AS us FROM w, b WHERE len(a) = {m}),
        p AS (SELECT *, {mean("a")} AS pa, {mean("lq")} AS pl, {mean("uq")} AS pu FROM e),
        lb AS (SELECT pos, round({" + ".join(kim)}, 6) AS kim, round({over("a", "lq", "uq")}, 6) AS keogh_query, round({over("b", "ls", "us")}, 6) AS keogh_data,
            round({piece} * list_sum(list_transform(range(1, {BOUND_PIECES + 1}), lambda i: power(greatest(pa[i] - pu[i], pl[i] - pa[i], 0), 2))), 6) AS paa FROM p),
        dia AS (
            SELECT pos, a, b, 2 AS d, list_transform(range(1, {m + 1}), lambda i: CASE WHEN i = 1 THEN power(a[1] - b[1], 2) ELSE 1e20 END) AS p1,
                list_transform(range(1, {m + 1}), lambda i: 1e20) AS p2 FROM e
            UNION ALL SELECT pos, a, b, d + 1, list_transform(range(1, {m + 1}), lambda i: CASE WHEN d + 1 - i BETWEEN 1 AND {m} AND abs(2 * i - d - 1) <= {rho}
                THEN least(coalesce(p1[i - 1], 1e20), p1[i], coalesce(p2[i - 1], 1e20)) + power(a[i] - b[d + 1 - i], 2) ELSE 1e20 END), p1 FROM dia WHERE d < {2 * m})
        SELECT {cols} FROM lb JOIN (SELECT pos, round(p1[{m}], 6) AS dtw FROM dia WHERE d = {2 * m}) USING (pos)"""


# answers


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.best(_scan("rsm_ed")(spark, sf_dir).withColumn("series_id", F.lit("s"))).select("pos", "dist")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.top_k(_scan("rsm_ed_walk")(spark, sf_dir).withColumn("series_id", F.lit("s")), 10).select("pos", "dist")


def nonoverlap_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    of, m, query = _query("rsm_ed_walk")
    s = of(spark, sf_dir)
    return _found(answers.without_overlap(verify.scan(s, series.fetch(s, OFFSET, m), query), m))


def match_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan("rsm_ed")(spark, sf_dir).agg((F.count("*") > 0).alias("found"))


# stored series and sources


def series_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.read_range(events(spark, sf_dir), 301, 400).select("pos", "value")


def series_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.to_chunks(events(spark, sf_dir))
    total = F.aggregate("vals", F.lit(0.0), lambda s, x: s + x)
    return got.select("chunk", "start", F.size("vals").cast("long").alias("n"), F.round(total, 4).alias("total"))


def chunks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.from_chunks(series.to_chunks(events(spark, sf_dir), 77)).select("pos", "value")


def numbered_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series from a table that only has an order, numbered without one task seeing it all."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return series.numbered(rows, "l_extendedprice", LINES).select("pos", "value")


def lineitem_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = series.numbered(rows, "l_quantity", LINES)
    return _found(verify.scan(s, series.fetch(s, OFFSET, 32), Query("RSM-ED", eps=72.03)))


def float_nsm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stored in single precision; arithmetic is in double."""
    s = events(spark, sf_dir).withColumn("value", F.col("value").cast("float").cast("double"))
    return _found(verify.scan(s, series.fetch(s, OFFSET, 64), Query("NSM-ED", eps=8.6)))


def per_series_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = users(spark, sf_dir)
    q = series.fetch(s, 1, 16, "1")
    return verify.scan(s, q, Query("RSM-ED", eps=140.0)).select(F.col("series_id").cast("long").alias("user_id"), "pos", F.round("dist", 6).alias("dist"))


def plan_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = walk(spark, sf_dir)
    stats = planner.Statistics.of(index.statistics(index.build(s, WINDOWS, D, SCALE)))
    of, m, query = _query("rsm_ed_walk")
    got = planner.plan(query, series.fetch(s, OFFSET, m), stats)
    return spark.createDataFrame([(x.first, x.w, x.low_mean, x.high_mean, x.lo, x.hi, x.intervals) for x in got], "first int, w int, low_mean double, high_mean double, lo double, hi double, intervals long")


def gen_random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.random_walk(spark, 5000)


def gen_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.gaussian(spark, 5000)


def gen_sine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.sine(spark, 5000)


def gen_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.mixed(spark, 5000)


def workload_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.workload(spark, [1, 201], [128, 256], [1.0, 2.0], [1.1, 1.5], [0.5, 1.0])


def workload_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of several thresholds, by decades of selectivity."""
    s = events(spark, sf_dir)
    found = verify.scan(s, series.fetch(s, OFFSET, 32), Query("RSM-ED", eps=330.0))
    runs = [found.where(F.col("dist") <= e).agg(F.lit(i).alias("run"), F.count("*").alias("answers")) for i, e in enumerate((220.0, 290.0, 310.0, 330.0))]
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    got = answers.by_selectivity(rows.withColumn("value", F.col("answers").cast("double")), 10_000, "value", "run")
    return got.select("decade", "n", "total", F.round("average", 6).alias("average"), "least", "most", "last")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {}
    for name, (of, *_) in MATCHES.items():
        out[f"{name}_scan"] = _scan(name)
        if of == "walk":
            out[f"{name}_index"] = _indexed(name)
    out |= {"paa_ed_scan": _scan("rsm_ed", 24), "paa_cnsm_ed_scan": _scan("cnsm_ed", 24), "paa_cnsm_dtw_scan": _scan("cnsm_dtw", 8)}
    for f in (
        window_means, bucket_histogram, index_islands, index_statistics, index_row_summary, index_row_merge, index_range_probe, interval_intersect,
        interval_union, interval_split, envelopes, lower_bounds, keogh_expression, best_match, top_k, nonoverlap_answers, match_exists, series_slice,
        series_chunks, chunks_round_trip, numbered_lineitem, lineitem_match, float_nsm_scan, per_series_match, plan_segments, gen_random_walk,
        gen_gaussian, gen_sine, gen_mixed, workload_grid, workload_statistics,
    ):
        out[f.__name__] = f
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, (of, *_) in MATCHES.items():
        out[f"{name}_scan"] = _match_sql(name)
        if of == "walk":
            out[f"{name}_index"] = out[f"{name}_scan"]
    out |= {"paa_ed_scan": out["rsm_ed_scan"], "paa_cnsm_ed_scan": out["cnsm_ed_scan"], "paa_cnsm_dtw_scan": out["cnsm_dtw_scan"]}
    means = " UNION ALL ".join(
        f"SELECT CAST({w} AS INTEGER) AS w, pos, round(avg(value) OVER f, 6) AS mean, round(stddev_pop(value) OVER f, 6) AS std, count(*) OVER f AS n FROM ser WINDOW f AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
        for w in WINDOWS
    )
    out["window_means"] = f"WITH {SER} SELECT w, pos, mean, std FROM ({means}) WHERE n = w"
    out["bucket_histogram"] = f"WITH {_islands_sql((50,), SER, 100)} SELECT key, count(*) AS n FROM win GROUP BY key"
    isl = _islands_sql(WINDOWS)
    out["index_islands"] = f'WITH {isl} SELECT CAST(w AS INTEGER) AS w, key, lft AS "left", rgt AS "right" FROM isl'
    meta = f"WITH {isl}, meta AS (SELECT CAST(w AS INTEGER) AS w, key, count(*) AS n_int, CAST(sum(rgt - lft + 1) AS BIGINT) AS n_off FROM isl GROUP BY 1, 2)"
    out["index_statistics"] = f"{meta} SELECT w, key, n_int, n_off, CAST(sum(n_int) OVER (PARTITION BY w ORDER BY key) AS BIGINT) AS cum_int, CAST(sum(n_off) OVER (PARTITION BY w ORDER BY key) AS BIGINT) AS cum_off FROM meta"
    out["index_row_summary"] = f"{meta} SELECT w, count(*) AS n_rows, round(avg(n_int), 6) AS average, min(n_int) AS least, max(n_int) AS most FROM meta GROUP BY w"
    out["index_row_merge"] = f"""WITH RECURSIVE {isl},
        touch AS (SELECT x.w, least(x.key, y.key) AS key, greatest(x.key, y.key) AS other, count(*) AS j FROM isl x JOIN isl y ON y.w = x.w AND y.lft = x.rgt + 1 AND y.key <> x.key GROUP BY 1, 2, 3),
        near AS (SELECT w, key, list(other) AS o, list(j) AS j FROM touch GROUP BY 1, 2),
        n AS (SELECT w, key, count(*) AS own, row_number() OVER (PARTITION BY w ORDER BY key DESC) AS i, avg(count(*)) OVER (PARTITION BY w) AS a FROM isl GROUP BY w, key),
        step AS (SELECT n.*, coalesce(near.o, []) AS o, coalesce(near.j, []) AS j FROM n LEFT JOIN near USING (w, key)),
        fold AS (
            SELECT w, i, key, key AS top, own AS size FROM step WHERE i = 1
            UNION ALL SELECT w, i, key, CASE WHEN own < 1.2 * a AND alone < 0.8 * (size + own) THEN top ELSE key END, CASE WHEN own < 1.2 * a AND alone < 0.8 * (size + own) THEN alone ELSE own END
            FROM (SELECT s.w, s.i, s.key, s.own, s.a, f.top, f.size,
                CAST(f.size + s.own - coalesce(list_sum(list_transform(range(1, len(s.o) + 1), lambda x: CASE WHEN s.o[x] <= f.top THEN s.j[x] ELSE 0 END)), 0) AS BIGINT) AS alone FROM fold f JOIN step s ON s.w = f.w AND s.i = f.i + 1)),
        own AS (SELECT w, top, lft, rgt, CASE WHEN lft > lag(rgt) OVER (PARTITION BY w, top ORDER BY lft) + 1 THEN 1 ELSE 0 END AS new FROM isl JOIN fold USING (w, key)),
        runs AS (SELECT *, sum(new) OVER (PARTITION BY w, top ORDER BY lft) AS g FROM own),
        least_of AS (SELECT w, top, min(key) AS key FROM fold GROUP BY 1, 2)
        SELECT CAST(w AS INTEGER) AS w, key, key * 0.5::DOUBLE AS lo, (top + 1) * 0.5::DOUBLE AS hi, min(lft) AS "left", max(rgt) AS "right" FROM runs JOIN least_of USING (w, top) GROUP BY w, top, key, g"""
    out["index_range_probe"] = f'WITH {_islands_sql((50,))} SELECT key, lft AS "left", rgt AS "right", round(50 * power(greatest(1.25 - (key + 1) * 0.5, key * 0.5 - 1.25, 0), 2), 6) AS lb FROM isl WHERE key BETWEEN -4 AND 6'
    parts = " UNION ALL ".join(
        f"SELECT {i} AS seg, pos - {s.first} AS start, {s.w} * power(greatest({s.low_mean} - (key + 1) * 0.5, key * 0.5 - {s.high_mean}, 0), 2) AS lb FROM win WHERE w = {s.w} AND (key + 1) * 0.5 >= {s.lo} AND key * 0.5 <= {s.hi}"
        for i, s in enumerate(_two_segments())
    )
    out["interval_intersect"] = f"WITH {_islands_sql((25, 50))} SELECT start, round(sum(lb), 6) AS lb FROM ({parts}), (SELECT max(pos) AS n FROM ser) WHERE start BETWEEN 1 AND n - 74 GROUP BY start HAVING count(*) = 2 AND sum(lb) <= 400.0000004"
    out["interval_union"] = f"""WITH {_islands_sql((25,))}, pts AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM win WHERE key BETWEEN -4 AND 3)
        SELECT min(pos) AS "left", max(pos) AS "right" FROM pts GROUP BY g"""
    out["interval_split"] = f'WITH {_islands_sql((400,))} SELECT key, k AS "left", least(k + 19, rgt) AS "right" FROM (SELECT key, rgt, unnest(range(lft, rgt + 1, 20)) AS k FROM isl)'
    out["envelopes"] = f"WITH {SER} SELECT pos, min(value) OVER f AS lower, max(value) OVER f AS upper FROM ser WINDOW f AS (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
    out["lower_bounds"] = _bounds_sql("pos, kim, keogh_query, keogh_data, paa, dtw")
    out["keogh_expression"] = _bounds_sql("pos, keogh_query")
    out["best_match"] = f"SELECT * FROM ({out['rsm_ed_scan']}) ORDER BY dist, pos LIMIT 1"
    out["top_k"] = f"SELECT * FROM ({out['rsm_ed_walk_scan']}) ORDER BY dist, pos LIMIT 10"
    m = MATCHES["rsm_ed_walk"][2]
    out["nonoverlap_answers"] = f"""WITH RECURSIVE ans AS ({out["rsm_ed_walk_scan"]}), rk AS (SELECT row_number() OVER (ORDER BY dist, pos) AS r, pos, dist FROM ans),
        pick AS (SELECT 1::BIGINT AS r, [(SELECT pos FROM rk WHERE r = 1)] AS kept UNION ALL
            SELECT p.r + 1, CASE WHEN list_min(list_transform(p.kept, lambda k: abs(k - rk.pos))) >= {m} THEN list_append(p.kept, rk.pos) ELSE p.kept END FROM pick p JOIN rk ON rk.r = p.r + 1)
        SELECT rk.pos, rk.dist FROM rk WHERE list_contains((SELECT kept FROM pick ORDER BY r DESC LIMIT 1), rk.pos)"""
    out["match_exists"] = f"SELECT count(*) > 0 AS found FROM ({out['rsm_ed_scan']})"
    out["series_slice"] = f"WITH {SER} SELECT pos, value FROM ser WHERE pos BETWEEN 301 AND 700"
    out["series_chunks"] = f"WITH {SER} SELECT (pos - 1) // 1000 AS chunk, min(pos) AS start, count(*) AS n, round(sum(value), 4) AS total FROM ser GROUP BY 1"
    out["chunks_round_trip"] = f"WITH {SER} SELECT pos, value FROM ser"
    out["numbered_lineitem"] = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_extendedprice AS value FROM lineitem"
    line = "ser AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CAST(l_quantity AS DOUBLE) AS value FROM lineitem)"
    ed = lambda ser, m, eps: f"""WITH {ser}, q AS (SELECT pos - {OFFSET} AS j, value FROM ser WHERE pos BETWEEN {OFFSET} AND {OFFSET + m - 1})
        SELECT s.pos - q.j AS pos, round(sqrt(sum(power(s.value - q.value, 2))), 6) AS dist FROM ser s CROSS JOIN q GROUP BY 1 HAVING count(*) = {m} AND sum(power(s.value - q.value, 2)) <= {eps * eps!r}"""  # noqa: E731
    out["lineitem_match"] = ed(line, 32, 72.03)
    out["float_nsm_scan"] = _match_sql("nsm_ed").replace("+ 1 AS pos, value FROM", "+ 1 AS pos, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM")
    out["per_series_match"] = """WITH ser AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events),
        q AS (SELECT pos - 1 AS j, value FROM ser WHERE user_id = 1 AND pos <= 16)
        SELECT user_id, s.pos - q.j AS pos, round(sqrt(sum(power(s.value - q.value, 2))), 6) AS dist FROM ser s CROSS JOIN q GROUP BY 1, 2
        HAVING count(*) = 16 AND sum(power(s.value - q.value, 2)) <= 19600.0"""
    out["workload_grid"] = """SELECT o AS "offset", m, eps, alpha, beta, CAST(floor(0.05 * m) AS INTEGER) AS rho FROM (SELECT unnest([1, 201])::BIGINT AS o), (SELECT unnest([128, 256])::INTEGER AS m),
        (SELECT unnest([1.0, 2.0])::DOUBLE AS eps), (SELECT unnest([1.1, 1.5])::DOUBLE AS alpha), (SELECT unnest([0.5, 1.0])::DOUBLE AS beta)"""
    out["workload_statistics"] = f"""WITH d AS ({ed(SER, 32, 330.0)}), runs AS (SELECT i AS run, CAST(count(*) FILTER (dist <= e) AS DOUBLE) AS value FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest([220.0, 290.0, 310.0, 330.0]) AS e) LEFT JOIN d ON true GROUP BY i)
        SELECT CAST(-floor(log10(greatest(value, 1) / 10000.0)) AS INTEGER) AS decade, count(*) AS n, sum(value) AS total, round(avg(value), 6) AS average, min(value) AS least, max(value) AS most, arg_max(value, run) AS last FROM runs GROUP BY 1"""
    return out
