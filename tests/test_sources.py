import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.__main__ import main
from wavesift.functions import windows
from wavesift.model import Query
from wavesift.operators import answers, index
from wavesift.sources import generators, series
from wavesift.streaming.matcher import match_stream


def test_csv_and_binary(spark, tmp_path):
    v = [1.5, -2.25, 3.0, 4.0] * 30
    (tmp_path / "s.csv").write_text("\n".join(map(str, v)))
    assert [r.value for r in series.from_csv(spark, str(tmp_path / "s.csv")).orderBy("pos").collect()] == v
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "data-120").write_bytes(np.array(v, ">f8").tobytes())
    got = series.from_binary(spark, str(tmp_path / "b")).orderBy("pos").collect()
    assert [r.value for r in got] == v and got[0].series_id == "data-120" and got[-1].pos == 120
    rows = series.to_binary_rows(series.from_csv(spark, str(tmp_path / "s.csv")), 50).orderBy("key").collect()
    assert rows[1].key == "0000000000051" and np.frombuffer(rows[1].data, ">f8").tolist() == v[50:100]


def test_codecs():
    assert series.decode_intervals(series.encode_intervals([(1, 5), (9, 9)])) == [(1, 5), (9, 9)]
    b = lambda x: (x - 128).to_bytes(1, "big", signed=True)
    data = (7).to_bytes(4, "big") + b(1) + b(3) + b(2) + b(0) + (900).to_bytes(4, "big") + b(0) + b(255)
    assert list(index.decode_compact(data)) == [(7, 10), (12, 12), (900, 1155)]
    q = series.export_query(np.array([1.0, 2.0]), 3.5)
    assert np.frombuffer(q[:4], ">f4")[0] == 3.5 and np.frombuffer(q[8:], ">f8").tolist() == [1.0, 2.0]


def test_store_and_slice(spark, tmp_path):
    s = generators.sine(spark, 3000, series="s")
    series.write(s, str(tmp_path / "s"))
    got = series.read(spark, str(tmp_path / "s"))
    assert got.count() == 3000
    plan = series.read_range(got, 100, 10)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(pos,100)" in plan
    assert series.fetch(got, 2991, 10).shape == (10,)
    with pytest.raises(ValueError):
        series.fetch(got, 2995, 10)
    generators.load(s, str(tmp_path / "c"))
    assert series.from_chunks(spark.read.parquet(str(tmp_path / "c"))).exceptAll(got).count() == 0


def test_running_sum_and_numbers(spark):
    v = np.random.default_rng(1).integers(-5, 6, 500)
    s = spark.createDataFrame([("a", i + 1, float(x)) for i, x in enumerate(v)] + [("b", 1, 7.0)], "series_id string, pos long, value double")
    got = series.running_sum(s, 64)
    assert [r.value for r in got.where("series_id = 'a'").orderBy("pos").collect()] == np.cumsum(v).tolist()
    df = spark.createDataFrame([(i * 7919 % 1000, float(i)) for i in range(1000)], "k long, v double").repartition(7)
    got = series.numbered(df, "v", ["k"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 1001)) and [r.value * 7919 % 1000 for r in got] == list(range(1000))


def test_generators_repeat_and_keep_their_ranges(spark):
    for make in (generators.random_walk, generators.gaussian, generators.sine, generators.mixed):
        a = [r.value for r in make(spark, 2500, seed=3).orderBy("pos").collect()]
        b = [r.value for r in make(spark, 2500, seed=3).repartition(5).orderBy("pos").collect()]
        assert a == b and len(a) == 2500 and a != [r.value for r in make(spark, 2500, seed=4).orderBy("pos").collect()]
    w = np.array([r.value for r in generators.random_walk(spark, 2500).orderBy("pos").collect()])
    assert -5 <= w[0] < 5 and np.abs(np.diff(w)).max() <= 1


def test_sliding_and_envelope_do_not_depend_on_spans(spark):
    v = np.random.default_rng(2).normal(size=300)
    s = spark.createDataFrame([("s", i + 1, float(x)) for i, x in enumerate(v)], "series_id string, pos long, value double")
    for span in (16, 100, 1000):
        got = windows.sliding(s, (5, 40), span=span).collect()
        assert len(got) == 296 + 261
        for r in got:
            x = v[r.pos - 1 : r.pos - 1 + r.w]
            assert abs(r["mean"] - x.mean()) < 1e-9 and abs(r["std"] - x.std()) < 1e-9
        for r in windows.envelope(s, 7, span).collect():
            x = v[max(0, r.pos - 8) : r.pos + 7]
            assert (r.lower, r.upper) == (x.min(), x.max())


def test_union_and_split(spark):
    rows = [("s", 1, 4), ("s", 3, 6), ("s", 7, 7), ("s", 10, 600)]
    i = spark.createDataFrame(rows, "series_id string, left long, right long")
    got = sorted((r.left, r.right) for r in index.coalesce(i, ["series_id"]).collect())
    assert got == [(1, 7), (10, 600)]
    got = sorted((r.left, r.right) for r in index.split(i.where("left = 10"), 255).collect())
    assert got == [(10, 264), (265, 519), (520, 600)]


def test_statistics_of_parts(spark):
    s = generators.sine(spark, 800, series="s")
    meta = index.statistics(index.build(s, (25,)))
    a, b = meta.where("key < 0"), meta.where("key >= 0")
    assert index.stitch([a, b]).exceptAll(meta).count() == 0


def test_summary(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, -4.0)], "k string, t int, v double")
    r = answers.summary(df, "v", ["k"], "t").first()
    assert (r.n, r.total, r.average, r.least, r.most, r["last"]) == (2, -2.0, -1.0, -4.0, 2.0, -4.0)


def test_workload_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text("x,201,128,7,1.5,10\n")
    r = series.read_workload(spark, str(tmp_path / "w.csv"), "cNSM-DTW").first()
    assert (r.offset, r.m, r.eps, r.alpha, r.beta, r.rho) == (201, 128, 7.0, 1.5, 10.0, 6)


def test_stream(spark, tmp_path):
    v = np.sin(np.arange(400) / 9.0).round(4)
    rows = [("s", i + 1, float(x)) for i, x in enumerate(v)]
    for i, cut in enumerate((rows[:130], rows[130:131], rows[131:])):
        spark.createDataFrame(cut, "series_id string, pos long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, pos long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = v[100:130]
    got = match_stream(stream, q, Query("RSM-ED", 0.8)).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    got.processAllAvailable()
    got.stop()
    x = np.lib.stride_tricks.sliding_window_view(v, 30)
    want = (np.flatnonzero(np.sqrt(((x - q) ** 2).sum(1)) <= 0.8) + 1).tolist()
    assert sorted(r.pos for r in spark.table("hits").collect()) == want


def test_command_line(spark, tmp_path, capsys):
    v = (np.sin(np.arange(300) / 9.0) + np.arange(300) / 1000).round(4)
    (tmp_path / "s.csv").write_text("\n".join(map(str, v)))
    main(["scan", "ED", "NSM", str(tmp_path / "s.csv"), "101", "140", "3"])
    assert "101,0.0" in capsys.readouterr().out
    main(["generate", "2000", str(tmp_path / "g")])
    main(["index", str(tmp_path / "g"), str(tmp_path / "i")])
    main(["query", str(tmp_path / "g"), str(tmp_path / "i"), "RSM-DTW", "300", "60", "1"])
    assert "300,0.0" in capsys.readouterr().out


def test_numbered_positions_are_those_of_the_rows(spark, tmp_path):
    """Every position once on a written table of many rows, also when columns are pruned."""
    n = 1_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k")).withColumn("v", F.xxhash64("k").cast("double")).repartition(7)
    got = series.numbered(df, "v", ["k"])
    got.write.parquet(str(tmp_path / "numbered"))
    back = spark.read.parquet(str(tmp_path / "numbered"))
    assert back.agg(F.count_distinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).first() == (n, 1, n)
    want = df.orderBy("k").limit(50).select("v").collect()
    assert [r.value for r in back.where("pos <= 50").orderBy("pos").collect()] == [r.v for r in want]


def test_csv_files_of_unequal_size_follow_by_name(spark, tmp_path):
    for name, values in (("a", [1, 2]), ("b", list(range(100, 3000))), ("c", [7, 8])):
        (tmp_path / f"{name}.csv").write_text("".join(f"{v}\n" for v in values))
    got = series.from_csv(spark, str(tmp_path))
    assert [r.value for r in got.orderBy("pos").collect()] == [1, 2, *range(100, 3000), 7, 8]
    assert [r.pos for r in got.orderBy("pos").collect()] == list(range(1, 2905))
