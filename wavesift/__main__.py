"""python -m wavesift scan | generate | index | query: the engine from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wavesift.engine import Engine
from wavesift.model import Query, band_of
from wavesift.operators import answers, index
from wavesift.sources import generators, series


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="wavesift")
    sub = p.add_subparsers(dest="what", required=True)
    scan = sub.add_parser("scan", help="answers in a CSV series, a value a line, to the part of it from begin to end")
    scan.add_argument("distance", choices=["ED", "DTW"])
    scan.add_argument("problem", choices=["RSM", "NSM", "cNSM"])
    scan.add_argument("path")
    scan.add_argument("begin", type=int)
    scan.add_argument("end", type=int)
    scan.add_argument("eps", type=float)
    scan.add_argument("alpha", type=float, nargs="?", default=1.0)
    scan.add_argument("beta", type=float, nargs="?", default=0.0)
    scan.add_argument("--rho", type=float, default=0.05, help="band, a share of the length up to 1 or a width")
    gen = sub.add_parser("generate", help="a mixed synthetic series")
    gen.add_argument("n", type=int)
    gen.add_argument("path")
    gen.add_argument("--seed", type=int, default=1)
    build = sub.add_parser("index", help="the index of a stored series")
    build.add_argument("series")
    build.add_argument("path")
    build.add_argument("--bucket", type=float, default=0.5)
    query = sub.add_parser("query", help="answers in an indexed series to its own part")
    query.add_argument("series")
    query.add_argument("index")
    query.add_argument("kind")
    query.add_argument("offset", type=int)
    query.add_argument("length", type=int)
    query.add_argument("eps", type=float)
    query.add_argument("--rho", type=float, default=0.05)
    query.add_argument("--alpha", type=float, default=1.0)
    query.add_argument("--beta", type=float, default=0.0)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("wavesift").getOrCreate()
    if a.what == "scan":
        m = a.end - a.begin + 1
        s = series.from_csv(spark, a.path)
        kind = f"{a.problem}-{a.distance}"
        found = Engine(s).query(Query(kind, a.eps, band_of(a.rho, m), a.alpha, a.beta), offset=a.begin, length=m).found
        for r in answers.ordered(answers.without_overlap(found, m)).toLocalIterator():
            print(f"{r.pos},{r.dist}")
    elif a.what == "generate":
        series.write(generators.mixed(spark, a.n, a.seed, "s"), a.path)
    elif a.what == "index":
        index.save(index.build(series.read(spark, a.series), d=a.bucket), a.path)
    else:
        rows, meta = index.load(spark, a.index)
        engine = Engine(series.read(spark, a.series), index_rows=rows.withColumn("w", F.col("w").cast("int")), meta=meta)
        got = engine.query(Query(a.kind, a.eps, band_of(a.rho, a.length), a.alpha, a.beta), offset=a.offset, length=a.length)
        for r in got.found.toLocalIterator():
            print(f"{r.pos},{r.dist}")
        print(got.metrics())


if __name__ == "__main__":
    main()
