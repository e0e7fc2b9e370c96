import random
from collections import Counter

import numpy as np
import pytest

from wavesift.llm import quality_classifier as qc
from wavesift.llm import quality_rules as qr
from wavesift.llm import secrets, stats
from wavesift.llm.common import WORD, table

SF = "/root/testdata/sf0.01"


def slow_repeats(w):
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    return len({k for i, x in enumerate(win) if n[x] > 1 for k in range(i, i + 5)})


def test_statistics(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a b\na b\n\n\nc", "x " * 40, "é! #*$%&|<> ok"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for limit in (stats.LONG, 3):
        monkeypatch.setattr(stats, "LONG", limit)
        for t in texts:
            w, lines = WORD.findall(t), t.split("\n")
            got = dict(zip(stats.COUNTS, stats.statistics_of(t), strict=True))
            assert got["n_words"] == len(w) and got["word_chars"] == sum(map(len, w))
            assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
            assert got["n_dup_lines"] == sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
            assert got["n_repeat_words"] == slow_repeats(w)
    assert stats.statistics_of(None)[0] == 0


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(4000, 3))
    y = ~((x[:, 0] > 0.9) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5)))
    rules = qr.learn(x, y.astype(int), ["a", "b", "c"])
    out = np.ones(len(x), bool)
    for r in rules:
        out &= ~r.covers(x, ["a", "b", "c"])
    assert (out == y).mean() > 0.98 and 2 <= len(rules) <= 6
    assert qr.learn(x, np.ones(4000, int), ["a", "b", "c"]) == [] and qr.learn(x[:0], y[:0].astype(int), ["a", "b", "c"]) == []


def test_rule_columns_agree_with_numpy(spark):
    r = qr.Rule([("a", ">", 0.25), ("b", "<=", 1.0)])
    rows = [(0.25, 0.0), (0.5, 1.0), (0.3, 1.5)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [x[0] for x in df.select(r.column({"a": df.a, "b": df.b})).collect()]
    assert got == r.covers(np.array(rows), ["a", "b"]).tolist() == [False, True, False]


def test_lasso_is_sparse_and_right():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2, (3000, 20)).astype(float)
    p = 1 / (1 + np.exp(-(3 * a[:, 2] - 2 * a[:, 5] - 0.5)))
    y = (rng.uniform(size=3000) < p).astype(float)
    b, w = qc.lasso_logistic(a, y, 0.01, 500)
    assert w[2] > 1.5 and w[5] < -1 and np.abs(np.delete(w, [2, 5])).max() < 0.2 and (w == 0).sum() >= 10


def edge(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a few words " * 9, 5), (3, "same same " * 50, 5), (3, "same same " * 50, 5), (4, "w" * 200_000, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int")


def test_rules_on_the_tables(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = qr.judge(docs, labels).join(labels, "doc_id").where("quality is not null").toPandas()
    assert len(got) > 300
    fine = got[~got.base_failed]
    assert (fine.kept == (fine.quality == 1)).mean() > 0.97
    assert not got[got.base_failed].kept.any()
    rows = {(r.doc_id, r.n_words): r for r in qr.judge(edge(spark), labels).collect()}
    assert rows[1, 0].base_failed and not rows[2, 0].kept and rows[3, 100].base_failed and len(rows) == 5
    assert qr.judge(docs.limit(0), labels).count() == 0
    assert qr.judge(edge(spark), labels.limit(0)).where("kept and base_failed").count() == 0


def test_classifier_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = qc.score(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()
    rows = qc.score(edge(spark), labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in qc.score(edge(spark), labels.limit(0)).collect()} == {0.5}
    kept = qc.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and 0.5 < kept.count() / docs.count() < 1


def test_sample_is_bounded_and_drops_bad_labels(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i + 1)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, None), (None, 1), (8, 5), (9, 0)], "doc_id long, quality int")
    x, y = stats.labelled_sample(stats.statistics(docs), labels, "quality", 20)
    assert len(x) == len(y) == 20
    x, y = stats.labelled_sample(stats.statistics(docs), labels, "quality", 1000)
    assert len(y) == 50 and y.sum() == 24
    with pytest.raises(Exception, match="nolabel"):
        stats.labelled_sample(stats.statistics(docs), labels, "nolabel", 5)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "some plain words here and there, token=abcdefgh12 at the end of it", 7, "a", "b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stat_n_words long, _stat_n_words string, _row string, _base long")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = qc.drop_rejected(df, labels, cut=0.0)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == rows
    other = spark.createDataFrame(rows, "doc_id long, text string, _text long, _more string, _row string, _key long")
    for done in (secrets.scan(other), secrets.redact(other)):
        r = done.first()
        assert done.columns[:6] == other.columns and tuple(r)[2:6] == rows[0][2:]
    assert r.text.endswith("[SECRET] at the end of it")


def test_scores_of_columns_are_those_of_the_model(spark):
    """The compiled column against the ensemble's own NumPy score, row by row; one with rules."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    some = stats.statistics(docs).cache()
    model = qc.train(some, labels)
    assert len(model.rules) > 3
    names = stats.features()
    rows = some.select(model.column(names).alias("got"), *[c.alias(n) for n, c in names.items()]).toPandas()
    want = model.score(rows[[*names]].to_numpy(dtype=float), list(names))
    np.testing.assert_allclose(rows["got"].to_numpy(), want, rtol=1e-9)
    some.unpersist()
