"""Quality classifier: a sparse rule ensemble. Paths of boosted trees over statistics become
conjunctive rules, lasso logistic regression weighs them, Spark columns score the documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavesift.llm.common import hide, id_remainder, materialize
from wavesift.llm.quality_rules import Rule
from wavesift.llm.stats import cut_points, features, labelled_ids, labelled_sample, statistics, with_statistics


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[tuple[float, Rule]]

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for w, r in self.rules:
            z += w * r.covers(x, names)
        return 1 / (1 + np.exp(-z))

    def column(self, cols: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for w, r in self.rules:
            z = z + F.when(r.column(cols), F.lit(w)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def _tree(codes: np.ndarray, cuts: list[np.ndarray], names: list[str], g: np.ndarray, h: np.ndarray, depth: int, least: int, step: float, out: list[Rule]) -> np.ndarray:
    """A regression tree for gradients g, h over binned features; its paths go to out. Returns its values."""
    value = np.zeros(len(g))

    def node(rows: np.ndarray, rule: Rule, level: int) -> None:
        if rule.terms:
            out.append(rule)
        value[rows] = step * g[rows].sum() / (h[rows].sum() + 1.0)
        if level == depth or len(rows) < 2 * least:
            return
        all_g, all_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for j in range(len(names)):
            k = len(cuts[j])
            if not k:
                continue
            c = codes[rows, j]
            n = np.bincount(c, minlength=k + 1)[:-1].cumsum()
            a = np.bincount(c, g[rows], k + 1)[:-1].cumsum()
            b = np.bincount(c, h[rows], k + 1)[:-1].cumsum()
            gain = a**2 / (b + 1) + (all_g - a) ** 2 / (all_h - b + 1) - all_g**2 / (all_h + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            return
        _, j, k = best
        low = codes[rows, j] <= k
        for op, part in (("<=", rows[low]), (">", rows[~low])):
            node(part, Rule([*rule.terms, (names[j], op, float(cuts[j][k]))]), level + 1)

    node(np.arange(len(g)), Rule(), 0)
    return value


def extract_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 12, depth: int = 3, least: int = 20, step: float = 0.3, bins: int = 48) -> list[Rule]:
    """The distinct paths of gradient-boosted trees."""
    cuts = [cut_points(x[:, j], bins) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    found: list[Rule] = []
    z = np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        z += _tree(codes, cuts, names, y - p, p * (1 - p), depth, least, step, found)
    return list({str(r): r for r in found}.values())


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300, start: tuple | None = None) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean log loss + penalty * |w|; the bias is free."""
    n, k = a.shape
    b, w = start or (float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(k))
    size = 4.0 / (np.linalg.norm(np.c_[a, np.ones(n)], 2) ** 2 / n)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ vw + vb))) - y
        nb, nw = vb - size * r.mean(), vw - size * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 1, **how) -> RuleEnsemble:
    """Rules from trees on all rows; the penalty of least log loss on a fifth of the rows.
    With no rows the score is one half; with one class it is that class, smoothed."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))), [])
    rules = extract_rules(x, y.astype(float), names, **how)
    a = np.stack([r.covers(x, names) for r in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))
    test = np.random.default_rng(seed).random(len(y)) < 0.2
    best, start = (np.inf, 1e-3), None
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        start = lasso_logistic(a[~test], y[~test], penalty, 150, start)
        p = np.clip(1 / (1 + np.exp(-(a[test] @ start[1] + start[0]))), 1e-6, 1 - 1e-6)
        loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean() if test.any() else np.inf
        if loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = lasso_logistic(a, y, best[1], 400)
    return RuleEnsemble(float(b), [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-6])


def held_out(col: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return id_remainder(col, 4) == 2


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **how) -> RuleEnsemble:
    """The ensemble learned from at most max_rows labelled rows that aren't held out."""
    x, y = labelled_sample(stats, labels, label, max_rows, ~held_out(F.col("doc_id")))
    return fit(x, y, list(features()), **how)


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Learns from at most max_rows labelled rows that aren't held out; the inputs are statistics
    of the text alone. Null and empty texts are scored by their statistics, all zero. Repeated
    rows score alike; an empty table gives no rows; without labels every score is one half.
    """
    stats = materialize(statistics(docs), "stats")
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), train(stats, labels, **how).column(features()).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def drop_rejected(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **how) -> DataFrame:
    """The rows of docs whose score reaches the cut, columns as they are, whatever their names.
    Scored as by score(); statistics for learning are those of the sampled texts only."""
    own, names = hide(docs)
    model = train(sampled_statistics(own, labels, max_rows=how.get("max_rows", 20_000)), labels, **how)
    return with_statistics(own, "stat_").where(model.column(features("stat_")) >= cut).select(*names).toDF(*docs.columns)


def sampled_statistics(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """statistics() of the rows of docs that train() takes: max_rows ids at most, broadcast."""
    own = labelled_ids(labels, label, max_rows, ~held_out(F.col("doc_id"))).select("doc_id")
    return statistics(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id", "left_semi"))
