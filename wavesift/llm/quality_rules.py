"""Quality rules: a decision list learned by sequential covering, compiled to Spark CASEs."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavesift.llm.common import materialize
from wavesift.llm.stats import COUNTS, cut_points, features, labelled_sample, statistics


@dataclass
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold); it rejects what it covers."""

    terms: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, op, v in self.terms:
            c = x[:, names.index(f)]
            out &= c <= v if op == "<=" else c > v
        return out

    def column(self, cols: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, v in self.terms:
            out &= cols[f] <= F.lit(v) if op == "<=" else cols[f] > F.lit(v)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {v:.6g}" for f, op, v in self.terms)


def _grow(x: np.ndarray, pos: np.ndarray, names: list[str], max_terms: int, bins: int) -> Rule:
    """Adds the term of the greatest information gain until no negative is covered."""
    rule, cover = Rule(), np.ones(len(x), dtype=bool)
    while len(rule.terms) < max_terms and (cover & ~pos).any():
        p0, n0 = (cover & pos).sum(), (cover & ~pos).sum()
        best, base = (0.0, None, None), np.log2(p0 / (p0 + n0))
        for j, f in enumerate(names):
            for v in cut_points(x[cover, j], bins):
                low = cover & (x[:, j] <= v)
                for op, m in (("<=", low), (">", cover & ~low)):
                    p, n = (m & pos).sum(), (m & ~pos).sum()
                    if p and (gain := p * (np.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                        best = (gain, (f, op, float(v)), m)
        if best[1] is None:
            break
        rule.terms.append(best[1])
        cover = best[2]
    return rule


def _prune(rule: Rule, x: np.ndarray, pos: np.ndarray, names: list[str]) -> Rule:
    """Keeps the first terms that are worth most on rows that the rule was not grown on."""

    def worth(r: Rule) -> float:
        m = r.covers(x, names)
        p, n = (m & pos).sum(), (m & ~pos).sum()
        return (p - n) / (p + n) if p + n else -1.0

    tried = [Rule(rule.terms[:k]) for k in range(1, len(rule.terms) + 1)]
    return max(tried, key=lambda r: (worth(r), -len(r.terms)), default=rule)


def learn(x: np.ndarray, y: np.ndarray, names: list[str], max_rules: int = 12, max_terms: int = 4, bins: int = 48, precision: float = 0.9, seed: int = 1) -> list[Rule]:
    """Rules for label 0, in the order of learning; what none covers is kept. Each rule is
    grown on two thirds of the rows left and pruned on the rest; learning ends when a rule
    is right on less than `precision` of what it covers there. One class only: no rules."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    for _ in range(max_rules):
        own = rng.random(len(x)) < 2 / 3
        grow, check = left & own, left & ~own
        if not (y[grow] == 0).any() or not (y[grow] == 1).any():
            break
        rule = _prune(_grow(x[grow], y[grow] == 0, names, max_terms, bins), x[check], y[check] == 0, names)
        if not rule.terms:
            break
        hit = rule.covers(x, names)
        p, n = (hit & check & (y == 0)).sum(), (hit & check & (y == 1)).sum()
        if p < 3 or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def compiled(rules: list[Rule], cols: dict[str, Column]) -> tuple[Column, Column]:
    """(kept, number of the rule that decided; null: none) as ordered CASE expressions."""
    kept, which = F.lit(True), F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        c = rules[i].column(cols)
        kept, which = F.when(c, F.lit(False)).otherwise(kept), F.when(c, F.lit(i)).otherwise(which)
    return kept, which


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **how) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, rule) for each row of docs.

    base_failed: under 10 words, or over a fifth of them in repeated 5-word windows; such rows
    are not kept. Else the list learned from at most max_rows rows of labels decides. Null and
    empty texts have no words, so they fail the base. Repeated rows are judged alike. Without
    usable labels the list is empty and the base alone decides.
    """
    stats = materialize(statistics(docs), "stats")
    names = features()
    x, y = labelled_sample(stats, labels, label, max_rows)
    kept, rule = compiled(learn(x, y, list(names), **how), names)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.select("doc_id", *COUNTS, failed.alias("base_failed"), kept.alias("kept"), rule.alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("kept"))
