"""Passages that start and end inside a sentence."""

import random

from wavesift.llm import substrings
from wavesift.llm.common import WORD


def test_passages_planted_inside_sentences(spark):
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, planted = [], []
    for k in range(60):
        passage = some(rng.randint(51, 90))
        for i in rng.sample(range(5, len(passage) - 5), k % 3):  # none, one or two sentence ends inside
            passage[i] += "."
        for d in (k, 100 + k):
            host = " ".join(some(30)) + " ", " " + " ".join(some(30)) + ". " + " ".join(some(40)) + "."
            rows.append((d, host[0] + " ".join(passage) + host[1]))
        planted.append((100 + k, passage, "".join(host).split()))
    rows += [(300, "lone words " * 400), (301, " ".join(some(400)))]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, passage, host in planted:
        left = WORD.findall(got[d].text)
        assert got[d].n_removed > 0
        assert len(set(passage) & set(left)) <= 34 and set(host) - set(passage) <= set(left) | set(passage)
    for d, t in rows:
        if not 100 <= d < 200:
            assert (got[d].text, got[d].n_removed) == (t, 0)
