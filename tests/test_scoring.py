"""Scored candidates without moved pairs: the same rows as joins and Python loops give."""

import random

import numpy as np
import pytest

from erlake import catalog
from erlake.functions import kernels as k
from erlake.operators import blocking as b
from erlake.operators import scoring

SF = "/root/testdata/sf0.001"


def test_similarities_equal_those_of_single_pairs():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abé語") for _ in range(rng.choice((1, 2, 3, 5))))
    left, right = ([" ".join(word() for _ in range(rng.choice((0, 1, 2, 4, 6, 14, 30)))) for _ in range(n)] for n in (60, 90))
    left[0], right[0] = "a" * 63, "a" * 64
    alphabet, words = {}, {}
    x, y = scoring._Texts(left, alphabet, words, -1), scoring._Texts(right, alphabet, words, -2)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(5, 60), np.arange(90), indexing="ij"))
    for lo, i in ((5, i), (0, i - 5)):
        got = scoring._similarity(x, y, lo, 60, i, j, len(alphabet) + 1)
        assert got.tolist() == [max(k.indel(left[p], right[q]), k.token_set(left[p], right[q])) for p, q in zip(i, j)]
    assert x.long.any() and not x.long.all()


@pytest.fixture(scope="module")
def joined(spark):
    keys = catalog._keys(spark, SF)
    return b.ranked(b.paired(b.route_pairs(keys, catalog.PER_KEY).select("s1", "candidate").distinct(), keys)).select("s1", "candidate", "score", "second").cache()


def test_queries_equal_the_joins(spark, joined, monkeypatch):
    monkeypatch.setattr(scoring, "ANCHORS", 150)
    monkeypatch.setattr(scoring, "STEP", 3000)
    keys, q = catalog._keys(spark, SF), catalog.queries()
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    assert rows(scoring.scored_candidates(keys, catalog.PER_KEY)) == rows(joined)
    assert rows(q["cap_quota"](spark, SF)) == rows(b.quota_cap(joined, catalog.CAP).select("s1", "candidate"))
    assert rows(q["hard_negatives"](spark, SF)) == rows(b.hard_negatives(joined, catalog._truth(keys)).select("s1", "candidate"))


def test_pairs_are_not_shuffled(spark):
    """An exchange of pairs took more disk than the input has."""
    plan = scoring.scored_candidates(catalog._keys(spark, SF), catalog.PER_KEY)._jdf.queryExecution().executedPlan().toString()
    last = plan.index("MapInArrow")
    assert "Exchange" not in plan[:last] and "ArrowEvalPython" not in plan
