"""Sampling by positions: permutations, quotas, and work that is linear in what is asked for."""

from collections import Counter

import numpy as np
import pytest

from gneiss.operators import examples as E
from gneiss.operators import sampling as S


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 1025])
def test_a_permutation(n):
    for key in (0, 1, 4294967295):
        got = S.permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got.tolist()) == list(range(n))


def test_keys_differ_and_every_place_is_drawn_alike():
    n, keys = 10, 4000
    first = S.permuted(np.zeros(keys, np.int64), np.full(keys, n), np.arange(keys) * 1_000_003 % (1 << 32))
    count = Counter(first.tolist())
    assert set(count) == set(range(n)) and max(count.values()) < 1.3 * keys / n and min(count.values()) > 0.7 * keys / n


def test_large_groups():
    n = (1 << 40) + 12345
    got = S.permuted(np.arange(1000), np.full(1000, n), np.full(1000, 77))
    assert len(set(got.tolist())) == 1000 and got.min() >= 0 and got.max() < n


def tables(spark, n, groups=4):
    pos = [(g, 100_000 + 10 * i + g) for g in range(groups) for i in range(n)]
    neg = [(g, 10 * i + g, i % 5 == 0) for g in range(groups) for i in range(10 * n)]
    return spark.createDataFrame(pos, "step long, item long"), spark.createDataFrame(neg, "step long, item long, own boolean")


def test_quotas(spark):
    pos, neg = tables(spark, 6)
    rows = E.negatives("step", pos, neg, "item", 7, 2).collect()
    by = {}
    for r in rows:
        by.setdefault((r.step, r.positive), []).append(r)
    assert len(by) == 24
    for (step, _), mine in by.items():
        assert len({r.negative for r in mine}) == 7 and Counter(r.own for r in mine) == {True: 2, False: 5}
        assert all(r.negative % 10 == step and (r.negative // 10 % 5 == 0) == r.own for r in mine)
    assert len({tuple(sorted(r.negative for r in mine)) for mine in by.values()}) > 20  # samples differ


def test_quotas_of_small_groups(spark):
    pos = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 9), (None, 9)], "step long, item long")
    neg = spark.createDataFrame([(1, i, True) for i in range(6)] + [(2, i, False) for i in range(6)] + [(3, i, i < 4) for i in range(6)] + [(4, i, True) for i in range(3)] + [(None, i, True) for i in range(8)], "step long, item long, own boolean")
    got = Counter((r.step, r.own) for r in E.negatives("step", pos, neg, "item", 5, 1).collect())
    assert got == {(1, True): 5, (2, False): 5, (3, True): 4, (3, False): 1}  # others cannot fill the rest; too few give none


def test_rows_are_linear_in_positives(spark):
    """Ten times the positives and negatives of the same groups make ten times the joined rows, not a hundred."""
    made = []
    for n in (20, 200):
        pos, neg = tables(spark, n)
        df = E.negatives("step", pos, neg, "item", 6, 1)
        assert df.count() == 4 * n * 6
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = joined_rows(df)
        assert rows, plan
        made.append(max(rows))
    assert made[1] <= 15 * made[0]


def joined_rows(df):
    """Output rows of every join of the executed plan."""
    out = []

    def walk(node):
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
        for inner in ("executedPlan", "plan"):
            if name in ("AdaptiveSparkPlan",) and inner == "executedPlan" or name.endswith("QueryStage") and inner == "plan":
                walk(getattr(node, inner)())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out
