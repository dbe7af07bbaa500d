"""Hard negatives against plain Python over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.llm import hard_negatives as H


def brute(rows, p=H.MineParams(), every=10):
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            best[i] = min(best.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, va) in best.items():
        if a % every:
            continue
        scores = sorted((-dot(va, v), i, label) for i, (label, v) in best.items() if i != a)
        for s, i, _ in [x for x in scores if x[2] == la][:p.positives]:
            fit = [x for x in scores if x[2] != la and p.low * -s <= 100 * -x[0] <= p.high * -s][:p.negatives]
            out += [(a, i, -s, j, -t, k + 1) for k, (t, j, _) in enumerate(fit)]
    return sorted(out)


def made(seed, n, dims, span, labels=3):
    rng = random.Random(seed)
    centres = [[rng.randrange(-span, span) for _ in range(dims)] for _ in range(6)]
    return [(i, rng.randrange(labels), [c + rng.randrange(-span // 3 - 1, span // 3 + 1) for c in rng.choice(centres)])
            for i in range(n)]


def mined(spark, data, **kw):
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id bigint, label int, embedding array<bigint>, ID string").drop("ID")
    out = H.mine(df.repartition(3), F.col("id") % 10 == 0, p=H.MineParams(**kw))
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("dims,span", [(1, 5), (7, 40), (64, 100), (130, 3)])
def test_matches_all_pairs(spark, dims, span):
    rows = made(dims, 300, dims, span)
    want = brute(rows)
    assert mined(spark, rows) == want and want
    assert mined(spark, rows, rows=17, width=2, block_bytes=15 * (32 + 24 * dims)) == want


def test_odd_rows(spark):
    rows = made(1, 60, 4, 6)
    rows += [(None, 1, [1, 2, 3, 4]), (61, None, [1, 2, 3, 4]), (62, 1, None), (63, 1, [1, None, 3, 4]), (64, 1, []), (70, 0, []),
             (65, 1, [9, 9]), (66, 2, [9, 9, 1, 1, 5, 5, 5]), (10, 1, [0, 0, 0, 1]), (10, 1, [0, 0, 0, 1]), (67, 0, [1 << 27, 0, 0, -(1 << 27)]),
             (80, 0, [1 << 27, 5, 5, 5]), (81, 0, [1, 1, 1, 1]), (82, 1, [1, 1, 1, 1]), (83, 2, [1, 1, 1, 1])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1])]) == [] and mined(spark, [(10, 1, [1])]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(-50, 50, (40, 8)), 4, axis=1) + rng.integers(-3, 4, (40, 32))
    means, devs = H.summary(x, 4)
    block = H.Block(np.arange(40), np.zeros(40), x, means, devs)
    true = x @ x.T
    before = None
    for m, s in block.steps(4, 8):
        middle, spread = m @ m.T, s @ s.T
        assert (middle - spread <= true + 1e-6).all() and (true <= middle + spread + 1e-6).all()
        assert before is None or (spread <= before + 1e-6).all()   # finer segments bound better
        before = spread
    r, a = H.survivors(block, block, np.ones((40, 40), bool), np.full(40, true.max()), np.full(40, np.inf), 4)
    assert 0 < len(r) < 40 and true.max() in true[np.ix_(r, a)]


def test_too_large_scores_are_refused():
    with pytest.raises(ValueError):
        H.exact(np.array([[1 << 40]]), np.array([[1 << 40]]))
    assert H.exact(np.array([[1 << 30, 1]]), np.array([[1 << 30, 1]]))[0, 0] == (1 << 60) + 1
