"""The stored inverted-file index against plain cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators.vector_index import IndexParams, VectorIndex
from corpusgauge.session import scratch_path


def made(n=1500, dims=16, groups=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dims))


def brute(x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        sims = unit @ unit[q]
        out[q] = sorted(range(len(x)), key=lambda i: (-round(sims[i], 12), i))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qid"], {})[r["rank"]] = r["did"]
    return {q: [d[i] for i in sorted(d)] for q, d in out.items()}


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, e array<double>").repartition(4)


@pytest.fixture(scope="module")
def index(spark):
    x = made()
    df = frame(spark, x)
    path = scratch_path(spark, "index-test")
    return x, df, VectorIndex.build(df, "vec_id", "e", path, IndexParams(block=40)), path


def test_exact_search_equals_plain_cosines(spark, index):
    x, df, _, path = index
    again = VectorIndex(spark, path)   # opened from its files
    queries = df.filter(F.col("vec_id") % 50 == 0)
    want = brute(x, range(0, len(x), 50), 10)
    assert found(again.search(queries, "vec_id", "e", 10, probes=1, exact=True, block=7)) == want
    assert found(again.search(queries, "vec_id", "e", 10, probes=10_000)) == want   # all lists


def test_inexact_search_reaches_its_recall_on_few_lists(spark, index):
    x, df, ix, _ = index
    queries = df.filter(F.col("vec_id") % 10 == 0)
    want = brute(x, range(0, len(x), 10), 10)
    lists = ix.centroids().count()
    got = found(ix.search(queries, "vec_id", "e", 10, probes=4))
    recall = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert lists == 39 and recall >= 0.9


def test_every_vector_is_in_one_block_and_unprobed_lists_are_not_read(spark, index):
    x, df, ix, _ = index
    members = ix.postings().select("list", F.size("ids").alias("n"), F.explode("ids").alias("id"))
    assert members.count() == members.select("id").distinct().count() == len(x)
    plan = ix.postings().filter(F.col("list").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_odd_vectors_and_a_hot_list(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(300 + i, [0.1 * i, 1.0, -1.0]) for i in range(30)]
    rows += [(None, [1.0, 2.0, 3.0]), (400, None), (401, []), (402, [0.0, 0.0, 0.0]), (403, [1.0, None, 2.0]), (404, [float("nan"), 1.0, 1.0]),
             (0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    ix = VectorIndex.build(df, "id", "v", scratch_path(spark, "index-hot"), IndexParams(lists=5, block=16))
    assert ix.postings().select(F.sum(F.size("ids"))).first()[0] == 331
    assert ix.postings().agg(F.max(F.size("ids"))).first()[0] < 60   # the hot list has many blocks
    got = found(ix.search(df, "id", "v", 4, probes=1, exact=True))
    assert got[7] == [0, 0, 1, 2] and got[300][0] == 300 and not {400, 401, 402, 403, 404, None} & set(got)
    empty = VectorIndex.build(df.limit(0), "id", "v", scratch_path(spark, "index-empty"))
    assert empty.search(df, "id", "v", 3, exact=True).count() == 0
    assert ix.search(df.limit(0), "id", "v", 3, exact=True).count() == 0
