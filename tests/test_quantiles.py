"""Exact quantiles of many groups by rank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import eda as E


def made(seed=1):
    rng = np.random.default_rng(seed)
    rows = [("hot", int(v)) for v in rng.integers(0, 5000, 3000)] + [("same", 7)] * 500 + [("one", 3), ("two", 1), ("two", 2)]
    rows += [(None, int(v)) for v in rng.integers(-50, 50, 101)] + [("hot", None), ("nothing", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v long").repartition(6)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_of_all_groups(spark, q):
    rows = made()
    got = {r["g"]: (r["n"], r["x"]) for r in E.group_quantiles(E.value_counts(frame(spark, rows), ["g"], "v"), ["g"], {"x": q, "y": 0.5}).collect()}
    want = {}
    for g in {g for g, _ in rows} - {"nothing"}:
        values = [v for h, v in rows if h == g and v is not None]
        want[g] = (len(values), float(np.quantile(values, q)))
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1]) for g in want)


def test_a_hot_group_is_dealt_over_many_tasks_and_nothing_buffers_it(spark):
    rows = [("hot", i) for i in range(4000)] + [("cold", i) for i in range(40)]
    counts = E.value_counts(frame(spark, rows), ["g"], "v")
    per_task = counts.filter("g = 'hot'").groupBy("_pid").count().collect()
    assert len(per_task) >= 6 and max(r["count"] for r in per_task) < 1500
    plan = E.group_quantiles(counts, ["g"], {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_box_stats_against_numpy(spark):
    rows = made(4)
    got = {r["g"]: r for r in E.box_stats(frame(spark, rows), "g", "v").collect()}
    for g in ("hot", "same", "one", "two", None):
        x = np.array([v for h, v in rows if h == g and v is not None])
        q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        r = got[g]
        assert (r["n"], r["q1"], r["median"], r["q3"]) == (len(x), pytest.approx(q1), pytest.approx(med), pytest.approx(q3))
        assert r["whisker_low"] == x[x >= q1 - 1.5 * (q3 - q1)].min() and r["whisker_high"] == x[x <= q3 + 1.5 * (q3 - q1)].max()
        assert r["mean_len"] == pytest.approx(round(x.mean(), 2), abs=0.011)


def test_one_row_statistics_and_empty_tables(spark):
    df = spark.createDataFrame([(1.5,), (2.5,), (None,), (10.0,)], "v double")
    r = E.missing_and_age_stats(df, "v").first()
    assert (r["n_valid"], r["min_value"], r["max_value"], r["median_value"]) == (3, 1.5, 10.0, 2.5)
    r = E.length_stats(df.select(F.col("v").cast("long").alias("v")), "v").first()
    assert (r["n"], r["median_len"], r["p90_len"], r["max_len"]) == (4, 2.0, pytest.approx(8.4), 10)
    empty = E.length_stats(df.limit(0), "v").first()
    assert empty["n"] == 0 and empty["median_len"] is None
    assert E.box_stats(frame(spark, made()).limit(0), "g", "v").count() == 0
