"""No caps, no silent empty results, no overflow: rules that only show at scale or on odd input."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgauge.operators import agreement as AG
from corpusgauge.operators import evalstats as M
from corpusgauge.operators import quality as Q
from corpusgauge.operators import retrieval as RT
from corpusgauge.operators import sampling as S
from corpusgauge.sources import io as IO


def test_reports_are_not_capped_and_errors_are_raised(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text("".join(json.dumps({"id": f"r{i:05d}", "risk_level": 1}) + "\n" for i in range(6000)))
    assert IO.read_reports(spark, str(p)).count() == 6000
    assert [r["id"] for r in IO.read_reports(spark, str(p), limit=2).collect()] == ["r00000", "r00001"]
    broken = tmp_path / "broken.parquet"
    broken.write_text("this is no footer")
    with pytest.raises(Exception):
        spark.read.parquet(str(broken)).count()
    assert IO.read_metrics(spark, str(tmp_path / "none*.json")).count() == 0


def test_equal_reports_have_two_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 3), (2, True, 3), (3, False, 3)], "row int, consent boolean, risk_level int")
    for key, folder in ((["row"], "a"), (None, "b")):
        out = str(tmp_path / folder)
        assert IO.append_reports(df, out, key) == 2 and IO.append_reports(df.filter("row = 1"), out, key) == 1
        back = IO.read_reports(spark, out)
        assert back.count() == 3 and back.select("id").distinct().count() >= 2


def test_inventory_of_folders(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "t2.parquet"))
    rows = {r["table"]: r for r in IO.table_inventory(spark, {"t": str(tmp_path / "t.parquet"), "t2": str(tmp_path / "t2.parquet")}).collect()}
    for name, n in (("t", 100), ("t2", 7)):
        size = sum(f.stat().st_size for f in (tmp_path / f"{name}.parquet").glob("*.parquet"))
        assert (rows[name]["n_rows"], rows[name]["n_columns"], rows[name]["bytes"]) == (n, 1, size)


def test_stream_over_part_files_equals_the_batch(spark, tmp_path):
    from corpusgauge.plans.stream_plans import dashboard_stream

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # four part files, written with the newest events first
    ranked = ev.withColumn("part", F.ntile(4).over(Window.orderBy("ts")))
    for part in (4, 2, 3, 1):
        ranked.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    key = lambda r: (r["day"], r["metric"], r["key"], r["n"])
    parts = sorted(map(key, dashboard_stream(spark, str(tmp_path)).collect()))
    single = sorted(map(key, dashboard_stream(spark, "/root/testdata/sf0.001").collect()))
    assert parts == single and len(parts) > 100
    assert any(m == "monthly_trend" for _, m, _, _ in parts)


def test_chi_square_of_24_million_rows(spark):
    # 4 x 5 cells: row 0 lies in column 0 alone, the other rows are even
    df = spark.range(24_000_000).select((F.col("id") % 4).alias("a"), F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id") % 5).alias("b"))
    out = M.chi_square(df, "a", "b", "big").first()
    o, n = {(a, b): 0.0 for a in range(4) for b in range(5)}, 24e6
    for a in range(4):
        for b in range(5):
            o[a, b] = 6e6 * (b == 0) if a == 0 else 1.2e6
    r, c = [6e6] * 4, [sum(o[a, b] for a in range(4)) for b in range(5)]
    want = sum((o[a, b] - r[a] * c[b] / n) ** 2 / (r[a] * c[b] / n) for a in range(4) for b in range(5))
    assert out["n"] == 24_000_000 and out["dof"] == 12 and math.isclose(out["chi2"], want, rel_tol=1e-9)
    assert out["p_value"] == 0.0 and out["log10_p"] < -1e6


def test_strong_effects_keep_their_logarithm(spark):
    t = spark.createDataFrame([(3000, 1, 1, 3000)], "a long, b long, c long, d long")
    out = M.fisher_exact(t).first()
    assert out["p_value"] == 0.0 and out["log10_p"] is not None and -1810 < out["log10_p"] < -1780
    rows = spark.range(5000).select(F.lit("x").alias("y"), F.lit("x").alias("p"), F.lit("z").alias("q"))
    assert abs(M.mcnemar_exact(rows, "y", "p", "q").first()["log10_p"] - (1 - 5000) * math.log10(2)) < 1e-3


def test_quotas_of_billions(spark):
    counts = spark.createDataFrame([("a", 6_000_000_000, 1), ("b", 4_000_000_000, 2), ("c", 1, 3)], "s string, n long, o int")
    got = {r["s"]: r["quota"] for r in S.largest_remainder_quotas(
        counts.withColumn("d", F.lit(7_000_000_000).cast("bigint")), "s", "n", "d", "o").collect()}
    total = 10_000_000_001
    floors = {s: n * 7_000_000_000 // total for s, n in (("a", 6_000_000_000), ("b", 4_000_000_000), ("c", 1))}
    assert sum(got.values()) == 7_000_000_000 and all(got[s] - floors[s] in (0, 1) for s in got)


def test_agreement_of_billions(spark):
    long = spark.createDataFrame([(i, r, "x" if i % 3 else "y") for i in range(9) for r in "ab"], "i int, r string, l string")
    out = AG.fleiss_kappa(long, "i", "l", ["x", "y"], 2).first()
    assert out["fleiss_kappa"] == 1.0


def test_lock_verifies_at_its_own_width(spark):
    ids = spark.range(500).select("id")
    for digits in (1, 3, Q.LOCK_HEX_DIGITS):
        lock = Q.ids_lock(ids, "id", digits)
        assert lock.first()["hex_digits"] == digits
        assert Q.verify_lock(ids.repartition(7), "id", lock).first()["ok"]
        assert not Q.verify_lock(ids.filter("id <> 3"), "id", lock).first()["ok"]
    assert Q.ids_lock(ids, "id").first() == Q.ids_lock(ids.repartition(3), "id").first()


def test_ranks_and_numbers_in_one_shuffle(spark):
    from corpusgauge.operators.common import sequential_ids

    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    df = df.withColumn("g", F.when(F.col("g") != "2", F.col("g")))  # a null group as well
    ranked = S.rank_within_groups(df, "g", "h", "rk", 5).collect()
    want: dict = {}
    for r in sorted(ranked, key=lambda r: r["h"]):
        want[r["g"]] = want.get(r["g"], 0) + 1
        assert r["rk"] == want[r["g"]]
    seq = sorted((r["seq"], r["h"]) for r in sequential_ids(df, "h", "seq", 4).collect())
    assert [s for s, _ in seq] == list(range(1, 1001)) and [h for _, h in seq] == sorted(h for _, h in seq)


def test_lexical_search_shuffles_no_pairs(spark, monkeypatch):
    q = spark.createDataFrame([(1, "a b c the"), (2, "the x"), (3, ""), (4, None)], "q int, t string")
    d = spark.createDataFrame([(i, f"the a w{i} {'x' if i % 2 else 'b c'}") for i in range(50)] + [(60, None)], "d int, t string")
    got = sorted((r["q"], r["rank"], r["d"], r["score"]) for r in RT.lexical_overlap(q, "q", "t", d, "d", "t", 2).collect())
    assert got == [(1, 1, 0, 4), (1, 2, 2, 4), (2, 1, 1, 2), (2, 2, 3, 2)]
    plan = RT.lexical_overlap(q, "q", "t", d, "d", "t", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan and "Join" not in plan
    monkeypatch.setattr(RT, "BLOCK_WORDS", 3)
    assert sorted((r["q"], r["rank"], r["d"], r["score"]) for r in RT.lexical_overlap(q, "q", "t", d, "d", "t", 2).collect()) == got


def test_bangla_stopwords_of_the_case_table(spark):
    from corpusgauge import fixed as X
    from corpusgauge.functions import text as T

    df = spark.createDataFrame([("বাবা মাকে খাবার দেয় না।",)], "text string")
    words = {r[0] for r in df.select(F.explode(T.bangla_tokens("text"))).collect()}
    assert "খাবার" in words - set(X.CASE_BN_STOP) and {"বাবা", "মাকে"} <= set(X.CASE_BN_STOP)
