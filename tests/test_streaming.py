"""ST1: the streaming dashboard equals the batch counts for on-time data and
drops rows that arrive behind the watermark."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusgauge.session import scratch_path
from corpusgauge.streaming.dashboard import run_dashboard_stream

SCHEMA = ("id string, abuse_types array<string>, risk_level int, gender string, district string, "
          "abuser_is_family boolean, consent boolean, created_at timestamp")


def _write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_counts_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "reports")
    d0 = dt.datetime(2025, 3, 1, 10)
    # file 1: two days of on-time reports; one without consent
    _write(spark, src, [("a", ["physical"], 4, "female", "X", True, True, d0),
                        ("b", ["neglect", "physical"], 2, None, None, False, True, d0 + dt.timedelta(days=3)),
                        ("c", ["verbal"], 1, "male", "Y", None, False, d0 + dt.timedelta(days=3))])
    base = scratch_path(spark, "stream-test")
    schema = spark.read.parquet(src).schema

    def source():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    out = run_dashboard_stream(spark, source(), lambda df: df, base)
    got = {(r["day"], r["metric"], r["key"]): r["n"] for r in out.collect()}
    assert got[("2025-03-01", "total", "all")] == 1 and got[("2025-03-04", "total", "all")] == 1
    assert got[("2025-03-04", "gender", "unknown")] == 1 and got[("2025-03-04", "abuse_type", "physical")] == 1
    assert ("2025-03-04", "district", None) not in got
    assert all(k[2] != "Y" for k in got)  # no consent -> never counted
    # file 2 arrives later: a row far behind the watermark (dropped) and one on time
    _write(spark, src, [("d", ["murder"], 5, "male", "Z", True, True, d0 - dt.timedelta(days=10)),
                        ("e", ["physical"], 3, "female", "X", True, True, d0 + dt.timedelta(days=3, hours=1))])
    out2 = run_dashboard_stream(spark, source(), lambda df: df, base)
    got2 = {(r["day"], r["metric"], r["key"]): r["n"] for r in out2.collect()}
    assert got2[("2025-03-04", "total", "all")] == 2
    assert not any(k[1] == "abuse_type" and k[2] == "murder" for k in got2)


def _reports(n):
    day = dt.datetime(2025, 1, 1)
    kinds = [["physical"], ["neglect", "verbal"], None, []]
    return [(f"r{i}", kinds[i % 4], i % 6, [None, "male", "female"][i % 3], [None, "X", "Y", ""][i % 4],
             [None, True, False][i % 3], [True, True, None, True, False][i % 5], day + dt.timedelta(days=(i * 37) % 90, hours=i % 24))
            for i in range(n)]


@pytest.mark.parametrize("order", ["forwards", "backwards", "mixed"])
def test_any_order_of_files_gives_the_batch_dashboard(spark, tmp_path, order):
    from corpusgauge.operators.reports import dashboard_stats
    from corpusgauge.streaming.dashboard import _numbered_folders, run_additive_dashboard

    rows = sorted(_reports(60), key=lambda r: r[-1], reverse=order == "backwards")
    parts = [rows[i:i + 10] for i in range(0, 60, 10)]
    if order == "mixed":
        parts = parts[3:] + parts[:3]
    src, base = str(tmp_path / "reports"), scratch_path(spark, "any-order")
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        return run_additive_dashboard(spark, source, lambda df: df, base, snapshot_every=3)

    for part in parts[:4]:
        _write(spark, src, part)
    run()
    for part in parts[4:]:   # the job is started again
        _write(spark, src, part)
    out = run()
    assert _numbered_folders(spark, f"{base}/snapshots") == [2, 5]
    got = {(r["metric"], r["key"]): r["n"] for r in out.groupBy("metric", "key").agg(F.sum("n").alias("n")).collect()}
    batch = spark.createDataFrame(rows, SCHEMA).filter("consent")
    assert got == {(r["metric"], r["key"]): r["n"] for r in dashboard_stats(batch).collect()}
    days = {(r["day"], r["n"]) for r in out.filter("metric = 'total'").collect()}
    assert days == {(str(r["d"]), r["n"]) for r in batch.groupBy(F.to_date("created_at").alias("d")).agg(F.count("*").alias("n")).collect()}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    from corpusgauge.streaming.dashboard import _added, additive_dashboard

    base = str(tmp_path / "dash")
    counts = spark.createDataFrame([("2025-01-01", "total", "all", 2)], "day string, metric string, key string, n bigint")
    for number in (0, 1, 1):
        counts.write.mode("overwrite").parquet(f"{base}/batches/{number}")
    assert [r["n"] for r in additive_dashboard(spark, base).collect()] == [4]
    _added(counts).write.parquet(f"{base}/snapshots/0")
    (tmp_path / "dash" / "snapshots" / "1").mkdir()   # begun and not ended: passed over
    assert [r["n"] for r in additive_dashboard(spark, base).collect()] == [4]
    assert additive_dashboard(spark, str(tmp_path / "none")).count() == 0
