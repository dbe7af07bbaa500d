"""ST1 plan: the dashboard as a Structured Streaming job over the ``events`` file."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge.plans.registry import load, query
from corpusgauge.plans.service_plans import TYPE_CAT
from corpusgauge.session import scratch_path
from corpusgauge.streaming.dashboard import run_additive_dashboard, run_dashboard_stream


def event_reports(ev):
    """One anonymised report per event (fixed rules over the event's fields)."""
    k = F.get_json_object("props", "$.k").cast("int")
    cat = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(c)) for t, c, _p in TYPE_CAT])
    uid = F.col("user_id")
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(cat.isNotNull(), F.array(cat)).otherwise(F.array().cast("array<string>")).alias("abuse_types"),
        (F.lit(1) + F.pmod(k, F.lit(5))).alias("risk_level"),
        F.when(F.pmod(uid, F.lit(3)) == 0, "male").when(F.pmod(uid, F.lit(3)) == 1, "female").alias("gender"),
        F.when(F.pmod(uid, F.lit(5)) != 0, F.concat(F.lit("DST_"), F.pmod(uid, F.lit(64)).cast("string")))
        .alias("district"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.lit(True)).when(F.pmod(k, F.lit(3)) == 1, F.lit(False))
        .alias("abuser_is_family"),
        (F.col("value") > 1.0).alias("consent"),
        F.col("ts").cast("timestamp").alias("created_at"))


STREAM_SQL = f"""
WITH e AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                  CASE event_type {' '.join(f"WHEN '{t}' THEN '{c}'" for t, c, _p in TYPE_CAT)} END AS cat FROM events),
r AS (SELECT ts, cat, 1 + k % 5 AS risk_level,
             CASE WHEN user_id % 3 = 0 THEN 'male' WHEN user_id % 3 = 1 THEN 'female' END AS gender,
             CASE WHEN user_id % 5 <> 0 THEN 'DST_' || CAST(user_id % 64 AS VARCHAR) END AS district,
             CASE WHEN k % 3 = 0 THEN 'family' WHEN k % 3 = 1 THEN 'non_family' END AS fam
      FROM e WHERE value > 1.0),
p AS (SELECT ts, 'total' AS metric, 'all' AS key FROM r
      UNION ALL SELECT ts, 'gender', coalesce(gender, 'unknown') FROM r
      UNION ALL SELECT ts, 'district', district FROM r
      UNION ALL SELECT ts, 'risk_level', CAST(risk_level AS VARCHAR) FROM r
      UNION ALL SELECT ts, 'family_vs_non', fam FROM r
      UNION ALL SELECT ts, 'monthly_trend', strftime(ts, '%Y-%m') FROM r
      UNION ALL SELECT ts, 'abuse_type', cat FROM r)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, metric, key, count(*)::BIGINT AS n
FROM p WHERE key IS NOT NULL AND key <> '' GROUP BY ALL"""


@query("dashboard_stream", STREAM_SQL, ops="ST1 F7 S30 A17")
def dashboard_stream(spark, sf_dir):
    # the table's path: one file or a folder of part files; all that is there is one batch
    schema = load(spark, sf_dir, "events").schema
    # (a pattern, because the file source takes a plain path to be a folder)
    src = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    return run_dashboard_stream(spark, src, event_reports, scratch_path(spark, "dashboard-stream"))


FILES_AT_A_TIME = 4   # of the stream that reads the events in any order


@query("dashboard_stream_any_order", STREAM_SQL, ops="ST1 F7 S30 A17")
def dashboard_stream_any_order(spark, sf_dir):
    """The events arrive in files whose order has nothing to do with their time, a few at a time:
    most of them are late, and all of them count."""
    events = load(spark, sf_dir, "events")
    folder = scratch_path(spark, "event-files")
    events.repartition(12, F.xxhash64("event_id")).write.parquet(folder)
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES_AT_A_TIME).parquet(folder)
    return run_additive_dashboard(spark, src, event_reports, scratch_path(spark, "dashboard-any-order"), snapshot_every=2)
