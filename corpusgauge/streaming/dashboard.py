"""ST1: continuous dashboard counts over arriving reports.

Reports arrive as files.  The stream applies the consent gate (F7) and the
whitelist (S30), turns every report into its (metric, key) pairs -- all
measures are additive -- and keeps per-day counts in a watermarked tumbling
window (late rows beyond the watermark are dropped: our rule).  Output mode is
``update``; each micro-batch writes its updated rows with the batch id
through ``foreachBatch`` (idempotent per batch: a re-run batch overwrites its
own folder), and the current dashboard is the latest row per
(day, metric, key).  Checkpoint and output live below the shared
``spark.checkpoint.dir``.

:func:`run_additive_dashboard` loses no late row: because all measures are additive, a
micro-batch is counted by itself and its counts are added to those of the others by key, so
the dashboard does not depend on the order of files or on how they are cut into batches.  It
needs no state and no watermark; from time to time the counts so far are made one snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.operators.reports import REPORT_COLUMNS, sanitize
from corpusgauge.sources.io import path_exists


def metric_pairs(reports: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """(ts, metric, key) rows of every report -- the additive form of A17."""
    def pair(metric: str, key: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"))

    fam = (F.when(F.col("abuser_is_family") == F.lit(True), "family")
           .when(F.col("abuser_is_family") == F.lit(False), "non_family"))
    scalars = F.array(
        pair("total", F.lit("all")),
        pair("gender", F.coalesce(F.col("gender"), F.lit("unknown"))),
        pair("district", F.col("district")),
        pair("risk_level", F.col("risk_level")),
        pair("family_vs_non", fam),
        pair("monthly_trend", F.date_format(ts_col, "yyyy-MM")))
    types = F.transform(F.coalesce(F.col("abuse_types"), F.array().cast("array<string>")),
                        lambda t: pair("abuse_type", t))
    rows = F.filter(F.concat(scalars, types), lambda p: p["key"].isNotNull() & (p["key"] != ""))
    return reports.select(F.col(ts_col).alias("ts"), F.explode(rows).alias("p")).select("ts", "p.metric", "p.key")


def accepted_pairs(reports: DataFrame) -> DataFrame:
    """The pairs of the reports with consent, from whitelisted columns only."""
    accepted = reports.filter(F.coalesce(F.col("consent") == F.lit(True), F.lit(False)))
    return metric_pairs(sanitize(accepted))


def windowed_counts(pairs: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    return (pairs.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "metric", "key")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "metric", "key",
                    F.col("n").cast("bigint").alias("n")))


def run_dashboard_stream(spark: SparkSession, source: DataFrame, to_reports, base_path: str,
                         window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Run the stream to completion (``availableNow``) and return the dashboard.

    ``source`` is a streaming DataFrame; ``to_reports`` maps it to report rows
    with a ``consent`` flag and a ``created_at`` timestamp.  Files come in order of their
    modification, not of their events, so a backfill must not cut the source into small
    batches (``maxFilesPerTrigger``): the watermark would drop what is older than the batch
    before.  Within a batch the order does not matter."""
    counts = windowed_counts(accepted_pairs(to_reports(source)), window, watermark)
    out_path = f"{base_path}/updates"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # the folder name carries the batch id (read back as a partition column)
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    q = (counts.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", f"{base_path}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, out_path):  # no micro-batch ran
        return spark.createDataFrame([], "day string, metric string, key string, n bigint")
    updates = spark.read.option("basePath", out_path).parquet(out_path)
    return (updates.groupBy("day", "metric", "key")
            .agg(F.max_by("n", "batch_id").cast("bigint").alias("n")))


COUNTS = "day string, metric string, key string, n bigint"


def _numbered_folders(spark: SparkSession, path: str) -> list[int]:
    """The numbers k of the complete folders ``path/k`` (written to their end), in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("day", "metric", "key").agg(F.sum("n").cast("bigint").alias("n"))


def additive_dashboard(spark: SparkSession, base_path: str, upto: int | None = None) -> DataFrame:
    """(day, metric, key, n) of all batches (up to number ``upto``): the newest snapshot and the
    batches after it."""
    batches, snapshots = (_numbered_folders(spark, f"{base_path}/{x}") for x in ("batches", "snapshots"))
    if upto is not None:
        batches, snapshots = [k for k in batches if k <= upto], [k for k in snapshots if k <= upto]
    last = snapshots[-1] if snapshots else -1
    paths = [f"{base_path}/snapshots/{last}"] * (last >= 0) + [f"{base_path}/batches/{k}" for k in batches if k > last]
    if not paths:
        return spark.createDataFrame([], COUNTS)
    return _added(spark.read.schema(COUNTS).parquet(*paths))


def run_additive_dashboard(spark: SparkSession, source: DataFrame, to_reports, base_path: str,
                           snapshot_every: int = 50) -> DataFrame:
    """Count what has arrived since the last run (``availableNow``) and return the dashboard.

    Rows count whenever they arrive, in any order and any cut into micro-batches.  A batch writes
    the folder of its number, which a re-run of the batch after a failure overwrites, so each row
    counts once.  After ``snapshot_every`` batches their counts are added to the last snapshot; the
    batches' folders stay, so a snapshot that was not written to its end is just passed over."""
    pairs = accepted_pairs(to_reports(source)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "metric", "key")

    def write_batch(batch: DataFrame, number: int) -> None:
        batch.groupBy("day", "metric", "key").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
            f"{base_path}/batches/{number}")
        if (number + 1) % snapshot_every == 0:
            additive_dashboard(spark, base_path, number - 1).unionByName(
                spark.read.schema(COUNTS).parquet(f"{base_path}/batches/{number}")).transform(_added).write.mode(
                "overwrite").parquet(f"{base_path}/snapshots/{number}")

    q = (pairs.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{base_path}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return additive_dashboard(spark, base_path)
