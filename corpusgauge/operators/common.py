"""Shared DataFrame building blocks: bounded top-k, sequential ids without a global window,
written tables, lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def shared_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, read again.

    Its lineage ends there, and its size is known when the next plan is made: Spark
    broadcasts it in a join if its bytes are below the threshold, and only then."""
    from corpusgauge.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark) -> None:
    """Lets Spark remove the shuffle files of plans that are no longer used: it does so when the driver's JVM collects
    garbage, by itself every half an hour (spark.cleaner.periodicGC.interval)."""
    spark.sparkContext._jvm.java.lang.System.gc()


def top_k(df: DataFrame, partition_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a group holding a third of all rows sends at most ``k``
    rows per map task to the final sort -- the hot group never lands whole in
    one task.
    """
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


# monotonically_increasing_id: the partition is above these bits, the row number below.
_ROW_BITS = 33


def numbered(df: DataFrame, order_cols, num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order_cols``, with ``_pid`` (partition) and
    ``_row`` (0-based row in it), written once so that all later uses see the same numbers.
    This is the only shuffle of the whole rows."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order_cols]
    placed = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id())
    return shared_table(placed, "numbered").withColumn("_pid", F.shiftright("_m", _ROW_BITS)).withColumn(
        "_row", F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_m")


def sequential_ids(df: DataFrame, order_col: str, out_col: str = "seq",
                   num_partitions: int | None = None) -> DataFrame:
    """1-based position of every row in ``order_col`` order, without a
    single-partition window over the rows: the row's number in its range partition and the
    rows of the partitions before it (one row per partition)."""
    parted = numbered(df, [order_col], num_partitions)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), "offsets")
    return (parted.join(offsets, "_pid").withColumn(out_col, (F.col("_off") + F.col("_row") + 1).cast("bigint"))
            .drop("_pid", "_row", "_off"))


def join_one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate ``right`` to every row of ``left``
    (Spark plans the constant key as a nested-loop join; ``right`` is a single row, so it is
    broadcast and no pairs are made)."""
    return (left.withColumn("_one", F.lit(1))
            .join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def pct(n: Column, d: Column, digits: int = 1) -> Column:
    """Percent with a zero guard, half-even rounding."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * n / d, digits))


def stable_hash_order(seed, *cols) -> Column:
    """Deterministic, partition-independent shuffle key: sha256(seed || '|' || cols)."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir`` (survives
    executor loss, unlike a local checkpoint)."""
    from corpusgauge.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
