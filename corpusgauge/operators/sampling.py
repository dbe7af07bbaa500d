"""Reproducible stratified sampling and splits.

Shuffles are replaced by a deterministic order: sha-256 of ``seed|id``.  The
result is independent of partitioning and of executor loss (re-computed tasks
get the same rows), and the SQL oracle can compute the same order.

Quotas follow the largest-remainder rule (floor of the proportional share,
the rest to the strata with the largest remainders, ties in label order).
Remainders are compared as exact integers ``(count * draws) mod total``.

Ranking inside a stratum never sorts a stratum in one task: rows are
range-partitioned on (stratum, hash), each partition is numbered locally, and
per-(stratum, partition) offsets are added (:func:`rank_within_groups`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.operators.common import numbered, shared_table, stable_hash_order


def rank_within_groups(df: DataFrame, group_col: str, order_col: str, out_col: str = "rank",
                       num_partitions: int | None = None) -> DataFrame:
    """1-based rank of each row inside its group by ``order_col`` (unique within the group).

    Sorted inside its range partition, a group's rows there are consecutive: the rank is the
    row's distance from the group's first row there plus the group's rows in the partitions
    before.  Only one row per (group, partition) is shuffled after the range partitioning."""
    parted = numbered(df, [group_col, order_col], num_partitions)
    counts = parted.groupBy(group_col, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(counts.select(
        F.col(group_col).alias("_g"), F.col("_pid").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off")), "offsets")
    joined = parted.join(offsets, F.col(group_col).eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p")))
    return joined.withColumn(out_col, (F.col("_row") + F.col("_off")).cast("bigint")).drop(
        "_pid", "_row", "_off", "_g", "_p")


def largest_remainder_quotas(counts: DataFrame, stratum_col: str, n_col: str, draws_col: str,
                             order_col: str, out_col: str = "quota") -> DataFrame:
    """Per-stratum quotas summing to ``draws`` (one value per table).

    Remainder ties go to the earlier label order, then the smaller stratum
    value, so the result never depends on row order.  Products of counts are exact decimals:
    they pass 64 bits from some 3e9 rows on."""
    total = F.sum(n_col).over(Window.partitionBy())
    wide = counts.withColumn("_tot", total.cast("decimal(18,0)")).withColumn(
        "_prod", F.col(n_col).cast("decimal(18,0)") * F.col(draws_col).cast("decimal(18,0)"))
    with_floor = (wide.withColumn("_floor", F.expr("_prod div _tot").cast("bigint"))
                  .withColumn("_rem", F.pmod(F.col("_prod"), F.col("_tot"))))
    need = F.col(draws_col) - F.sum("_floor").over(Window.partitionBy())
    ranked = with_floor.withColumn("_need", need).withColumn(
        "_rr", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(order_col), F.col(stratum_col))))
    return (ranked.withColumn(out_col, F.col("_floor") + F.when(F.col("_rr") <= F.col("_need"), 1).otherwise(0))
            .drop("_tot", "_prod", "_floor", "_rem", "_need", "_rr"))


def stratum_counts(df: DataFrame, stratum_col: str, labels: list[str] | None = None) -> DataFrame:
    """Counts per stratum with a label order column (labels list order, else name)."""
    c = df.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("n"))
    if labels:
        order = F.coalesce(F.array_position(F.array(*[F.lit(l) for l in labels]), F.col(stratum_col)),
                           F.lit(len(labels) + 1))
    else:
        order = F.lit(0)
    return c.withColumn("label_ord", order)


def stratified_split(df: DataFrame, id_col: str, stratum_col: str, seed: int = 42,
                     test_frac_num: int = 3, test_frac_den: int = 10,
                     labels: list[str] | None = None) -> DataFrame:
    """70/15/15-style split: first ``train`` vs rest (rest = ceil(frac*n)),
    then the rest in halves (test = ceil(rest/2)); quotas per stratum by the
    largest-remainder rule applied to train first, then to val.

    Adds ``split`` in {train, val, test}."""
    counts = stratum_counts(df, stratum_col, labels)
    tot = F.sum("n").over(Window.partitionBy())
    n_rest = F.floor((F.lit(test_frac_num) * tot + F.lit(test_frac_den - 1)) / F.lit(test_frac_den))
    c1 = counts.withColumn("_draw_train", (tot - n_rest).cast("bigint"))
    q_train = largest_remainder_quotas(c1, stratum_col, "n", "_draw_train", "label_ord", "q_train")
    rem = q_train.withColumn("n_rest", F.col("n") - F.col("q_train"))
    rest_tot = F.sum("n_rest").over(Window.partitionBy())
    rem = rem.withColumn("_draw_val", (rest_tot - F.ceil(rest_tot / F.lit(2))).cast("bigint"))
    q_val = largest_remainder_quotas(rem, stratum_col, "n_rest", "_draw_val", "label_ord", "q_val")
    quotas = q_val.select(stratum_col, "q_train", "q_val")
    keyed = df.withColumn("_h", stable_hash_order(seed, id_col))
    ranked = rank_within_groups(keyed, stratum_col, "_h", "_rk")
    # one row per stratum, written: broadcast if it is small, whatever the number of strata
    j = ranked.join(shared_table(quotas, "quotas"), stratum_col)
    return (j.withColumn("split", F.when(F.col("_rk") <= F.col("q_train"), "train")
                         .when(F.col("_rk") <= F.col("q_train") + F.col("q_val"), "val")
                         .otherwise("test"))
            .drop("_h", "_rk", "q_train", "q_val"))


def stratified_sample(df: DataFrame, id_col: str, stratum_col: str, size: int, seed: int = 42,
                      labels: list[str] | None = None, out_col: str = "in_sample") -> DataFrame:
    """Fixed-size stratified sample; adds a boolean ``in_sample``."""
    counts = stratum_counts(df, stratum_col, labels).withColumn("_draw", F.lit(size).cast("bigint"))
    quotas = largest_remainder_quotas(counts, stratum_col, "n", "_draw", "label_ord", "_q").select(
        stratum_col, "_q")
    keyed = df.withColumn("_h", stable_hash_order(seed, id_col))
    ranked = rank_within_groups(keyed, stratum_col, "_h", "_rk")
    return (ranked.join(shared_table(quotas, "quotas"), stratum_col)
            .withColumn(out_col, F.col("_rk") <= F.col("_q")).drop("_h", "_rk", "_q"))


def stratified_folds(df: DataFrame, id_col: str, stratum_col: str, k: int, seed: int = 42,
                     labels: list[str] | None = None, out_col: str = "fold") -> DataFrame:
    """P5: stratified k-fold: fold = (offset of the stratum + rank - 1) mod k."""
    counts = stratum_counts(df, stratum_col, labels)
    offs = counts.select(stratum_col, F.coalesce(F.sum("n").over(
        Window.orderBy("label_ord", stratum_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))
    keyed = df.withColumn("_h", stable_hash_order(seed, id_col))
    ranked = rank_within_groups(keyed, stratum_col, "_h", "_rk")
    return (ranked.join(shared_table(offs, "fold-offsets"), stratum_col)
            .withColumn(out_col, F.pmod(F.col("_off") + F.col("_rk") - 1, F.lit(k)).cast("int"))
            .drop("_h", "_rk", "_off"))


def uniform_sample(df: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """Sample of ``size`` rows without replacement (smallest hash keys)."""
    return (df.withColumn("_h", stable_hash_order(seed, id_col))
            .orderBy("_h").limit(size).drop("_h"))


def rater_sheets(overlap: DataFrame, own: DataFrame, id_col: str, raters: list[str],
                 seed: int = 42, label_cols=("polarity", "emotion")) -> DataFrame:
    """Each rater's sheet = the shared overlap ids + the rater's own fold,
    ordered by sha-256(seed|rater|id), labels blank.  ``own`` has a ``rater``
    column.  The rater dimension is tiny and broadcast."""
    shared = overlap.select(id_col, F.explode(F.array(*[F.lit(r) for r in raters])).alias("rater"))
    sheets = shared.unionByName(own.select(id_col, "rater"))
    sheets = sheets.withColumn("_h", stable_hash_order(seed, "rater", id_col))
    ranked = rank_within_groups(sheets, "rater", "_h", "sheet_pos")
    out = ranked.drop("_h")
    for c in label_cols:
        out = out.withColumn(c, F.lit(""))
    return out
