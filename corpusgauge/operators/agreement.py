"""Rater agreement (M1-M4) as plain aggregates.

All measures reduce to counts: a confusion matrix (M1, M2) or per-item
category counts (M3, M4), each a partial aggregate; the final formulas run on
a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions.normalize import band_at_least
from corpusgauge.operators.common import join_one_row


def confusion(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """M1: full label x label grid of counts (empty cells 0) over rows where both are valid."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], f"{a} string, {b} string")
    valid = df.filter(F.col(a).isin(labels) & F.col(b).isin(labels))
    counts = valid.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(grid).join(counts, [a, b], "left")
            .select(a, b, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def cohen_kappa(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """M2: Cohen's kappa, percent agreement, compared and dropped counts, verdict."""
    valid = F.col(a).isin(labels) & F.col(b).isin(labels)
    base = df.select(F.coalesce(valid, F.lit(False)).alias("_v"), a, b)
    totals = base.agg(F.count_if("_v").alias("n_compared"), F.count_if(~F.col("_v")).alias("n_dropped"),
                      F.count_if(F.col("_v") & (F.col(a) == F.col(b))).alias("_agree"))
    ma = base.filter("_v").groupBy(F.col(a).alias("_l")).agg(F.count(F.lit(1)).alias("_na"))
    mb = base.filter("_v").groupBy(F.col(b).alias("_l")).agg(F.count(F.lit(1)).alias("_nb"))
    pe_num = ma.join(mb, "_l").agg(F.sum(F.col("_na").cast("double") * F.col("_nb")).alias("_pe_num"))
    j = join_one_row(totals, pe_num)
    n = F.col("n_compared").cast("double")
    po = F.col("_agree") / n
    pe = F.coalesce(F.col("_pe_num"), F.lit(0)) / (n * n)
    kappa = F.when(pe == 1.0, F.lit(None).cast("double")).otherwise((po - pe) / (1 - pe))
    return j.select(
        F.col("n_compared").cast("bigint").alias("n_compared"),
        F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.round(kappa, 6).alias("cohen_kappa"),
        F.round(po, 6).alias("percent_agreement"),
        F.when(kappa >= X.COHEN_OK, X.COHEN_VERDICTS[0]).otherwise(X.COHEN_VERDICTS[1]).alias("verdict"))


def fleiss_kappa(long: DataFrame, item_col: str, label_col: str, categories: list[str], k: int) -> DataFrame:
    """M3 + M4: Fleiss' kappa over items with exactly ``k`` valid labels.

    Returns n_items, fleiss_kappa, P_bar, P_e, top_label_agreement (the
    source's pairwise figure that only counts the top label) and the verdict.
    NaN-free: kappa is null when P_e = 1."""
    valid = long.filter(F.col(label_col).isin(categories))
    per_cat = valid.groupBy(item_col, label_col).agg(F.count(F.lit(1)).alias("_nij"))
    per_item = per_cat.groupBy(item_col).agg(
        F.sum("_nij").alias("_n"), F.sum(F.col("_nij").cast("double") * F.col("_nij")).alias("_sq"),
        F.max("_nij").alias("_top"))
    items = per_item.filter(F.col("_n") == k)
    item_stats = items.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg((F.col("_sq") - k) / F.lit(k * (k - 1))).alias("P_bar"),
        F.avg(F.col("_top") * (F.col("_top") - 1) / F.lit(k * (k - 1))).alias("top_label_agreement"))
    cat_tot = (per_cat.join(items.select(item_col), item_col, "left_semi")
               .groupBy(label_col).agg(F.sum("_nij").alias("_cj")))
    pe = cat_tot.agg(F.sum(F.col("_cj").cast("double") * F.col("_cj")).alias("_cj_sq"), F.sum(F.col("_cj").cast("double")).alias("_ctot"))
    j = join_one_row(item_stats, pe)
    p_e = F.col("_cj_sq") / (F.col("_ctot") * F.col("_ctot"))
    kappa = F.when(p_e == 1.0, F.lit(None).cast("double")).otherwise((F.col("P_bar") - p_e) / (1 - p_e))
    return j.select(
        F.col("n_items").cast("bigint").alias("n_items"),
        F.round(kappa, 6).alias("fleiss_kappa"),
        F.round("P_bar", 6).alias("P_bar"), F.round(p_e, 6).alias("P_e"),
        F.round("top_label_agreement", 6).alias("top_label_agreement"),
        band_at_least(kappa, X.FLEISS_VERDICTS, X.FLEISS_FLOOR).alias("verdict"))


def items_rated_by_all(long: DataFrame, item_col: str, rater_col: str, k: int) -> DataFrame:
    """Ids present for all ``k`` raters."""
    return (long.groupBy(item_col).agg(F.countDistinct(rater_col).alias("_r"))
            .filter(F.col("_r") == k).select(item_col))
