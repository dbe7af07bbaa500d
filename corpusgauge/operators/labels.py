"""Label assembly, audit and gold-label operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions.normalize import map_or_null


def polarity_from_flags(quality_col: str, toxic_col: str):
    """Three-way polarity from two 0/1 flags: toxic -> Negative, quality -> Positive, else Neutral."""
    return (F.when(F.col(toxic_col) == 1, "Negative")
            .when(F.col(quality_col) == 1, "Positive").otherwise("Neutral"))


def polarity_code_from_flags(quality_col: str, toxic_col: str):
    return (F.when(F.col(toxic_col) == 1, "Neg")
            .when(F.col(quality_col) == 1, "Pos").otherwise("Neu"))


def decode_codes(df: DataFrame, pol_col: str = "pol", emo_col: str | None = "emo") -> DataFrame:
    """Neg/Neu/Pos and ANG/GRF/PRY/BLM/OTH codes -> labels (unknown -> null)."""
    out = df.withColumn("polarity", map_or_null(F.col(pol_col), X.POLARITY_CODES))
    if emo_col:
        out = out.withColumn("emotion", map_or_null(F.col(emo_col), X.EMOTION_CODES))
    return out


def attach_codes(corpus: DataFrame, codes: DataFrame, id_col: str) -> DataFrame:
    """Corpus left-joined with decoded codes on the id."""
    return corpus.join(codes, id_col, "left")


def keyed_correction(df: DataFrame, fixes: DataFrame, id_col: str, col: str) -> DataFrame:
    """Update ``col`` by id where the stored value equals the fix's ``old``.

    ``fixes`` has (id, old, new).  Returns the corrected frame with an
    ``applied`` flag; fixes whose precondition fails are reported by
    :func:`correction_violations`."""
    f = fixes.select(F.col(id_col), F.col("old").alias("_old"), F.col("new").alias("_new"))
    j = df.join(f, id_col, "left")
    hit = F.col("_new").isNotNull() & (F.col(col) == F.col("_old"))
    return (j.withColumn("applied", F.coalesce(hit, F.lit(False)))
            .withColumn(col, F.when(hit, F.col("_new")).otherwise(F.col(col)))
            .drop("_old", "_new"))


def correction_violations(df: DataFrame, fixes: DataFrame, id_col: str, col: str) -> DataFrame:
    """Fixes whose id is missing or whose old value does not match (abort if non-empty)."""
    cur = df.select(id_col, F.col(col).alias("_cur"))
    j = fixes.join(cur, id_col, "left")
    return j.filter(F.col("_cur").isNull() | (F.col("_cur") != F.col("old")))


def majority_vote(long: DataFrame, item_col: str, label_col: str, categories: list[str],
                  fallback_col: str | None = None) -> DataFrame:
    """Per item the label with most valid votes; a tie or no valid vote
    takes the fallback (silver) label.  ``long`` holds one row per (item, rater).

    Output: item, label, status ('majority' | 'tie→ai' | 'empty→ai')."""
    valid = long.filter(F.col(label_col).isin(categories))
    counts = valid.groupBy(item_col, label_col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.withColumn("_r", F.row_number().over(
        Window.partitionBy(item_col).orderBy(F.col("_n").desc(), F.col(label_col))))
    per_item = ranked.groupBy(item_col).agg(
        F.max(F.when(F.col("_r") == 1, F.col(label_col))).alias("_top"),
        F.max(F.when(F.col("_r") == 1, F.col("_n"))).alias("_n1"),
        F.max(F.when(F.col("_r") == 2, F.col("_n"))).alias("_n2"))
    items = long.select(item_col, *([fallback_col] if fallback_col else [])).dropDuplicates([item_col])
    j = items.join(per_item, item_col, "left")
    fb = F.col(fallback_col) if fallback_col else F.lit(None).cast("string")
    fb_ok = F.when(fb.isin(categories), fb)
    return j.select(
        item_col,
        F.when(F.col("_top").isNull(), fb)
        .when(F.col("_n2").isNull() | (F.col("_n1") > F.col("_n2")), F.col("_top"))
        .otherwise(F.coalesce(fb_ok, F.col("_top"))).alias("label"),
        F.when(F.col("_top").isNull(), "empty→ai")
        .when(F.col("_n2").isNull() | (F.col("_n1") > F.col("_n2")), "majority")
        .otherwise("tie→ai").alias("status"))
