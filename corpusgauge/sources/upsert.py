"""Corrections of a stored, partitioned table (J11, J12, IO8): only touched partitions are rewritten.

1. The partitions that hold a corrected id are found by one semi join of narrow columns.
2. They alone are read, corrected and written to a staging folder; the same pass counts, with an
   ``Observation``, the hits, the rows whose stored value is not the expected one, and the rows.
3. If a correction found no row or another value, nothing has changed and the call fails.
4. Else the staged partitions replace the old ones (dynamic partition overwrite).  Files of other
   partitions are neither read nor written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusgauge.operators.common import shared_table


@dataclass(frozen=True)
class Upsert:
    n_fixes: int
    n_applied: int
    n_rows: int              # of the rewritten partitions
    partitions: list[tuple]  # rewritten


def _among(columns: list[str], values: list[tuple]):
    """Whether the partition columns have one of the ``values`` (null equals null)."""
    out = F.lit(False)
    for row in values:
        one = F.lit(True)
        for c, v in zip(columns, row):
            one = one & F.col(c).eqNullSafe(F.lit(v))
        out = out | one
    return out


def correct_partitions(spark: SparkSession, path: str, fixes: DataFrame, id_col: str, col: str,
                       partition_cols: list[str], strict: bool = True) -> Upsert:
    """Set ``col`` of the Parquet table at ``path`` to ``new`` where ``id_col`` is a fix's and the stored
    value is its ``old`` (null equals null).

    ``fixes``: (id, old, new), one row an id (else an error); rows without id are left out.  A fix whose
    row holds ``new`` already counts as applied, so a call may be repeated.  ``strict``: fail, and
    change nothing, unless every fix applies; otherwise those that do not are passed over.  Rows
    that repeat an id are all corrected."""
    fixes = shared_table(fixes.select(id_col, F.col("old").alias("_old"), F.col("new").alias("_new")).filter(
        F.col(id_col).isNotNull()), "fixes")
    n_fixes = fixes.count()
    if fixes.select(id_col).distinct().count() != n_fixes:
        raise ValueError(f"{id_col} occurs twice among the corrections")
    table = spark.read.parquet(path)
    touched = [tuple(r) for r in table.join(fixes.select(id_col), id_col, "left_semi").select(*partition_cols).distinct().collect()]
    seen = Observation("correction")
    hit = F.col("_hit") & (F.col(col).eqNullSafe(F.col("_old")) | F.col(col).eqNullSafe(F.col("_new")))
    rows = table.filter(_among(partition_cols, touched)).join(fixes.withColumn("_hit", F.lit(True)), id_col, "left").withColumn(
        "_ok", F.coalesce(hit, F.lit(False)))
    fixed = rows.withColumn(col, F.when(F.col("_ok"), F.col("_new")).otherwise(F.col(col))).withColumn(
        "_miss", F.col("_hit") & ~F.col("_ok")).observe(
        seen, F.count(F.lit(1)).alias("n"), F.count_if("_miss").alias("other_value"), F.count_if("_ok").alias("applied"))
    staged = shared_table(fixed.select(*table.columns), "corrected")
    counts = seen.get
    missing = fixes.join(table.select(id_col), id_col, "left_anti").count()
    if strict and (counts["other_value"] or missing):
        raise ValueError(f"{missing} corrections without a row, {counts['other_value']} rows with another value")
    if touched:
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path)
    return Upsert(n_fixes, counts["applied"], counts["n"], sorted(touched, key=str))


def file_times(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified) of the table's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"))
