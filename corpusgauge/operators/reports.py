"""Anonymised reports and dashboard aggregates.

The dashboard is one long table ``(metric, key, n)``.  Scalar keys are
counted with GROUPING SETS in a single aggregate; abuse types are counted in a
separate ``explode`` branch so that exploding the array cannot inflate the
other counts.  All measures are additive, so the same plan works as a
streaming aggregate (see :mod:`corpusgauge.streaming.dashboard`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitelist of the anonymised report store (anything else is dropped).
REPORT_COLUMNS = ["id", "abuse_types", "risk_level", "severity", "district", "division", "gender",
                  "reporter_type", "abuser_relation", "abuser_is_family", "ongoing", "created_at"]


def sanitize(df: DataFrame) -> DataFrame:
    """Keep whitelisted columns only (fail closed on unknown columns)."""
    return df.select(*[c for c in df.columns if c in REPORT_COLUMNS])


def consent_gate(df: DataFrame, consent_col: str = "consent"):
    """(accepted rows, rejected count column) -- rows without consent are never stored."""
    ok = F.coalesce(F.col(consent_col) == F.lit(True), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def _answer(field: str) -> Column:
    return F.max(F.when(F.col("field") == field, F.col("value")))


def dashboard_records(answers: DataFrame, assessed: DataFrame) -> DataFrame:
    """One anonymised record per session from answers and assessment."""
    a = answers.groupBy("session_id").agg(
        _answer("location").alias("_loc"), _answer("gender").alias("gender"),
        _answer("reporter_type").alias("reporter_type"), _answer("abuser_relation").alias("abuser_relation"),
        _answer("abuser_is_family").alias("_fam"), _answer("ongoing").alias("_ong"),
        _answer("consent").alias("_consent"))
    j = a.join(assessed, "session_id")
    tri = lambda c: F.when(F.lower(c) == "true", F.lit(True)).when(F.lower(c) == "false", F.lit(False))
    return j.select(
        F.col("session_id").cast("string").alias("id"),
        F.col("confirmed_categories").alias("abuse_types"), "risk_level", "severity",
        F.nullif(F.split_part(F.col("_loc"), F.lit("|"), F.lit(2)), F.lit("")).alias("district"),
        F.nullif(F.split_part(F.col("_loc"), F.lit("|"), F.lit(1)), F.lit("")).alias("division"),
        "gender", "reporter_type", "abuser_relation",
        tri(F.col("_fam")).alias("abuser_is_family"), tri(F.col("_ong")).alias("ongoing"),
        tri(F.col("_consent")).alias("consent"))


def dashboard_stats(reports: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """A17 + A16: (metric, key, n) for total, gender (null -> 'unknown'),
    district (null dropped), risk level, family split (tri-state; missing
    skipped), month 'yyyy-MM', and exploded abuse types."""
    base = reports.select(
        F.coalesce("gender", F.lit("unknown")).alias("gender"), "district",
        F.col("risk_level").cast("string").alias("risk_level"),
        F.when(F.col("abuser_is_family") == F.lit(True), "family")
        .when(F.col("abuser_is_family") == F.lit(False), "non_family").alias("family"),
        F.date_format(F.col(ts_col), "yyyy-MM").alias("month"), "abuse_types")
    gs = base.groupingSets([[], ["gender"], ["district"], ["risk_level"], ["family"], ["month"]],
                           "gender", "district", "risk_level", "family", "month").agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping_id().alias("_g"))
    # grouping_id bits: gender=16, district=8, risk=4, family=2, month=1 (1 = aggregated away)
    metric = (F.when(F.col("_g") == 31, "total").when(F.col("_g") == 15, "gender")
              .when(F.col("_g") == 23, "district").when(F.col("_g") == 27, "risk_level")
              .when(F.col("_g") == 29, "family_vs_non").when(F.col("_g") == 30, "monthly_trend"))
    key = (F.when(F.col("_g") == 31, F.lit("all")).when(F.col("_g") == 15, F.col("gender"))
           .when(F.col("_g") == 23, F.col("district")).when(F.col("_g") == 27, F.col("risk_level"))
           .when(F.col("_g") == 29, F.col("family")).when(F.col("_g") == 30, F.col("month")))
    scalars = gs.select(metric.alias("metric"), key.alias("key"), F.col("n").cast("bigint").alias("n")).filter(
        F.col("key").isNotNull() & (F.col("key") != ""))
    types = (base.select(F.explode("abuse_types").alias("key")).groupBy("key")
             .agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit("abuse_type").alias("metric"), "key", "n"))
    return scalars.unionByName(types)


# The fields of a case record and what stands for a missing one.
CASE_DEFAULTS = {"transcript": "", "abuse_type": "", "applicable_sections": None, "severity": None, "civil_or_criminal": "",
                 "legal_advice_bangla": "", "recommended_action_bangla": "", "reporter_type": "unknown", "entities": None,
                 "uno_upazila": None, "uno_district": None, "case_ref": None}


def case_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and all fields of a case record from the columns of ``df`` that have their names.

    A missing column or a null is the field's default; sections default to an empty list; an
    office field or reference may stay null."""
    have = {c.lower() for c in df.columns}
    out = []
    for name, default in CASE_DEFAULTS.items():
        if name in have:
            col = F.col(name)
            if default is not None:
                col = F.coalesce(col, F.lit(default))
            elif name == "applicable_sections":
                col = F.coalesce(col, F.array().cast("array<string>"))
        elif name == "applicable_sections":
            col = F.array().cast("array<string>")
        else:
            col = F.lit(default) if default is not None else F.lit(None).cast("int" if name == "severity" else "string")
        out.append(col.alias(name))
    return df.select(*keys, *out)
