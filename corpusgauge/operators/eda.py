"""Descriptive aggregates (A1-A21) and token tables.

Every aggregate is a Spark ``groupBy``/``agg`` with map-side partial
aggregation; ordered outputs use :func:`top_k` (partial WindowGroupLimit) so
no group is ever sorted whole in one task.  Exact percentiles are found by rank
(:func:`group_quantiles`): values are counted, the counts are dealt by ranges of (group,
value), and only the values at the wanted ranks go on, so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.operators.common import join_one_row, numbered, shared_table, top_k


def value_counts(df: DataFrame, *cols, name: str = "n") -> DataFrame:
    """A1: counts per value (order is presentation only: n desc, label asc)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def counts_over_labels(df: DataFrame, col: str, labels: list[str], name: str = "n") -> DataFrame:
    """A2: counts over a fixed label order, missing labels as 0."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], f"label_ord int, {col} string")
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return (F.broadcast(dim).join(counts, col, "left")
            .select("label_ord", col, F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)))


def shares(df: DataFrame, group_cols, count_col: str = "n", out: str = "share") -> DataFrame:
    """A3: count / sum(count) within the group (window over an already-aggregated table)."""
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    return df.withColumn(out, F.col(count_col) / F.sum(count_col).over(w))


def crosstab(df: DataFrame, row: str, col: str, col_values: list, prefix: str = "n_") -> DataFrame:
    """A4: cross-tab counts with a fixed column order; empty cells are 0."""
    piv = df.groupBy(row).pivot(col, col_values).agg(F.count(F.lit(1)))
    return piv.select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("bigint").alias(f"{prefix}{v}")
                             for v in col_values])


def row_percent(ct: DataFrame, row: str, cols: list[str], digits: int = 1, prefix: str = "pct_") -> DataFrame:
    """A5: each cell as percent of its row (half-even rounding, zero guard)."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    out = ct.withColumn("_row_total", total)
    for c in cols:
        out = out.withColumn(prefix + c.split("_", 1)[-1],
                             F.when(F.col("_row_total") == 0, F.lit(0.0))
                             .otherwise(F.bround(F.lit(100.0) * F.col(c) / F.col("_row_total"), digits)))
    return out.drop("_row_total")


def label_share(df: DataFrame, group: str, label_col: str, label, digits: int = 6) -> DataFrame:
    """Share of rows with ``label`` inside each group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(F.col(label_col) == label, 1.0).otherwise(0.0)), digits).alias("share"))


def value_counts(df: DataFrame, groups: list[str], col: str) -> DataFrame:
    """(groups..., _v, _n, _pid, _row): how often each value of ``col`` (nulls left out) occurs in
    each group, dealt and sorted by (group, value) and written.  The only shuffles of the rows: a
    partial aggregate and the ranges of its result, over which a frequent group spreads."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*groups, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return numbered(counts, [*groups, "_v"])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] or [F.lit(True)]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def group_quantiles(counts: DataFrame, groups: list[str], qs: dict[str, float]) -> DataFrame:
    """(groups..., n, sum, and one column for each of ``qs``): exact linearly interpolated quantiles of
    the values counted by :func:`value_counts`, for all groups and all quantiles at once.

    A value holds the ranks from the number of smaller ones on: the rows before it in its range
    (a running sum inside the range) and in the ranges before it (a row for each group and range).
    Of a quantile between two ranks both values are kept: two rows at most for each of ``qs``."""
    parts = shared_table(counts.groupBy(*groups, "_pid").agg(F.sum("_n").alias("_s"), F.sum(F.col("_v") * F.col("_n")).alias("_t")), "range-counts")
    of_group = Window.partitionBy(*groups)
    offsets = parts.select(*groups, "_pid", F.sum("_s").over(of_group).alias("n"), F.coalesce(
        F.sum("_s").over(of_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    offsets = shared_table(offsets, "range-offsets")
    placed = null_safe(counts, offsets, [*groups, "_pid"])
    inside = Window.partitionBy("_pid", *groups).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_to", F.col("_off") + F.sum("_n").over(inside))
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    first, last = F.col("_to") - F.col("_n"), F.col("_to") - 1   # ranks from 0
    holds = lambda rank: (first <= rank) & (rank <= last)
    hits = [(f"_{side}_{name}", holds(edge(x))) for name, x in at.items() for side, edge in (("lo", F.floor), ("hi", F.ceil))]
    any_hit = hits[0][1]
    for _, hit in hits[1:]:
        any_hit = any_hit | hit
    found = placed.filter(any_hit).groupBy(*groups, "n").agg(*[F.max(F.when(hit, F.col("_v"))).cast("double").alias(c) for c, hit in hits])
    quantiles = [(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (x - F.floor(x))).alias(name) for name, x in at.items()]
    sums = parts.groupBy(*groups).agg(F.sum("_t").alias("sum"))
    out = found.select(*groups, "n", *quantiles)
    return null_safe(out, sums, groups) if groups else join_one_row(out, sums)


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """N, mean, median, p90, max (linear-interpolated percentiles) of all rows; n counts null
    values, the others leave them out."""
    counts = value_counts(df.select(col), [], col)
    q = group_quantiles(counts, [], {"_med": 0.5, "_p90": 0.9})
    rest = df.agg(F.count(F.lit(1)).alias("_rows"), F.round(F.avg(col), 4).alias("mean_len"), F.max(col).cast("bigint").alias("max_len"))
    out = rest.join(q, F.lit(True), "left")   # one row each
    return out.select(F.col("_rows").alias("n"), "mean_len", F.round("_med", 4).alias("median_len"),
                      F.round("_p90", 4).alias("p90_len"), "max_len")


def box_stats(df: DataFrame, group: str, col: str) -> DataFrame:
    """Quartiles, truncated median, mean and whiskers (no fliers) of each group (a null group
    is one, too), over the rows with a value.

    The rows are counted once per group and value; quartiles and, with the 1.5 IQR fences, the
    extreme values inside them come from those counts."""
    counts = value_counts(df.select(group, col), [group], col)
    q = shared_table(group_quantiles(counts, [group], {"q1": 0.25, "med": 0.5, "q3": 0.75}), "quartiles")
    j = null_safe(counts.select(group, "_v"), q, [group])
    iqr = F.col("q3") - F.col("q1")
    fences = j.groupBy(group).agg(
        F.min(F.when(F.col("_v") >= F.col("q1") - 1.5 * iqr, F.col("_v"))).cast("bigint").alias("whisker_low"),
        F.max(F.when(F.col("_v") <= F.col("q3") + 1.5 * iqr, F.col("_v"))).cast("bigint").alias("whisker_high"))
    return null_safe(q, fences, [group]).select(
        group, F.col("n").cast("bigint").alias("n"), F.round("q1", 4).alias("q1"),
        F.floor("med").cast("bigint").alias("median_int"), F.round("med", 4).alias("median"),
        F.round("q3", 4).alias("q3"), F.round(F.col("sum") / F.col("n"), 2).alias("mean_len"),
        "whisker_low", "whisker_high")


def missing_and_age_stats(df: DataFrame, col: str) -> DataFrame:
    """Valid count, min, max, mean, median of a lenient numeric column."""
    counts = value_counts(df.select(col), [], col)
    median = group_quantiles(counts, [], {"_med": 0.5})
    rest = df.agg(F.count(F.col(col)).alias("n_valid"), F.min(col).alias("min_value"), F.max(col).alias("max_value"),
                  F.round(F.avg(col), 4).alias("mean_value"))
    return rest.join(median, F.lit(True), "left").select(
        "n_valid", "min_value", "max_value", "mean_value", F.round("_med", 4).alias("median_value"))


def histogram(df: DataFrame, col: str, bins: int = 12) -> DataFrame:
    """Equal-width bins between min and max, last bin closed, empty bins kept.

    The min/max pass is a global partial aggregate; the bin table (``bins``
    rows, tiny) is left-joined to the per-bin counts."""
    spark = df.sparkSession
    # two scalars -- the only values that travel through the driver
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    width = (hi_c - lo_c) / F.lit(float(bins))
    raw_bin = F.floor((F.col(col) - lo_c) / width)
    binned = df.filter(F.col(col).isNotNull()).select(
        (F.lit(0) if hi == lo else F.least(raw_bin, F.lit(bins - 1))).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    dim = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (dim.join(counts, "bin", "left")
            .select("bin",
                    F.round(lo_c + F.col("bin") * width, 6).alias("bin_lo"),
                    F.round(lo_c + (F.col("bin") + 1) * width, 6).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def exact_median(df: DataFrame, col: str):
    """The exact median of a numeric column (None without values).

    Rows per value (a partial aggregate) are range-partitioned by value and numbered; running
    counts are taken inside the partitions and one row per partition is added up.  Only the
    values at the one or two middle ranks come to the driver."""
    counts = numbered(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), ["_v"])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(counts.groupBy("_pid").agg(F.sum("_n").alias("_s")).select(
        "_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"), "_s"), "offsets")
    n = offsets.agg(F.sum("_s")).first()[0]
    if not n:
        return None
    ranks = [(n + 1) // 2, n // 2 + 1]
    # the partitions that hold the middle ranks, then the running counts in them
    hit = [F.lit(r).between(F.col("_off") + 1, F.col("_off") + F.col("_s")) for r in ranks]
    inside = counts.join(offsets.filter(hit[0] | hit[1]), "_pid")
    top = F.col("_off") + F.sum("_n").over(Window.partitionBy("_pid").orderBy("_row"))
    placed = inside.withColumn("_to", top)
    found = [placed.filter(F.lit(r).between(F.col("_to") - F.col("_n") + 1, F.col("_to"))).first()["_v"] for r in ranks]
    return (float(found[0]) + float(found[1])) / 2


def token_counts(tokens: DataFrame, group_cols, token_col: str = "token") -> DataFrame:
    """Counts per (group, token) after the stopword anti-join (partial agg before shuffle)."""
    return tokens.groupBy(*group_cols, token_col).agg(F.count(F.lit(1)).alias("n"))


def top_tokens(counts: DataFrame, group_cols, k: int, token_col: str = "token") -> DataFrame:
    """T7 + T9: top-k tokens per group (n desc, token asc) with size relative to the group max."""
    ranked = top_k(counts, group_cols, [F.col("n").desc(), F.col(token_col)], k)
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    return ranked.withColumn("rel_size", F.round(F.col("n") / F.max("n").over(w), 6))


def topk_cross(df: DataFrame, a: str, b: str, ka: int, kb: int) -> DataFrame:
    """Counts of (a, b) restricted to the top-ka values of ``a`` and top-kb of ``b``.

    One partial aggregate to (a, b) counts, written and read by all that follows, two global top-k (per-partition
    limit + merge), and semi joins against the k-row winners (broadcast: their
    size is bounded by k)."""
    ab = shared_table(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    ta = (ab.groupBy(a).agg(F.sum("n").alias("_t")).orderBy(F.col("_t").desc(), F.col(a)).limit(ka)
          .select(a))
    tb = (ab.groupBy(b).agg(F.sum("n").alias("_t")).orderBy(F.col("_t").desc(), F.col(b)).limit(kb)
          .select(b))
    return (ab.join(F.broadcast(ta), a, "left_semi").join(F.broadcast(tb), b, "left_semi")
            .select(a, b, F.col("n").cast("bigint").alias("n")))


def keyword_composition(keywords: DataFrame, scripts=("bangla", "english", "mixed_forms")) -> DataFrame:
    """Keywords per category x script (pivot with a fixed column order) and totals."""
    piv = keywords.groupBy("category").pivot("script", list(scripts)).agg(F.count(F.lit(1)))
    cols = [F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in scripts]
    out = piv.select("category", *cols)
    return out.withColumn("total", sum((F.col(s) for s in scripts[1:]), F.col(scripts[0])))
