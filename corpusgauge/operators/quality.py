"""Corpus cleaning and data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.fixed import REASON_DUP, REASON_SHORT, REASON_SPAM, REASON_TEXTLESS
from corpusgauge.functions import text as T
from corpusgauge.operators.common import join_one_row, sequential_ids, shared_table


def text_key(col) -> F.Column:
    """Fixed-width join/group key for a (possibly 100 KB) text: sha-256 of it."""
    return F.sha2(F.coalesce(col, F.lit("")), 256)


def first_occurrence_flag(df: DataFrame, key_col: str, id_col: str, out_col: str = "is_dup") -> DataFrame:
    """True for every row whose key already occurred at a smaller id.

    ``min(id)`` per key is a partial (map-side) aggregate, so a key held by a
    third of all rows shrinks to one row per map task before the shuffle.  Keys of one row
    are left out, and the others are written before the join back: it is many-to-one,
    both its sides are plain shuffles, and Spark splits the task of a frequent key (or
    broadcasts the keys, if what was written is small).
    """
    firsts = df.groupBy(key_col).agg(F.min(id_col).alias("_first_id"), F.count(F.lit(1)).alias("_n"))
    firsts = shared_table(firsts.filter(F.col("_n") > 1).drop("_n"), "repeated-keys")
    return (df.join(firsts, key_col, "left")
            .withColumn(out_col, F.coalesce(F.col(id_col) > F.col("_first_id"), F.lit(False)))
            .drop("_first_id"))


def clean_corpus(df: DataFrame, id_col: str, text_col: str, keep_text: bool = False,
                 extra=None) -> DataFrame:
    """every row with ``char_len``, ``remove_reason`` (null when kept) and the
    requested per-row columns.  Priority: spam > textless > too short > duplicate.
    Duplicates are judged over all rows on the stripped text, first id kept.

    All text rules run in one projection next to the scan; only narrow columns
    (id, a 64-hex text key, flags) go through the duplicate shuffle.  ``extra``
    maps output names to functions of the stripped text (e.g. a language tag);
    ``keep_text`` also keeps the stripped text as ``_stripped``."""
    stripped = T.ustrip(F.coalesce(F.col(text_col), F.lit("")))
    base = df.withColumn("_stripped", stripped)
    cols = [F.col(c) for c in df.columns if c != text_col]
    feats = base.select(
        *cols,
        F.length("_stripped").alias("char_len"),
        T.is_spam("_stripped").alias("_spam"),
        T.is_textless("_stripped").alias("_textless"),
        text_key(F.col("_stripped")).alias("_tkey"),
        *[fn(F.col("_stripped")).alias(name) for name, fn in (extra or {}).items()],
        *([F.col("_stripped")] if keep_text else []))
    if not keep_text:
        # the narrow per-row features (about 100 bytes a row) feed both the
        # duplicate aggregate and the join back: written so the texts are
        # scanned and regex-matched once, and nothing stays cached
        feats = shared_table(feats, "clean-features")
    flagged = first_occurrence_flag(feats, "_tkey", id_col, "_dup")
    reason = (F.when(F.col("_spam"), REASON_SPAM)
              .when(F.col("_textless"), REASON_TEXTLESS)
              .when(F.col("char_len") <= 2, REASON_SHORT)
              .when(F.col("_dup"), REASON_DUP))
    return flagged.withColumn("remove_reason", reason).drop("_dup", "_tkey", "_spam", "_textless")


def split_kept_removed(cleaned: DataFrame):
    """(kept, removed) from one cleaned frame."""
    kept = cleaned.filter(F.col("remove_reason").isNull()).drop("remove_reason")
    removed = cleaned.filter(F.col("remove_reason").isNotNull())
    return kept, removed


def number_kept(kept: DataFrame, id_col: str, prefix: str = "C", width: int = 5,
                out_col: str = "comment_id") -> DataFrame:
    """``C00001``... in id order, computed from per-partition offsets."""
    seq = sequential_ids(kept, id_col, "_seq")
    return (seq.withColumn(out_col, F.format_string(f"{prefix}%0{width}d", F.col("_seq")))
            .drop("_seq"))


def row_slice(df: DataFrame, seq_col: str, start: int, count: int) -> DataFrame:
    """Rows with 0-based position in [start, start+count)."""
    return df.filter((F.col(seq_col) > start) & (F.col(seq_col) <= start + count))


def order_by_length(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Longest texts first, id as tie-break."""
    return df.orderBy(F.length(F.col(text_col)).desc(), F.col(id_col))


# -- A11 / A12 profiles ------------------------------------------------------

def missing_profile(df: DataFrame) -> DataFrame:
    """Per column null count and percent; only columns with nulls, most first."""
    n_rows = F.count(F.lit(1))
    aggs = [n_rows.alias("_rows")] + [
        F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]
    one = df.agg(*aggs)
    stack = "stack({}, {}) as (column_name, n_missing)".format(
        len(df.columns), ", ".join(f"'{c}', `{c}`" for c in df.columns))
    long = one.selectExpr("_rows", stack)
    return (long.filter(F.col("n_missing") > 0)
            .select("column_name", F.col("n_missing").cast("bigint").alias("n_missing"),
                    F.bround(F.lit(100.0) * F.col("n_missing") / F.col("_rows"), 2).alias("pct_missing")))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column data type, non-null count and distinct count, in one pass."""
    aggs = []
    for c in df.columns:
        aggs.append(F.count(F.col(c)).alias(f"nn__{c}"))
        aggs.append(F.countDistinct(F.col(c)).alias(f"nd__{c}"))
    one = df.agg(*aggs)
    types = dict(df.dtypes)
    stack = "stack({}, {}) as (column_name, data_type, non_null, n_distinct)".format(
        len(df.columns),
        ", ".join(f"'{c}', '{types[c]}', `nn__{c}`, `nd__{c}`" for c in df.columns))
    return one.selectExpr(stack).select(
        "column_name", "data_type", F.col("non_null").cast("bigint").alias("non_null"),
        F.col("n_distinct").cast("bigint").alias("n_distinct"))


# -- A22 key and domain checks -----------------------------------------------

def key_violations(df: DataFrame, id_col: str, domains: dict) -> DataFrame:
    """One violations table: duplicate ids and out-of-domain codes.

    ``domains`` maps a column to its allowed values.  Output:
    (violation, id, column_name, value)."""
    dups = (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            .select(F.lit("duplicate_id").alias("violation"), F.col(id_col).cast("string").alias("id"),
                    F.lit(id_col).alias("column_name"), F.col("_n").cast("string").alias("value")))
    out = dups
    for c, allowed in domains.items():
        bad = (df.filter(F.col(c).isNull() | ~F.col(c).isin(list(allowed)))
               .select(F.lit("bad_code").alias("violation"), F.col(id_col).cast("string").alias("id"),
                       F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
        out = out.unionByName(bad)
    return out


def coverage_diff(base: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Ids missing from ``labels`` and extra ids not in ``base`` (anti joins)."""
    b = base.select(id_col).distinct()
    l = labels.select(id_col).distinct()
    missing = b.join(l, id_col, "left_anti").select(F.lit("missing").alias("kind"), id_col)
    extra = l.join(b, id_col, "left_anti").select(F.lit("extra").alias("kind"), id_col)
    return missing.unionByName(extra)


# -- A23 ids lock ------------------------------------------------------------

LOCK_HEX_DIGITS = 4


def ids_lock(df: DataFrame, id_col: str, hex_digits: int = LOCK_HEX_DIGITS) -> DataFrame:
    """Content lock of an id set -- (n_ids, hex_digits, sha256_ids).

    The ids are spread over 16**hex_digits buckets by the first hex digits of
    their own sha-256; each bucket hashes its sorted, newline-joined ids; the
    lock is the sha-256 of the bucket digests joined in bucket order.  No task
    holds the whole id set and the final step sees one row per bucket.  The
    digest depends on the ids and on ``hex_digits`` alone, and the row records
    the digits, so :func:`verify_lock` can recompute it at any size."""
    ids = df.select(F.col(id_col).cast("string").alias("_id"))
    per_bucket = (ids.withColumn("_b", F.substring(F.sha2(F.col("_id"), 256), 1, hex_digits))
                  .groupBy("_b")
                  .agg(F.count(F.lit(1)).alias("_n"),
                       F.sha2(F.array_join(F.sort_array(F.collect_list("_id")), "\n"), 256).alias("_h")))
    return per_bucket.agg(
        F.sum("_n").cast("bigint").alias("n_ids"), F.lit(hex_digits).alias("hex_digits"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_h"))),
                                        lambda s: s["_h"]), "\n"), 256).alias("sha256_ids"))


def verify_lock(df: DataFrame, id_col: str, lock: DataFrame) -> DataFrame:
    """Whether ``df`` still holds exactly the locked ids: (n_ok, sha256_ok, ok).
    ``lock`` is a row of :func:`ids_lock`, with the digits it was made with."""
    digits = lock.select("hex_digits").first()[0]
    now = ids_lock(df, id_col, digits)
    both = join_one_row(lock.select(F.col("n_ids").alias("_n"), F.col("sha256_ids").alias("_h")), now)
    return both.select((F.col("n_ids") == F.col("_n")).alias("n_ok"), (F.col("sha256_ids") == F.col("_h")).alias("sha256_ok"),
                       ((F.col("n_ids") == F.col("_n")) & (F.col("sha256_ids") == F.col("_h"))).alias("ok"))


def lock_tree(df: DataFrame, id_col: str, levels: int = 3) -> DataFrame:
    """The id set's digests as a tree -- (level, prefix, n, digest), level 0 the root.

    A leaf holds the ids whose sha-256 begins with its ``levels`` hex digits: the digest of its sorted
    ids, each with the number of its rows.  A node of a higher level drops a digit and digests its 16
    children, so a change of one id changes one path.  Repeated ids are counted before they are
    collected, so a leaf's task holds about n / 16**levels ids whatever repeats."""
    ids = df.groupBy(F.col(id_col).cast("string").alias("_id")).agg(F.count(F.lit(1)).alias("_c")).filter("_id is not null")
    leaf = F.substring(F.sha2(F.col("_id"), 256), 1, levels)
    nodes = ids.groupBy(leaf.alias("prefix")).agg(
        F.sum("_c").alias("n"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "_id", "_c"))), "\n"), 256).alias("digest"))
    nodes = shared_table(nodes, "lock-leaves")
    out = nodes.withColumn("level", F.lit(levels))
    for level in range(levels - 1, -1, -1):
        nodes = nodes.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(
            F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda s: s["digest"]), "\n"), 256).alias("digest"))
        out = out.unionByName(nodes.withColumn("level", F.lit(level)))
    return out.select("level", "prefix", "n", "digest")


def changed_leaves(now: DataFrame, lock: DataFrame) -> DataFrame:
    """(prefix, n_locked, n_now): the leaves in which two trees of :func:`lock_tree` differ, found by walking
    down: a level's nodes are compared only below nodes that differ.  Empty: the id sets are equal."""
    depth = lock.agg(F.max("level")).first()[0]
    if depth is None:
        depth = now.agg(F.max("level")).first()[0] or 0
    differ = None
    for level in range(depth + 1):
        a, b = (t.filter(F.col("level") == level).select("prefix", F.col("n").alias(n), F.col("digest").alias(d))
                for t, n, d in ((lock, "n_locked", "_a"), (now, "n_now", "_b")))
        if differ is not None:
            up = F.substring("prefix", 1, level - 1)
            a, b = (t.withColumn("_up", up).join(differ.select(F.col("prefix").alias("_up")), "_up", "left_semi").drop("_up") for t in (a, b))
        differ = shared_table(a.join(b, "prefix", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))), "lock-differences")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return differ.select("prefix", zero("n_locked"), zero("n_now"))
