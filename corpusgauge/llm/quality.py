"""Quality rules on hosts: rule failures per host, shrunk by an empirical beta prior.

1. Every whole text is measured once (:func:`measure`); the metrics never leave the row.
2. Failures are counted per host.  The count is a partial aggregate, so a host that holds a
   third of all rows sends one row per task.
3. The rates of all hosts give a beta prior by moments; each host's rate is its posterior
   mean, so a host with few documents stays near the corpus and cannot be condemned by one.
4. The verdicts (one narrow row per host, written as a table) are joined back.  Spark
   broadcasts them only if the written table is below its threshold.

A document is kept unless it fails a base rule, or fails a soft rule on a bad host: one whose
shrunk failure rate lies more than ``host_deviations`` standard deviations above the mean of
the hosts' shrunk rates (both weighted by documents).  The limit follows the corpus: where
hosts fail alike, none is bad; a host that fails more often than the others loses its soft
failures, whatever the level.  A clean document is kept on any host.

Nulls: a null text has no words (it fails); null hosts form one host.  An empty table gives
no rows.  Repeated rows are judged one by one.  Extra columns are ignored by
:func:`host_quality` and kept by :func:`filter_quality`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.common import byte_values, free_name, tune, window_hashes, word_hashes, written
from corpusgauge.operators.common import join_one_row

# The symbol characters that are counted.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20            # base: fewer words fail
    max_repeat_pct: int = 30       # base: share of words in repeated windows
    window: int = 8                # words in a window
    max_symbol_pct: int = 50       # soft: symbols per 100 words
    max_dup_line_pct: int = 30     # soft: repeated lines per 100 lines with a word
    host_deviations: float = 1.0   # standard deviations above the hosts' mean at which soft failures go


METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_metrics(text: bytes | None, window: int = 8) -> tuple[int, int, int, int, int, int]:
    """The :data:`METRICS` of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    joined = b"".join(words)
    # a code point is a byte that does not continue another one
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), chars, symbols, len(lines), len(lines) - len(set(lines)),
            repeated_words(words, window))


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    keys = window_hashes(word_hashes(words), window)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(df: DataFrame, text_col: str, carry: list[str], out: str, window: int = 8) -> DataFrame:
    """The columns ``carry`` of ``df`` and a struct ``out`` of the metrics of its texts."""
    tune(df.sparkSession)
    kind = pa.struct([(m, pa.int64()) for m in METRICS])

    def run(batches):
        for batch in batches:
            rows = [text_metrics(t, window) for t in byte_values(batch.column(0))]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(METRICS))]
            found = pa.StructArray.from_arrays(cols, fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], names=[*carry, out])

    schema = T.StructType([*(df.schema[c] for c in carry),
                           T.StructField(out, T.StructType([T.StructField(m, T.LongType()) for m in METRICS]))])
    # the text comes first and once more under its own name if it is carried
    source = df.select(F.col(f"`{text_col}`").alias("_0"), *[F.col(f"`{c}`").alias(f"_{i + 1}")
                                                             for i, c in enumerate(carry)])
    return source.mapInArrow(run, schema)


def rule_columns(q: str, rules: QualityRules):
    """(base failed, soft failed) from the metrics struct ``q``."""
    m = lambda name: F.col(f"`{q}`.{name}")
    base = (m("n_words") < rules.min_words) | (100 * m("n_repeat_words") > rules.max_repeat_pct * m("n_words"))
    soft = (100 * m("n_symbols") > rules.max_symbol_pct * m("n_words")) | (
        100 * m("n_dup_lines") > rules.max_dup_line_pct * m("n_lines"))
    return base, soft


def host_verdicts(measured: DataFrame, host_col: str, q: str, rules: QualityRules) -> DataFrame:
    """One row per host: host, n_docs, n_failed, shrunk rate, bad.

    The prior is beta(a, b) with the mean and the variance of the hosts' rates (weighted by
    their documents); where the rates do not vary, or vary more than a beta can, its weight
    a + b falls back to one document."""
    base, soft = rule_columns(q, rules)
    hosts = written(
        measured.groupBy(F.col(f"`{host_col}`").alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(base | soft).alias("n_failed")), "hosts")
    r, n = F.col("n_failed") / F.col("n_docs"), F.col("n_docs").cast("double")
    prior = (hosts.agg(F.sum(n).alias("n"), F.sum(r * n).alias("s1"), F.sum(r * r * n).alias("s2"))
             .select((F.col("s1") / F.col("n")).alias("mean"),
                     (F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2).alias("var")))
    spread = F.col("mean") * (1 - F.col("mean"))
    prior = prior.select("mean", F.when((F.col("var") > 1e-12) & (spread > F.col("var")), spread / F.col("var") - 1)
                         .otherwise(F.lit(1.0)).alias("weight"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    rated = written(join_one_row(hosts, prior).select("host", "n_docs", "n_failed", rate.alias("host_rate")), "host-rates")
    h = F.col("host_rate")
    moments = rated.agg(F.sum(n).alias("n"), F.sum(h * n).alias("s1"), F.sum(h * h * n).alias("s2")).select(
        (F.col("s1") / F.col("n")).alias("m"), (F.col("s2") / F.col("n")).alias("square"))
    deviation = F.sqrt(F.greatest(F.col("square") - F.col("m") * F.col("m"), F.lit(0.0)))
    # rounding must not condemn a host that fails exactly as all do
    limit = moments.select((F.col("m") + rules.host_deviations * deviation + 1e-6).alias("limit"))
    return written(join_one_row(rated, limit).select(
        "host", "n_docs", "n_failed", "host_rate", (h > F.col("limit")).alias("host_bad")), "host-verdicts")


def with_verdicts(measured: DataFrame, host_col: str, q: str, hosts: DataFrame, rules: QualityRules,
                  out: str) -> DataFrame:
    """``measured`` and a struct ``out``: base_failed, soft_failed, host_rate, host_bad, kept."""
    base, soft = rule_columns(q, rules)
    host = hosts.select(F.struct("host", "host_rate", "host_bad").alias(out))
    v = lambda name: F.col(f"`{out}`.{name}")
    joined = measured.join(host, F.col(f"`{host_col}`").eqNullSafe(v("host")), "left")
    return joined.withColumn(out, F.struct(
        base.alias("base_failed"), soft.alias("soft_failed"), v("host_rate").alias("host_rate"),
        v("host_bad").alias("host_bad"),
        (~base & ~(soft & F.coalesce(v("host_bad"), F.lit(False)))).alias("kept")))


def host_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id",
                 rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: id, the metrics, base_failed, soft_failed, host_rate, host_bad, kept."""
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host_of"),
                        F.col(f"`{text_col}`").alias("text"))
    measured = written(measure(named, "text", ["doc_id", "host_of"], "q", rules.window), "quality")
    hosts = host_verdicts(measured, "host_of", "q", rules)
    return with_verdicts(measured, "host_of", "q", hosts, rules, "v").select("doc_id", "q.*", "v.*")


def filter_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                   rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The texts are measured twice, once for the hosts and once where they are filtered:
    cheaper than moving or storing them."""
    q, v = free_name(docs, "_q"), free_name(docs, "_v")
    hosts = host_verdicts(measure(docs, text_col, [host_col], q, rules.window), host_col, q, rules)
    full = measure(docs, text_col, docs.columns, q, rules.window)
    return with_verdicts(full, host_col, q, hosts, rules, v).filter(F.col(f"`{v}`.kept")).select(
        *[F.col(f"`{c}`") for c in docs.columns])
