"""The document pipeline: quality rules, near-duplicates, benchmark passages, secrets, tokens.

Each stage works on all that its predecessor kept.  A stage's result is written as Parquet
below the shared folder and read again as the next stage's input, so its lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgauge.llm.common import written
from corpusgauge.plans.registry import Query, load


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    from corpusgauge.llm.quality import filter_quality

    return filter_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 85 % or more, as op3)."""
    from corpusgauge.llm.minhash import drop_near_duplicates

    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    from corpusgauge.llm.decontam import drop_contaminated

    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in them masked and their length brought up to date."""
    from pyspark.sql import functions as F

    from corpusgauge.llm.secret_scan import Ledger, redact
    from corpusgauge.session import scratch_path

    clean = redact(docs, Ledger(spark, scratch_path(spark, "pipeline-ledger")))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the text, their number, and whether they decode to it."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from corpusgauge.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    hashed = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    ids = encode(hashed, path, public_tokenizers.PATTERN, carry=["doc_id", "lang", "source", "text_sha256"])
    return decode(ids, path, as_text=True).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("quality", quality_stage), ("near-duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("secrets", secrets_stage), ("tokens", tokens_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The last stage's tokens cannot be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None

QUERY = Query("pipeline", run, ORACLE_SQL, "pipeline")
