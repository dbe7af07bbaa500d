"""Sources and sinks (IO1-IO11).

Every reader declares its schema (no inference on the hot path), keeps the
source's blank-vs-null conventions, and returns a lazy DataFrame.  Nested JSON
dimension files are read whole (``wholetext``) and parsed with ``from_json``
into map types, then exploded -- they are small dimension files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.fixed import CASE_COLUMNS, CORPUS_COLUMNS
from corpusgauge.functions.text import ustrip

REPORT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("abuse_types", T.ArrayType(T.StringType())),
    T.StructField("risk_level", T.IntegerType()), T.StructField("severity", T.IntegerType()),
    T.StructField("district", T.StringType()), T.StructField("division", T.StringType()),
    T.StructField("gender", T.StringType()), T.StructField("reporter_type", T.StringType()),
    T.StructField("abuser_relation", T.StringType()), T.StructField("abuser_is_family", T.BooleanType()),
    T.StructField("ongoing", T.BooleanType()), T.StructField("created_at", T.TimestampType()),
])


def _string_schema(cols) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def read_corpus(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """IO1: all-string CSV with header; blank fields stay '' (never null)."""
    df = (spark.read.schema(_string_schema(columns or CORPUS_COLUMNS))
          .option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
          .option("mode", "PERMISSIVE").csv(path))
    return df.na.fill("")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """IO2: case table CSV with an explicit schema; typed columns are derived later."""
    return (spark.read.schema(_string_schema(CASE_COLUMNS)).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


def read_code_batches(spark: SparkSession, path_glob: str) -> DataFrame:
    """IO3: headerless code files; stray lines (id not starting with 'C') dropped;
    the source file is kept for lineage."""
    df = (spark.read.schema(_string_schema(["comment_id", "pol", "emo"])).option("header", False)
          .csv(path_glob).select("*", F.col("_metadata.file_path").alias("source_file")))
    return df.filter(F.col("comment_id").startswith("C")).select(
        ustrip("comment_id").alias("comment_id"), ustrip("pol").alias("pol"), ustrip("emo").alias("emo"),
        "source_file")


def read_raters(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """IO4: long rater table (rater, comment_id, polarity, emotion); null -> '' and trimmed."""
    cols = ["rater", "comment_id", "polarity", "emotion"]
    reader = spark.read.schema(_string_schema(cols))
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return df.select(*[ustrip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in cols])


def _json_map(spark: SparkSession, path: str, value_type: T.DataType) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value_type))).alias("key", "v"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """IO5: keyword dictionary -> (category, cat_ord, script, keyword, ord).

    ``cat_ord`` follows the file order of the categories (the classifier's
    final tie-break)."""
    groups = T.StructType([T.StructField(s, T.ArrayType(T.StringType()))
                           for s in ("bangla", "english", "mixed_forms")])
    raw = spark.read.text(path, wholetext=True)
    # keys in file order: a JSON object's key order is kept by reading the keys array
    keys = raw.select(F.posexplode(F.json_object_keys("value")).alias("cat_ord", "category"))
    m = _json_map(spark, path, groups).withColumnRenamed("key", "category")
    long = m.select("category", F.explode(F.array(
        *[F.struct(F.lit(i).alias("s_ord"), F.lit(s).alias("script"), F.col("v")[s].alias("words"))
          for i, s in enumerate(("bangla", "english", "mixed_forms"))])).alias("g"))
    words = long.select("category", "g.s_ord", "g.script", F.posexplode("g.words").alias("pos", "keyword"))
    return (words.join(keys, "category")
            .select("category", "cat_ord", "script", "keyword",
                    (F.col("s_ord") * 10000 + F.col("pos")).alias("ord")))


def keyword_lists(df: DataFrame) -> dict[str, list[str]]:
    """Small helper: keyword table -> {category: [keywords in file order]} for the classifier."""
    rows = df.orderBy("cat_ord", "ord").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["category"], []).append(r["keyword"])
    return out


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """IO5: knowledge base -> (id, section, text, text_english, applicable_for, severity_min)."""
    st = T.StructType([T.StructField("section", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("text_english", T.StringType()),
                       T.StructField("applicable_for", T.ArrayType(T.StringType())),
                       T.StructField("severity_min", T.IntegerType())])
    return _json_map(spark, path, st).select(F.col("key").alias("id"), "v.*")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a glob) names anything, by the file system Spark reads it with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_reports(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """IO6: report store (JSON lines); a missing store is an empty typed table, malformed
    records are dropped, any other read error is raised.  ``limit`` keeps the newest reports
    (by creation time, then id), as a report page does; by default all are read."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], REPORT_SCHEMA)
    df = spark.read.schema(REPORT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return df if limit is None else df.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(limit)


def read_metrics(spark: SparkSession, path_glob: str) -> DataFrame:
    """IO7: result JSON files -> long (file, key, value) table; no files -> empty."""
    if not path_exists(spark, path_glob):
        return spark.createDataFrame([], "file string, key string, value string")
    raw = spark.read.text(path_glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    m = raw.select("file", F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))))
    return m.select("file", "key", "value")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """IO8: table sink, optionally partitioned (e.g. by split)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # as the CSV readers here read it: texts with quotes, line ends and outer blanks come back unchanged
        w = w.option("header", True).option("escape", '"').option("quoteAll", True).option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.save(path)


def save_pipeline(model, path: str) -> None:
    """IO9: persist a fitted Spark ML model / pipeline."""
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def append_reports(df: DataFrame, path: str, row_key: list[str] | None = None) -> int:
    """IO10: append consenting, whitelisted reports as one batch folder; returns their number.

    Ids are derived from ``row_key`` (columns that tell the input rows apart, dropped by the
    whitelist afterwards) and the record, so two equal reports have two ids and a retried task
    writes the same ones.  Without a key, equal records are told apart by the batch and their
    row in it, without a shuffle; only one attempt of a task is kept, so ids stay different.
    The rows are counted where they were written, not computed again."""
    import uuid

    from corpusgauge.operators.reports import REPORT_COLUMNS, consent_gate, sanitize

    number = uuid.uuid4().hex
    ok, _ = consent_gate(df)
    body = F.sha2(F.to_json(F.struct(*[F.col(c) for c in ok.columns if c in REPORT_COLUMNS and c != "id"])), 256)
    keyed = ok.withColumn("_body", body)
    if row_key:
        keyed = keyed.withColumn("_nth", F.to_json(F.struct(*row_key)))
    else:
        keyed = keyed.withColumn("_nth", F.concat_ws("|", F.lit(number), F.monotonically_increasing_id()))
    keyed = keyed.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "_body", "_nth"), 256), 1, 20))
    rec = sanitize(keyed)
    if "created_at" not in rec.columns:
        rec = rec.withColumn("created_at", F.current_timestamp())
    batch = f"{path.rstrip('/')}/batch={number}"
    rec.write.json(batch)
    return df.sparkSession.read.schema(REPORT_SCHEMA).json(batch).count()


def table_inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """IO11: per table its bytes (file listing, content not read), rows (parquet footers) and
    column count; a table is one file or a folder of part files."""
    counts = None
    for name, p in paths.items():
        df = spark.read.parquet(p)
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        counts = one if counts is None else counts.unionByName(one)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths.values()))
             .select("path", "length"))
    # a file belongs to the table whose path it lies under (the longest such path)
    roots = sorted(paths.items(), key=lambda x: -len(x[1]))
    under = [F.when(F.col("path").contains(p.split("://")[-1].rstrip("/") + "/") | F.col("path").endswith(
        p.split("://")[-1].rstrip("/")), name) for name, p in roots]
    sizes = files.withColumn("table", F.coalesce(*under)).groupBy("table").agg(F.sum("length").alias("bytes"))
    return counts.join(sizes, "table", "left").select("table", "n_rows", "n_columns", "bytes")
