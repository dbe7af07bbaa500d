"""Sources and sinks (IO1-IO3, IO5-IO8, IO10, T10, S19, S34, S35): rows of the given tables are
written in each source's format to the shared scratch folder, read back by its reader, and
compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions import normalize as N
from corpusgauge.operators import eda as E
from corpusgauge.operators import reports as R
from corpusgauge.operators import retrieval as RT
from corpusgauge.plans.registry import _REGISTRY, load, query, sql_str
from corpusgauge.plans.service_plans import reports_frame
from corpusgauge.session import scratch_path
from corpusgauge.sources import io as IO


@query("corpus_csv", """
SELECT CAST(doc_id AS VARCHAR) AS comment_id, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, ''))::BIGINT AS chars,
       coalesce(source, '') AS platform, '' AS "Likes"
FROM documents""", ops="IO1 IO8")
def corpus_csv(spark, sf_dir):
    """The documents as a CSV corpus: line ends, quotes and blanks of the texts come back, nulls as ''."""
    path = scratch_path(spark, "corpus-csv")
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("comment_id"), F.col("text").alias("Comment"), F.col("source").alias("platform"),
        F.col("lang").alias("abuse_type"), F.lit(None).cast("string").alias("Likes"), F.lit("2024").alias("Date"))
    IO.write_table(docs, path, "csv")
    c = IO.read_corpus(spark, path)
    return c.select("comment_id", F.sha2("Comment", 256).alias("text_sha256"), F.length("Comment").cast("bigint").alias("chars"),
                    "platform", "Likes")


SOURCE_TYPES = ["primary (Interview)", "Primary(Interview)", "Secondary Interview", "secondary (Interview)", "Newspaper", None]
SOURCE_SQL = f"""regexp_replace(regexp_replace(t, '[Pp]rimary\\s*\\(Interview\\)', 'Primary (Interview)', 'g'),
                 '[Ss]econdary\\s*\\(?Interview\\)?', 'Secondary (Interview)', 'g')"""


def _source_type_sql() -> str:
    return f"CASE c_custkey % {len(SOURCE_TYPES)} " + " ".join(
        f"WHEN {i} THEN {sql_str(t)}" for i, t in enumerate(SOURCE_TYPES) if t is not None) + " END"


@query("case_csv", f"""
WITH c AS (SELECT {_source_type_sql()} AS t, CASE WHEN c_custkey % 7 = 0 THEN 'about 70' ELSE CAST(30 + c_custkey % 60 AS VARCHAR) END AS age,
                  c_custkey % 28 + 1 AS day, c_custkey % 12 + 1 AS month FROM customer)
SELECT coalesce({SOURCE_SQL}, 'none') AS source_type, count(*)::BIGINT AS n, count(TRY_CAST(age AS INTEGER))::BIGINT AS n_age,
       sum(TRY_CAST(age AS INTEGER))::BIGINT AS age_sum, min(make_date(2024, month, day))::VARCHAR AS first_day
FROM c GROUP BY 1""", ops="IO2 IO8 S17 S18 S19")
def case_csv(spark, sf_dir):
    """The customers as a table of cases in CSV, its columns all strings, typed after reading."""
    path = scratch_path(spark, "case-csv")
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in SOURCE_TYPES]), (key % len(SOURCE_TYPES) + 1).cast("int"))
    age = F.when(key % 7 == 0, "about 70").otherwise((30 + key % 60).cast("string"))
    values = {"Data Type": kind, "Date": F.concat_ws("/", key % 28 + 1, key % 12 + 1, F.lit(2024)), "Name": F.col("c_name"), "Age": age,
              "Abuse Category": F.col("c_mktsegment")}
    cases = load(spark, sf_dir, "customer").select(*[values.get(c, F.lit(None)).cast("string").alias(c) for c in IO.CASE_COLUMNS])
    IO.write_table(cases, path, "csv")
    c = IO.read_cases(spark, path)
    years = N.lenient_int("Age")
    return c.groupBy(F.coalesce(N.source_type_norm("Data Type"), F.lit("none")).alias("source_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count(years).alias("n_age"), F.sum(years).cast("bigint").alias("age_sum"),
        F.min(N.day_first_date("Date")).cast("string").alias("first_day"))


POL_CODE = "CASE WHEN toxic = 1 THEN 'Neg' WHEN quality = 1 THEN 'Pos' ELSE 'Neu' END"


@query("code_batches", f"""
SELECT {POL_CODE} AS pol, CASE WHEN doc_id % 2 = 0 THEN 'ANG' ELSE 'OTH' END AS emo, count(*)::BIGINT AS n,
       sum(doc_id)::BIGINT AS id_sum, min('C' || doc_id) AS first_id, max('C' || doc_id) AS last_id
FROM labels WHERE doc_id IS NOT NULL GROUP BY ALL""", ops="IO3")
def code_batches(spark, sf_dir):
    """The labels as headerless code files with blanks around the codes and stray lines."""
    path = scratch_path(spark, "codes")
    lab = load(spark, sf_dir, "labels").filter("doc_id is not null")
    line = F.concat(F.lit("C"), F.col("doc_id").cast("string"), F.lit(", "), F.expr(POL_CODE), F.lit(" ,"),
                    F.when(F.col("doc_id") % 2 == 0, "ANG").otherwise("OTH"))
    stray = spark.createDataFrame([("comment_id,pol,emo",), ("",), ("# notes, of, a rater",)], "value string")
    lab.select(line.alias("value")).unionByName(stray).repartition(4).write.text(path)
    codes = IO.read_code_batches(spark, f"{path}/part-*")
    return codes.groupBy("pol", "emo").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.substring("comment_id", 2, 20).cast("bigint")).alias("id_sum"),
        F.min("comment_id").alias("first_id"), F.max("comment_id").alias("last_id"))


@query("report_store", _REGISTRY["dashboard"].sql, ops="IO6 IO10 A17 F7 S30")
def report_store(spark, sf_dir):
    """The reports appended to a store in two batches, one of them with reports that have no consent, and
    the dashboard of what is read back."""
    path = scratch_path(spark, "report-store")
    reports = reports_frame(spark, sf_dir)
    odd = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    IO.append_reports(reports.filter(odd).withColumn("consent", F.lit(True)), path, row_key=["id"])
    refused = reports.withColumn("consent", F.lit(False))
    IO.append_reports(reports.filter(~odd).withColumn("consent", F.lit(True)).unionByName(refused), path, row_key=["id"])
    return R.dashboard_stats(IO.read_reports(spark, path))


@query("metrics_files", """
WITH m AS (SELECT coalesce(lang, 'none') AS lang, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY 1)
SELECT key, value, count(*)::BIGINT AS n_files
FROM (SELECT 'lang' AS key, lang AS value FROM m UNION ALL SELECT 'n', CAST(n AS VARCHAR) FROM m UNION ALL SELECT 'chars', CAST(chars AS VARCHAR) FROM m)
GROUP BY ALL""", ops="IO7")
def metrics_files(spark, sf_dir):
    """A result file of JSON for each language, read as one long table."""
    path = scratch_path(spark, "metrics")
    m = load(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    m.select(F.to_json(F.struct("lang", "n", "chars")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    long = IO.read_metrics(spark, f"{path}/part-*")
    return long.groupBy("key", "value").agg(F.countDistinct("file").alias("n_files"))


def _keyword_file(spark, sf_dir) -> str:
    """A keyword dictionary made of the documents: a category a language, its words the names of its sources."""
    path = scratch_path(spark, "keywords")
    # a few names for each of a few languages
    d = load(spark, sf_dir, "documents").filter("lang is not null and source is not null").select("lang", "source").distinct()
    words = lambda rest: F.sort_array(F.collect_list(F.when(F.pmod(F.length("source"), F.lit(3)) == rest, F.col("source"))))
    groups = d.groupBy("lang").agg(F.struct(words(0).alias("bangla"), words(1).alias("english"), words(2).alias("mixed_forms")).alias("g"))
    groups.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "g"))))).alias("value")).write.text(path)
    return f"{path}/part-*"


@query("keyword_file", """
WITH d AS (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT lang AS category, count(*) FILTER (WHERE length(source) % 3 = 0)::BIGINT AS bangla, count(*) FILTER (WHERE length(source) % 3 = 1)::BIGINT AS english,
       count(*) FILTER (WHERE length(source) % 3 = 2)::BIGINT AS mixed_forms, count(*)::BIGINT AS total
FROM d GROUP BY lang""", ops="IO5 T10")
def keyword_file(spark, sf_dir):
    return E.keyword_composition(IO.read_keywords(spark, _keyword_file(spark, sf_dir)))


@query("kb_file", f"""
WITH d AS (SELECT DISTINCT lang, source, length(source) % 3 AS script FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
words AS (SELECT lang, string_agg(source, ' ' ORDER BY script, source) AS w FROM d GROUP BY lang),
kb AS (SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'pma_sec' ELSE 'bpc_' END || n_nationkey AS id, n_name AS section, 'region ' || n_regionkey AS text,
              CASE n_nationkey % 4 WHEN 0 THEN ['all'] WHEN 1 THEN ['en'] WHEN 2 THEN ['fr', 'all', 'de'] ELSE ['es', 'none'] END AS tags FROM nation),
tags AS (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM kb),
enrich AS (SELECT id, string_agg(w, '  ' ORDER BY pos) AS e FROM tags JOIN words ON tag = lang WHERE tag <> 'all' GROUP BY id)
SELECT id, section || chr(10) || text || chr(10) || '' || CASE WHEN e IS NULL THEN '' ELSE chr(10) || {sql_str(X.KB_ENRICH_PREFIX)} || e END AS document,
       array_to_string(tags, ',') AS applicable_for, CASE WHEN id LIKE 'pma%' THEN 'PMA' ELSE 'BPC' END AS law
FROM kb LEFT JOIN enrich USING (id)""", ops="IO5 S34 S35")
def kb_file(spark, sf_dir):
    """A knowledge base made of the nations, and its search documents with the dictionary's words."""
    path = scratch_path(spark, "kb")
    kind = F.when(F.col("n_regionkey") % 2 == 0, "pma_sec").otherwise("bpc_")
    tags = F.element_at(F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in (["all"], ["en"], ["fr", "all", "de"], ["es", "none"])]),
                        (F.col("n_nationkey") % 4 + 1).cast("int"))
    rows = load(spark, sf_dir, "nation").select(
        F.concat(kind, F.col("n_nationkey").cast("string")).alias("id"),
        F.struct(F.col("n_name").alias("section"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("text"),
                 tags.alias("applicable_for"), F.lit(1).alias("severity_min")).alias("v"))
    # one file of a few sections
    rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "v"))))).alias("value")).write.text(path)
    kb = IO.read_kb(spark, f"{path}/part-*")
    return RT.enriched_kb_documents(kb, IO.read_keywords(spark, _keyword_file(spark, sf_dir)))
