"""EDA plans: token tables, cross-tabs, profiles, maps, histograms, trends, top-k
(T1, T2, T7-T9, A2-A6, A11-A16, A18-A21, S12-S19, W5, F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions import normalize as N
from corpusgauge.functions import text as T
from corpusgauge.operators import eda as E
from corpusgauge.operators import quality as Q
from corpusgauge.operators.common import top_k
from corpusgauge.operators.common import shared_table
from corpusgauge.plans.registry import load, query, sql_list, sql_str

CASE_STOP_SQL = sql_list(X.CASE_EN_STOP)


# -- token tables --------------------------------------------------------------

def english_token_rows(spark, sf_dir):
    """``[a-z]+`` tokens of lower-cased text, stopwords and short words removed
    before the shuffle (the filter runs inside the scan stage)."""
    docs = load(spark, sf_dir, "documents").select("lang", "text")
    toks = docs.select("lang", F.explode(T.english_tokens("text")).alias("token"))
    return toks.filter((F.length("token") > 3) & ~F.col("token").isin(X.CASE_EN_STOP))


EN_TOKENS_CTE = f"""
toks AS (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS token FROM documents),
ftoks AS (SELECT * FROM toks WHERE length(token) > 3 AND NOT list_contains({CASE_STOP_SQL}, token)),
cnt AS (SELECT lang, token, count(*) AS n FROM ftoks GROUP BY lang, token)"""


@query("top_tokens_by_lang", f"""
WITH {EN_TOKENS_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM cnt)
SELECT lang, token, n::BIGINT AS n, rank::INTEGER AS rank,
       round(n / max(n) OVER (PARTITION BY lang), 6) AS rel_size
FROM r WHERE rank <= 10""", ops="T2 T7 T9")
def top_tokens_by_lang(spark, sf_dir):
    counts = E.token_counts(english_token_rows(spark, sf_dir), ["lang"])
    return E.top_tokens(counts, ["lang"], 10).select(
        "lang", "token", F.col("n").cast("bigint").alias("n"), "rank", "rel_size")


@query("token_frequency", f"""
WITH {EN_TOKENS_CTE},
tot AS (SELECT token, sum(n) AS n FROM cnt GROUP BY token)
SELECT token, n::BIGINT AS n FROM tot ORDER BY n DESC, token LIMIT 120""", ops="T8")
def token_frequency(spark, sf_dir):
    toks = english_token_rows(spark, sf_dir)
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("token")).limit(120)


@query("corpus_tokens_top", f"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(coalesce(text, ''), {sql_str(X.CORPUS_TOKEN)})) AS token FROM documents),
f AS (SELECT * FROM t WHERE NOT list_contains({sql_list(X.CORPUS_EN_STOP)}, lower(token))
                        AND NOT list_contains({sql_list(X.CORPUS_BN_STOP)}, token)),
c AS (SELECT lang, token, count(*) AS n FROM f GROUP BY lang, token),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c)
SELECT lang, token, n::BIGINT AS n, rank::INTEGER AS rank FROM r WHERE rank <= 12""", ops="T1 T7")
def corpus_tokens_top(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("lang", "text")
    toks = docs.select("lang", F.explode(T.corpus_tokens("text")).alias("token"))
    toks = toks.filter(~F.lower("token").isin(X.CORPUS_EN_STOP) & ~F.col("token").isin(X.CORPUS_BN_STOP))
    counts = E.token_counts(toks, ["lang"])
    return top_k(counts, ["lang"], [F.col("n").desc(), F.col("token")], 12).select(
        "lang", "token", F.col("n").cast("bigint").alias("n"), "rank")


# -- cross-tabs over events ------------------------------------------------------

DAY_PARTS = ["night", "morning", "afternoon", "evening"]


def day_part(ts_col):
    h = F.hour(ts_col)
    return (F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening"))


DAY_PART_SQL = ("CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' "
                "WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END")


@query("crosstab_rowpct", f"""
WITH e AS (SELECT event_type, {DAY_PART_SQL} AS part FROM events),
c AS (SELECT event_type,
             count(*) FILTER (WHERE part = 'night') AS n_night,
             count(*) FILTER (WHERE part = 'morning') AS n_morning,
             count(*) FILTER (WHERE part = 'afternoon') AS n_afternoon,
             count(*) FILTER (WHERE part = 'evening') AS n_evening FROM e GROUP BY event_type)
SELECT event_type, n_night::BIGINT AS n_night, n_morning::BIGINT AS n_morning,
       n_afternoon::BIGINT AS n_afternoon, n_evening::BIGINT AS n_evening,
       round_even(100.0 * n_night / (n_night + n_morning + n_afternoon + n_evening), 1) AS pct_night,
       round_even(100.0 * n_morning / (n_night + n_morning + n_afternoon + n_evening), 1) AS pct_morning,
       round_even(100.0 * n_afternoon / (n_night + n_morning + n_afternoon + n_evening), 1) AS pct_afternoon,
       round_even(100.0 * n_evening / (n_night + n_morning + n_afternoon + n_evening), 1) AS pct_evening
FROM c""", ops="A4 A5")
def crosstab_rowpct(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_type", day_part(F.col("ts")).alias("part"))
    ct = E.crosstab(ev, "event_type", "part", DAY_PARTS)
    return E.row_percent(ct, "event_type", [f"n_{p}" for p in DAY_PARTS])


LABELLED_DOCS_SQL = "documents d JOIN labels l USING (doc_id)"


@query("label_share_by_group", f"""
SELECT d.lang, count(*)::BIGINT AS n,
       round(avg(CASE WHEN l.toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS toxic_share,
       round(avg(CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS quality_share
FROM {LABELLED_DOCS_SQL} GROUP BY d.lang""", ops="A6 J1")
def label_share_by_group(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    l = load(spark, sf_dir, "labels")
    j = d.join(l, "doc_id")
    return j.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)), 6).alias("toxic_share"),
        F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("quality_share"))


@query("polarity_counts_fixed", f"""
WITH p AS (SELECT CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive'
                       ELSE 'Neutral' END AS polarity FROM labels l),
dim AS (SELECT * FROM (VALUES (0, 'Negative'), (1, 'Neutral'), (2, 'Positive'), (3, 'Mixed')) t(label_ord, polarity)),
c AS (SELECT polarity, count(*) AS n FROM p GROUP BY polarity)
SELECT dim.label_ord::INTEGER AS label_ord, dim.polarity, coalesce(c.n, 0)::BIGINT AS n,
       round(coalesce(c.n, 0) / (SELECT count(*) FROM labels), 6) AS share
FROM dim LEFT JOIN c USING (polarity)""", ops="A2 A3 S13")
def polarity_counts_fixed(spark, sf_dir):
    from corpusgauge.operators.labels import polarity_from_flags
    l = load(spark, sf_dir, "labels")
    p = l.select(polarity_from_flags("quality", "toxic").alias("polarity"))
    counts = E.counts_over_labels(p, "polarity", X.POLARITY_LABELS + ["Mixed"])
    shared = E.shares(counts, [], "n", "share")
    return shared.select("label_ord", "polarity", "n", F.round("share", 6).alias("share"))


# -- profiles --------------------------------------------------------------------

PROFILE_SRC_SQL = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def profile_source(spark, sf_dir, text):
    """The profiled table; ``text`` stands for the texts, which do not go through the join."""
    d = load(spark, sf_dir, "documents").withColumn("text", text)
    l = load(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left")


@query("missing_profile", f"""
WITH s AS ({PROFILE_SRC_SQL}),
u AS (UNPIVOT (SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(text) AS text,
                      count(*) - count(lang) AS lang, count(*) - count(source) AS source,
                      count(*) - count(n_chars) AS n_chars, count(*) - count(quality) AS quality,
                      count(*) - count(toxic) AS toxic FROM s)
      ON doc_id, text, lang, source, n_chars, quality, toxic INTO NAME column_name VALUE n_missing)
SELECT column_name, n_missing::BIGINT AS n_missing,
       round_even(100.0 * n_missing / (SELECT count(*) FROM s), 2) AS pct_missing
FROM u WHERE n_missing > 0""", ops="A11 J1")
def missing_profile(spark, sf_dir):
    # null or not is all the profile needs of a text
    return Q.missing_profile(profile_source(spark, sf_dir, F.when(F.col("text").isNotNull(), F.lit(""))))


@query("column_profile", f"""
WITH s AS ({PROFILE_SRC_SQL})
SELECT * FROM (VALUES
  ('doc_id', 'bigint', (SELECT count(doc_id) FROM s), (SELECT count(DISTINCT doc_id) FROM s)),
  ('text', 'string', (SELECT count(text) FROM s), (SELECT count(DISTINCT text) FROM s)),
  ('lang', 'string', (SELECT count(lang) FROM s), (SELECT count(DISTINCT lang) FROM s)),
  ('source', 'string', (SELECT count(source) FROM s), (SELECT count(DISTINCT source) FROM s)),
  ('n_chars', 'bigint', (SELECT count(n_chars) FROM s), (SELECT count(DISTINCT n_chars) FROM s)),
  ('quality', 'int', (SELECT count(quality) FROM s), (SELECT count(DISTINCT quality) FROM s)),
  ('toxic', 'int', (SELECT count(toxic) FROM s), (SELECT count(DISTINCT toxic) FROM s))
) t(column_name, data_type, non_null, n_distinct)""", ops="A12 A21")
def column_profile(spark, sf_dir):
    # a text's hash is as distinct as the text
    return Q.column_profile(profile_source(spark, sf_dir, F.sha2("text", 256)))


# -- dictionary maps and derived scores over orders / part -----------------------

# Variant merge (unmapped keep the original) and core map (unmapped -> null) for p_type.
TYPE_VARIANTS = {"PROMO": "PROMOTION", "ECONOMY": "ECONOMY CLASS", "MEDIUM": "STANDARD"}
TYPE_CORE = {"SMALL": "Compact", "MEDIUM": "Regular", "STANDARD": "Regular", "LARGE": "Bulk"}


def _values_sql(m: dict) -> str:
    return ", ".join(f"({sql_str(k)}, {sql_str(v) if isinstance(v, str) else v})" for k, v in m.items())


@query("normalise_map", f"""
WITH v(k, v) AS (VALUES {_values_sql(TYPE_VARIANTS)}),
c(k, v) AS (VALUES {_values_sql(TYPE_CORE)}),
p AS (SELECT p.p_type, coalesce(v.v, p.p_type) AS type_norm, c.v AS type_core
      FROM part p LEFT JOIN v ON p.p_type = v.k LEFT JOIN c ON p.p_type = c.k)
SELECT p_type, type_norm, type_core, count(*)::BIGINT AS n FROM p GROUP BY ALL""", ops="S12 S15")
def normalise_map(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_type")
    out = part.select("p_type",
                      N.map_keep(F.col("p_type"), TYPE_VARIANTS).alias("type_norm"),
                      N.map_or_null(F.col("p_type"), TYPE_CORE).alias("type_core"))
    return out.groupBy("p_type", "type_norm", "type_core").agg(F.count(F.lit(1)).alias("n"))


PRIORITY_SEVERITY = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "5-LOW": 1}
FAMILY_WORDS = ["house", "home"]


@query("severity_scores", f"""
WITH s(k, v) AS (VALUES {_values_sql(PRIORITY_SEVERITY)}),
o AS (SELECT coalesce(s.v, 2) AS severity,
             CASE WHEN regexp_matches(lower(c.c_mktsegment), {sql_str('|'.join(FAMILY_WORDS))}) THEN 1 ELSE 0 END AS trust_blind_spot,
             year(try_strptime(strftime(o.o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')) AS yr,
             TRY_CAST(left(o.o_orderpriority, 1) AS INTEGER) AS priority_num, o.o_totalprice
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN s ON o.o_orderpriority = s.k)
SELECT severity::INTEGER AS severity, trust_blind_spot::INTEGER AS trust_blind_spot, yr::INTEGER AS yr,
       count(*)::BIGINT AS n, sum(priority_num)::BIGINT AS priority_sum,
       round(avg(o_totalprice), 4) AS avg_price
FROM o GROUP BY ALL""", ops="S14 S16 S17 S18")
def severity_scores(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    j = o.join(c, "o_custkey")
    day_first = F.date_format("o_orderdate", "dd/MM/yyyy")
    out = j.select(
        N.map_default(F.col("o_orderpriority"), PRIORITY_SEVERITY, 2).alias("severity"),
        N.contains_any_flag(F.col("c_mktsegment"), FAMILY_WORDS).alias("trust_blind_spot"),
        F.year(N.day_first_date(day_first)).alias("yr"),
        N.lenient_int(F.substring("o_orderpriority", 1, 1)).alias("priority_num"),
        "o_totalprice")
    return out.groupBy("severity", "trust_blind_spot", "yr").agg(
        F.count(F.lit(1)).alias("n"), F.sum("priority_num").cast("bigint").alias("priority_sum"),
        F.round(F.avg("o_totalprice"), 4).alias("avg_price"))


@query("histogram_12", """
WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
b AS (SELECT CASE WHEN r.hi = r.lo THEN 0
                  ELSE least(floor((p.p_retailprice - r.lo) / ((r.hi - r.lo) / 12)), 11) END::INTEGER AS bin
      FROM part p, r WHERE p.p_retailprice IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin::INTEGER AS bin, round(r.lo + g.bin * ((r.hi - r.lo) / 12), 6) AS bin_lo,
       round(r.lo + (g.bin + 1) * ((r.hi - r.lo) / 12), 6) AS bin_hi, coalesce(c.n, 0)::BIGINT AS n
FROM range(12) g(bin) CROSS JOIN r LEFT JOIN c ON c.bin = g.bin""", ops="A14")
def histogram_12(spark, sf_dir):
    return E.histogram(load(spark, sf_dir, "part").select("p_retailprice"), "p_retailprice", 12)


@query("year_trend", """
SELECT year(o_orderdate)::INTEGER AS yr, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total_price
FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1""", ops="A15 F6")
def year_trend(spark, sf_dir):
    # the year floor as a bound on the raw column, so it reaches the parquet scan
    o = (load(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
         .select(F.year("o_orderdate").alias("yr"), "o_totalprice"))
    return (o.groupBy("yr")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total_price")))


@query("month_trend", """
SELECT strftime(ts, '%Y-%m') AS month, count(*)::BIGINT AS n FROM events
WHERE length(strftime(ts, '%Y-%m')) >= 7 GROUP BY 1""", ops="A16")
def month_trend(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("month"))
    return ev.filter(F.length("month") >= 7).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


# -- top-k dimensions --------------------------------------------------------------

ORDERS_NATION_SQL = """
SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, n.n_name, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""


def orders_by_nation(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension -> broadcast; customer joins by key.
    cn = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", "c_mktsegment")
    return o.join(cn, o.o_custkey == cn.c_custkey).drop("c_custkey", "o_custkey")


@query("topk_pivot", f"""
WITH j AS ({ORDERS_NATION_SQL}),
tn AS (SELECT n_name FROM j GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 8),
tp AS (SELECT o_orderpriority FROM j GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 8)
SELECT n_name, o_orderpriority, count(*)::BIGINT AS n FROM j
WHERE n_name IN (SELECT n_name FROM tn) AND o_orderpriority IN (SELECT o_orderpriority FROM tp)
GROUP BY ALL""", ops="A18 W5")
def topk_pivot(spark, sf_dir):
    j = orders_by_nation(spark, sf_dir)
    return E.topk_cross(j, "n_name", "o_orderpriority", 8, 8)


@query("topk_location", """
SELECT n.n_name AS location, count(*)::BIGINT AS n
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE lower(n.n_name) <> 'unknown'
GROUP BY 1 ORDER BY n DESC, location LIMIT 15""", ops="W5 F5")
def topk_location(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("location"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).filter(F.lower("location") != "unknown")
    counts = j.groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("location")).limit(15)


@query("family_split", f"""
WITH j AS ({ORDERS_NATION_SQL}),
f AS (SELECT *, c_mktsegment = 'HOUSEHOLD' AS fam FROM j),
s AS (SELECT 'split' AS metric, CASE WHEN fam THEN 'family' ELSE 'other' END AS key, count(*) AS n FROM f GROUP BY 2),
t AS (SELECT 'family_top' AS metric, n_name AS key, count(*) AS n FROM f WHERE fam GROUP BY n_name
      ORDER BY n DESC, key LIMIT 8)
SELECT metric, key, n::BIGINT AS n FROM s UNION ALL SELECT metric, key, n::BIGINT FROM t""", ops="A19")
def family_split(spark, sf_dir):
    j = orders_by_nation(spark, sf_dir).withColumn("fam", F.col("c_mktsegment") == "HOUSEHOLD")
    # counted once; both parts are made of these few rows
    j = shared_table(j.groupBy("n_name", "fam").agg(F.count(F.lit(1)).alias("n")), "family-counts")
    split = j.groupBy(F.when(F.col("fam"), "family").otherwise("other").alias("key")).agg(
        F.sum("n").alias("n")).select(F.lit("split").alias("metric"), "key", "n")
    top = (j.filter("fam").groupBy(F.col("n_name").alias("key")).agg(F.sum("n").alias("n"))
           .orderBy(F.col("n").desc(), F.col("key")).limit(8)
           .select(F.lit("family_top").alias("metric"), "key", "n"))
    return split.unionByName(top)


@query("severity_by_status", f"""
WITH s(k, v) AS (VALUES {_values_sql(PRIORITY_SEVERITY)}),
o AS (SELECT coalesce(s.v, 2) AS severity, o_orderstatus FROM orders LEFT JOIN s ON o_orderpriority = s.k)
SELECT severity::INTEGER AS severity,
       count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS n_F,
       count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS n_O,
       count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS n_P
FROM o GROUP BY 1""", ops="A20")
def severity_by_status(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(
        N.map_default(F.col("o_orderpriority"), PRIORITY_SEVERITY, 2).alias("severity"), "o_orderstatus")
    return E.crosstab(o, "severity", "o_orderstatus", ["F", "O", "P"])


@query("numeric_stats", """
SELECT count(c_acctbal)::BIGINT AS n_valid, min(c_acctbal) AS min_value, max(c_acctbal) AS max_value,
       round(avg(c_acctbal), 4) AS mean_value, round(quantile_cont(c_acctbal, 0.5), 4) AS median_value,
       count(DISTINCT c_nationkey)::BIGINT AS n_distinct_nations
FROM customer""", ops="A13 A21")
def numeric_stats(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey")
    median = E.exact_median(c, "c_acctbal")
    return c.agg(
        F.count("c_acctbal").alias("n_valid"), F.min("c_acctbal").alias("min_value"),
        F.max("c_acctbal").alias("max_value"), F.round(F.avg("c_acctbal"), 4).alias("mean_value"),
        F.round(F.lit(median).cast("double"), 4).alias("median_value"),
        F.countDistinct("c_nationkey").alias("n_distinct_nations"))


@query("table_inventory", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t})::BIGINT AS n_rows, "
    f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}')::INTEGER AS n_columns"
    for t in ["documents", "labels", "events", "conversations", "benchmark", "embeddings", "pages"]),
       ops="IO11")
def table_inventory(spark, sf_dir):
    from corpusgauge.sources.io import table_inventory as inv
    names = ["documents", "labels", "events", "conversations", "benchmark", "embeddings", "pages"]
    df = inv(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in names})
    return df.select(F.col("table").alias("table_name"), F.col("n_rows").cast("bigint").alias("n_rows"),
                     F.col("n_columns").cast("int").alias("n_columns"))
