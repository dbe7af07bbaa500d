"""Corpus cleaning and language plans over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions import text as T
from corpusgauge.operators import eda as E
from corpusgauge.operators import quality as Q
from corpusgauge.plans.registry import load, query, sql_list, sql_str

# -- shared SQL fragments (the oracle restates each rule in DuckDB SQL) ------

STRIP_SQL = sql_str(T.STRIP_REGEX)
WS_RUN_SQL = sql_str(T.WS_RUN_REGEX)
SPAM_SQL = sql_str(X.SPAM_REGEX)
LETTER_SQL = sql_str(X.LETTER_CLASS)
RELIG_SQL = sql_list([m.lower() for m in X.RELIGIOUS_MARKERS])

CLEAN_CTE = f"""
cg_base AS (
  SELECT doc_id, text, lang, regexp_replace(coalesce(text, ''), {STRIP_SQL}, '', 'g') AS s
  FROM documents),
cg_flag AS (
  SELECT *, length(s) AS char_len, doc_id > min(doc_id) OVER (PARTITION BY s) AS dup FROM cg_base),
cg_clean AS (
  SELECT *, CASE WHEN regexp_matches(s, {SPAM_SQL}) THEN '{Q.REASON_SPAM}'
                 WHEN NOT regexp_matches(s, {LETTER_SQL}) THEN '{Q.REASON_TEXTLESS}'
                 WHEN char_len <= 2 THEN '{Q.REASON_SHORT}'
                 WHEN dup THEN '{Q.REASON_DUP}' END AS remove_reason
  FROM cg_flag)"""

TAG_SQL = f"""CASE WHEN regexp_matches(s, '[{X.ARABIC_RANGE}]') AND NOT regexp_matches(s, '[{X.BENGALI_RANGE}]') THEN 'arabic'
     WHEN regexp_matches(s, '[{X.BENGALI_RANGE}]') AND regexp_matches(s, '[A-Za-z]') THEN 'bn+en'
     WHEN regexp_matches(s, '[{X.BENGALI_RANGE}]') THEN 'bengali'
     WHEN regexp_matches(s, '[A-Za-z]') THEN 'latin'
     ELSE 'emoji/other' END"""


def cleaned_documents(spark, sf_dir, keep_text=False, extra=None):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return Q.clean_corpus(docs, "doc_id", "text", keep_text, extra)


@query("clean_reason_counts", f"""
WITH {CLEAN_CTE}
SELECT coalesce(remove_reason, 'kept') AS remove_reason, count(*)::BIGINT AS n
FROM cg_clean GROUP BY 1""", ops="S1 S2 S8 S9 F1 F2 W1 A1")
def clean_reason_counts(spark, sf_dir):
    c = cleaned_documents(spark, sf_dir)
    return (c.groupBy(F.coalesce("remove_reason", F.lit("kept")).alias("remove_reason"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("clean_kept", f"""
WITH {CLEAN_CTE}
SELECT doc_id, printf('C%05d', row_number() OVER (ORDER BY doc_id)) AS comment_id,
       char_len::BIGINT AS char_len, {TAG_SQL} AS lang_tag
FROM cg_clean WHERE remove_reason IS NULL""", ops="F2 W2 S2 S5")
def clean_kept(spark, sf_dir):
    # the language tag is computed next to the scan; numbering moves narrow rows only
    c = cleaned_documents(spark, sf_dir, extra={"lang_tag": T.tag_language})
    kept, _ = Q.split_kept_removed(c)
    numbered = Q.number_kept(kept.select("doc_id", "char_len", "lang_tag"), "doc_id")
    return numbered.select("doc_id", "comment_id", F.col("char_len").cast("bigint").alias("char_len"), "lang_tag")


@query("lang_tag_counts", f"""
WITH {CLEAN_CTE}
SELECT {TAG_SQL} AS lang_tag, lang AS source_lang, count(*)::BIGINT AS n
FROM cg_clean WHERE remove_reason IS NULL GROUP BY 1, 2""", ops="S5 A1")
def lang_tag_counts(spark, sf_dir):
    kept, _ = Q.split_kept_removed(cleaned_documents(spark, sf_dir, extra={"lang_tag": T.tag_language}))
    return (kept.groupBy("lang_tag", F.col("lang").alias("source_lang"))
            .agg(F.count(F.lit(1)).alias("n")))


LANG_MODE_SQL = f"""
WITH m AS (
  SELECT text,
         length(regexp_replace(coalesce(text, ''), '[^{X.BENGALI_RANGE}]', '', 'g')) AS bn,
         length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS en,
         text IS NULL OR length(regexp_replace(text, {STRIP_SQL}, '', 'g')) = 0 AS blank
  FROM documents)
SELECT CASE WHEN blank THEN 'unknown'
            WHEN bn > 0 AND en > 0 THEN CASE WHEN bn / (bn + en) > 0.8 THEN 'bangla'
                                             WHEN en / (bn + en) > 0.8 THEN 'english'
                                             ELSE 'mixed' END
            WHEN bn > 0 THEN 'bangla' WHEN en > 0 THEN 'english' ELSE 'unknown' END AS language_mode,
       count(*)::BIGINT AS n
FROM m GROUP BY 1"""


@query("language_mode_counts", LANG_MODE_SQL, ops="S7 A1")
def language_mode_counts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("text")
    return docs.groupBy(T.language_mode("text").alias("language_mode")).agg(F.count(F.lit(1)).alias("n"))


@query("length_stats", f"""
WITH {CLEAN_CTE}
SELECT count(*)::BIGINT AS n, round(avg(char_len), 4) AS mean_len,
       round(quantile_cont(char_len, 0.5), 4) AS median_len,
       round(quantile_cont(char_len, 0.9), 4) AS p90_len, max(char_len)::BIGINT AS max_len
FROM cg_clean WHERE remove_reason IS NULL""", ops="A7")
def length_stats(spark, sf_dir):
    kept, _ = Q.split_kept_removed(cleaned_documents(spark, sf_dir))
    return E.length_stats(kept, "char_len")


@query("length_box_by_lang", """
WITH d AS (SELECT lang, length(text) AS len FROM documents WHERE text IS NOT NULL),
q AS (SELECT lang, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS med,
             quantile_cont(len, 0.75) AS q3, count(*) AS n, avg(len) AS mean_len FROM d GROUP BY lang)
SELECT q.lang, q.n::BIGINT AS n, round(q.q1, 4) AS q1, trunc(q.med)::BIGINT AS median_int,
       round(q.med, 4) AS median, round(q.q3, 4) AS q3, round(q.mean_len, 2) AS mean_len,
       min(d.len) FILTER (WHERE d.len >= q.q1 - 1.5 * (q.q3 - q.q1))::BIGINT AS whisker_low,
       max(d.len) FILTER (WHERE d.len <= q.q3 + 1.5 * (q.q3 - q.q1))::BIGINT AS whisker_high
FROM q JOIN d USING (lang)
GROUP BY q.lang, q.n, q.q1, q.med, q.q3, q.mean_len""", ops="A8 A9")
def length_box_by_lang(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    d = docs.select("lang", F.length("text").alias("len"))
    return E.box_stats(d, "lang", "len")


@query("emoji_marker_flags", f"""
SELECT lang, count(*)::BIGINT AS n,
       count(*) FILTER (WHERE regexp_matches(coalesce(text, ''), {sql_str(X.EMOJI_CLASS)}))::BIGINT AS n_emoji,
       count(*) FILTER (WHERE len(list_filter({RELIG_SQL},
                                              lambda m: strpos(lower(coalesce(text, '')), m) > 0)) > 0)::BIGINT AS n_religious,
       round(avg(CASE WHEN len(list_filter({RELIG_SQL},
                                              lambda m: strpos(lower(coalesce(text, '')), m) > 0)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS religious_share
FROM documents GROUP BY lang""", ops="S10 S11 A10")
def emoji_marker_flags(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("lang", "text", T.is_religious("text").alias("rel"))
    rel = F.col("rel")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(T.has_emoji("text")).alias("n_emoji"),
        F.count_if(rel).alias("n_religious"),
        F.round(F.avg(rel.cast("double")), 6).alias("religious_share"))


@query("preview_slice", f"""
WITH {CLEAN_CTE},
k AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS seq FROM cg_clean WHERE remove_reason IS NULL)
SELECT doc_id, seq::BIGINT AS seq,
       left(regexp_replace(regexp_replace(text, {WS_RUN_SQL}, ' ', 'g'), {STRIP_SQL}, '', 'g'), 350) AS preview
FROM k WHERE seq > 100 AND seq <= 150""", ops="S4 W3")
def preview_slice(spark, sf_dir):
    kept, _ = Q.split_kept_removed(cleaned_documents(spark, sf_dir))
    from corpusgauge.operators.common import sequential_ids
    seq = sequential_ids(kept.select("doc_id"), "doc_id", "seq")
    rows = Q.row_slice(seq, "seq", 100, 50)
    # the slice is bounded (50 ids): join the texts back for the preview only
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(rows), "doc_id").select("doc_id", "seq", T.preview("text").alias("preview"))


BUCKET_SQL = """CASE WHEN lower(tag) LIKE 'beng%' THEN 'Bangla' WHEN lower(tag) IN ('latin', 'banglish') THEN 'Banglish (Latin)'
     WHEN strpos(lower(tag), 'bn+en') > 0 OR strpos(lower(tag), 'mix') > 0 THEN 'Code-mixed'
     WHEN strpos(lower(tag), 'arab') > 0 THEN 'Arabic' ELSE 'Other' END"""


@query("dedupe_norm", f"""
WITH b AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), {STRIP_SQL}, '', 'g') AS s,
                  lower(regexp_replace(regexp_replace(coalesce(text, ''), {WS_RUN_SQL}, ' ', 'g'), {STRIP_SQL}, '', 'g')) AS nk
           FROM documents),
t AS (SELECT *, {TAG_SQL} AS tag, doc_id > min(doc_id) OVER (PARTITION BY nk) AS dup FROM b),
g AS (SELECT {BUCKET_SQL} AS lang_bucket, count(*) AS n,
             count(*) FILTER (WHERE length(text) BETWEEN 1 AND 5000) AS n_in_gate,
             count(*) FILTER (WHERE dup) AS n_dup FROM t GROUP BY 1)
SELECT lang_bucket, n::BIGINT AS n, n_in_gate::BIGINT AS n_in_gate, n_dup::BIGINT AS n_dup,
       CASE WHEN n = 0 THEN 0.0 ELSE round_even(100.0 * n_dup / n, 1) END AS pct_dup FROM g""",
       ops="S3 S6 F8 S38 W1")
def dedupe_norm(spark, sf_dir):
    from corpusgauge.operators.common import pct
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    feats = docs.select(
        "doc_id", Q.text_key(T.norm_text("text")).alias("_nk"),
        T.lang_bucket(T.tag_language(T.ustrip(F.coalesce(F.col("text"), F.lit(""))))).alias("lang_bucket"),
        F.length("text").between(1, 5000).alias("in_gate"))
    flagged = Q.first_occurrence_flag(feats, "_nk", "doc_id", "dup")
    g = flagged.groupBy("lang_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("in_gate", F.lit(False))).alias("n_in_gate"),
        F.count_if("dup").alias("n_dup"))
    return g.select("lang_bucket", "n", "n_in_gate", "n_dup", pct(F.col("n_dup"), F.col("n")).alias("pct_dup"))


BN_STRIP_CHARS = X.TOKEN_PUNCT + "0123456789" + X.BANGLA_DIGITS + " "


@query("bangla_tokens_top", f"""
WITH w AS (SELECT lang, unnest(regexp_split_to_array(coalesce(text, ''), {WS_RUN_SQL})) AS raw FROM documents),
s AS (SELECT lang, regexp_replace(raw, {sql_str(T.bangla_strip_regex())}, '', 'g') AS token FROM w),
f AS (SELECT * FROM s WHERE length(token) > 1 AND NOT list_contains({sql_list(X.CASE_BN_STOP)}, token)
                        AND regexp_matches(token, '[{X.BENGALI_RANGE}]')),
c AS (SELECT lang, token, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c)
SELECT lang, token, n::BIGINT AS n, rank::INTEGER AS rank FROM r WHERE rank <= 10""", ops="T3 T7")
def bangla_tokens_top(spark, sf_dir):
    from corpusgauge.operators.common import top_k
    docs = load(spark, sf_dir, "documents").select("lang", "text")
    toks = docs.select("lang", F.explode(T.bangla_tokens("text")).alias("token"))
    toks = toks.filter((F.length("token") > 1) & ~F.col("token").isin(X.CASE_BN_STOP)
                       & F.col("token").rlike(f"[{X.BENGALI_RANGE}]"))
    counts = toks.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["lang"], [F.col("n").desc(), F.col("token")], 10).select(
        "lang", "token", F.col("n").cast("bigint").alias("n"), "rank")
