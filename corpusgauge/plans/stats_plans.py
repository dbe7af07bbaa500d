"""Evaluation and statistics plans (M5-M19) over rule-made predictions on
``documents`` joined with ``labels``, and cross-tabs of ``events`` / ``orders``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions import text as T
from corpusgauge.operators import evalstats as M
from corpusgauge.operators import labels as L
from corpusgauge.operators.common import shared_table
from corpusgauge.plans.corpus import BUCKET_SQL, STRIP_SQL, TAG_SQL
from corpusgauge.plans.eda import DAY_PART_SQL, day_part
from corpusgauge.plans.registry import load, query, sql_str

LABELS3 = X.POLARITY_LABELS
POL_SQL = "CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END"
PRED_A_SQL = ("CASE WHEN n_chars < 300 THEN 'Negative' WHEN n_chars < 800 THEN 'Neutral' ELSE 'Positive' END")
PRED_B_SQL = ("CASE WHEN lang = 'en' THEN 'Positive' WHEN lang = 'de' THEN 'Neutral' "
              "WHEN n_chars < 1000 THEN 'Negative' ELSE 'Positive' END")
PREDS_CTE = f"""preds AS (
  SELECT d.doc_id, d.text, d.lang, {POL_SQL} AS y, {PRED_A_SQL} AS pred_a, {PRED_B_SQL} AS pred_b
  FROM documents d JOIN labels l USING (doc_id))"""


def predictions(spark, sf_dir, **flags):
    """Labelled documents with both predictions; ``flags`` are columns made of the text next to
    the scan (the texts do not go through the join)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", *[f.alias(n) for n, f in flags.items()])
    l = load(spark, sf_dir, "labels")
    j = d.join(l, "doc_id")
    pred_a = (F.when(F.col("n_chars") < 300, "Negative").when(F.col("n_chars") < 800, "Neutral")
              .otherwise("Positive"))
    pred_b = (F.when(F.col("lang") == "en", "Positive").when(F.col("lang") == "de", "Neutral")
              .when(F.col("n_chars") < 1000, "Negative").otherwise("Positive"))
    return j.select("doc_id", "lang", *flags, L.polarity_from_flags("quality", "toxic").alias("y"),
                    pred_a.alias("pred_a"), pred_b.alias("pred_b"))


def long_preds(spark, sf_dir, extra=(), **flags):
    return M.long_predictions(predictions(spark, sf_dir, **flags), "doc_id", "y", {"a": "pred_a", "b": "pred_b"},
                              (*extra, *flags))


LONG_SQL = """lp AS (SELECT doc_id, text, lang, y, 'a' AS model, pred_a AS pred FROM preds
                UNION ALL SELECT doc_id, text, lang, y, 'b', pred_b FROM preds)"""

METRICS_SQL = f"""
WITH {PREDS_CTE}, {LONG_SQL},
lab(label) AS (VALUES ('Negative'), ('Neutral'), ('Positive')),
per0 AS (SELECT m.model, lab.label,
                count(lp.doc_id) FILTER (WHERE lp.y = lab.label AND lp.pred = lab.label) AS tp,
                count(lp.doc_id) FILTER (WHERE lp.y = lab.label) AS support,
                count(lp.doc_id) FILTER (WHERE lp.pred = lab.label) AS npred
         FROM (SELECT DISTINCT model FROM lp) m CROSS JOIN lab JOIN lp ON lp.model = m.model
         GROUP BY m.model, lab.label),
per1 AS (SELECT *, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS precision,
                   CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per0),
per AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                       ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM per1),
ov AS (SELECT model, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1,
              sum(f1 * support) / sum(support) AS weighted_f1 FROM per GROUP BY model)"""


@query("eval_metrics", METRICS_SQL + """
SELECT model, class, metric, round(value, 6) AS value FROM (
  SELECT model, label AS class, 'precision' AS metric, precision AS value FROM per
  UNION ALL SELECT model, label, 'recall', recall FROM per
  UNION ALL SELECT model, label, 'f1', f1 FROM per
  UNION ALL SELECT model, label, 'support', support::DOUBLE FROM per
  UNION ALL SELECT model, 'all', 'accuracy', accuracy FROM ov
  UNION ALL SELECT model, 'all', 'macro_f1', macro_f1 FROM ov
  UNION ALL SELECT model, 'all', 'weighted_f1', weighted_f1 FROM ov)""", ops="M5 M18 M1")
def eval_metrics(spark, sf_dir):
    return M.classification_metrics(long_preds(spark, sf_dir), LABELS3)


@query("best_model", METRICS_SQL + """
SELECT model, round(macro_f1, 6) AS macro_f1 FROM ov ORDER BY macro_f1 DESC, model LIMIT 1""", ops="M16")
def best_model(spark, sf_dir):
    m = M.classification_metrics(long_preds(spark, sf_dir), LABELS3)
    f = m.filter((F.col("class") == "all") & (F.col("metric") == "macro_f1"))
    return f.orderBy(F.col("value").desc(), F.col("model")).limit(1).select(
        "model", F.col("value").alias("macro_f1"))


@query("mcnemar", f"""
WITH {PREDS_CTE},
bc AS (SELECT count(*) FILTER (WHERE pred_a = y AND pred_b <> y) AS b,
              count(*) FILTER (WHERE pred_a <> y AND pred_b = y) AS c FROM preds),
t AS (SELECT b, c, b + c AS n,
             (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))
              FROM range(0, least(b, c) + 1) r(i)) AS tail FROM bc),
p AS (SELECT b, c, n, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END AS p_raw FROM t)
SELECT b::BIGINT AS b, c::BIGINT AS c, n::BIGINT AS n, round(p_raw, 6) AS p_value,
       round(log10(p_raw), 4) AS log10_p, p_raw < 0.05 AS significant FROM p""", ops="M6")
def mcnemar(spark, sf_dir):
    return M.mcnemar_exact(predictions(spark, sf_dir), "y", "pred_a", "pred_b")


@query("confusion_pairs", f"""
WITH {PREDS_CTE}, {LONG_SQL}
SELECT model, y || '→' || pred AS pair, count(*)::BIGINT AS n FROM lp WHERE y <> pred GROUP BY ALL""",
       ops="M12")
def confusion_pairs(spark, sf_dir):
    lp = long_preds(spark, sf_dir)
    return (lp.filter(F.col("y") != F.col("pred"))
            .groupBy("model", F.concat_ws("→", "y", "pred").alias("pair"))
            .agg(F.count(F.lit(1)).alias("n")))


LATIN_SQL = ("regexp_matches(coalesce(text, ''), '[A-Za-z]') AND NOT "
             "(regexp_matches(coalesce(text, ''), '[\\x{0600}-\\x{06FF}]') AND NOT "
             "regexp_matches(coalesce(text, ''), '[\\x{0980}-\\x{09FF}]'))")


@query("error_groups", f"""
WITH {PREDS_CTE}, {LONG_SQL},
g AS (SELECT model, pred <> y AS wrong, regexp_matches(coalesce(text, ''), {sql_str(X.EMOJI_CLASS)}) AS emoji,
             {LATIN_SQL} AS latin FROM lp),
e AS (SELECT model, 'emoji' AS grp, avg(CASE WHEN wrong THEN 1.0 ELSE 0.0 END) FILTER (WHERE emoji) AS err FROM g GROUP BY model
      UNION ALL SELECT model, 'no_emoji', avg(CASE WHEN wrong THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT emoji) FROM g GROUP BY model
      UNION ALL SELECT model, 'latin_script', avg(CASE WHEN wrong THEN 1.0 ELSE 0.0 END) FILTER (WHERE latin) FROM g GROUP BY model
      UNION ALL SELECT model, 'other_script', avg(CASE WHEN wrong THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT latin) FROM g GROUP BY model),
w AS (SELECT count(*) FILTER (WHERE pred_a <> y AND pred_b <> y) AS both_wrong,
             count(*) FILTER (WHERE pred_a <> y AND pred_b = y) AS only_a_wrong,
             count(*) FILTER (WHERE pred_a = y AND pred_b <> y) AS only_b_wrong FROM preds)
SELECT model || ':' || grp AS metric, round(err, 6) AS value FROM e
UNION ALL SELECT 'both_wrong', both_wrong::DOUBLE FROM w
UNION ALL SELECT 'only_a_wrong', only_a_wrong::DOUBLE FROM w
UNION ALL SELECT 'only_b_wrong', only_b_wrong::DOUBLE FROM w""", ops="M13 M14")
def error_groups(spark, sf_dir):
    p = shared_table(predictions(spark, sf_dir, emoji=T.has_emoji("text"),
                                 latin=T.tag_language("text").isin("latin", "bn+en")), "predictions")
    g = M.long_predictions(p, "doc_id", "y", {"a": "pred_a", "b": "pred_b"}, ("emoji", "latin")).select(
        "model", (F.col("pred") != F.col("y")).alias("wrong"), "emoji", "latin")
    wrong = F.when(F.col("wrong"), 1.0).otherwise(0.0)
    rates = g.groupBy("model").agg(
        F.avg(F.when(F.col("emoji"), wrong)).alias("emoji"),
        F.avg(F.when(~F.col("emoji"), wrong)).alias("no_emoji"),
        F.avg(F.when(F.col("latin"), wrong)).alias("latin_script"),
        F.avg(F.when(~F.col("latin"), wrong)).alias("other_script"))
    er = rates.select(F.expr("stack(4, 'emoji', emoji, 'no_emoji', no_emoji, 'latin_script', latin_script, "
                             "'other_script', other_script) as (grp, value)"), "model").select(
        F.concat_ws(":", "model", "grp").alias("metric"), F.round("value", 6).alias("value"))
    a_wrong, b_wrong = F.col("pred_a") != F.col("y"), F.col("pred_b") != F.col("y")
    w = p.agg(F.count_if(a_wrong & b_wrong).cast("double").alias("both_wrong"),
              F.count_if(a_wrong & ~b_wrong).cast("double").alias("only_a_wrong"),
              F.count_if(~a_wrong & b_wrong).cast("double").alias("only_b_wrong"))
    wl = w.select(F.expr("stack(3, 'both_wrong', both_wrong, 'only_a_wrong', only_a_wrong, "
                         "'only_b_wrong', only_b_wrong) as (metric, value)"))
    return er.unionByName(wl)


@query("hardest_examples", f"""
WITH {PREDS_CTE}
SELECT doc_id, left(text, 120) AS text_head, y, pred_a, pred_b, lang FROM preds
WHERE pred_a <> y AND pred_b <> y ORDER BY doc_id LIMIT 12""", ops="M15")
def hardest_examples(spark, sf_dir):
    p = predictions(spark, sf_dir)
    both = p.filter((F.col("pred_a") != F.col("y")) & (F.col("pred_b") != F.col("y")))
    # the twelve first, then their texts
    rows = shared_table(both.orderBy("doc_id").limit(12), "hardest")
    texts = load(spark, sf_dir, "documents").select("doc_id", "text")
    return texts.join(F.broadcast(rows), "doc_id").select(
        "doc_id", F.substring("text", 1, 120).alias("text_head"), "y", "pred_a", "pred_b", "lang")


@query("accuracy_by_lang", f"""
WITH {PREDS_CTE}, {LONG_SQL},
s AS (SELECT model, y, pred, regexp_replace(coalesce(text, ''), {STRIP_SQL}, '', 'g') AS s FROM lp),
t AS (SELECT model, y, pred, {TAG_SQL} AS tag FROM s),
b AS (SELECT model, {BUCKET_SQL} AS lang_bucket, y, pred, count(*) AS n FROM t GROUP BY ALL)
SELECT model, lang_bucket, y, pred, n::BIGINT AS n,
       round(sum(CASE WHEN y = pred THEN n ELSE 0 END) OVER w / sum(n) OVER w, 6) AS accuracy
FROM b WINDOW w AS (PARTITION BY model, lang_bucket)""", ops="M10 M11")
def accuracy_by_lang(spark, sf_dir):
    """M10 + M11: the confusion cells of each model and language bucket, with the bucket's accuracy."""
    bucket = T.lang_bucket(T.tag_language(T.ustrip(F.coalesce(F.col("text"), F.lit("")))))
    cells = long_preds(spark, sf_dir, lang_bucket=bucket).groupBy("model", "lang_bucket", "y", "pred").agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model", "lang_bucket")
    right = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).over(w)
    return cells.withColumn("accuracy", F.round(right / F.sum("n").over(w), 6))


@query("val_test_gap", f"""
WITH {PREDS_CTE}, {{split_cte}},
j AS (SELECT s.split, p.y, p.pred_a AS pred FROM preds p JOIN split s USING (doc_id) WHERE s.split IN ('val', 'test')),
labv(label) AS (VALUES ('Negative'), ('Neutral'), ('Positive')),
per0 AS (SELECT sp.split, labv.label,
                count(j.y) FILTER (WHERE j.y = labv.label AND j.pred = labv.label) AS tp,
                count(j.y) FILTER (WHERE j.y = labv.label) AS support,
                count(j.y) FILTER (WHERE j.pred = labv.label) AS npred
         FROM (SELECT DISTINCT split FROM j) sp CROSS JOIN labv JOIN j ON j.split = sp.split GROUP BY ALL),
per AS (SELECT *, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS pr,
                  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM per0),
f AS (SELECT split, avg(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END) AS macro_f1 FROM per GROUP BY split)
SELECT round(v.macro_f1, 6) AS val_macro_f1, round(t.macro_f1, 6) AS test_macro_f1,
       round(t.macro_f1 - v.macro_f1, 6) AS gap
FROM f v, f t WHERE v.split = 'val' AND t.split = 'test'""", ops="M17")
def val_test_gap(spark, sf_dir):
    from corpusgauge.plans.labels_plans import split_frame
    sp = split_frame(spark, sf_dir).select("doc_id", "split").filter(F.col("split").isin("val", "test"))
    p = predictions(spark, sf_dir).join(sp, "doc_id")
    long = p.select("doc_id", F.col("split").alias("model"), "y", F.col("pred_a").alias("pred"))
    m = M.classification_metrics(long, LABELS3).filter((F.col("class") == "all") & (F.col("metric") == "macro_f1"))
    piv = m.groupBy().pivot("model", ["val", "test"]).agg(F.first("value"))
    return piv.select(F.round("val", 6).alias("val_macro_f1"), F.round("test", 6).alias("test_macro_f1"),
                      F.round(F.col("test") - F.col("val"), 6).alias("gap"))


def _fix_gap_sql():
    from corpusgauge.plans import labels_plans as LP
    from corpusgauge.plans.registry import _REGISTRY
    q = _REGISTRY["val_test_gap"]
    q.sql = q.sql.replace("{split_cte}", LP.SPLIT_CTE.strip())


_fix_gap_sql()


CHI_SQL = """
WITH c AS (SELECT {row} AS r, {col} AS k, count(*) AS o FROM {src} GROUP BY ALL),
rs AS (SELECT r, sum(o) AS ri FROM c GROUP BY r), cs AS (SELECT k, sum(o) AS cj FROM c GROUP BY k),
n AS (SELECT sum(o) AS n FROM c),
s AS (SELECT sum(o * o * n.n / (ri * cj)) - max(n.n) AS chi2, max(n.n) AS n FROM c JOIN rs USING (r) JOIN cs USING (k), n),
sh AS (SELECT (SELECT count(*) FROM rs) AS rr, (SELECT count(*) FROM cs) AS cc),
t AS (SELECT chi2, n, rr, cc, (rr - 1) * (cc - 1) AS dof FROM s, sh),
p AS (SELECT *, exp(-chi2 / 2) * (SELECT sum(pow(chi2 / 2, i) / exp(lgamma(i + 1))) FROM range(0, dof // 2) g(i)) AS p_raw,
             sqrt(chi2 / (n * (least(rr, cc) - 1))) AS v FROM t)
SELECT '{name}' AS cross_tab, round(chi2, 6) AS chi2, dof::BIGINT AS dof, n::BIGINT AS n, round(p_raw, 6) AS p_value,
       round(log10(p_raw), 4) AS log10_p, round(v, 6) AS cramers_v,
       CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small' WHEN v < 0.5 THEN 'moderate' ELSE 'strong' END AS effect,
       p_raw < 0.05 AS significant, rr || 'x' || cc AS table_shape FROM p"""


@query("chi_square", "SELECT * FROM (" + CHI_SQL.format(row="event_type", col=DAY_PART_SQL, src="events",
                                                       name="event_type x day_part")
       + ") UNION ALL SELECT * FROM (" + CHI_SQL.format(row="o_orderpriority", col="o_orderstatus",
                                                       src="orders", name="priority x status") + ")",
       ops="M7 M8 S37")
def chi_square(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_type", day_part(F.col("ts")).alias("part"))
    o = load(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    return (M.chi_square(ev, "event_type", "part", "event_type x day_part")
            .unionByName(M.chi_square(o, "o_orderpriority", "o_orderstatus", "priority x status")))


@query("fisher", """
WITH t AS (SELECT coalesce(l.toxic = 1, false) AS r, d.lang = 'en' AS k FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE NOT r AND NOT k) AS a, count(*) FILTER (WHERE NOT r AND k) AS b,
             count(*) FILTER (WHERE r AND NOT k) AS c, count(*) FILTER (WHERE r AND k) AS d FROM t),
m AS (SELECT *, a + b AS r1, a + c AS c1, a + b + c + d AS n FROM c),
lp AS (SELECT i, lgamma(c1 + 1) - lgamma(i + 1) - lgamma(c1 - i + 1)
                 + lgamma(n - c1 + 1) - lgamma(r1 - i + 1) - lgamma(n - c1 - r1 + i + 1)
                 - (lgamma(n + 1) - lgamma(r1 + 1) - lgamma(n - r1 + 1)) AS lp
       FROM m, range(greatest(0, r1 + c1 - n), least(r1, c1) + 1) g(i)),
obs AS (SELECT lp AS lo FROM lp, m WHERE i = a),
p AS (SELECT sum(exp(lp)) FILTER (WHERE lp <= lo + ln(1 + 1e-7)) AS p_raw FROM lp, obs)
SELECT a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d,
       round(CASE WHEN b * c = 0 THEN 'inf'::DOUBLE ELSE a * d / (b * c) END, 6) AS odds_ratio,
       round(least(1.0, p_raw), 6) AS p_value, round(log10(least(1.0, p_raw)), 4) AS log10_p,
       p_raw < 0.05 AS significant FROM m, p""", ops="M9")
def fisher(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    l = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    t = d.join(l, "doc_id").select(F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("r"),
                                   (F.col("lang") == "en").alias("k"))
    table = t.agg(F.count_if(~F.col("r") & ~F.col("k")).alias("a"), F.count_if(~F.col("r") & F.col("k")).alias("b"),
                  F.count_if(F.col("r") & ~F.col("k")).alias("c"), F.count_if(F.col("r") & F.col("k")).alias("d"))
    return M.fisher_exact(table)


@query("ari_rule", """
WITH e AS (SELECT label, (CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END) + (CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END) AS cl
           FROM embeddings),
c AS (SELECT label, cl, count(*) AS nij FROM e GROUP BY ALL),
x AS (SELECT sum(nij * (nij - 1) / 2.0) AS idx, sum(nij) AS n FROM c),
a AS (SELECT sum(ai * (ai - 1) / 2.0) AS sa FROM (SELECT sum(nij) AS ai FROM c GROUP BY label)),
b AS (SELECT sum(bj * (bj - 1) / 2.0) AS sb FROM (SELECT sum(nij) AS bj FROM c GROUP BY cl)),
r AS (SELECT idx, n, sa * sb / (n * (n - 1) / 2.0) AS ex, (sa + sb) / 2 AS mx FROM x, a, b)
SELECT n::BIGINT AS n, round(CASE WHEN mx = ex THEN 1.0 ELSE (idx - ex) / (mx - ex) END, 6) AS ari FROM r""",
       ops="M19")
def ari_rule(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select(
        "label", ((F.when(F.col("embedding")[0] > 0, 2).otherwise(0))
                  + F.when(F.col("embedding")[1] > 0, 1).otherwise(0)).alias("cl"))
    return M.adjusted_rand_index(e, "label", "cl")
