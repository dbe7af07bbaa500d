"""Label assembly, audit, agreement, sampling and lock plans over ``labels`` and
``documents`` (J1-J5, J11, J12, A22-A25, M1-M4, P1-P7, P10, U1-U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions.text import ustrip
from corpusgauge.operators import agreement as AG
from corpusgauge.operators import labels as L
from corpusgauge.operators import quality as Q
from corpusgauge.operators import sampling as S
from corpusgauge.operators.common import join_one_row, shared_table
from corpusgauge.plans.registry import load, query
from corpusgauge.session import scratch_path
from corpusgauge.sources import upsert as UP
from corpusgauge.sources import workbooks as WB

POL_SQL = ("CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END")
POL_CODE_SQL = "CASE WHEN toxic = 1 THEN 'Neg' WHEN quality = 1 THEN 'Pos' ELSE 'Neu' END"


@query("coverage_diff", """
SELECT 'missing' AS kind, doc_id FROM (SELECT DISTINCT doc_id FROM documents) d
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
UNION ALL
SELECT 'extra' AS kind, doc_id FROM (SELECT DISTINCT doc_id FROM labels) l
WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)""", ops="J2 J5 U3")
def coverage_diff(spark, sf_dir):
    return Q.coverage_diff(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id")


@query("key_violations", """
SELECT 'duplicate_id' AS violation, CAST(doc_id AS VARCHAR) AS id, 'doc_id' AS column_name,
       CAST(count(*) AS VARCHAR) AS value FROM labels GROUP BY doc_id HAVING count(*) > 1
UNION ALL
SELECT 'bad_code', CAST(doc_id AS VARCHAR), 'quality', CAST(quality AS VARCHAR) FROM labels
WHERE quality IS NULL OR quality NOT IN (0, 1)
UNION ALL
SELECT 'bad_code', CAST(doc_id AS VARCHAR), 'toxic', CAST(toxic AS VARCHAR) FROM labels
WHERE toxic IS NULL OR toxic NOT IN (0, 1)
UNION ALL
SELECT 'bad_code', CAST(doc_id AS VARCHAR), 'lang', lang FROM documents
WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de')""", ops="A22")
def key_violations(spark, sf_dir):
    l = Q.key_violations(load(spark, sf_dir, "labels"), "doc_id", {"quality": [0, 1], "toxic": [0, 1]})
    d = load(spark, sf_dir, "documents")
    bad_lang = (d.filter(F.col("lang").isNull() | ~F.col("lang").isin("en", "fr", "de"))
                .select(F.lit("bad_code").alias("violation"), F.col("doc_id").cast("string").alias("id"),
                        F.lit("lang").alias("column_name"), F.col("lang").alias("value")))
    return l.unionByName(bad_lang)


@query("silver_assembly", f"""
SELECT d.doc_id, c.pol AS pol_code,
       CASE c.pol WHEN 'Neg' THEN 'Negative' WHEN 'Neu' THEN 'Neutral' WHEN 'Pos' THEN 'Positive' END AS polarity
FROM documents d LEFT JOIN (SELECT doc_id, {POL_CODE_SQL} AS pol FROM labels) c USING (doc_id)""",
       ops="J1 S13 U1")
def silver_assembly(spark, sf_dir):
    codes = load(spark, sf_dir, "labels").select(
        "doc_id", L.polarity_code_from_flags("quality", "toxic").alias("pol_code"))
    decoded = L.decode_codes(codes, "pol_code", None)
    return L.attach_codes(load(spark, sf_dir, "documents").select("doc_id"), decoded, "doc_id")


@query("keyed_correction", """
WITH fixes AS (SELECT doc_id, 1 AS old, 0 AS new FROM documents WHERE n_chars < 200),
j AS (SELECT l.doc_id, l.quality, f.old, f.new, d.lang FROM labels l JOIN documents d USING (doc_id)
      LEFT JOIN fixes f USING (doc_id)),
a AS (SELECT lang, coalesce(new IS NOT NULL AND quality = old, false) AS applied,
             CASE WHEN new IS NOT NULL AND quality = old THEN new ELSE quality END AS quality_after,
             new IS NOT NULL AND quality <> old AS violated FROM j)
SELECT lang, count(*) FILTER (WHERE applied)::BIGINT AS n_applied,
       count(*) FILTER (WHERE violated)::BIGINT AS n_violations,
       sum(quality_after)::BIGINT AS quality_after_sum, count(*)::BIGINT AS n
FROM a GROUP BY lang""", ops="J11 J12")
def keyed_correction(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    fixes = docs.filter(F.col("n_chars") < 200).select("doc_id", F.lit(1).alias("old"), F.lit(0).alias("new"))
    fixed = L.keyed_correction(labels, fixes, "doc_id", "quality")
    bad = L.correction_violations(labels, fixes, "doc_id", "quality").select(
        "doc_id", F.lit(True).alias("violated"))
    j = (fixed.join(docs.select("doc_id", "lang"), "doc_id")
         .join(bad.join(labels.select("doc_id"), "doc_id", "left_semi"), "doc_id", "left"))
    return j.groupBy("lang").agg(
        F.count_if("applied").alias("n_applied"),
        F.count_if(F.coalesce("violated", F.lit(False))).alias("n_violations"),
        F.sum("quality").cast("bigint").alias("quality_after_sum"),
        F.count(F.lit(1)).alias("n"))


# -- four deterministic raters ----------------------------------------------------

RATERS = ["A", "B", "C", "D"]


def rater_rule(r: int):
    """Rater r's label: blank on one residue, the next label on another, else the silver label."""
    v = F.pmod(F.col("doc_id") * (2 * r + 1) + r, F.lit(7))
    base = L.polarity_from_flags("quality", "toxic")
    nxt = (F.when(base == "Negative", "Neutral").when(base == "Neutral", "Positive").otherwise("Negative"))
    return F.when(v == 0, F.lit("")).when(v == 1, nxt).otherwise(base)


def rater_long(spark, sf_dir):
    lab = load(spark, sf_dir, "labels")
    rows = F.array(*[F.struct(F.lit(name).alias("rater"), rater_rule(i).alias("polarity"))
                     for i, name in enumerate(RATERS, start=1)])
    long = lab.select("doc_id", L.polarity_from_flags("quality", "toxic").alias("silver"),
                      F.explode(rows).alias("r")).select("doc_id", "silver", "r.rater", "r.polarity")
    # rater D never saw every 11th id (an id missing for one rater)
    return long.filter(~((F.col("rater") == "D") & (F.pmod("doc_id", F.lit(11)) == 0)))


def _rater_sql(i: int, name: str) -> str:
    v = f"((doc_id * {2 * i + 1} + {i}) % 7)"
    nxt = ("CASE WHEN toxic = 1 THEN 'Neutral' WHEN quality = 1 THEN 'Negative' ELSE 'Positive' END")
    return (f"SELECT doc_id, {POL_SQL} AS silver, '{name}' AS rater, "
            f"CASE WHEN {v} = 0 THEN '' WHEN {v} = 1 THEN {nxt} ELSE {POL_SQL} END AS polarity FROM labels")


RATER_LONG_SQL = (" UNION ALL ".join(_rater_sql(i, n) for i, n in enumerate(RATERS, start=1)))
RATER_CTE = f"""rl AS (SELECT * FROM ({RATER_LONG_SQL}) x WHERE NOT (rater = 'D' AND doc_id % 11 = 0))"""
LABELS3 = "('Negative', 'Neutral', 'Positive')"

AGREEMENT_SQL = f"""
WITH {RATER_CTE},
common AS (SELECT doc_id FROM rl GROUP BY doc_id HAVING count(DISTINCT rater) = 4),
ab AS (SELECT a.polarity AS a, b.polarity AS b FROM rl a JOIN rl b ON a.doc_id = b.doc_id
       WHERE a.rater = 'A' AND b.rater = 'B'),
abv AS (SELECT *, coalesce(a IN {LABELS3} AND b IN {LABELS3}, false) AS v FROM ab),
ck AS (SELECT count(*) FILTER (WHERE v) AS n_compared, count(*) FILTER (WHERE NOT v) AS n_dropped,
              count(*) FILTER (WHERE v AND a = b) AS agree FROM abv),
ma AS (SELECT a AS l, count(*) AS na FROM abv WHERE v GROUP BY a),
mb AS (SELECT b AS l, count(*) AS nb FROM abv WHERE v GROUP BY b),
pe AS (SELECT sum(na * nb) AS pe_num FROM ma JOIN mb USING (l)),
ckf AS (SELECT n_compared, n_dropped, agree / n_compared AS po, pe_num / (n_compared * n_compared) AS pe
        FROM ck, pe),
pc AS (SELECT doc_id, polarity, count(*) AS nij FROM rl WHERE polarity IN {LABELS3} GROUP BY ALL),
pi AS (SELECT doc_id, sum(nij) AS n, sum(nij * nij) AS sq, max(nij) AS top FROM pc GROUP BY doc_id),
items AS (SELECT * FROM pi WHERE n = 4),
ist AS (SELECT count(*) AS n_items, avg((sq - 4) / 12.0) AS p_bar, avg(top * (top - 1) / 12.0) AS tla FROM items),
ct AS (SELECT polarity, sum(nij) AS cj FROM pc WHERE doc_id IN (SELECT doc_id FROM items) GROUP BY polarity),
fe AS (SELECT sum(cj * cj) / (sum(cj) * sum(cj)) AS p_e FROM ct)
SELECT metric, value FROM (
  SELECT 'n_common_ids' AS metric, (SELECT count(*) FROM common)::DOUBLE AS value
  UNION ALL SELECT 'cohen_n_compared', n_compared::DOUBLE FROM ckf
  UNION ALL SELECT 'cohen_n_dropped', n_dropped::DOUBLE FROM ckf
  UNION ALL SELECT 'cohen_kappa', round((po - pe) / (1 - pe), 6) FROM ckf
  UNION ALL SELECT 'percent_agreement', round(po, 6) FROM ckf
  UNION ALL SELECT 'fleiss_n_items', n_items::DOUBLE FROM ist
  UNION ALL SELECT 'fleiss_kappa', round((p_bar - p_e) / (1 - p_e), 6) FROM ist, fe
  UNION ALL SELECT 'P_bar', round(p_bar, 6) FROM ist
  UNION ALL SELECT 'P_e', round(p_e, 6) FROM fe
  UNION ALL SELECT 'top_label_agreement', round(tla, 6) FROM ist)"""


@query("rater_agreement", AGREEMENT_SQL, ops="M1 M2 M3 M4 J3 J4 U2 F3 F4")
def rater_agreement(spark, sf_dir):
    long = rater_long(spark, sf_dir)
    common = AG.items_rated_by_all(long, "doc_id", "rater", 4).agg(F.count(F.lit(1)).alias("n_common_ids"))
    a = long.filter("rater = 'A'").select("doc_id", F.col("polarity").alias("a"))
    b = long.filter("rater = 'B'").select("doc_id", F.col("polarity").alias("b"))
    ck = AG.cohen_kappa(a.join(b, "doc_id"), "a", "b", X.POLARITY_LABELS)
    fk = AG.fleiss_kappa(long, "doc_id", "polarity", X.POLARITY_LABELS, 4)
    one = join_one_row(join_one_row(common, ck), fk)
    metrics = [("n_common_ids", "n_common_ids"), ("cohen_n_compared", "n_compared"),
               ("cohen_n_dropped", "n_dropped"), ("cohen_kappa", "cohen_kappa"),
               ("percent_agreement", "percent_agreement"), ("fleiss_n_items", "n_items"),
               ("fleiss_kappa", "fleiss_kappa"), ("P_bar", "P_bar"), ("P_e", "P_e"),
               ("top_label_agreement", "top_label_agreement")]
    stack = "stack({}, {}) as (metric, value)".format(
        len(metrics), ", ".join(f"'{m}', cast(`{c}` as double)" for m, c in metrics))
    return one.selectExpr(stack)


@query("confusion_ab", f"""
WITH {RATER_CTE},
ab AS (SELECT a.polarity AS a, b.polarity AS b FROM rl a JOIN rl b ON a.doc_id = b.doc_id
       WHERE a.rater = 'A' AND b.rater = 'B' AND a.polarity IN {LABELS3} AND b.polarity IN {LABELS3}),
g AS (SELECT x.a, y.b FROM (VALUES ('Negative'), ('Neutral'), ('Positive')) x(a),
                         (VALUES ('Negative'), ('Neutral'), ('Positive')) y(b))
SELECT g.a, g.b, count(ab.a)::BIGINT AS n FROM g LEFT JOIN ab ON g.a = ab.a AND g.b = ab.b GROUP BY g.a, g.b""",
       ops="M1")
def confusion_ab(spark, sf_dir):
    long = rater_long(spark, sf_dir)
    a = long.filter("rater = 'A'").select("doc_id", F.col("polarity").alias("a"))
    b = long.filter("rater = 'B'").select("doc_id", F.col("polarity").alias("b"))
    return AG.confusion(a.join(b, "doc_id"), "a", "b", X.POLARITY_LABELS)


@query("gold_labels", f"""
WITH {RATER_CTE},
common AS (SELECT doc_id FROM rl GROUP BY doc_id HAVING count(DISTINCT rater) = 4),
ov AS (SELECT * FROM rl WHERE doc_id IN (SELECT doc_id FROM common)),
c AS (SELECT doc_id, polarity, count(*) AS n FROM ov WHERE polarity IN {LABELS3} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, polarity) AS rk FROM c),
p AS (SELECT doc_id, max(polarity) FILTER (WHERE rk = 1) AS top, max(n) FILTER (WHERE rk = 1) AS n1,
             max(n) FILTER (WHERE rk = 2) AS n2 FROM r GROUP BY doc_id),
it AS (SELECT DISTINCT doc_id, silver FROM ov),
maj AS (SELECT it.doc_id,
          CASE WHEN top IS NULL THEN silver WHEN n2 IS NULL OR n1 > n2 THEN top
               ELSE coalesce(CASE WHEN silver IN {LABELS3} THEN silver END, top) END AS label,
          CASE WHEN top IS NULL THEN 'empty→ai' WHEN n2 IS NULL OR n1 > n2 THEN 'majority'
               ELSE 'tie→ai' END AS status,
          'overlap' AS source
        FROM it LEFT JOIN p USING (doc_id)),
single AS (SELECT doc_id, polarity AS label, 'single' AS status, 'rater_' || rater AS source
           FROM rl WHERE doc_id NOT IN (SELECT doc_id FROM common))
SELECT * FROM maj UNION ALL SELECT * FROM single""", ops="A24 A25 J4 J5 U1")
def gold_labels(spark, sf_dir):
    long = rater_long(spark, sf_dir)
    common = AG.items_rated_by_all(long, "doc_id", "rater", 4)
    ov = long.join(common, "doc_id", "left_semi")
    maj = L.majority_vote(ov, "doc_id", "polarity", X.POLARITY_LABELS, "silver").withColumn(
        "source", F.lit("overlap"))
    # outside the overlap every rater's rows are gold, with the rater's tag
    single = (long.join(common, "doc_id", "left_anti")
              .select("doc_id", F.col("polarity").alias("label"), F.lit("single").alias("status"),
                      F.concat(F.lit("rater_"), F.col("rater")).alias("source")))
    return maj.unionByName(single)


# -- splits, folds, samples, lock --------------------------------------------------

SEED = 42


def _quota_sql(counts: str, draws: str, n_col: str = "n", out: str = "q") -> str:
    """Largest-remainder quotas in SQL over a CTE ``counts`` (stratum, n, label_ord)."""
    return f"""(SELECT *, fl + CASE WHEN rr <= need THEN 1 ELSE 0 END AS {out} FROM (
      SELECT *, row_number() OVER (ORDER BY rem DESC, label_ord) AS rr,
             {draws} - sum(fl) OVER () AS need FROM (
        SELECT *, ({n_col} * ({draws})) // sum({n_col}) OVER () AS fl,
               ({n_col} * ({draws})) % sum({n_col}) OVER () AS rem FROM {counts}) a) b)"""


SPLIT_CTE = f"""
lab AS (SELECT doc_id, {POL_SQL} AS polarity FROM labels),
cnt AS (SELECT polarity, count(*) AS n,
               CASE polarity WHEN 'Negative' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Positive' THEN 3 END AS label_ord
        FROM lab GROUP BY polarity),
tot AS (SELECT sum(n) AS t FROM cnt),
c1 AS (SELECT cnt.*, (SELECT t - (3 * t + 9) // 10 FROM tot) AS draw_train FROM cnt),
q1 AS {_quota_sql('c1', 'draw_train', 'n', 'q_train')},
r1 AS (SELECT polarity, label_ord, q_train, n - q_train AS n_rest FROM q1),
c2 AS (SELECT r1.*, (SELECT sum(n_rest) - ceil(sum(n_rest) / 2) FROM r1)::BIGINT AS draw_val FROM r1),
q2 AS {_quota_sql('c2', 'draw_val', 'n_rest', 'q_val')},
rk AS (SELECT lab.*, row_number() OVER (PARTITION BY polarity ORDER BY sha256('{SEED}|' || doc_id)) AS rnk FROM lab),
split AS (SELECT rk.doc_id, rk.polarity,
                 CASE WHEN rnk <= q_train THEN 'train' WHEN rnk <= q_train + q_val THEN 'val' ELSE 'test' END AS split
          FROM rk JOIN q2 USING (polarity))"""


def split_frame(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select("doc_id", L.polarity_from_flags("quality", "toxic").alias("polarity"))
    return S.stratified_split(lab, "doc_id", "polarity", SEED, labels=X.POLARITY_LABELS)


@query("stratified_split", f"""
WITH {SPLIT_CTE},
g AS (SELECT split, polarity, count(*) AS n FROM split GROUP BY GROUPING SETS ((split, polarity), (polarity)))
SELECT coalesce(split, 'all') AS split, polarity, n::BIGINT AS n,
       round(n / sum(n) OVER (PARTITION BY coalesce(split, 'all')), 6) AS share FROM g""", ops="P2 P10 A2 A3")
def stratified_split(spark, sf_dir):
    sp = split_frame(spark, sf_dir)
    g = sp.groupBy("split", "polarity").agg(F.count(F.lit(1)).alias("n"))
    allp = sp.groupBy("polarity").agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.lit("all"))
    u = g.unionByName(allp)
    from pyspark.sql import Window
    return u.select("split", "polarity", F.col("n").cast("bigint").alias("n"),
                    F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 6).alias("share"))


@query("test_lock", f"""
WITH {SPLIT_CTE},
ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM split WHERE split = 'test'),
b AS (SELECT substr(sha256(id), 1, 3) AS b, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS h
      FROM ids GROUP BY 1)
SELECT sum(n)::BIGINT AS n_ids, 3 AS hex_digits, sha256(string_agg(h, chr(10) ORDER BY b)) AS sha256_ids, true AS verified
FROM b""", ops="A23 P2")
def test_lock(spark, sf_dir):
    sp = split_frame(spark, sf_dir).filter(F.col("split") == "test")
    lock = Q.ids_lock(sp, "doc_id", 3)
    return join_one_row(lock, Q.verify_lock(sp, "doc_id", lock).select(F.col("ok").alias("verified")))


@query("correction_by_split", f"""
WITH {SPLIT_CTE},
fixes AS (SELECT doc_id FROM documents WHERE n_chars < 200),
j AS (SELECT s.split, l.quality, f.doc_id IS NOT NULL AND l.quality = 1 AS hit
      FROM split s JOIN labels l USING (doc_id) LEFT JOIN fixes f USING (doc_id))
SELECT split, count(*)::BIGINT AS n, count(*) FILTER (WHERE hit)::BIGINT AS n_applied,
       sum(CASE WHEN hit THEN 0 ELSE quality END)::BIGINT AS quality_after_sum
FROM j GROUP BY split""", ops="J12 J11 P2")
def correction_by_split(spark, sf_dir):
    """The corrections carried into the split tables, with the hits in each."""
    fixes = load(spark, sf_dir, "documents").filter(F.col("n_chars") < 200).select(
        "doc_id", F.lit(1).alias("old"), F.lit(0).alias("new"))
    rows = load(spark, sf_dir, "labels").join(split_frame(spark, sf_dir).select("doc_id", "split"), "doc_id")
    fixed = L.keyed_correction(rows, fixes, "doc_id", "quality")
    return fixed.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("applied").alias("n_applied"),
        F.sum("quality").cast("bigint").alias("quality_after_sum"))


@query("overlap_sample", f"""
WITH lab AS (SELECT doc_id, {POL_SQL} AS polarity FROM labels),
cnt AS (SELECT polarity, count(*) AS n,
               CASE polarity WHEN 'Negative' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Positive' THEN 3 END AS label_ord,
               100 AS draw FROM lab GROUP BY polarity),
q AS {_quota_sql('cnt', 'draw', 'n', 'q')},
rk AS (SELECT lab.*, row_number() OVER (PARTITION BY polarity ORDER BY sha256('{SEED}|' || doc_id)) AS rnk FROM lab)
SELECT rk.doc_id, rk.polarity FROM rk JOIN q USING (polarity) WHERE rnk <= q""", ops="P1 P4 P7")
def overlap_sample(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select("doc_id", L.polarity_from_flags("quality", "toxic").alias("polarity"))
    s = S.stratified_sample(lab, "doc_id", "polarity", 100, SEED, X.POLARITY_LABELS)
    return s.filter("in_sample").select("doc_id", "polarity")


@query("kfold", f"""
WITH lab AS (SELECT doc_id, {POL_SQL} AS polarity FROM labels),
cnt AS (SELECT polarity, count(*) AS n,
               CASE polarity WHEN 'Negative' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Positive' THEN 3 END AS label_ord
        FROM lab GROUP BY polarity),
off AS (SELECT polarity, coalesce(sum(n) OVER (ORDER BY label_ord, polarity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cnt),
rk AS (SELECT lab.*, row_number() OVER (PARTITION BY polarity ORDER BY sha256('{SEED}|' || doc_id)) AS rnk FROM lab),
f AS (SELECT (o + rnk - 1) % 4 AS fold, polarity FROM rk JOIN off USING (polarity))
SELECT fold::INTEGER AS fold, polarity, count(*)::BIGINT AS n FROM f GROUP BY ALL""", ops="P5")
def kfold(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select("doc_id", L.polarity_from_flags("quality", "toxic").alias("polarity"))
    f = S.stratified_folds(lab, "doc_id", "polarity", 4, SEED, X.POLARITY_LABELS)
    return f.groupBy("fold", "polarity").agg(F.count(F.lit(1)).alias("n"))


@query("uniform_sample", f"""
SELECT doc_id FROM documents ORDER BY sha256('{SEED}|' || doc_id) LIMIT 50""", ops="P9")
def uniform_sample(spark, sf_dir):
    return S.uniform_sample(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, SEED)


@query("rater_sheets", f"""
WITH lab AS (SELECT doc_id, {POL_SQL} AS polarity FROM labels),
cnt AS (SELECT polarity, count(*) AS n,
               CASE polarity WHEN 'Negative' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Positive' THEN 3 END AS label_ord,
               100 AS draw FROM lab GROUP BY polarity),
q AS {_quota_sql('cnt', 'draw', 'n', 'q')},
rk AS (SELECT lab.*, row_number() OVER (PARTITION BY polarity ORDER BY sha256('{SEED}|' || doc_id)) AS rnk FROM lab),
ov AS (SELECT rk.doc_id FROM rk JOIN q USING (polarity) WHERE rnk <= q),
rest AS (SELECT * FROM lab WHERE doc_id NOT IN (SELECT doc_id FROM ov)),
rc AS (SELECT polarity, count(*) AS n,
              CASE polarity WHEN 'Negative' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Positive' THEN 3 END AS label_ord
       FROM rest GROUP BY polarity),
off AS (SELECT polarity, coalesce(sum(n) OVER (ORDER BY label_ord, polarity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM rc),
rr AS (SELECT rest.*, row_number() OVER (PARTITION BY polarity ORDER BY sha256('{SEED}|' || doc_id)) AS rnk FROM rest),
own AS (SELECT doc_id, ['A', 'B', 'C', 'D'][CAST(((o + rnk - 1) % 4) + 1 AS INTEGER)] AS rater FROM rr JOIN off USING (polarity)),
sh AS (SELECT doc_id, rater FROM ov, (VALUES ('A'), ('B'), ('C'), ('D')) r(rater) UNION ALL SELECT doc_id, rater FROM own)
SELECT rater, doc_id, row_number() OVER (PARTITION BY rater ORDER BY sha256('{SEED}|' || rater || '|' || doc_id))::BIGINT AS sheet_pos,
       '' AS polarity
FROM sh""", ops="P5 P6 P7")
def rater_sheets(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select("doc_id", L.polarity_from_flags("quality", "toxic").alias("polarity"))
    s = S.stratified_sample(lab, "doc_id", "polarity", 100, SEED, X.POLARITY_LABELS)
    overlap = s.filter("in_sample").select("doc_id")
    rest = s.filter(~F.col("in_sample")).select("doc_id", "polarity")
    folds = S.stratified_folds(rest, "doc_id", "polarity", 4, SEED, X.POLARITY_LABELS)
    own = folds.select("doc_id", F.element_at(F.array(*[F.lit(r) for r in RATERS]), F.col("fold") + 1).alias("rater"))
    sheets = S.rater_sheets(overlap, own, "doc_id", RATERS, SEED, label_cols=("polarity",))
    return sheets.select("rater", "doc_id", "sheet_pos", "polarity")


_SPLIT80_CTE = f"""
c AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment AS s FROM customer),
sc AS (SELECT s, count(*) AS n FROM c GROUP BY s),
m AS (SELECT c.c_custkey, c.s, CASE WHEN sc.n < 2 THEN 'Other' ELSE c.s END AS stratum FROM c JOIN sc USING (s)),
cnt AS (SELECT stratum, count(*) AS n, 0 AS label_ord FROM m GROUP BY stratum),
tot AS (SELECT sum(n) AS t FROM cnt),
c1 AS (SELECT cnt.*, (SELECT t - (2 * t + 9) // 10 FROM tot) AS draw FROM cnt),
q AS (SELECT *, fl + CASE WHEN rr <= need THEN 1 ELSE 0 END AS q FROM (
        SELECT *, row_number() OVER (ORDER BY rem DESC, label_ord, stratum) AS rr, draw - sum(fl) OVER () AS need FROM (
          SELECT *, (n * draw) // sum(n) OVER () AS fl, (n * draw) % sum(n) OVER () AS rem FROM c1) a) b),
rk AS (SELECT m.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SEED}|' || c_custkey)) AS rnk FROM m)"""


def _split_80_20_frame(spark, sf_dir):
    """(c_custkey, s, stratum, split): 80/20 split stratified by nation|segment,
    strata with fewer than two rows merged into 'Other' for the split only."""
    c = load(spark, sf_dir, "customer").select(
        "c_custkey", F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("s"))
    sizes = c.groupBy("s").agg(F.count(F.lit(1)).alias("_n"))
    m = c.join(sizes, "s").select("c_custkey", "s",
                                  F.when(F.col("_n") < 2, "Other").otherwise(F.col("s")).alias("stratum"))
    sp = S.stratified_split(m, "c_custkey", "stratum", SEED, 2, 10, labels=None)
    # 80/20: the "rest" (test) is ceil(0.2 n); every row not in train is test
    return sp.withColumn("split", F.when(F.col("split") == "train", "train").otherwise("test"))


@query("split_80_20", f"""
WITH {_SPLIT80_CTE}
SELECT CASE WHEN rnk <= q THEN 'train' ELSE 'test' END AS split, count(*)::BIGINT AS n,
       count(DISTINCT stratum)::BIGINT AS n_strata,
       count(*) FILTER (WHERE stratum = 'Other')::BIGINT AS n_other
FROM rk JOIN q USING (stratum) GROUP BY 1""", ops="P3")
def split_80_20(spark, sf_dir):
    sp = _split_80_20_frame(spark, sf_dir)
    return sp.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stratum").alias("n_strata"),
                                   F.count_if(F.col("stratum") == "Other").alias("n_other"))


@query("split_share_check", f"""
WITH {_SPLIT80_CTE},
sp AS (SELECT s, CASE WHEN rnk <= q THEN 'train' ELSE 'test' END AS split FROM rk JOIN q USING (stratum)),
d AS (SELECT split, s, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 1) AS pct
      FROM sp GROUP BY split, s),
tr AS (SELECT s, pct FROM d WHERE split = 'train'),
te AS (SELECT s, pct FROM d WHERE split = 'test')
SELECT coalesce(tr.s, te.s) AS category, coalesce(tr.pct, 0) AS train_pct, coalesce(te.pct, 0) AS test_pct
FROM tr FULL OUTER JOIN te ON tr.s = te.s""", ops="J6 P3")
def split_share_check(spark, sf_dir):
    """Share of every actual category (not the merged stratum) in train and
    in test, percent to one decimal; a category missing from one side is 0."""
    sp = _split_80_20_frame(spark, sf_dir)
    cnt = sp.groupBy("split", "s").agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.groupBy("split").agg(F.sum("n").alias("_t"))  # one row per split
    pct = cnt.join(F.broadcast(tot), "split").select(
        "split", F.col("s").alias("category"), F.round(100.0 * F.col("n") / F.col("_t"), 1).alias("pct"))
    tr = pct.filter(F.col("split") == "train").select("category", F.col("pct").alias("train_pct"))
    te = pct.filter(F.col("split") == "test").select("category", F.col("pct").alias("test_pct"))
    return tr.join(te, "category", "full_outer").na.fill(0.0, ["train_pct", "test_pct"])


@query("review_sheet", f"""
SELECT l.doc_id, 'Negative' AS current_value, 'Negative' AS new_value, length(d.text)::BIGINT AS text_len,
       d.text AS full_text, d.lang, d.source, 'Negative' AS final_polarity, '' AS is_correct, '' AS notes
FROM labels l JOIN documents d USING (doc_id) WHERE {POL_SQL} = 'Negative'""", ops="P8 W4")
def review_sheet(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select("doc_id", L.polarity_from_flags("quality", "toxic").alias("polarity"))
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    sel = lab.filter(F.col("polarity") == "Negative").join(d, "doc_id")
    return Q.order_by_length(sel, "text", "doc_id").select(
        "doc_id", F.col("polarity").alias("current_value"), F.col("polarity").alias("new_value"),
        F.length("text").cast("bigint").alias("text_len"), F.col("text").alias("full_text"), "lang", "source",
        # for the reviewer: the polarity to correct, and two empty cells
        F.col("polarity").alias("final_polarity"), F.lit("").alias("is_correct"), F.lit("").alias("notes"))


# -- rater workbooks and corrections of a stored table --------------------------------

@query("rater_workbooks", f"""
WITH {RATER_CTE}
SELECT rater, CAST(doc_id AS VARCHAR) AS comment_id, polarity, silver AS emotion FROM rl""", ops="IO4 P6")
def rater_workbooks(spark, sf_dir):
    """The raters' sheets as workbooks (a few hundred rows each here), read back as their long table."""
    long = rater_long(spark, sf_dir).select(
        F.concat(F.lit("annotator_"), "rater", F.lit(".xlsx")).alias("path"), F.col("doc_id").cast("string").alias("comment_id"),
        F.when(F.col("polarity") != "", F.concat(F.lit(" "), "polarity", F.lit(" "))).alias("polarity"), F.col("silver").alias("emotion"))
    books = shared_table(WB.workbooks(long, "path", "comment_id", WB.RATER_COLUMNS, "Annotate", per_book=1000), "workbooks")
    rows = WB.workbook_rows(books, "Annotate", WB.RATER_COLUMNS)
    return rows.select(F.regexp_extract("path", "annotator_([^_.]+)", 1).alias("rater"),
                       *[ustrip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in WB.RATER_COLUMNS])


@query("correction_upsert", f"""
WITH {SPLIT_CTE},
t AS (SELECT s.split, s.doc_id, l.quality, d.doc_id IS NOT NULL AS fix FROM split s JOIN labels l USING (doc_id)
      LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars < 200) d ON d.doc_id = s.doc_id AND s.split = 'test' AND l.quality = 1)
SELECT split, count(*)::BIGINT AS n, sum(CASE WHEN fix THEN 0 ELSE quality END)::BIGINT AS quality_sum,
       count(*) FILTER (WHERE fix)::BIGINT AS n_applied, bool_or(fix) AS rewritten
FROM t GROUP BY split""", ops="J11 J12 IO8")
def correction_upsert(spark, sf_dir):
    """Corrections of the test split in a table stored by split: the other splits' files stay."""
    path = scratch_path(spark, "labels-by-split")
    rows = load(spark, sf_dir, "labels").join(split_frame(spark, sf_dir).select("doc_id", "split"), "doc_id")
    rows.write.partitionBy("split").parquet(path)
    before = shared_table(UP.file_times(spark, path), "file-times")
    fixes = spark.read.parquet(path).filter("split = 'test' and quality = 1").join(
        load(spark, sf_dir, "documents").filter("n_chars < 200").select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", F.col("quality").alias("old"), F.lit(0).cast("int").alias("new"))
    fixes = shared_table(fixes, "corrections")
    UP.correct_partitions(spark, path, fixes, "doc_id", "quality", ["split"])
    of_split = F.regexp_extract("path", "split=([^/]+)", 1).alias("split")
    kept = before.join(UP.file_times(spark, path), ["path", "modified"]).select(of_split, F.lit(True).alias("_kept")).distinct()
    hits = fixes.join(split_frame(spark, sf_dir).select("doc_id", "split"), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n_applied"))
    after = spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("bigint").alias("quality_sum"))
    return after.join(kept, "split", "left").join(hits, "split", "left").select(
        "split", "n", "quality_sum", F.coalesce("n_applied", F.lit(0)).cast("bigint").alias("n_applied"), F.col("_kept").isNull().alias("rewritten"))


def _tree_sql(ids: str, name: str, levels: int = 2) -> str:
    """The CTEs of a lock tree over a query of ids: ``name`` (level, prefix, n, digest)."""
    out = [f"""{name}_ids AS (SELECT CAST(id AS VARCHAR) AS id, count(*) AS c FROM ({ids}) x WHERE id IS NOT NULL GROUP BY 1),
{name}_{levels} AS (SELECT substr(sha256(id), 1, {levels}) AS prefix, sum(c) AS n,
                    sha256(string_agg(id || ':' || c, chr(10) ORDER BY id || ':' || c)) AS digest FROM {name}_ids GROUP BY 1)"""]
    for level in range(levels - 1, -1, -1):
        out.append(f"""{name}_{level} AS (SELECT substr(prefix, 1, {level}) AS prefix, sum(n) AS n,
                    sha256(string_agg(digest, chr(10) ORDER BY prefix)) AS digest FROM {name}_{level + 1} GROUP BY 1)""")
    union = " UNION ALL ".join(f"SELECT {level} AS level, prefix, n, digest FROM {name}_{level}" for level in range(levels + 1))
    return ",\n".join(out) + f",\n{name} AS ({union})"


@query("lock_tree", f"""
WITH {_tree_sql("SELECT doc_id AS id FROM documents", "t")}
SELECT level::INTEGER AS level, prefix, n::BIGINT AS n, digest FROM t""", ops="A23")
def lock_tree(spark, sf_dir):
    return Q.lock_tree(load(spark, sf_dir, "documents"), "doc_id", 2)


@query("lock_tree_changes", f"""
WITH {_tree_sql("SELECT doc_id AS id FROM documents", "a")},
{_tree_sql("SELECT CASE WHEN doc_id % 500 = 3 THEN -doc_id ELSE doc_id END AS id FROM documents", "b")}
SELECT coalesce(a.prefix, b.prefix) AS prefix, coalesce(a.n, 0)::BIGINT AS n_locked, coalesce(b.n, 0)::BIGINT AS n_now
FROM (SELECT * FROM a WHERE level = 2) a FULL JOIN (SELECT * FROM b WHERE level = 2) b ON a.prefix = b.prefix
WHERE a.digest IS DISTINCT FROM b.digest""", ops="A23")
def lock_tree_changes(spark, sf_dir):
    """The leaves that name the ids which changed since the lock."""
    docs = load(spark, sf_dir, "documents").select("doc_id")
    lock = shared_table(Q.lock_tree(docs, "doc_id", 2), "lock")
    changed = docs.select(F.when(F.col("doc_id") % 500 == 3, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"))
    return Q.changed_leaves(shared_table(Q.lock_tree(changed, "doc_id", 2), "lock-now"), lock)
