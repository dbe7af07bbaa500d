"""Classification, entity and JSON plans (R1-R3, J7, W6, F10, S20-S24) over
``conversations``, ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from corpusgauge import fixed as X
from corpusgauge.functions import normalize as N
from corpusgauge.functions.text import STRIP_REGEX
from corpusgauge.operators import classify as C
from corpusgauge.plans.registry import load, query, sql_list, sql_str


def _kw_values_sql() -> str:
    rows = []
    for order, (cat, words) in enumerate(X.KEYWORDS.items()):
        for pos, w in enumerate(words):
            rows.append(f"({sql_str(cat)}, {order}, {pos}, {sql_str(w.lower())}, {X.SEVERITY.get(cat, 1)})")
    return ", ".join(rows)


def _case_map_sql(expr: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {sql_str(k) if isinstance(k, str) else k} THEN {sql_str(v) if isinstance(v, str) else v}"
                     for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _laws_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str('; '.join(v))}" for k, v in X.LEGAL_SECTIONS.items())
    return f"CASE {expr} {whens} ELSE '' END"


STRIP_SQL = sql_str(STRIP_REGEX)


def classify_sql(src: str, keys: str, tie_severity: bool = True) -> str:
    sev_order = "severity DESC, " if tie_severity else ""
    return f"""
WITH kw(category, cat_ord, pos, keyword, severity) AS (VALUES {_kw_values_sql()}),
t AS (SELECT {keys}, text, lower(coalesce(text, '')) AS lt,
             text IS NULL OR length(regexp_replace(text, {STRIP_SQL}, '', 'g')) = 0 AS blank FROM {src}),
h AS (SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, kw.category, kw.cat_ord, kw.severity,
             count(*) AS n, string_agg(kw.keyword, ', ' ORDER BY kw.pos) AS matched
      FROM t JOIN kw ON strpos(t.lt, kw.keyword) > 0 WHERE NOT t.blank GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {sev_order}cat_ord) AS rk,
             sum(n) OVER (PARTITION BY {keys}) AS total FROM h)
SELECT {', '.join('t.' + k.strip() for k in keys.split(','))},
       coalesce(r.category, 'unknown') AS category, coalesce(r.n, 0)::INTEGER AS top_hits,
       coalesce(r.total, 0)::INTEGER AS total_hits,
       CASE WHEN r.category IS NULL THEN 0 ELSE r.severity END::INTEGER AS severity,
       CASE WHEN r.category IS NULL THEN 0.0 ELSE round_even(r.n / r.total, 2) END AS confidence,
       coalesce(r.matched, '') AS matched,
       {_laws_sql("coalesce(r.category, 'unknown')")} AS legal_sections,
       {_case_map_sql("coalesce(r.category, 'unknown')", X.CIVIL_OR_CRIMINAL, "'Unknown'")} AS civil_or_criminal,
       CASE WHEN t.blank THEN {sql_str(X.ACTION_BLANK)} WHEN r.category IS NULL THEN {sql_str(X.ACTION_UNKNOWN)}
            ELSE {_case_map_sql("r.severity", X.RECOMMENDED_ACTIONS, "''")} END AS recommended_action
FROM t LEFT JOIN (SELECT * FROM r WHERE rk = 1) r USING ({keys})"""


def _classified(df, keys):
    out = C.classify_text(df, "text")
    return out.select(*keys, "category", F.col("top_hits").cast("int").alias("top_hits"),
                      F.col("total_hits").cast("int").alias("total_hits"),
                      F.col("severity").cast("int").alias("severity"), "confidence",
                      F.array_join("matched", ", ").alias("matched"),
                      F.array_join("legal_sections", "; ").alias("legal_sections"), "civil_or_criminal",
                      "recommended_action")


@query("keyword_classify", classify_sql("conversations", "conv_id, turn"), ops="R1 R2 W6 J7 F10")
def keyword_classify(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return _classified(conv, ["conv_id", "turn"])


@query("document_classify_counts", f"""
WITH c AS ({classify_sql('documents', 'doc_id')})
SELECT category, severity, count(*)::BIGINT AS n, sum(top_hits)::BIGINT AS hits FROM c GROUP BY ALL""",
       ops="R1 R2 A1")
def document_classify_counts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    c = _classified(docs, ["doc_id"])
    return c.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum("top_hits").cast("bigint").alias("hits"))


@query("quick_classify", f"""
WITH c AS ({classify_sql('conversations', 'conv_id, turn', tie_severity=False)}),
j AS (SELECT c.category, v.role FROM c JOIN conversations v USING (conv_id, turn))
SELECT role, category, count(*)::BIGINT AS n FROM j GROUP BY ALL""", ops="R3")
def quick_classify(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = C.classify_text(conv, "text", tie="order")
    return c.groupBy("role", "category").agg(F.count(F.lit(1)).alias("n"))


def _word_sql(pattern: str) -> str:
    core = pattern.replace(r"\b", "")
    return sql_str(rf"(?i)(?:^|[^\pL\pN_])(?:{core})(?:[^\pL\pN_]|$)")


def _relation_sql(text: str, rules) -> str:
    cls = "[" + "".join("\\" + ch if ch in "[]\\^-" else ch for ch in X.TOKEN_PUNCT) + "]"
    toks = (f"list_transform(regexp_split_to_array(coalesce({text}, ''), {sql_str(X.WS_CLASS + '+')}), "
            f"lambda w: regexp_replace(w, {sql_str(rf'\A{cls}+|{cls}+\z')}, '', 'g'))")
    whens = " ".join(
        f"WHEN regexp_matches(coalesce({text}, ''), {_word_sql(en)}) OR list_has_any({toks}, {sql_list(bn)}) "
        f"THEN {sql_str(name)}" for name, en, bn in rules)
    return f"CASE {whens} END"


AGE_SQL = f"""CASE WHEN regexp_extract(translate(coalesce(text, ''), '{X.BANGLA_DIGITS}', '0123456789'),
                                     {sql_str(X.AGE_PATTERN)}, 1) <> ''
              AND TRY_CAST(regexp_extract(translate(coalesce(text, ''), '{X.BANGLA_DIGITS}', '0123456789'),
                                          {sql_str(X.AGE_PATTERN)}, 1) AS INTEGER) BETWEEN 30 AND 120
         THEN TRY_CAST(regexp_extract(translate(coalesce(text, ''), '{X.BANGLA_DIGITS}', '0123456789'),
                                      {sql_str(X.AGE_PATTERN)}, 1) AS INTEGER) END"""


@query("entity_extract", f"""
SELECT conv_id, turn, {AGE_SQL} AS age, {_relation_sql('text', X.VICTIM_RELATIONS)} AS victim_relation,
       {_relation_sql('text', X.ABUSER_RELATIONS)} AS abuser_relation
FROM conversations""", ops="S20 S21")
def entity_extract(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return C.extract_entities(conv, "text").select(
        "conv_id", "turn", F.col("age").cast("int").alias("age"), "victim_relation", "abuser_relation")


@query("entity_mentions", f"""
WITH e AS (SELECT {_relation_sql('text', X.VICTIM_RELATIONS)} AS victim_relation,
                  {_relation_sql('text', X.ABUSER_RELATIONS)} AS abuser_relation, {AGE_SQL} AS age FROM documents)
SELECT coalesce(victim_relation, 'none') AS victim_relation, coalesce(abuser_relation, 'none') AS abuser_relation,
       count(*)::BIGINT AS n, count(age)::BIGINT AS n_with_age FROM e GROUP BY ALL""", ops="S20 S21 A1")
def entity_mentions(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    e = C.extract_entities(docs, "text")
    return e.groupBy(F.coalesce("victim_relation", F.lit("none")).alias("victim_relation"),
                     F.coalesce("abuser_relation", F.lit("none")).alias("abuser_relation")).agg(
        F.count(F.lit(1)).alias("n"), F.count("age").alias("n_with_age"))


# -- model-response parsing and entity normalisation --------------------------------

RAW_SQL = """SELECT event_id, event_type, value, user_id,
  CASE WHEN event_type = 'error' THEN 'model says: ' || props || ' -- end' WHEN event_type = 'purchase' AND value > 45
       THEN 'no json here' ELSE props END AS raw,
  CASE event_type WHEN 'click' THEN 'self' WHEN 'view' THEN ' Third_Party ' WHEN 'signup' THEN 'garbage' END AS reporter_raw,
  CAST(CAST(floor(value * 4) AS BIGINT) AS VARCHAR) AS age_raw
FROM events"""


def raw_responses(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id", "props")
    raw = (F.when(F.col("event_type") == "error",
                  F.concat(F.lit("model says: "), F.col("props"), F.lit(" -- end")))
           .when((F.col("event_type") == "purchase") & (F.col("value") > 45), F.lit("no json here"))
           .otherwise(F.col("props")))
    rep = (F.when(F.col("event_type") == "click", "self").when(F.col("event_type") == "view", " Third_Party ")
           .when(F.col("event_type") == "signup", "garbage"))
    return ev.select("event_id", "event_type", "value", "user_id", raw.alias("raw"), rep.alias("reporter_raw"),
                     F.floor(F.col("value") * 4).cast("bigint").cast("string").alias("age_raw"))


GENDER_WORDS = ["male", "F", "মহিলা", "unknown", " Female "]


@query("json_fallback", f"""
WITH r AS ({RAW_SQL}),
p AS (SELECT *, CASE WHEN json_valid(raw) THEN raw
                     WHEN json_valid(regexp_extract(raw, '(?s)\\{{.*\\}}', 0)) THEN regexp_extract(raw, '(?s)\\{{.*\\}}', 0)
                END AS js FROM r),
k AS (SELECT *, TRY_CAST(json_extract_string(js, '$.k') AS INTEGER) AS k FROM p),
g AS (SELECT *, list_extract({sql_list(GENDER_WORDS)}, (coalesce(k, 0) % 5) + 1) AS gender_raw FROM k)
SELECT event_id, k, js IS NOT NULL AS parsed,
       coalesce(TRY_CAST(regexp_replace(CAST(k AS VARCHAR), {STRIP_SQL}, '', 'g') AS INTEGER), 2) AS severity,
       CASE WHEN lower(regexp_replace(coalesce(reporter_raw, ''), {STRIP_SQL}, '', 'g')) IN ('self', 'third_party', 'unknown')
            THEN lower(regexp_replace(coalesce(reporter_raw, ''), {STRIP_SQL}, '', 'g')) ELSE 'unknown' END AS reporter_type,
       CASE WHEN TRY_CAST(regexp_replace(age_raw, {STRIP_SQL}, '', 'g') AS INTEGER) BETWEEN 30 AND 120
            THEN TRY_CAST(regexp_replace(age_raw, {STRIP_SQL}, '', 'g') AS INTEGER) END AS victim_age,
       CASE WHEN lower(regexp_replace(coalesce(gender_raw, ''), {STRIP_SQL}, '', 'g')) IN {tuple(X.MALE_WORDS)} THEN 'Male'
            WHEN lower(regexp_replace(coalesce(gender_raw, ''), {STRIP_SQL}, '', 'g')) IN {tuple(X.FEMALE_WORDS)} THEN 'Female'
       END AS victim_gender
FROM g""", ops="S22 S23 S24")
def json_fallback(spark, sf_dir):
    r = raw_responses(spark, sf_dir)
    schema = Ty.StructType([Ty.StructField("k", Ty.StringType())])
    parsed = N.parse_json_fallback(F.col("raw"), schema)
    k = parsed["k"].try_cast("int")
    out = r.select("event_id", "reporter_raw", "age_raw", k.alias("k"), parsed.isNotNull().alias("parsed"))
    gender = F.element_at(F.array(*[F.lit(g) for g in GENDER_WORDS]),
                          (F.pmod(F.coalesce("k", F.lit(0)), F.lit(5)) + 1).cast("int"))
    raw_struct = F.struct(F.col("reporter_raw").alias("reporter_type"), F.col("age_raw").alias("victim_age"),
                          gender.alias("victim_gender"), F.lit(None).cast("string").alias("victim_name"),
                          F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("abuser_name"),
                          F.lit(None).cast("string").alias("abuser_relation"),
                          F.lit(None).cast("string").alias("incident_date"))
    ent = C.normalize_entities(raw_struct)
    return out.select("event_id", "k", "parsed",
                      N.int_or_default(F.col("k"), F.lit(2)).alias("severity"),
                      ent["reporter_type"].alias("reporter_type"), ent["victim_age"].alias("victim_age"),
                      ent["victim_gender"].alias("victim_gender"))
