"""Questionnaire scoring and dashboard plans.

Sessions are the users of ``events``; each user's answers are derived from
their events by fixed rules (the derivation is one SQL text that Spark and the
DuckDB oracle both run), then scored by the library operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.operators import classify as C
from corpusgauge.operators import assess as A
from corpusgauge.operators import reports as R
from corpusgauge.functions.text import STRIP_REGEX as T_STRIP
from corpusgauge.plans.registry import load, query, sql_list, sql_str

TYPE_CAT = [("click", "physical", "P"), ("view", "verbal", "V"), ("purchase", "financial", "F"),
            ("signup", "neglect", "N"), ("error", "abandonment", "A")]


def answer_spec():
    """(field, value expression, condition) over the per-user counts ``u``.

    The expressions are plain SQL understood by both Spark and DuckDB."""
    spec = [
        ("started", "'true'", "true"),
        ("reporter_type", "CASE WHEN session_id % 3 = 0 THEN 'third_party' ELSE 'self' END", "true"),
        ("is_elder", "'true'", "session_id % 11 <> 0"),
        ("gender", "CASE WHEN session_id % 4 = 0 THEN 'male' ELSE 'female' END", "session_id % 4 <> 2"),
        ("location", "'DIV_' || CAST(session_id % 8 AS STRING) || '|DST_' || CAST(session_id % 64 AS STRING)",
         "session_id % 5 <> 0"),
    ]
    any_sel = []
    for t, cat, p in TYPE_CAT:
        spec.append(("selected_categories", f"'{cat}'", f"n_{t} >= 13"))
        spec.append((f"{p}1", f"CASE WHEN n_{t} >= 15 THEN 'true' ELSE 'false' END", f"n_{t} >= 10"))
        spec.append((f"{p}2", f"CASE WHEN n_{t} % 2 = 0 THEN 'true' ELSE 'false' END", f"n_{t} >= 12"))
        any_sel.append(f"n_{t} >= 13")
    murder = "session_id % 3 = 0 AND n_error >= 16"
    spec += [
        ("selected_categories", "'murder'", murder),
        ("M1", "CASE WHEN n_error >= 18 THEN 'true' ELSE 'false' END", murder),
        ("selected_categories", "''", f"NOT ({' OR '.join(any_sel)} OR ({murder}))"),
        ("abuser_is_family", "CASE WHEN session_id % 2 = 0 THEN 'true' ELSE 'false' END", "session_id % 7 <> 0"),
        ("abuser_relation", "'son'", "session_id % 6 = 0"),
        ("ongoing", "CASE WHEN n_ev > 66 THEN 'true' ELSE 'false' END", "session_id % 10 <> 3"),
        ("needs_safe_place", "CASE WHEN n_error >= 19 THEN 'true' ELSE 'false' END", "session_id % 10 <> 7"),
        ("consent", "CASE WHEN session_id % 9 <> 0 THEN 'true' ELSE 'false' END", "true"),
    ]
    return spec


def _user_counts_sql(events: str) -> str:
    counts = ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS n_{t}" for t, _c, _p in TYPE_CAT)
    return f"SELECT user_id AS session_id, count(*) AS n_ev, {counts} FROM {events} GROUP BY user_id"


def _answers_sql(events: str) -> str:
    parts = [f"SELECT session_id, '{f}' AS field, {v} AS value FROM u WHERE {w}" for f, v, w in answer_spec()]
    return f"WITH u AS ({_user_counts_sql(events)}) SELECT session_id, field, value FROM (" + \
        " UNION ALL ".join(parts) + ") x"


def answers_frame(spark, sf_dir):
    """One aggregate of the events per user, then every answer row from one
    ``explode`` of (field, value, keep) structs -- a single scan."""
    events = load(spark, sf_dir, "events").select("user_id", "event_type")
    u = spark.sql(_user_counts_sql("{events}"), events=events)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.expr(v).cast("string").alias("value"),
                              F.expr(w).alias("keep")) for f, v, w in answer_spec()])
    return (u.select("session_id", F.explode(rows).alias("r"))
            .filter(F.col("r.keep")).select("session_id", "r.field", "r.value"))


ANSWERS_CTE = f"a AS ({_answers_sql('events')})"

CATS_VALUES = ", ".join(f"({sql_str(c)}, {i}, {sev}, {sql_list(laws)})"
                        for i, (c, sev, laws, _t) in enumerate(X.BANK_CATEGORIES))
FU_VALUES = ", ".join(f"({sql_str(q)}, {sql_str(c)}, {i}, {str(e).lower()}, {str(m).lower()}, "
                      f"{sql_str(X.EMERGENCY_ACTIONS.get(q, ''))})"
                      for i, (q, c, e, m) in enumerate(X.BANK_FOLLOWUPS))
RISK_LABELS_SQL = sql_list([X.RISK_LABELS[i] for i in range(1, 6)])

ASSESS_CTE = f"""{ANSWERS_CTE},
cats(category, cat_ord, severity, laws) AS (VALUES {CATS_VALUES}),
fu(qid, category, q_ord, escalates, emergency, action) AS (VALUES {FU_VALUES}),
sel AS (SELECT session_id, value AS category FROM a WHERE field = 'selected_categories'),
asked AS (SELECT a.session_id, fu.*, lower(a.value) = 'true' AS yes FROM a JOIN fu ON a.field = fu.qid
          JOIN sel ON sel.session_id = a.session_id AND sel.category = fu.category),
pc AS (SELECT session_id, category, count(*) AS n_asked, count(*) FILTER (WHERE yes) AS n_yes,
              bool_or(yes AND escalates) AS esc, bool_or(yes AND emergency) AS emg,
              list(action ORDER BY q_ord) FILTER (WHERE yes AND emergency AND action <> '') AS acts
       FROM asked GROUP BY ALL),
pcc AS (SELECT pc.*, cats.cat_ord, cats.severity, cats.laws FROM pc JOIN cats USING (category)),
ps AS (SELECT session_id, sum(n_asked) AS n_asked, sum(n_yes) AS n_yes,
              max(severity) FILTER (WHERE n_yes > 0) AS severity, bool_or(esc) AS escalated, bool_or(emg) AS emg_fu,
              list(category ORDER BY cat_ord) FILTER (WHERE n_yes > 0) AS confirmed,
              flatten(list(laws ORDER BY cat_ord) FILTER (WHERE n_yes > 0)) AS laws_all,
              flatten(list(acts ORDER BY cat_ord) FILTER (WHERE acts IS NOT NULL)) AS acts_all
       FROM pcc GROUP BY session_id),
fl AS (SELECT session_id, bool_or(lower(value) = 'true') FILTER (WHERE field = 'ongoing') AS ongoing,
              bool_or(lower(value) = 'true') FILTER (WHERE field = 'needs_safe_place') AS safe_place,
              bool_or(lower(value) = 'true') FILTER (WHERE field = 'abuser_is_family') AS family
       FROM a GROUP BY session_id),
j AS (SELECT s.session_id, ps.*, fl.ongoing, fl.safe_place, fl.family,
             coalesce(len(ps.confirmed), 0) AS n_conf, coalesce(ps.severity, 0) AS sev,
             coalesce(ps.emg_fu, false) OR coalesce(fl.safe_place, false) AS emergency
      FROM (SELECT DISTINCT session_id FROM a) s LEFT JOIN ps USING (session_id) LEFT JOIN fl USING (session_id)),
asm AS (SELECT session_id, coalesce(confirmed, []) AS confirmed, sev AS severity,
               CASE WHEN n_conf = 0 THEN 1 WHEN emergency THEN 5
                    ELSE greatest(1, least(sev + CAST(coalesce(escalated, false) AS INTEGER)
                                              + CAST(coalesce(ongoing, false) AS INTEGER), 4)) END AS risk_level,
               round_even(least(CASE WHEN coalesce(n_asked, 0) = 0 THEN 0.0 WHEN coalesce(n_yes, 0) = 0 THEN 0.30
                                     ELSE 0.55 + 0.45 * n_yes / n_asked END, 0.98), 2) AS confidence,
               emergency,
               list_concat(coalesce(acts_all, []),
                           CASE WHEN coalesce(safe_place, false) THEN [{sql_str(X.SAFE_PLACE_ACTION)}] ELSE [] END) AS acts,
               coalesce(laws_all, []) AS laws_all, coalesce(family, false) AS trust_blind_spot
        FROM j)"""


@query("assess_sessions", f"""
WITH {ASSESS_CTE}
SELECT session_id, array_to_string(confirmed, ',') AS confirmed, severity::INTEGER AS severity,
       risk_level::INTEGER AS risk_level, list_extract({RISK_LABELS_SQL}, risk_level) AS risk_label,
       confidence, emergency, array_to_string(acts, ' | ') AS emergency_actions,
       array_to_string(list_filter(laws_all, lambda x, i: list_position(laws_all, x) = i), '; ') AS laws,
       trust_blind_spot
FROM asm""", ops="R4 R5 U4")
def assess_sessions(spark, sf_dir):
    a = A.assess(answers_frame(spark, sf_dir))
    return a.select("session_id", F.array_join("confirmed_categories", ",").alias("confirmed"),
                    F.col("severity").cast("int").alias("severity"), F.col("risk_level").cast("int").alias("risk_level"),
                    "risk_label", "confidence", "emergency",
                    F.array_join("emergency_actions", " | ").alias("emergency_actions"),
                    F.array_join("laws", "; ").alias("laws"), "trust_blind_spot")


SCREENS_VALUES = ", ".join(
    f"({o}, {sql_str(s)}, {sql_str(f)}, {sql_str(t)}, {sql_str(c) if c else 'NULL'}, "
    f"{sql_str(sf) if sf else 'NULL'}, {sql_str(sv) if sv else 'NULL'})"
    for o, s, f, t, c, sf, sv in A.screen_rows())

SEQ_CTE = f"""{ANSWERS_CTE},
scr(ord, screen_id, field, type, category, show_field, show_value) AS (VALUES {SCREENS_VALUES}),
ss AS (SELECT DISTINCT session_id FROM a),
seq AS (SELECT ss.session_id, scr.* FROM ss, scr
        WHERE (scr.category IS NULL AND scr.show_field IS NULL)
           OR (scr.category IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.session_id = ss.session_id
                   AND a.field = 'selected_categories' AND a.value = scr.category))
           OR (scr.show_field IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.session_id = ss.session_id
                   AND a.field = scr.show_field AND lower(a.value) = scr.show_value))),
sa AS (SELECT seq.*, EXISTS (SELECT 1 FROM a WHERE a.session_id = seq.session_id AND a.field = seq.field) AS answered
       FROM seq)"""


@query("progress", f"""
WITH {SEQ_CTE},
p AS (SELECT session_id, count(*) AS total, count(*) FILTER (WHERE answered) AS current FROM sa
      WHERE type <> 'welcome' GROUP BY session_id),
q AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE round_even(current / total * 100, 0) END::INTEGER AS percent FROM p)
SELECT session_id, total::BIGINT AS total, current::BIGINT AS current, percent,
       repeat('█', round_even(percent / 10.0, 0)::INTEGER) || repeat('░', 10 - round_even(percent / 10.0, 0)::INTEGER) AS bar
FROM q""", ops="R6 F9")
def progress(spark, sf_dir):
    p = A.progress(answers_frame(spark, sf_dir))
    return p.select("session_id", F.col("total").cast("bigint").alias("total"),
                    F.col("current").cast("bigint").alias("current"), "percent", "bar")


@query("next_screen", f"""
WITH {SEQ_CTE},
o AS (SELECT session_id, arg_min(screen_id, ord) AS next_screen FROM sa WHERE NOT answered GROUP BY session_id)
SELECT ss.session_id, coalesce(o.next_screen, 'complete') AS next_screen FROM ss LEFT JOIN o USING (session_id)""",
       ops="R7 W7 F9")
def next_screen(spark, sf_dir):
    return A.next_screen(answers_frame(spark, sf_dir))


def reports_frame(spark, sf_dir):
    ans = answers_frame(spark, sf_dir)
    recs = R.dashboard_records(ans, A.assess(ans))
    created = (load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
               .select(F.col("user_id").cast("string").alias("id"), "created_at"))
    ok, _rejected = R.consent_gate(recs.join(created, "id"))
    return R.sanitize(ok)


@query("dashboard", f"""
WITH {ASSESS_CTE},
rec AS (SELECT asm.session_id, asm.confirmed AS abuse_types, asm.risk_level,
               max(CASE WHEN a.field = 'gender' THEN a.value END) AS gender,
               nullif(split_part(max(CASE WHEN a.field = 'location' THEN a.value END), '|', 2), '') AS district,
               max(CASE WHEN a.field = 'abuser_is_family' THEN lower(a.value) END) AS fam,
               max(CASE WHEN a.field = 'consent' THEN lower(a.value) END) AS consent
        FROM asm JOIN a USING (session_id) GROUP BY asm.session_id, asm.confirmed, asm.risk_level),
cr AS (SELECT user_id AS session_id, min(ts) AS created_at FROM events GROUP BY user_id),
r AS (SELECT rec.*, cr.created_at FROM rec JOIN cr USING (session_id) WHERE consent = 'true')
SELECT 'total' AS metric, 'all' AS key, count(*)::BIGINT AS n FROM r
UNION ALL SELECT 'gender', coalesce(gender, 'unknown'), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'district', district, count(*) FROM r WHERE district IS NOT NULL AND district <> '' GROUP BY 2
UNION ALL SELECT 'risk_level', CAST(risk_level AS VARCHAR), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'family_vs_non', CASE fam WHEN 'true' THEN 'family' ELSE 'non_family' END, count(*) FROM r
          WHERE fam IN ('true', 'false') GROUP BY 2
UNION ALL SELECT 'monthly_trend', strftime(created_at, '%Y-%m'), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'abuse_type', t, count(*) FROM (SELECT unnest(abuse_types) AS t FROM r) GROUP BY 2""",
       ops="A17 A16 F7 S30 S31")
def dashboard(spark, sf_dir):
    return R.dashboard_stats(reports_frame(spark, sf_dir))


# -- complaint records, work lists, lookups ------------------------------------------

def _bn_case_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in X.ABUSE_TYPE_BN.items())
    return f"CASE lower({expr}) {whens} ELSE {expr} END"


def _list_case_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_list(v)}" for k, v in X.LEGAL_SECTIONS.items() if v)
    return f"CASE {expr} {whens} ELSE []::VARCHAR[] END"


@query("complaint_records", f"""
WITH {ASSESS_CTE},
cr AS (SELECT user_id AS session_id, min(ts) AS created_at FROM events GROUP BY user_id),
ag AS (SELECT session_id, max(CASE WHEN field = 'gender' THEN value END) AS gender,
              max(CASE WHEN field = 'location' THEN value END) AS loc,
              max(CASE WHEN field = 'reporter_type' THEN value END) AS reporter_type,
              max(CASE WHEN field = 'consent' THEN lower(value) END) AS consent FROM a GROUP BY session_id),
r AS (SELECT asm.session_id, array_to_string(asm.confirmed, ', ') AS abuse_type, asm.risk_level, cr.created_at,
             asm.severity, asm.confirmed, coalesce(ag.reporter_type, 'unknown') AS reporter_type,
             ag.gender, nullif(split_part(ag.loc, '|', 2), '') AS district
      FROM asm JOIN cr USING (session_id) JOIN ag USING (session_id) WHERE ag.consent = 'true'),
t AS (SELECT *, list_filter(list_transform(string_split(abuse_type, ','),
                                           lambda p: regexp_replace(p, {sql_str(T_STRIP)}, '', 'g')),
                            lambda p: length(p) > 0) AS parts FROM r)
SELECT session_id,
       'EA-' || strftime(created_at, '%Y') || '-' || strftime(created_at, '%m%d') || '-' ||
         upper(substr(sha256(CAST(session_id AS VARCHAR)), 1, 4)) AS case_ref,
       CASE WHEN abuse_type = '' THEN ''
            ELSE array_to_string(list_transform(parts, lambda p: {_bn_case_sql('p')}), ' ও ') || ' (' || abuse_type || ')'
       END AS abuse_type_bn,
       translate(CAST(risk_level AS VARCHAR), '0123456789', '{X.BANGLA_DIGITS}') AS risk_bn,
       CASE WHEN gender IS NULL OR length(regexp_replace(gender, {sql_str(T_STRIP)}, '', 'g')) = 0
            THEN {sql_str(X.PLACEHOLDER)} ELSE gender END AS gender,
       CASE WHEN district IS NULL OR length(regexp_replace(district, {sql_str(T_STRIP)}, '', 'g')) = 0
            THEN {sql_str(X.PLACEHOLDER)} ELSE district END AS district,
       severity::INTEGER AS severity, reporter_type,
       array_to_string(flatten(list_transform(confirmed, lambda c: {_list_case_sql('c')})), '; ') AS applicable_sections,
       CASE confirmed[1] {' '.join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in X.CIVIL_OR_CRIMINAL.items())}
            ELSE 'Unknown' END AS civil_or_criminal
FROM t""", ops="S25 S26 S27 S28 S29 S31")
def complaint_records(spark, sf_dir):
    from corpusgauge.functions import normalize as N
    ans = answers_frame(spark, sf_dir)
    asm = A.assess(ans)
    recs = R.dashboard_records(ans, asm)
    created = (load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
               .select(F.col("user_id").cast("string").alias("id"), "created_at"))
    ok, _ = R.consent_gate(recs.join(created, "id"))
    abuse = F.array_join("abuse_types", ", ")
    return ok.select(
        F.col("id").cast("bigint").alias("session_id"),
        N.case_reference(F.col("id"), F.col("created_at")).alias("case_ref"),
        N.translate_list(abuse, X.ABUSE_TYPE_BN).alias("abuse_type_bn"),
        N.ascii_to_bangla_digits(F.col("risk_level")).alias("risk_bn"),
        N.placeholder(F.col("gender"), X.PLACEHOLDER).alias("gender"),
        N.placeholder(F.col("district"), X.PLACEHOLDER).alias("district"),
        F.col("severity").cast("int").alias("severity"), F.coalesce("reporter_type", F.lit("unknown")).alias("reporter_type"),
        F.array_join(F.flatten(F.transform("abuse_types", C.legal_sections)), "; ").alias("applicable_sections"),
        N.map_default(F.try_element_at("abuse_types", F.lit(1)), X.CIVIL_OR_CRIMINAL, "Unknown").alias("civil_or_criminal"))


@query("district_lookup", f"""
WITH {ANSWERS_CTE},
l AS (SELECT DISTINCT split_part(value, '|', 1) AS division, split_part(value, '|', 2) AS district
      FROM a WHERE field = 'location')
SELECT division, count(*)::BIGINT AS n_districts, string_agg(district, ',' ORDER BY district) AS districts
FROM l GROUP BY division""", ops="J16")
def district_lookup(spark, sf_dir):
    ans = answers_frame(spark, sf_dir).filter(F.col("field") == "location")
    loc = ans.select(F.split_part("value", F.lit("|"), F.lit(1)).alias("division"),
                     F.split_part("value", F.lit("|"), F.lit(2)).alias("district")).distinct()
    # one division's districts are bounded by the dimension (64 in the source bank)
    return loc.groupBy("division").agg(
        F.count(F.lit(1)).alias("n_districts"),
        F.array_join(F.sort_array(F.collect_list("district")), ",").alias("districts"))


VOICE, RATE = "bn-BD-female", "+0%"


@query("tts_worklist", f"""
WITH t AS (SELECT turn, substr(sha256('{VOICE}|{RATE}|' || text), 1, 32) AS key, text
           FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
cache AS (SELECT DISTINCT key FROM t WHERE turn < 2)
SELECT key, min(length(text))::BIGINT AS n_chars FROM t WHERE key NOT IN (SELECT key FROM cache) GROUP BY key""",
       ops="S36 J15")
def tts_worklist(spark, sf_dir):
    from corpusgauge.functions import normalize as N
    conv = load(spark, sf_dir, "conversations").filter((F.col("role") == "assistant") & F.col("text").isNotNull())
    keyed = conv.select("turn", N.content_key(VOICE, RATE, F.col("text")).alias("key"), "text")
    cache = keyed.filter(F.col("turn") < 2).select("key").distinct()
    todo = keyed.join(cache, "key", "left_anti")
    return todo.groupBy("key").agg(F.min(F.length("text")).cast("bigint").alias("n_chars"))


@query("rule_model_merge", """
WITH e AS (SELECT event_id, event_type,
             CASE WHEN event_type = 'error' THEN 'model says: ' || props || ' -- end'
                  WHEN event_type = 'purchase' AND value > 45 THEN 'no json here' ELSE props END AS raw FROM events),
p AS (SELECT *, CASE WHEN json_valid(raw) THEN raw
                     WHEN json_valid(regexp_extract(raw, '(?s)\\{.*\\}', 0)) THEN regexp_extract(raw, '(?s)\\{.*\\}', 0)
                END AS js FROM e),
m AS (SELECT *, TRY_CAST(json_extract_string(js, '$.k') AS INTEGER) % 6 AS ms,
             CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 2
                             WHEN 'error' THEN 3 END AS rule_sev FROM p),
f AS (SELECT event_type, CASE WHEN ms BETWEEN 1 AND 5 THEN ms END AS model_sev, rule_sev FROM m)
SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE model_sev IS NULL)::BIGINT AS n_degraded,
       sum(coalesce(model_sev, rule_sev))::BIGINT AS severity_sum FROM f GROUP BY event_type""", ops="J17 S23 S24")
def rule_model_merge(spark, sf_dir):
    from pyspark.sql import types as Ty

    from corpusgauge.functions import normalize as N
    from corpusgauge.plans.classify_plans import raw_responses
    r = raw_responses(spark, sf_dir)
    parsed = N.parse_json_fallback(F.col("raw"), Ty.StructType([Ty.StructField("k", Ty.StringType())]))
    ms = F.pmod(parsed["k"].try_cast("int"), F.lit(6))
    model = r.select("event_id", F.when(ms.between(1, 5), ms).alias("model_sev"))
    sev = {t: X.SEVERITY[c] for t, c, _p in TYPE_CAT}
    rule = r.select("event_id", "event_type", N.map_default(F.col("event_type"), sev, 1).alias("rule_sev"))
    # rule result left-joined with the model result; fall back to the rules (degraded)
    j = rule.join(model, "event_id", "left")
    return j.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("model_sev").isNull()).alias("n_degraded"),
        F.sum(N.int_or_default(F.col("model_sev"), F.col("rule_sev"))).cast("bigint").alias("severity_sum"))


def _map_case(expr: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


_P = X.SUMMARY_PHRASES
_YN = lambda e: f"CASE WHEN lower({e}) = 'true' THEN {sql_str(_P['yes'])} ELSE {sql_str(_P['no'])} END"
FU_TEXT_VALUES = ", ".join(
    f"({sql_str(q)}, {sql_str(c)}, {i}, {[k for k, *_ in X.BANK_CATEGORIES].index(c)}, {sql_str(X.FOLLOWUP_TEXT_BN[q])})"
    for i, (q, c, _e, _m) in enumerate(X.BANK_FOLLOWUPS))
CAT_LABEL_VALUES = ", ".join(f"({sql_str(c)}, {i}, {sql_str(X.CATEGORY_LABELS_BN[c])})"
                             for i, (c, *_r) in enumerate(X.BANK_CATEGORIES))


@query("answer_summaries", f"""
WITH {ANSWERS_CTE},
fu(qid, category, q_ord, cat_ord, text_bn) AS (VALUES {FU_TEXT_VALUES}),
cat(category, cat_ord, label) AS (VALUES {CAT_LABEL_VALUES}),
sel AS (SELECT session_id, value AS category FROM a WHERE field = 'selected_categories' AND value <> ''),
fr AS (SELECT a.session_id, fu.cat_ord, fu.q_ord, fu.category, '  - ' || fu.text_bn || ' → ' || {_YN('a.value')} AS line
       FROM a JOIN fu ON a.field = fu.qid JOIN sel ON sel.session_id = a.session_id AND sel.category = fu.category),
fr2 AS (SELECT fr.*, cat.label, lag(fr.category) OVER (PARTITION BY session_id ORDER BY fr.cat_ord, q_ord) AS prev
        FROM fr JOIN cat USING (category)),
blk AS (SELECT session_id, flatten(list(CASE WHEN prev IS NULL OR prev <> category THEN ['', label || ':', line]
                                             ELSE [line] END ORDER BY cat_ord, q_ord)) AS lines FROM fr2 GROUP BY session_id),
sc AS (SELECT a.session_id,
              max(CASE WHEN field = 'reporter_type' THEN value END) AS rep,
              bool_or(field = 'is_elder') AS has_elder, max(CASE WHEN field = 'is_elder' THEN value END) AS elder,
              max(CASE WHEN field = 'gender' THEN value END) AS gender,
              max(CASE WHEN field = 'location' THEN value END) AS loc,
              list(cat.label ORDER BY cat.cat_ord) FILTER (WHERE cat.label IS NOT NULL) AS sel_names,
              bool_or(field = 'selected_categories' AND value <> '') AS any_sel,
              max(CASE WHEN field = 'abuser_is_family' THEN value END) AS fam,
              max(CASE WHEN field = 'abuser_relation' THEN value END) AS rel,
              max(CASE WHEN field = 'ongoing' THEN value END) AS ong,
              max(CASE WHEN field = 'needs_safe_place' THEN value END) AS safe,
              regexp_replace(coalesce(max(CASE WHEN field = 'extra_detail' THEN value END), ''), {sql_str(T_STRIP)}, '', 'g') AS extra
       FROM a LEFT JOIN cat ON a.field = 'selected_categories' AND a.value = cat.category GROUP BY a.session_id),
x AS (SELECT sc.*, split_part(coalesce(loc, ''), '|', 2) AS district, split_part(coalesce(loc, ''), '|', 1) AS division,
             CASE WHEN coalesce(rel, '') = '' THEN '' ELSE {_map_case('rel', X.RELATION_LABELS_BN, 'rel')} END AS rel_bn,
             blk.lines AS blines FROM sc LEFT JOIN blk USING (session_id)),
l AS (SELECT session_id, list_filter(list_concat(
        [{sql_str(_P['reporter'])} || {_map_case('rep', {'self': _P['self'], 'third_party': _P['third_party']}, sql_str(_P['unknown']))},
         CASE WHEN has_elder AND elder IS NOT NULL THEN {sql_str(_P['elder'])} || {_YN('elder')} END,
         CASE WHEN coalesce(gender, '') <> '' THEN {sql_str(_P['victim'])} || {_map_case('gender', X.GENDER_LABELS_BN, sql_str(_P['unknown']))} END,
         CASE WHEN district <> '' THEN regexp_replace({sql_str(_P['area'])} || district || ', ' || division, '\\A[, ]+|[, ]+\\z', '', 'g') END],
        CASE WHEN coalesce(any_sel, false) THEN ['', {sql_str(_P['selected'])} || array_to_string(coalesce(sel_names, []), ', ')] ELSE [] END,
        coalesce(blines, []),
        ['', CASE WHEN fam IS NOT NULL THEN {sql_str(_P['abuser'])} ||
                  CASE WHEN lower(fam) = 'true' THEN {sql_str(_P['family'])} ELSE {sql_str(_P['non_family'])} END ||
                  CASE WHEN rel_bn <> '' THEN ' — ' || rel_bn ELSE '' END END,
         CASE WHEN ong IS NOT NULL THEN {sql_str(_P['ongoing'])} || {_YN('ong')} END,
         CASE WHEN safe IS NOT NULL THEN {sql_str(_P['safe_place'])} || {_YN('safe')} END],
        CASE WHEN extra <> '' THEN ['', {sql_str(_P['extra'])} || extra] ELSE [] END), lambda v: v IS NOT NULL) AS lines
      FROM x)
SELECT session_id, array_to_string(lines, chr(10)) AS summary, len(lines)::INTEGER AS n_lines FROM l""", ops="S32")
def answer_summaries(spark, sf_dir):
    return A.summary_text(answers_frame(spark, sf_dir))
