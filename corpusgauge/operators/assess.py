"""Rule scoring of questionnaire sessions.

Answers are a long table ``(session_id, field, value)`` -- one row per answered
field (``selected_categories`` has one row per selected category, '' for an
explicit empty choice).  Every operator is a join of the answers with a small
question-bank dimension (broadcast, a few rows) followed by a group-by on
``session_id``; per-session groups are bounded by the number of questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions.normalize import map_or_null
from corpusgauge.functions.text import ustrip


def bank_categories(spark) -> DataFrame:
    rows = [(c, i, sev, laws, tpo) for i, (c, sev, laws, tpo) in enumerate(X.BANK_CATEGORIES)]
    return spark.createDataFrame(
        rows, "category string, cat_ord int, severity int, laws array<string>, third_party_only boolean")


def bank_followups(spark) -> DataFrame:
    rows = [(q, c, i, esc, emg, X.EMERGENCY_ACTIONS.get(q, ""))
            for i, (q, c, esc, emg) in enumerate(X.BANK_FOLLOWUPS)]
    return spark.createDataFrame(
        rows, "qid string, category string, q_ord int, escalates boolean, emergency boolean, action string")


def _truthy(col):
    return F.lower(F.col(col)) == "true"


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


QIDS = [q for q, *_r in X.BANK_FOLLOWUPS]
CATEGORIES = [c for c, *_r in X.BANK_CATEGORIES]


def session_profile(answers: DataFrame) -> DataFrame:
    """One row per session with everything the rules read -- the only shuffle.

    ``sel`` (selected categories), ``fu`` (answered follow-ups as
    (q_ord, qid, yes)), ``fields`` (answered keys) and the three yes/no flags;
    every array is bounded by the question bank."""
    q_ord = _lit_map({q: i for i, q in enumerate(QIDS)})
    f = F.col("field")
    return answers.groupBy("session_id").agg(
        F.collect_set(F.when((f == "selected_categories") & (F.col("value") != ""), F.col("value"))).alias("sel"),
        F.array_sort(F.collect_list(F.when(f.isin(QIDS), F.struct(
            F.element_at(q_ord, f).alias("q_ord"), f.alias("qid"), _truthy("value").alias("yes"))))).alias("fu"),
        F.collect_set(f).alias("fields"),
        F.max(F.when(f == "ongoing", _truthy("value"))).alias("ongoing"),
        F.max(F.when(f == "needs_safe_place", _truthy("value"))).alias("safe_place"),
        F.max(F.when(f == "abuser_is_family", _truthy("value"))).alias("family"),
        F.max(F.when(f == "abuser_is_family", F.lower("value"))).alias("_fam_value"))


def assess(answers: DataFrame) -> DataFrame:
    """R4 + R5: per session confirmed categories, severity, risk level and label,
    confidence, emergency flag and actions, laws (ordered, de-duplicated) and
    the trust-blind-spot flag.

    One group-by on the session (:func:`session_profile`); the rules are array
    expressions over that session's bounded follow-up list, with the bank as
    map literals (no join, no further shuffle)."""
    q_cat = _lit_map({q: c for q, c, _e, _m in X.BANK_FOLLOWUPS})
    q_esc = _lit_map({q: e for q, _c, e, _m in X.BANK_FOLLOWUPS})
    q_emg = _lit_map({q: m for q, _c, _e, m in X.BANK_FOLLOWUPS})
    q_act = _lit_map({q: X.EMERGENCY_ACTIONS.get(q, "") for q in QIDS})
    c_sev = _lit_map({c: sev for c, sev, _l, _t in X.BANK_CATEGORIES})
    c_laws = F.create_map(*[x for c, _s, laws, _t in X.BANK_CATEGORIES
                            for x in (F.lit(c), F.array(*[F.lit(v) for v in laws]))])
    prof = session_profile(answers)
    asked = F.filter("fu", lambda x: F.array_contains(F.col("sel"), F.element_at(q_cat, x["qid"])))
    j = (prof.withColumn("_asked", asked).withColumn("_yes", F.filter("_asked", lambda x: x["yes"]))
         .withColumn("_conf", F.filter(F.array(*[F.lit(c) for c in CATEGORIES]),
                                       lambda c: F.exists("_yes", lambda x: F.element_at(q_cat, x["qid"]) == c))))
    n_conf = F.size("_conf")
    sev = F.coalesce(F.array_max(F.transform("_conf", lambda c: F.element_at(c_sev, c))), F.lit(0))
    escalated = F.exists("_yes", lambda x: F.element_at(q_esc, x["qid"]))
    emg_fu = F.exists("_yes", lambda x: F.element_at(q_emg, x["qid"]))
    emergency = emg_fu | F.coalesce(F.col("safe_place"), F.lit(False))
    raw_risk = sev + escalated.cast("int") + F.coalesce(F.col("ongoing"), F.lit(False)).cast("int")
    risk = (F.when(n_conf == 0, F.lit(1)).when(emergency, F.lit(5))
            .otherwise(F.greatest(F.lit(1), F.least(raw_risk, F.lit(4)))))
    n_asked = F.size("_asked")
    n_yes = F.size("_yes")
    conf = (F.when(n_asked == 0, F.lit(0.0)).when(n_yes == 0, F.lit(0.30))
            .otherwise(F.lit(0.55) + F.lit(0.45) * n_yes / n_asked))
    conf = F.bround(F.least(conf, F.lit(0.98)), 2)
    acts = F.transform(F.filter("_yes", lambda x: F.element_at(q_emg, x["qid"])),
                       lambda x: F.element_at(q_act, x["qid"]))
    acts = F.concat(acts, F.when(F.coalesce(F.col("safe_place"), F.lit(False)),
                                 F.array(F.lit(X.SAFE_PLACE_ACTION))).otherwise(F.array().cast("array<string>")))
    risk_label = F.element_at(F.array(*[F.lit(X.RISK_LABELS[i]) for i in range(1, 6)]), risk)
    return j.select(
        "session_id", F.col("_conf").alias("confirmed_categories"),
        sev.alias("severity"), risk.alias("risk_level"), risk_label.alias("risk_label"),
        conf.alias("confidence"), emergency.alias("emergency"),
        F.filter(acts, lambda a: a != "").alias("emergency_actions"),
        F.array_distinct(F.flatten(F.transform("_conf", lambda c: F.element_at(c_laws, c)))).alias("laws"),
        F.coalesce(F.col("family"), F.lit(False)).alias("trust_blind_spot"))


def screen_rows():
    """Static screen sequence as (ord, screen_id, field, type, category, show_field, show_value)."""
    rows = []
    for i, (sid, field, typ) in enumerate(X.INTRO_SCREENS):
        rows.append((i, sid, field, typ, None, None, None))
    for i, (qid, cat, _e, _m) in enumerate(X.BANK_FOLLOWUPS):
        rows.append((100 + i, qid, qid, "yes_no", cat, None, None))
    for i, (sid, field, typ, sf, sv) in enumerate(X.CLOSING_SCREENS):
        rows.append((200 + i, sid, field, typ, None, sf, sv))
    return rows


def _screens_literal() -> Column:
    return F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(s).alias("screen_id"), F.lit(f).alias("field"),
                              F.lit(t).alias("type"), F.lit(c).cast("string").alias("category"),
                              F.lit(sf).cast("string").alias("show_field"),
                              F.lit(sv).cast("string").alias("show_value"))
                     for o, s, f, t, c, sf, sv in screen_rows()])


def _sequence(prof: DataFrame) -> DataFrame:
    """per session the applicable screens (bank order) with an answered flag,
    as one array: static screens, follow-ups of selected categories, and the
    closing screens whose show-if answer matches.  Only abuser_is_family is a
    show-if field in the bank, so its value is carried in the profile."""
    show_vals = F.create_map(F.lit("abuser_is_family"), F.col("_fam_value"))
    seq = F.filter(_screens_literal(), lambda s: (
        (s["category"].isNull() & s["show_field"].isNull())
        | (s["category"].isNotNull() & F.array_contains(F.col("sel"), s["category"]))
        | (s["show_field"].isNotNull()
           & F.coalesce(F.element_at(show_vals, s["show_field"]) == s["show_value"], F.lit(False)))))
    return prof.withColumn("_seq", F.transform(seq, lambda s: s.withField(
        "answered", F.array_contains(F.col("fields"), s["field"]))))


def applicable_screens(answers: DataFrame) -> DataFrame:
    """F9 as rows: (session_id, ord, screen_id, field, type, category, answered)."""
    seq = _sequence(session_profile(answers))
    return seq.select("session_id", F.explode("_seq").alias("s")).select("session_id", "s.*")


def progress(answers: DataFrame) -> DataFrame:
    """Answered / applicable screens (welcome not counted), percent
    (half-even) and a 10-block bar -- array logic over one session profile."""
    seq = _sequence(session_profile(answers))
    counted = F.filter("_seq", lambda s: s["type"] != "welcome")
    p = seq.select("session_id", F.size(counted).alias("total"),
                   F.size(F.filter(counted, lambda s: s["answered"])).alias("current"))
    pct = F.when(F.col("total") == 0, F.lit(0)).otherwise(
        F.bround(F.col("current") / F.col("total") * 100, 0)).cast("int")
    filled = F.bround(F.col("percent") / 10.0, 0).cast("int")
    return (p.withColumn("percent", pct)
            .withColumn("bar", F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), 10 - filled))))


def next_screen(answers: DataFrame) -> DataFrame:
    """First applicable screen without an answer; none left -> 'complete'."""
    seq = _sequence(session_profile(answers))
    first_open = F.try_element_at(F.filter("_seq", lambda s: ~s["answered"]), F.lit(1))["screen_id"]
    return seq.select("session_id", F.coalesce(first_open, F.lit("complete")).alias("next_screen"))


def summary_text(answers: DataFrame) -> DataFrame:
    """The ordered Bangla summary of a session's answers, missing parts skipped.

    One aggregate per session for the scalar answers, plus the answered
    follow-ups of the selected categories (a join with the follow-up dimension
    and the selection) collected in bank order -- bounded by the bank size.
    Selected categories are listed in bank order."""
    spark = answers.sparkSession
    P = X.SUMMARY_PHRASES
    fu = F.broadcast(bank_followups(spark).join(bank_categories(spark).select("category", "cat_ord"), "category"))
    selected = (answers.filter((F.col("field") == "selected_categories") & (F.col("value") != ""))
                .select("session_id", F.col("value").alias("category")))
    fu_rows = (answers.join(fu, answers.field == fu.qid).join(selected, ["session_id", "category"], "left_semi")
               .select("session_id", "cat_ord", "q_ord", "category", "qid", "value"))

    def yn(c):
        return F.when(F.lower(c) == "true", P["yes"]).otherwise(P["no"])

    fu_lines = fu_rows.select(
        "session_id", F.struct("cat_ord", "q_ord", F.col("category").alias("cat"),
                               F.concat(F.lit("  - "), map_or_null(F.col("qid"), X.FOLLOWUP_TEXT_BN), F.lit(" → "),
                                        yn(F.col("value"))).alias("line")).alias("s"))
    fu_agg = fu_lines.groupBy("session_id").agg(F.sort_array(F.collect_list("s")).alias("_fu"))

    def val(f):
        return F.max(F.when(F.col("field") == f, F.col("value")))

    def has(f):
        return F.max(F.when(F.col("field") == f, F.lit(True)))

    cat_ord = F.coalesce(*[F.when(F.col("value") == c, F.lit(i)) for i, (c, *_r) in enumerate(X.BANK_CATEGORIES)])
    scal = answers.groupBy("session_id").agg(
        val("reporter_type").alias("rep"), has("is_elder").alias("has_elder"), val("is_elder").alias("elder"),
        val("gender").alias("gender"), val("location").alias("loc"),
        F.sort_array(F.collect_list(F.when((F.col("field") == "selected_categories") & cat_ord.isNotNull(),
                                           F.struct(cat_ord.alias("o"), F.col("value").alias("c"))))).alias("_sel"),
        F.max((F.col("field") == "selected_categories") & (F.col("value") != "")).alias("any_sel"),
        val("abuser_is_family").alias("fam"), val("abuser_relation").alias("rel"),
        val("ongoing").alias("ong"), val("needs_safe_place").alias("safe"), val("extra_detail").alias("extra"))
    j = scal.join(fu_agg, "session_id", "left")
    rep = (F.when(F.col("rep") == "self", P["self"]).when(F.col("rep") == "third_party", P["third_party"])
           .otherwise(P["unknown"]))
    district = F.split_part(F.coalesce("loc", F.lit("")), F.lit("|"), F.lit(2))
    division = F.split_part(F.coalesce("loc", F.lit("")), F.lit("|"), F.lit(1))
    area = F.regexp_replace(F.concat(F.lit(P["area"]), district, F.lit(", "), division), r"\A[, ]+|[, ]+\z", "")
    names = F.array_join(F.transform("_sel", lambda s: map_or_null(s["c"], X.CATEGORY_LABELS_BN)), ", ")
    fu_arr = F.coalesce(F.col("_fu"), F.array())
    blocks = F.flatten(F.transform(fu_arr, lambda s, i: F.when(
        (i == 0) | (F.element_at(fu_arr, i)["cat"] != s["cat"]),
        F.array(F.lit(""), F.concat(map_or_null(s["cat"], X.CATEGORY_LABELS_BN), F.lit(":")), s["line"]))
        .otherwise(F.array(s["line"]))))
    rel_bn = F.when(F.coalesce(F.col("rel"), F.lit("")) == "", F.lit("")).otherwise(
        F.coalesce(map_or_null(F.col("rel"), X.RELATION_LABELS_BN), F.col("rel")))
    fam = F.when(F.col("fam").isNotNull(), F.concat(
        F.lit(P["abuser"]), F.when(F.lower("fam") == "true", P["family"]).otherwise(P["non_family"]),
        F.when(rel_bn != "", F.concat(F.lit(" — "), rel_bn)).otherwise(F.lit(""))))
    extra = ustrip(F.coalesce(F.col("extra"), F.lit("")))
    head = F.array(
        F.concat(F.lit(P["reporter"]), rep),
        F.when(F.col("has_elder") & F.col("elder").isNotNull(), F.concat(F.lit(P["elder"]), yn(F.col("elder")))),
        F.when(F.coalesce(F.col("gender"), F.lit("")) != "",
               F.concat(F.lit(P["victim"]), F.coalesce(map_or_null(F.col("gender"), X.GENDER_LABELS_BN), F.lit(P["unknown"])))),
        F.when(district != "", area))
    sel_lines = F.when(F.coalesce(F.col("any_sel"), F.lit(False)),
                       F.array(F.lit(""), F.concat(F.lit(P["selected"]), names))).otherwise(F.array())
    tail = F.array(
        F.lit(""), fam,
        F.when(F.col("ong").isNotNull(), F.concat(F.lit(P["ongoing"]), yn(F.col("ong")))),
        F.when(F.col("safe").isNotNull(), F.concat(F.lit(P["safe_place"]), yn(F.col("safe")))))
    extra_lines = F.when(extra != "", F.array(F.lit(""), F.concat(F.lit(P["extra"]), extra))).otherwise(F.array())
    lines = F.filter(F.concat(head, sel_lines, blocks, tail, extra_lines), lambda x: x.isNotNull())
    return j.select("session_id", F.array_join(lines, "\n").alias("summary"), F.size(lines).alias("n_lines"))
