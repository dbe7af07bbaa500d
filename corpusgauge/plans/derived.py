"""Plans over texts derived from the tables by fixed rules, so that rules which the tables
themselves never trigger (ages, relations, spam, textless and short texts, Bangla words, scripts)
are compared with SQL on rows that do."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions import text as T
from corpusgauge.operators import classify as C
from corpusgauge.operators import quality as Q
from corpusgauge.operators import reports as R
from corpusgauge.operators import retrieval as RT
from corpusgauge.operators.common import shared_table, top_k
from corpusgauge.plans.classify_plans import AGE_SQL, _case_map_sql, _classified, _relation_sql, classify_sql
from corpusgauge.plans.corpus import CLEAN_CTE, STRIP_SQL, TAG_SQL, WS_RUN_SQL
from corpusgauge.plans.registry import load, query, sql_list, sql_str
from corpusgauge.plans.retrieval_plans import KB_VALUES

# What is put behind a conversation's text, by (conversation + turn) modulo their number.
CASE_ENDINGS = [
    "", " The mother, aged 72 years, was beaten by her son.", " ৬৫ বছর বয়সী বাবা, তার ছেলে মারধর করে।",
    " My father is 130 years old; a neighbor helped.", " grandmother 80 years old, daughter-in-law", " স্বামী ও বৃদ্ধা, 45 age.",
]
# Complaints with Bangla, English and mixed keywords: overlapping ones, one inside another, several
# categories, equal hits, capitals, keywords at the ends and joined to other words.
COMPLAINT_ENDINGS = [
    "", " ছেলে আমাকে মারধর করেছে এবং আঘাত পেয়েছি", " তার ছেলে জমি ও টাকা নিয়েছে", " তারা আমাকে CARE করে না", "লাশ", " They hit করেছে, HIT again",
    " খাবার দেয় না, ওষুধ দেয় না; property and pension", "beatingbeaten slapped", " হত্যার হুমকি ও গালি", " left alone, no food, no medicine",
    " খুন", " বৃদ্ধাশ্রমে ফেলে গেছে", " abandoned and insulted and beaten", " টাকা টাকা টাকা money",
]
# What replaces a document's text, by id modulo their number; None: the text stays.
DOCUMENT_TEXTS = [
    None, None, "subscribe to my channel https://t.me/x", "😀😀 !!", "ab", "  ৭২  ", "বাবা মাকে খাবার দেয় না।  ছেলে খাবার চায়",
    "খাবার and rice বাবা", "السلام عليكم", "বৃদ্ধ মানুষ একা থাকে, খাবার নাই।",
]


def pick(key, values, text):
    """Column: the value of ``values`` for ``key`` modulo their number (None: ``text``)."""
    out = None
    for i, v in enumerate(values):
        hit, value = F.pmod(key, F.lit(len(values))) == i, text if v is None else F.lit(v)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def pick_sql(key: str, values, text: str) -> str:
    return f"CASE ({key}) % {len(values)} " + " ".join(
        f"WHEN {i} THEN {text if v is None else sql_str(v)}" for i, v in enumerate(values)) + " END"


@query("entity_extract_cases", f"""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') || {pick_sql("conv_id + turn", CASE_ENDINGS, "text")} AS text FROM conversations)
SELECT conv_id, turn, {AGE_SQL} AS age, {_relation_sql("text", X.VICTIM_RELATIONS)} AS victim_relation,
       {_relation_sql("text", X.ABUSER_RELATIONS)} AS abuser_relation FROM c""", ops="S20 S21")
def entity_extract_cases(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ending = pick(F.col("conv_id") + F.col("turn"), CASE_ENDINGS, F.col("text"))
    conv = conv.withColumn("text", F.concat(F.coalesce("text", F.lit("")), ending))
    return C.extract_entities(conv, "text").select(
        "conv_id", "turn", F.col("age").cast("int").alias("age"), "victim_relation", "abuser_relation")


DOCS_SQL = f"(SELECT doc_id, {pick_sql('doc_id', DOCUMENT_TEXTS, 'text')} AS text, lang FROM documents)"


def derived_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.withColumn("text", pick(F.col("doc_id"), DOCUMENT_TEXTS, F.col("text")))


@query("clean_reasons_cases", f"""
WITH {CLEAN_CTE.replace("FROM documents", f"FROM {DOCS_SQL}")}
SELECT coalesce(remove_reason, 'kept') AS remove_reason, {TAG_SQL} AS lang_tag, count(*)::BIGINT AS n
FROM cg_clean GROUP BY 1, 2""", ops="S1 S2 S5 S8 S9 F1 F2 W1")
def clean_reasons_cases(spark, sf_dir):
    c = Q.clean_corpus(derived_documents(spark, sf_dir), "doc_id", "text", extra={"lang_tag": T.tag_language})
    return c.groupBy(F.coalesce("remove_reason", F.lit("kept")).alias("remove_reason"), "lang_tag").agg(
        F.count(F.lit(1)).alias("n"))


@query("bangla_tokens_cases", f"""
WITH w AS (SELECT lang, unnest(regexp_split_to_array(coalesce(text, ''), {WS_RUN_SQL})) AS raw FROM {DOCS_SQL}),
s AS (SELECT lang, regexp_replace(raw, {sql_str(T.bangla_strip_regex())}, '', 'g') AS token FROM w),
f AS (SELECT * FROM s WHERE length(token) > 1 AND NOT list_contains({sql_list(X.CASE_BN_STOP)}, token)
                        AND regexp_matches(token, '[{X.BENGALI_RANGE}]')),
c AS (SELECT lang, token, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c)
SELECT lang, token, n::BIGINT AS n, rank::INTEGER AS rank FROM r WHERE rank <= 10""", ops="T3 T7")
def bangla_tokens_cases(spark, sf_dir):
    toks = derived_documents(spark, sf_dir).select("lang", F.explode(T.bangla_tokens("text")).alias("token"))
    toks = toks.filter((F.length("token") > 1) & ~F.col("token").isin(X.CASE_BN_STOP)
                       & F.col("token").rlike(f"[{X.BENGALI_RANGE}]"))
    counts = toks.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["lang"], [F.col("n").desc(), F.col("token")], 10).select(
        "lang", "token", F.col("n").cast("bigint").alias("n"), "rank")


COMPLAINTS_SQL = (f"(SELECT conv_id, turn, coalesce(text, '') || {pick_sql('conv_id + turn', COMPLAINT_ENDINGS, 'text')} AS text"
                  " FROM conversations)")


@query("keyword_classify_cases", classify_sql(COMPLAINTS_SQL, "conv_id, turn"), ops="R1 R2 W6 J7 F10")
def keyword_classify_cases(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ending = pick(F.col("conv_id") + F.col("turn"), COMPLAINT_ENDINGS, F.col("text"))
    return _classified(conv.withColumn("text", F.concat(F.coalesce("text", F.lit("")), ending)), ["conv_id", "turn"])


@query("document_classify_cases", f"""
WITH c AS ({classify_sql(DOCS_SQL, "doc_id")})
SELECT category, matched, severity, confidence, count(*)::BIGINT AS n FROM c GROUP BY ALL""", ops="R1 R2 J7 A1")
def document_classify_cases(spark, sf_dir):
    c = _classified(derived_documents(spark, sf_dir), ["doc_id"])
    return c.groupBy("category", "matched", "severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


def complaints(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ending = pick(F.col("conv_id") + F.col("turn"), COMPLAINT_ENDINGS, F.col("text"))
    return conv.withColumn("text", F.concat(F.coalesce("text", F.lit("")), ending))


def knowledge_base(spark, sf_dir):
    """The sections with texts from the tables: the document and the benchmark item of their number."""
    kb = RT.kb_sections(spark)
    docs = load(spark, sf_dir, "documents").filter(F.col("doc_id") < len(X.KB_SECTIONS)).select(F.col("doc_id").alias("kb_ord"), "text")
    items = load(spark, sf_dir, "benchmark").orderBy("item_id").limit(len(X.KB_SECTIONS)).select(
        (F.row_number().over(Window.orderBy("item_id")) - 1).alias("kb_ord"), F.col("text").alias("text_english"))
    return kb.join(docs, "kb_ord", "left").join(items, "kb_ord", "left")


@query("prompt_contexts", f"""
WITH src AS {COMPLAINTS_SQL},
c AS ({classify_sql("src", "conv_id, turn")}),
cc AS (SELECT conv_id, category, min(turn) AS first_turn FROM c GROUP BY ALL),
keys AS (SELECT conv_id, category, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, category) AS cat_pos FROM cc),
titles(kb_ord, id, section, applicable_for) AS (VALUES {KB_VALUES}),
items AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS kb_ord FROM benchmark),
kb AS (SELECT t.*, '[' || id || '] ' || section || chr(10) || {sql_str(X.CONTEXT_BANGLA)} || coalesce(d.text, '') || chr(10)
              || {sql_str(X.CONTEXT_ENGLISH)} || coalesce(i.text, '') AS block
       FROM titles t LEFT JOIN documents d ON d.doc_id = t.kb_ord LEFT JOIN items i ON i.kb_ord = t.kb_ord),
s AS (SELECT k.conv_id, k.cat_pos, kb.id, kb.kb_ord, kb.block FROM keys k JOIN kb
      ON (k.category <> 'unknown' AND list_contains(kb.applicable_for, k.category))
      OR (k.category = 'unknown' AND NOT list_contains(kb.applicable_for, 'all'))
      OR list_contains({sql_list(X.KB_ALWAYS)}, kb.id)),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY cat_pos, kb_ord) = 1),
x AS (SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY cat_pos, kb_ord) AS context, count(*) AS n FROM f GROUP BY conv_id),
m AS (SELECT conv_id, length(regexp_replace(text, '[^{X.BENGALI_RANGE}]', '', 'g')) AS bn, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en,
             length(regexp_replace(text, {STRIP_SQL}, '', 'g')) = 0 AS blank
      FROM src QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
l AS (SELECT conv_id, CASE WHEN blank THEN 'unknown' WHEN bn > 0 AND en > 0 THEN CASE WHEN bn / (bn + en) > 0.8 THEN 'bangla'
             WHEN en / (bn + en) > 0.8 THEN 'english' ELSE 'mixed' END WHEN bn > 0 THEN 'bangla' WHEN en > 0 THEN 'english' ELSE 'unknown' END AS mode FROM m)
SELECT conv_id, n::BIGINT AS n_sections, sha256(context) AS context_sha256, length(context)::BIGINT AS context_chars, mode AS language_mode,
       {_case_map_sql("mode", X.LANGUAGE_RULES, sql_str(X.LANGUAGE_RULE_BOTH))} AS language_rule
FROM x JOIN l USING (conv_id)""", ops="S33 S7 J8 J9 U4")
def prompt_contexts(spark, sf_dir):
    """Each conversation's whole context block and the rule for the answer's language."""
    src = complaints(spark, sf_dir)
    cc = C.classify_text(src, "text").groupBy("conv_id", "category").agg(F.min("turn").alias("first_turn"))
    keys = cc.withColumn("cat_pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "category")))
    sections = shared_table(RT.multi_category_sections(keys, RT.kb_sections(spark), ["conv_id"], "category", "cat_pos"), "sections")
    context = RT.full_prompt_context(sections, knowledge_base(spark, sf_dir), ["conv_id"])
    first = src.groupBy("conv_id").agg(F.min_by(T.language_mode("text"), "turn").alias("language_mode"))
    return context.join(first, "conv_id").select(
        "conv_id", "n_sections", F.sha2("context", 256).alias("context_sha256"), F.length("context").cast("bigint").alias("context_chars"),
        "language_mode", RT.language_rule(F.col("language_mode")).alias("language_rule"))


@query("case_records", f"""
WITH src AS {COMPLAINTS_SQL},
c AS ({classify_sql("src", "conv_id, turn")})
SELECT conv_id, turn, src.text AS transcript, category AS abuse_type, legal_sections AS applicable_sections, severity,
       civil_or_criminal, '' AS legal_advice_bangla, recommended_action AS recommended_action_bangla, 'unknown' AS reporter_type,
       {AGE_SQL.replace("text", "src.text")} AS age, {_relation_sql("src.text", X.VICTIM_RELATIONS)} AS victim_relation,
       {_relation_sql("src.text", X.ABUSER_RELATIONS)} AS abuser_relation, CAST(NULL AS VARCHAR) AS uno_upazila, CAST(NULL AS VARCHAR) AS uno_district
FROM src JOIN c USING (conv_id, turn)""", ops="S29 S20 S21 R1 R2")
def case_records(spark, sf_dir):
    """All fields of each complaint's record, missing ones by their defaults."""
    c = C.extract_entities(C.classify_text(complaints(spark, sf_dir), "text"), "text")
    named = c.select("conv_id", "turn", F.col("text").alias("transcript"), F.col("category").alias("abuse_type"),
                     F.col("legal_sections").alias("applicable_sections"), F.col("severity").cast("int").alias("severity"), "civil_or_criminal",
                     F.col("recommended_action").alias("recommended_action_bangla"), F.lit(None).cast("string").alias("reporter_type"),
                     F.struct(F.col("age").cast("int").alias("age"), "victim_relation", "abuser_relation").alias("entities"))
    return R.case_records(named, ["conv_id", "turn"]).drop("case_ref").withColumn(
        "applicable_sections", F.array_join("applicable_sections", "; ")).select("*", "entities.*").drop("entities")
