"""Keyword classification (R1-R3, J7, W6) and entity extraction.

All keywords are looked up in one pass over a text by an Aho-Corasick automaton; a scan per
keyword reads it 231 times.  No row explosion, no join, no shuffle: the pass runs in the scan
stage, and the rest is one projection over array literals.  The best category is ``array_max``
over structs ordered (hits, severity, -dictionary order), which is exactly "most hits, then
higher severity, then first in the dictionary".
"""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions import normalize as N
from corpusgauge.functions.text import WS_RUN_JAVA, automaton, lit_array, ustrip

# Python-style word boundary (letters, digits, underscore are word characters).
_W = r"[\p{L}\p{N}_]"


def word_regex(pattern: str) -> str:
    """A ``\\b...\\b`` pattern with Unicode-aware boundaries (as Python's ``re``)."""
    core = pattern.replace(r"\b", "")
    return rf"(?i)(?<!{_W})(?:{core})(?!{_W})"


def keyword_dictionary(keywords: dict[str, list[str]] | None = None):
    """[(category, ord, severity, [keywords...])] in dictionary order."""
    kw = keywords or X.KEYWORDS
    return [(c, i, X.SEVERITY.get(c, 1), words) for i, (c, words) in enumerate(kw.items())]


def found_keywords(low: Column, words) -> Column:
    """The different ``words`` that occur in the lower-cased text ``low``, in any order; overlapping
    ones all count.  An Aho-Corasick automaton reads each text once, whatever the number of words,
    in Arrow batches; only the few words found come back."""
    words = tuple(sorted({w for w in words if w}))

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        found = automaton(words)
        return pd.Series([list({w for _, w in found.iter(t)}) if t else [] for t in texts], dtype=object)

    return find(low) if words else F.array().cast("array<string>")


def category_scores(found: Column, dictionary) -> Column:
    """Array of structs (n, severity, neg_ord, category, hits) -- one per category.

    ``found`` must be an already projected column of the keywords found (computed once per
    row, not once per category)."""
    items = []
    for cat, order, sev, words in dictionary:
        hits = F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(
            F.filter(lit_array([w.lower() for w in words]), lambda k: F.array_contains(found, k)))
        items.append(F.struct(F.size(hits).alias("n"), F.lit(sev).alias("severity"),
                              F.lit(-order).alias("neg_ord"), F.lit(cat).alias("category"),
                              hits.alias("hits")))
    return F.array(*items)


def classify_text(df: DataFrame, text_col: str, dictionary=None, tie: str = "severity") -> DataFrame:
    """R1 (tie='severity') / R3 (tie='order'): category, hits, total, severity,
    confidence, matched keywords, legal sections, civil/criminal, recommended action.

    Blank or keyword-free text gives 'unknown' with severity 0.  The found keywords
    and the score array are projected once and then referenced, so a text is read
    once."""
    dictionary = dictionary or keyword_dictionary()
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    base = df.withColumn("_found", found_keywords(low, [w.lower() for _, _, _, words in dictionary for w in words]))
    scores = category_scores(F.col("_found"), dictionary)
    if tie == "order":
        scores = F.transform(scores, lambda s: s.withField("severity", F.lit(0)))
    blank = F.col(text_col).isNull() | (F.length(ustrip(F.col(text_col))) == 0)
    scored = (base.withColumn("_sc", scores)
              .withColumn("_best", F.array_max(F.filter(F.col("_sc"), lambda s: s["n"] > 0)))
              .withColumn("_known", ~blank & F.col("_best").isNotNull()))
    known = F.col("_known")
    best = F.col("_best")
    total = F.aggregate(F.col("_sc"), F.lit(0), lambda acc, s: acc + s["n"])
    cat = F.when(known, best["category"]).otherwise(F.lit("unknown"))
    sev_map = N.map_literal(X.SEVERITY)
    return (scored
            .withColumn("category", cat)
            .withColumn("top_hits", F.when(known, best["n"]).otherwise(F.lit(0)))
            .withColumn("total_hits", F.when(blank, F.lit(0)).otherwise(total))
            .withColumn("severity", F.when(known, F.coalesce(F.try_element_at(sev_map, cat), F.lit(1)))
                        .otherwise(F.lit(0)))
            .withColumn("confidence", F.when(known, F.bround(F.col("top_hits") / F.col("total_hits"), 2))
                        .otherwise(F.lit(0.0)))
            .withColumn("matched", F.when(known, best["hits"]).otherwise(F.array().cast("array<string>")))
            .withColumn("legal_sections", legal_sections(F.col("category")))
            .withColumn("civil_or_criminal", N.map_default(F.col("category"), X.CIVIL_OR_CRIMINAL, "Unknown"))
            .withColumn("recommended_action", F.when(blank, F.lit(X.ACTION_BLANK)).when(~known, F.lit(X.ACTION_UNKNOWN))
                        .otherwise(N.map_default(F.col("severity"), X.RECOMMENDED_ACTIONS, "")))
            .drop("_sc", "_found", "_best", "_known"))


def legal_sections(category: Column) -> Column:
    """R2: legal sections of a category (array literal per category)."""
    out = None
    for c, laws in X.LEGAL_SECTIONS.items():
        arr = lit_array(laws) if laws else F.array().cast("array<string>")
        out = F.when(category == c, arr) if out is None else out.when(category == c, arr)
    return out.otherwise(F.array().cast("array<string>"))


def _literals(pattern: str) -> list[str]:
    """The words of a pattern that is one word or a choice of words."""
    core = pattern.replace(r"\b", "")
    words = re.findall(r"[a-z][a-z-]*", core)
    if core not in ("|".join(words), f"({'|'.join(words)})"):
        raise ValueError(f"not a choice of words: {pattern}")
    return words


def relation(text: Column, rules, found: Column) -> Column:
    """First rule in rank order whose English pattern (Unicode word
    boundaries, case-insensitive) matches or whose Bangla word set holds a
    whitespace token with punctuation stripped from its ends.

    ``found``: the rules' words that occur anywhere in the lower-cased text; a rule is tried only
    where one of its words does."""
    t = F.coalesce(text, F.lit(""))
    cls = "[" + "".join("\\" + ch if ch in "[]\\^-" else ch for ch in X.TOKEN_PUNCT) + "]"
    toks = F.transform(F.split(t, WS_RUN_JAVA), lambda w: F.regexp_replace(w, rf"\A{cls}+|{cls}+\z", ""))
    out = None
    for name, en, bn in rules:
        # when(), not &: the exact test must not be hoisted out of its condition
        cond = (F.when(F.arrays_overlap(found, lit_array(_literals(en))), t.rlike(word_regex(en))).otherwise(F.lit(False))
                | F.when(F.arrays_overlap(found, lit_array(bn)), F.arrays_overlap(toks, lit_array(bn))).otherwise(F.lit(False)))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


AGE_WORDS = ["বছর", "year", "age"]   # X.AGE_PATTERN ends in one of them


def extract_entities(df: DataFrame, text_col: str) -> DataFrame:
    """S20 + S21: age, victim relation, abuser relation.

    One pass finds the words that the rules name; the rules' expressions run where they occur."""
    t = F.col(text_col)
    words = AGE_WORDS + [w for _, en, bn in X.VICTIM_RELATIONS + X.ABUSER_RELATIONS for w in [*_literals(en), *bn]]
    found = F.col("_words")
    return (df.withColumn("_words", found_keywords(F.lower(F.coalesce(t, F.lit(""))), words))
            .withColumn("age", F.when(F.arrays_overlap(found, lit_array(AGE_WORDS)), N.age_from_text(t)))
            .withColumn("victim_relation", relation(t, X.VICTIM_RELATIONS, found))
            .withColumn("abuser_relation", relation(t, X.ABUSER_RELATIONS, found)).drop("_words"))


def normalize_entities(raw: Column) -> Column:
    """Canonical entity struct from a raw struct/map of strings."""
    def g(name):
        return raw[name]
    return F.struct(
        N.normalize_reporter(g("reporter_type")).alias("reporter_type"),
        N.normalize_free_text(g("victim_name")).alias("victim_name"),
        N.normalize_age(g("victim_age")).alias("victim_age"),
        N.normalize_gender(g("victim_gender")).alias("victim_gender"),
        N.normalize_free_text(g("location")).alias("location"),
        N.normalize_free_text(g("abuser_name")).alias("abuser_name"),
        N.normalize_free_text(g("abuser_relation")).alias("abuser_relation"),
        N.normalize_free_text(g("incident_date")).alias("incident_date"))
