"""Column -> Column text functions (S1-S11, token rules T1-T6).

They are built-in Spark expressions (regex, string and higher-order functions) that run
JVM-side inside the scan's stage; only lists of words are looked up by an automaton in Arrow
batches, which reads a text once whatever the number of words.  Regex literals use ``\\x{..}`` escapes that Java regex and RE2
read the same way, which keeps the SQL oracle identical.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge import fixed as X


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# -- S1 / S2 / S3 / S4 -------------------------------------------------------

STRIP_REGEX = rf"\A{X.WS_CLASS}+|{X.WS_CLASS}+\z"
WS_RUN_REGEX = rf"{X.WS_CLASS}+"
# The same whitespace set written for Java regex: Unicode \s plus U+001C-U+001F.
# Checked equal to WS_CLASS over every code point; Java matches it about twice
# as fast.  WS_RUN_REGEX stays the portable form used by the SQL oracle.
WS_RUN_JAVA = r"(?U)[\s\x{1C}-\x{1F}]+"


def _class_chars(cls: str) -> str:
    """Expand a ``[...]`` class of single chars, hex escapes and ranges into its characters."""
    import re

    body = cls[1:-1]
    tokens = re.findall(r"\\x\{([0-9A-Fa-f]+)\}|\\([tnr])|(.)", body)
    chars = []
    for hexv, esc, lit in tokens:
        chars.append(chr(int(hexv, 16)) if hexv else {"t": "\t", "n": "\n", "r": "\r"}[esc] if esc else lit)
    out, i = [], 0
    while i < len(chars):
        if i + 2 < len(chars) and chars[i + 1] == "-":
            out.extend(chr(c) for c in range(ord(chars[i]), ord(chars[i + 2]) + 1))
            i += 3
        else:
            out.append(chars[i])
            i += 1
    return "".join(out)


# the same whitespace set as a plain string, for btrim
WS_CHARS = _class_chars(X.WS_CLASS)


def ustrip(col) -> Column:
    """Trim all Unicode whitespace at both ends (Spark ``trim`` only trims spaces).

    ``btrim`` with the whitespace set works on the two ends only (a regex
    anchored at the end would be tried at every position of a long text)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def char_len(col) -> Column:
    """Code points of the stripped text."""
    return F.length(ustrip(col))


def collapse_ws(col) -> Column:
    """Collapse whitespace runs to one blank and strip the ends."""
    return ustrip(F.regexp_replace(_c(col), WS_RUN_JAVA, " "))


def norm_text(col) -> Column:
    """Duplicate key: collapsed whitespace, stripped, lower case."""
    return F.lower(collapse_ws(col))


def preview(col, n: int = 350) -> Column:
    """Single-line preview: whitespace collapsed, first ``n`` characters."""
    return F.substring(collapse_ws(col), 1, n)


# -- S5 / S6 / S7 ------------------------------------------------------------

def tag_language(col) -> Column:
    """Script rule in fixed order: arabic (no Bangla), bn+en, bengali, latin, emoji/other."""
    c = _c(col).cast("string")
    has_bn = c.rlike(f"[{X.BENGALI_RANGE}]")
    has_ar = c.rlike(f"[{X.ARABIC_RANGE}]")
    has_lat = c.rlike("[A-Za-z]")
    return (F.when(has_ar & ~has_bn, "arabic")
            .when(has_bn & has_lat, "bn+en")
            .when(has_bn, "bengali")
            .when(has_lat, "latin")
            .otherwise("emoji/other"))


def lang_bucket(col, with_arabic: bool = True) -> Column:
    """Language bucket from a language tag (prefix / membership rules)."""
    l = F.lower(_c(col).cast("string"))
    out = (F.when(l.startswith("beng"), "Bangla")
           .when(l.isin("latin", "banglish"), "Banglish (Latin)")
           .when(l.contains("bn+en") | l.contains("mix"), "Code-mixed"))
    if with_arabic:
        out = out.when(l.contains("arab"), "Arabic")
    return out.otherwise("Other")


def language_mode(col) -> Column:
    """bangla / english / mixed / unknown by share of script letters (> 0.8 wins)."""
    c = _c(col)
    bn = F.length(F.regexp_replace(c, f"[^{X.BENGALI_RANGE}]", ""))
    en = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    total = bn + en
    blank = c.isNull() | (F.length(ustrip(c)) == 0)
    return (F.when(blank, "unknown")
            .when((bn > 0) & (en > 0),
                  F.when(bn / total > 0.8, "bangla")
                  .when(en / total > 0.8, "english")
                  .otherwise("mixed"))
            .when(bn > 0, "bangla")
            .when(en > 0, "english")
            .otherwise("unknown"))


# -- S8 / S9 / S10 / S11 -----------------------------------------------------

def is_textless(col) -> Column:
    """No Latin, Bangla or Arabic letter at all (emoji / punctuation only)."""
    return ~F.coalesce(_c(col), F.lit("")).rlike(X.LETTER_CLASS)


def is_spam(col) -> Column:
    """Any of the five spam patterns, case-insensitive."""
    return F.coalesce(_c(col), F.lit("")).rlike(X.SPAM_REGEX)


def has_emoji(col) -> Column:
    return F.coalesce(_c(col), F.lit("")).rlike(X.EMOJI_CLASS)


def is_religious(col, markers=None) -> Column:
    """Any marker as a lower-case substring (so short markers hit inside words)."""
    low = F.lower(F.coalesce(_c(col), F.lit("")))
    return has_any(low, [m.lower() for m in (markers or X.RELIGIOUS_MARKERS)])


@lru_cache(maxsize=16)
def automaton(words: tuple[str, ...]):
    """Aho-Corasick automaton of ``words``."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def has_any(col, words) -> Column:
    """Whether any of ``words`` occurs in the text; a text is read once, up to the first one."""
    words = tuple(sorted(set(words)))

    @F.pandas_udf("boolean")
    def find(texts: pd.Series) -> pd.Series:
        found = automaton(words)
        return pd.Series([bool(t) and next(found.iter(t), None) is not None for t in texts], dtype=bool)

    if "" in words:  # the empty word is in every text
        return F.lit(True)
    return find(_c(col)) if words else F.lit(False)


# -- token rules (T1-T6) -----------------------------------------------------

def corpus_tokens(col) -> Column:
    """Runs of 2+ Bangla/Latin letters, original case."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(X.CORPUS_TOKEN), 0)


def english_tokens(col) -> Column:
    """``[a-z]+`` runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit("[a-z]+"), 0)


def bangla_strip_regex() -> str:
    """Punctuation, ASCII and Bangla digits at either end of a token."""
    strip_chars = X.TOKEN_PUNCT + "0123456789" + X.BANGLA_DIGITS + " "
    cls = "[" + "".join("\\" + ch if ch in "[]\\^-" else ch for ch in strip_chars) + "]"
    return rf"\A{cls}+|{cls}+\z"


def bangla_tokens(col) -> Column:
    """T3 (before filtering): whitespace split, punctuation and digits stripped from both ends."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), WS_RUN_JAVA)
    pat = bangla_strip_regex()
    return F.transform(parts, lambda w: F.regexp_replace(w, pat, ""))


def model_tokens(col) -> Column:
    """T4: ``[A-Za-z]+|[Bangla]+`` runs, lower-cased (vowel signs stay inside words)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(X.MODEL_TOKEN), 0)


def word_ngrams(tokens, n_max: int = 2) -> Column:
    """T5: word 1..n grams joined by a blank (as a bag, order kept).

    Pass a column *reference* (a projected token array): the token expression
    is read once per n-gram position inside the lambda."""
    toks = _c(tokens)

    def grams_of_size(n):
        # one-argument lambda: transform() passes (element, index) to two-argument ones
        return F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1),
                           lambda i: F.array_join(F.slice(toks, i, n), " "))

    parts = [toks] + [F.when(F.size(toks) >= n, grams_of_size(n)).otherwise(F.array().cast("array<string>"))
                      for n in range(2, n_max + 1)]
    return F.flatten(F.array(*parts))


def _wb_grams_of_padded(w, n_min: int, n_max: int) -> Column:
    empty = F.array().cast("array<string>")

    def grams_of_size(n):
        return F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))

    per_n = [F.when(F.length(w) > n, grams_of_size(n)).otherwise(empty) for n in range(n_min, n_max + 1)]
    per_n.append(F.when(F.length(w) <= n_max, F.array(w)).otherwise(empty))
    return F.flatten(F.array(*per_n))


def char_wb_word_grams(word, n_min: int = 3, n_max: int = 5) -> Column:
    """T6 for one (already lower-cased, non-blank) word: its padded char n-grams."""
    padded = F.concat(F.lit(" "), _c(word), F.lit(" "))
    return _wb_grams_of_padded(padded, n_min, n_max)


def char_wb_ngrams(col, n_min: int = 3, n_max: int = 5) -> Column:
    """Character n-grams inside word boundaries, each word padded by one blank.

    Public scikit-learn ``char_wb`` semantics: for each size ``n`` shorter
    than the padded word all its n-grams are emitted; the first size that
    reaches the padded length emits the padded word once and ends that word.
    Text is lower-cased first.
    """
    words = F.filter(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), WS_RUN_JAVA),
                     lambda w: F.length(w) > 0)
    return F.flatten(F.transform(words, lambda w: char_wb_word_grams(w, n_min, n_max)))


def whitespace_words(col) -> Column:
    """Lower-cased whitespace-separated words (blank pieces dropped)."""
    return F.filter(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), WS_RUN_JAVA),
                    lambda w: F.length(w) > 0)
