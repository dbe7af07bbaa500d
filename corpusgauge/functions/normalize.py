"""Column -> Column normalisation functions.

Small dictionaries are map literals evaluated inside the projection (no join,
no shuffle); lenient casts use ``try_cast`` / ``try_to_date`` so bad values
become null instead of failing an ANSI-mode job.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions.text import _c, lit_array, ustrip


def map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def map_keep(col, mapping: dict) -> Column:
    """Dictionary value mapping; unmapped values keep the original."""
    c = _c(col)
    return F.coalesce(F.try_element_at(map_literal(mapping), c), c)


def map_or_null(col, mapping: dict) -> Column:
    """Code decode or core-category map; unmapped -> null."""
    return F.try_element_at(map_literal(mapping), _c(col))


def map_default(col, mapping: dict, default) -> Column:
    """Map with a default (severity from category, default 2)."""
    return F.coalesce(F.try_element_at(map_literal(mapping), _c(col)), F.lit(default))


def contains_any_flag(col, words) -> Column:
    """1 when the lower-cased value contains any word, null -> 0."""
    pat = "|".join(words)
    return F.coalesce(F.lower(_c(col)).rlike(pat), F.lit(False)).cast("int")


def lenient_int(col, default=None) -> Column:
    """Integer via lenient cast (bad -> null, or ``default``)."""
    v = ustrip(_c(col).cast("string")).try_cast("int")
    return v if default is None else F.coalesce(v, F.lit(default))


def lenient_double(col) -> Column:
    return ustrip(_c(col).cast("string")).try_cast("double")


DAY_FIRST_FORMATS = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy"]


def day_first_date(col, formats=None) -> Column:
    """Day-first date over a format list; unparseable -> null."""
    c = _c(col).cast("string")
    return F.coalesce(*[F.try_to_date(c, f) for f in (formats or DAY_FIRST_FORMATS)])


def source_type_norm(col) -> Column:
    """Merge spelling variants of interview source types."""
    s = F.regexp_replace(_c(col), r"[Pp]rimary\s*\(Interview\)", "Primary (Interview)")
    return F.regexp_replace(s, r"[Ss]econdary\s*\(?Interview\)?", "Secondary (Interview)")


def bangla_to_ascii_digits(col) -> Column:
    return F.translate(_c(col), X.BANGLA_DIGITS, "0123456789")


def ascii_to_bangla_digits(col) -> Column:
    """S26."""
    return F.translate(_c(col).cast("string"), "0123456789", X.BANGLA_DIGITS)


def age_from_text(col, lo: int = 30, hi: int = 120) -> Column:
    """2-3 digits before a year word (Bangla digits translated), kept in [lo, hi]."""
    t = bangla_to_ascii_digits(F.coalesce(_c(col), F.lit("")))
    raw = F.regexp_extract(t, X.AGE_PATTERN, 1)
    age = F.when(raw != "", raw.cast("int"))
    return F.when(age.between(lo, hi), age)


def parse_json_fallback(col, schema) -> Column:
    """Parse directly, else the first ``{`` .. last ``}`` span, else null."""
    c = _c(col)
    direct = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    span = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(c, "$").isNotNull(), direct).otherwise(
        F.when(F.get_json_object(span, "$").isNotNull(), F.from_json(span, schema)))


def normalize_reporter(col) -> Column:
    """Reporter enum (self / third_party / unknown)."""
    v = F.lower(ustrip(F.coalesce(_c(col).cast("string"), F.lit(""))))
    return F.when(v.isin(X.REPORTER_TYPES), v).otherwise(F.lit("unknown"))


def normalize_age(col, lo: int = 30, hi: int = 120) -> Column:
    a = ustrip(_c(col).cast("string")).try_cast("int")
    return F.when(a.between(lo, hi), a)


def normalize_gender(col) -> Column:
    g = F.lower(ustrip(F.coalesce(_c(col).cast("string"), F.lit(""))))
    return F.when(g.isin(X.MALE_WORDS), "Male").when(g.isin(X.FEMALE_WORDS), "Female")


def normalize_free_text(col) -> Column:
    """Strip; blank or a placeholder word -> null."""
    s = ustrip(_c(col).cast("string"))
    return F.when((F.length(s) > 0) & ~F.lower(s).isin(X.PLACEHOLDERS), s)


def int_or_default(col, default_col) -> Column:
    """Lenient int of a model value, else the rule-based default."""
    return F.coalesce(ustrip(_c(col).cast("string")).try_cast("int"), _c(default_col))


def translate_list(col, mapping: dict, joiner: str = " ও ") -> Column:
    """Split a comma-joined list, trim, drop blanks, map lower-case, rejoin,
    and keep the original in parentheses; blank input -> ''."""
    c = _c(col)
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: ustrip(p)),
                     lambda p: F.length(p) > 0)
    m = map_literal(mapping)
    mapped = F.transform(parts, lambda p: F.coalesce(F.try_element_at(m, F.lower(p)), p))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.array_join(mapped, joiner), F.lit(" ("), c, F.lit(")")))


def placeholder(col, text: str) -> Column:
    """null/blank -> placeholder."""
    s = _c(col).cast("string")
    return F.when(s.isNull() | (F.length(ustrip(s)) == 0), F.lit(text)).otherwise(s)


def case_reference(id_col, date_col) -> Column:
    """``EA-yyyy-MMdd-XXXX`` with 4 hex digits of sha-256(id) (deterministic)."""
    return F.concat_ws("-", F.lit("EA"), F.date_format(_c(date_col), "yyyy"),
                       F.date_format(_c(date_col), "MMdd"),
                       F.upper(F.substring(F.sha2(_c(id_col).cast("string"), 256), 1, 4)))


def law_family(col) -> Column:
    """``pma...`` ids are PMA, the rest BPC."""
    return F.when(F.lower(_c(col)).startswith("pma"), "PMA").otherwise("BPC")


def content_key(voice, rate, text_col) -> Column:
    """32 hex of sha-256 over ``voice|rate|text``."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(voice), F.lit(rate), _c(text_col)), 256), 1, 32)


def band(col, bands, top: str) -> Column:
    """First band whose upper bound exceeds the value, else ``top``."""
    c = _c(col)
    out = None
    for bound, label in bands:
        out = F.when(c < bound, label) if out is None else out.when(c < bound, label)
    return out.otherwise(top)


def band_at_least(col, bands, floor: str) -> Column:
    """S37 (descending thresholds): first band whose lower bound the value reaches."""
    c = _c(col)
    out = None
    for bound, label in bands:
        out = F.when(c >= bound, label) if out is None else out.when(c >= bound, label)
    return out.otherwise(floor)
