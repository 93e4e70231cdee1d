"""Column -> Column helpers for text and missing-value semantics.

All helpers are built-in Spark expressions (codegen-friendly); none is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Textual tokens that count as "empty" after trim + lower.
EMPTY_TOKENS = ("", "nan", "none", "null", "nat")

# String -> 0/1 mapping used when a target is not numeric 0/1.
BINARY_TEXT_MAP = {"0": 0.0, "1": 1.0, "false": 0.0, "true": 1.0, "no": 0.0, "yes": 1.0}

# The characters Python's str.strip() removes (str.isspace), trimmed with btrim
# (a character-set trim, much cheaper than a regex on every value).
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """cast to string, NULL -> ''."""
    return F.coalesce(col_of(c).cast("string"), F.lit(""))


def normalize_text(c) -> Column:
    """cast to string, NULL -> '', strip leading/trailing whitespace."""
    return F.btrim(as_text(c), F.lit(WHITESPACE))


def regex_trim(c) -> Column:
    """Whitespace trim that also strips tabs/newlines/Unicode spaces (``trim`` strips spaces
    only); a character-set ``btrim``, no regular expression despite the historical name."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def is_empty(c) -> Column:
    """True when the normalised, lower-cased text is an empty token."""
    return F.lower(normalize_text(c)).isin(*EMPTY_TOKENS)


def non_empty_text(c) -> Column:
    """Normalised text, or NULL when it is an empty token."""
    n = normalize_text(c)
    return F.when(~F.lower(n).isin(*EMPTY_TOKENS), n)


def nan_to_null(c) -> Column:
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def safe_double(c, dtype=None) -> Column:
    """Numeric coercion: numbers pass, text is parsed, failures and NaN -> NULL."""
    c = col_of(c)
    if dtype is not None and dtype.typeName() == "string":
        v = regex_trim(c).try_cast("double")
    else:
        v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def safe_bigint(c) -> Column:
    """Text -> bigint going through double, so '12.0' -> 12 (direct cast gives NULL)."""
    d = regex_trim(col_of(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(d) & (d == F.floor(d)), d.cast("bigint"))


def safe_binary_target(c) -> Column:
    """Per value: numeric 0/1 passes, else the text mapping; anything else NULL."""
    c = col_of(c)
    num = regex_trim(c.cast("string")).try_cast("double")
    low = F.lower(normalize_text(c))
    mapped = F.lit(None).cast("double")
    for k, v in BINARY_TEXT_MAP.items():
        mapped = F.when(low == k, F.lit(v)).otherwise(mapped)
    return F.when(num.isin(0.0, 1.0), num).otherwise(mapped)


def lower_trim_norm(c, unknown: str = "UNKNOWN") -> Column:
    """NULL -> unknown label, then trim + lower."""
    return F.lower(regex_trim(F.coalesce(col_of(c).cast("string"), F.lit(unknown))))


def regex_flag(c, pattern: str) -> Column:
    """Case-insensitive Unicode match -> 0/1; NULL -> 0. ``(?iu)`` folds Cyrillic too."""
    return F.coalesce(col_of(c).rlike("(?iu)" + pattern), F.lit(False)).cast("int")


def first_keyword_category(c, rules: list[tuple[str, str]], default: str = "other",
                           null_label: str | None = None) -> Column:
    """First (keyword, label) in list order whose keyword is contained in lower(value)."""
    low = F.lower(col_of(c).cast("string"))
    out = F.lit(default)
    for kw, label in reversed(rules):
        out = F.when(low.contains(kw.lower()), F.lit(label)).otherwise(out)
    if null_label is not None:
        out = F.when(col_of(c).isNull(), F.lit(null_label)).otherwise(out)
    return out


def map_values(c, mapping: dict, default=None) -> Column:
    """Fixed value map with default (a literal map lookup, no join)."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    out = F.element_at(m, col_of(c).cast("string")) if mapping else F.lit(None)
    out = F.when(col_of(c).isNull(), F.lit(None)).otherwise(out)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def whitelist_group(c, keep: list[str], other: str = "other") -> Column:
    """Listed values pass; everything else, NULL included, becomes ``other``."""
    c = col_of(c)
    return F.when(F.coalesce(c.isin(*keep), F.lit(False)), c).otherwise(F.lit(other))


def placeholder_to_null(c, placeholders: list[str]) -> Column:
    c = col_of(c)
    return F.when(~F.coalesce(c.isin(*placeholders), F.lit(False)), c)


def leading_letters(c, unknown: str = "unknown", cyrillic: bool = True) -> Column:
    """Cut at the first non-letter; empty -> unknown."""
    cls = "A-Za-zА-Яа-яЁё" if cyrillic else "A-Za-z"
    s = F.regexp_extract(F.coalesce(col_of(c).cast("string"), F.lit("")), f"^[{cls}]+", 0)
    return F.when(s == "", F.lit(unknown)).otherwise(s)


def url_last_segment(c) -> Column:
    """Text after the last '/'; the whole string when there is no slash."""
    return F.substring_index(col_of(c), "/", -1)


def pickup_code_extract(c, unknown: str | None = "unknown") -> Column:
    """First ``[A-Z]+\\d+`` run in the text; no match -> unknown (or the original)."""
    c = col_of(c)
    code = F.regexp_extract(F.coalesce(c, F.lit("")), r"[A-Z]+\d+", 0)
    fallback = F.lit(unknown) if unknown is not None else c
    return F.when(code == "", fallback).otherwise(code)


def code_prefix(c, unknown: str = "unknown") -> Column:
    """Letters of an exact ``[A-Z]+\\d+`` code, else unknown."""
    s = F.coalesce(regex_trim(col_of(c).cast("string")), F.lit(""))
    p = F.regexp_extract(s, r"^([A-Z]+)\d+$", 1)
    return F.when(p == "", F.lit(unknown)).otherwise(p)


def same_owner_flag(a, b) -> Column:
    """1 when the ids are equal or the second one is missing."""
    a, b = col_of(a), col_of(b)
    return (F.coalesce(a == b, F.lit(False)) | b.isNull()).cast("int")


def concat_key(*cols, sep: str = "__") -> Column:
    return F.concat_ws(sep, *[F.coalesce(col_of(c).cast("string"), F.lit("")) for c in cols])
