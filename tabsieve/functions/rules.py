"""Rule-based categorical features of the order domain, as Column expressions.

The literal lists below must equal the reference's for equal results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabsieve.functions.text import col_of, first_keyword_category

# ---------------------------------------------------------------------------
# Fixed values (must match the reference's rules).
PAYMENT_CASH_ON_DELIVERY = "Наложенный платеж"
WIDTH_RANGE, WIDTH_SMALL_BELOW, WIDTH_NORMAL_TO = (10, 50), 25, 35
HEIGHT_SMALL_TO, HEIGHT_MEDIUM_TO = 4, 12
DELIVERY_RULES = [
    (["СДЭК до ПВЗ", "Самовывоз"], "pickup_point"),
    (["СДЭК до Двери", "Курьер ЕМС"], "door_delivery"),
    (["Почта"], "post"),
]
UTM_CAMPAIGN_PLACEHOLDERS = ["{campaing_id}", "Неизвестно"]
LEAD_GROUP_MAIN = ["yur", "but"]
REFERRER_CATEGORIES = ["varikoz", "otek", "sustav", "sleep", "davlenie"]
REFERRER_SITES = ["artraid", "npotpz"]
TAG_CATEGORIES = ["tilda", "npotpz", "Callibri", "ВХОДЯЩИЙ", "artraid"]
SITE_FAMILIES = [
    # (label, contains, startswith, endswith, infix)
    ("yandex", "yandex", "ya.", ".ya", ".ya."),
    ("dzen", "dzen", "zen.", ".zen", ".zen."),
    ("ok", None, "ok.", ".ok", ".ok."),
    ("ria", None, "ria.", ".ria", ".ria."),
]
UTM_PARTS = 10
UTM_UNKNOWN_DEVICE = ["undefined", ""]
# ---------------------------------------------------------------------------


def payment_type(c) -> Column:
    c = col_of(c)
    return (F.when(c.isNull(), F.lit("unknown"))
            .when(c == PAYMENT_CASH_ON_DELIVERY, F.lit("cash_on_delivery"))
            .otherwise(F.lit("online")))


def delivery_type(c, default: str = "unknown") -> Column:
    c = col_of(c)
    out = F.when(c.isNull(), F.lit("unknown"))
    for values, label in DELIVERY_RULES:
        out = out.when(c.isin(*values), F.lit(label))
    return out.otherwise(F.lit(default))


def width_category(c) -> Column:
    x = col_of(c)
    return (F.when(x.isNull(), F.lit("unknown"))
            .when((x < WIDTH_RANGE[0]) | (x > WIDTH_RANGE[1]), F.lit("anomaly"))
            .when(x < WIDTH_SMALL_BELOW, F.lit("small"))
            .when(x <= WIDTH_NORMAL_TO, F.lit("normal"))
            .otherwise(F.lit("large")))


def height_bin(c) -> Column:
    x = col_of(c)
    return (F.when(x.isNull(), F.lit("unknown"))
            .when(x <= HEIGHT_SMALL_TO, F.lit("small"))
            .when(x <= HEIGHT_MEDIUM_TO, F.lit("medium"))
            .otherwise(F.lit("large")))


def referrer_site(c) -> Column:
    """Brand keyword in the URL -> site class; NULL/empty -> unknown."""
    x = col_of(c)
    out = first_keyword_category(x, [(k, k) for k in REFERRER_SITES], default="other")
    return F.when(x.isNull() | (x == ""), F.lit("unknown")).otherwise(out)


def referrer_category(c) -> Column:
    """Topic keyword of the URL's last path segment (first match in list order)."""
    x = col_of(c)
    last = F.substring_index(x, "/", -1)
    out = first_keyword_category(last, [(k, k) for k in REFERRER_CATEGORIES], default="other")
    return F.when(x.isNull() | (x == "") | (last == ""), F.lit("unknown")).otherwise(out)


def tag_category(c) -> Column:
    x = col_of(c)
    out = first_keyword_category(x, [(k, k) for k in TAG_CATEGORIES], default="unknown")
    return F.when(x.isNull() | (x == ""), F.lit("unknown")).otherwise(out)


def site_family(c) -> Column:
    """Apply the domain family rules in order; each rule sees the previous result."""
    x = col_of(c)
    for label, contains, prefix, suffix, infix in SITE_FAMILIES:
        cond = x.startswith(prefix) | x.endswith(suffix) | x.contains(infix)
        if contains:
            cond = cond | x.contains(contains)
        x = F.when(F.coalesce(cond, F.lit(False)), F.lit(label)).otherwise(x)
    return x


def utm_parts(c) -> Column:
    """Array of the 10 '_'-separated parts, or ten 'unknown' when the count differs.

    NULL is parsed as its text form (one part), hence all 'unknown'.
    """
    parts = F.split(F.coalesce(col_of(c).cast("string"), F.lit("None")), "_", -1)
    return F.when(F.size(parts) == UTM_PARTS, parts).otherwise(
        F.array_repeat(F.lit("unknown"), UTM_PARTS))


def utm_device(c) -> Column:
    d = F.element_at(utm_parts(c), 5)
    return F.when(d.isin(*UTM_UNKNOWN_DEVICE), F.lit("unknown")).otherwise(d)


def utm_id(c, k: int) -> Column:
    """Numeric id from part k (1-based); anything non-numeric -> -1."""
    from tabsieve.functions.text import safe_bigint
    return F.coalesce(safe_bigint(F.element_at(utm_parts(c), k)), F.lit(-1).cast("bigint"))
