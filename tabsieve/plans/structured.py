"""The structured lead feature set: eighteen named transforms, deferred drops and their statistics.

Every transform names the columns it needs, the columns it makes and the
columns that go once all transforms are done. Fitted parts (group means,
frequencies, top-k lists, the median delay) are small aggregates or joins on
the level; everything else is one projection.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabsieve.functions import rules as R
from tabsieve.functions import text as X
from tabsieve.operators import encode as E
from tabsieve.operators import transform as T
from tabsieve.operators.dates import date_out_of_range_to_null
from tabsieve.operators.profile import c_

# ---------------------------------------------------------------------------
# Fixed values (must match the reference's rules).
NO_CATEGORY = "Нет категории"
FEATURE_PHONE = "Кнопочный"
UTM_TERM_PLACEHOLDERS = ["Неизвестно"]
UTM_SKY_PLACEHOLDERS = ["{keyword}"]
UTM_SKY_AUTOTARGET = "---autotargeting"
UTM_SKY_TOPICS = [
    ("utm_sky_brand", "artraid|артрейд"),
    ("utm_sky_varicose", "варикоз|вены|флеболог"),
    ("utm_sky_sleep", "сон|sleep"),
]
PAID_TRAFFIC = "cpc|cpm"
PROBLEM_MAIN = [
    "Суставы и позвоночник",
    "Варикоз",
    "Сердечно-сосудистые заболевания",
    "Бессоница",
    "Головные боли",
    "Отеки",
    "Зрительная система",
    "Давление",
    "Инсульт",
    "Боли и тяжесть в ногах",
]
CAMPAIGN_TOP, SOURCE_TOP, TERM_TOP = 20, 20, 40
# ---------------------------------------------------------------------------

#: Prefix of the columns that count clipped dates while the transforms run.
CLIPPED = "_clipped_"


@dataclass
class Transform:
    name: str
    needs: list[str]
    makes: list[str]
    drops: list[str]
    apply: Callable[[DataFrame], DataFrame]


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _join_level(df: DataFrame, level: Column, stat: DataFrame, out: str) -> DataFrame:
    """Attach one value per level; ``stat`` has columns ``_level`` and ``out`` and one row per level, so rows of a hot
    level are split by the skew join."""
    return df.withColumn("_level", level).join(stat, "_level", "left").drop("_level")


def transforms(target: str = "buyout_flag", start: str | None = None, end: str | None = None) -> list[Transform]:
    """The eighteen transforms in order; with ``start`` and ``end``, dates outside them become NULL first (and a mark
    per transform counts them until the drops)."""
    def clipped(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        if not (start and end):
            return df
        inside = {c: date_out_of_range_to_null(c_(c), start, end) for c in cols}
        lost = [(c_(c).isNotNull() & x.isNull()).cast("int") for c, x in inside.items()]
        return df.withColumns({CLIPPED + name: functools.reduce(lambda a, b: a + b, lost)}).withColumns(inside)

    def group_quality(df):
        level = F.coalesce(c_("lead_group_id").cast("string"), F.lit("unknown"))
        stat = df.groupBy(level.alias("_level")).agg(F.avg(c_(target).cast("double")).alias("lead_group_quality"))
        return _join_level(df, level, stat, "lead_group_quality")

    def category_freq(df):
        c = c_("lead_Категория и варианты выбора")
        level = F.when(c.isNull() | (c == NO_CATEGORY), F.lit("unknown")).otherwise(c)
        n = df.count()
        stat = df.groupBy(level.alias("_level")).agg((F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias("lead_category_freq"))
        return _join_level(df, level, stat, "lead_category_freq")

    def contact_delay(df):
        df = clipped(df, ["contact_created_dt", "contact_updated_dt"], "contact_update_delay")
        return T.delay_days_features(df, "contact_created_dt", "contact_updated_dt", "contact_update_delay", fill="median")

    def delivery_delays(df):
        df = clipped(df, ["lead_created_dt", "handed_to_delivery_dt", "sale_date_dt"], "delivery_delays")
        df = T.delay_days_features(df, "lead_created_dt", "handed_to_delivery_dt", "lead_to_delivery_days")
        return T.delay_days_features(df, "sale_date_dt", "handed_to_delivery_dt", "sale_to_delivery")

    def assembly(df):
        end_col = "lead_Дата перехода в Сборку"
        df = T.capped_delay(clipped(df, ["lead_created_dt", end_col], "assembly_delay"), "lead_created_dt", end_col,
                            "lead_to_assembly")
        return df.withColumnRenamed("lead_to_assembly_flag", "assembly_flag")

    def grouped(col, missing, out, k, other, placeholders=()):
        def apply(df):
            v = X.placeholder_to_null(c_(col), list(placeholders)) if placeholders else c_(col)
            df = df.withColumn("_v", v)
            top = E.top_k_levels(df, "_v", k)
            return df.withColumns({missing: F.col("_v").isNull().cast("int"),
                                   out: E.top_k_group_expr("_v", top, other)}).drop("_v")
        return apply

    def utm_sky(df):
        v = X.placeholder_to_null(c_("lead_utm_sky"), UTM_SKY_PLACEHOLDERS)
        return df.withColumns({"utm_sky_missing": v.isNull().cast("int"), "utm_sky_autotarget": _flag(v == UTM_SKY_AUTOTARGET)}
                              | {name: _flag(F.lower(v).rlike(p)) for name, p in UTM_SKY_TOPICS})

    def whitelisted(col, missing, out, main):
        return lambda df: df.withColumns({missing: c_(col).isNull().cast("int"), out: X.whitelist_group(c_(col), main)})

    def with_(**columns):
        return lambda df: df.withColumns({name: make() for name, make in columns.items()})

    mass = "lead_Масса (гр)"
    return [
        Transform("width", ["lead_Ширина"], ["width_cat"], ["lead_Ширина"], with_(width_cat=lambda: R.width_category(c_("lead_Ширина")))),
        Transform("height", ["lead_Линейная высота (см)"], ["lead_height_known"], ["lead_Линейная высота (см)"],
                  with_(lead_height_known=lambda: T.known_flag(c_("lead_Линейная высота (см)")))),
        Transform("payment_type", ["lead_Вид оплаты"], ["lead_payment_type"], ["lead_Вид оплаты", "returned_dt"],
                  with_(lead_payment_type=lambda: R.payment_type(c_("lead_Вид оплаты")))),
        Transform("delivery_type", ["lead_Служба доставки"], ["lead_delivery_type"],
                  ["lead_Служба доставки", "lead_Компания Отправитель"],
                  with_(lead_delivery_type=lambda: R.delivery_type(c_("lead_Служба доставки")))),
        Transform("group_quality", ["lead_group_id", target], ["lead_group_quality"], ["lead_group_id"], group_quality),
        Transform("mass", ["lead_Масса (гр)"], ["lead_mass_known", "lead_mass_log"], ["lead_Масса (гр)", "lead_closed_dt"],
                  with_(lead_mass_known=lambda: T.known_flag(c_(mass)), lead_mass_log=lambda: T.log1p_nonnegative(c_(mass), fill=0.0))),
        Transform("contact_update_delay", ["contact_created_dt", "contact_updated_dt"], ["contact_update_delay_log"],
                  ["contact_created_dt", "contact_updated_dt"], contact_delay),
        Transform("paid_traffic", ["lead_utm_medium"], ["is_paid_traffic"], ["lead_utm_medium"],
                  with_(is_paid_traffic=lambda: _flag(F.lower(c_("lead_utm_medium")).rlike(PAID_TRAFFIC)))),
        Transform("category_freq", ["lead_Категория и варианты выбора"], ["lead_category_freq"],
                  ["lead_Категория и варианты выбора", "received_dt"], category_freq),
        Transform("phone_model", ["lead_Модель телефона"], ["is_feature_phone"],
                  ["lead_Модель телефона", "lead_Дата перехода Передан в доставку"],
                  with_(is_feature_phone=lambda: _flag(c_("lead_Модель телефона") == FEATURE_PHONE))),
        Transform("delivery_delays", ["lead_created_dt", "handed_to_delivery_dt", "sale_date_dt"],
                  ["lead_to_delivery_days_log", "lead_to_delivery_days_missing", "sale_to_delivery_log",
                   "sale_to_delivery_missing"], ["handed_to_delivery_dt"], delivery_delays),
        Transform("utm_campaign", ["lead_utm_campaign"], ["lead_utm_campaign_missing", "lead_utm_campaign_grouped"],
                  ["lead_utm_campaign"], grouped("lead_utm_campaign", "lead_utm_campaign_missing", "lead_utm_campaign_grouped",
                                                 CAMPAIGN_TOP, "unknown", R.UTM_CAMPAIGN_PLACEHOLDERS)),
        Transform("traffic_source", ["contact_Источник трафика"], ["traffic_source_missing", "traffic_source_grouped"],
                  ["contact_Источник трафика"], grouped("contact_Источник трафика", "traffic_source_missing",
                                                        "traffic_source_grouped", SOURCE_TOP, "other")),
        Transform("assembly_delay", ["lead_created_dt", "lead_Дата перехода в Сборку"],
                  ["assembly_flag", "lead_to_assembly_long", "lead_to_assembly_days"], ["lead_Дата перехода в Сборку"], assembly),
        Transform("utm_term", ["lead_utm_term"], ["utm_term_missing", "utm_term_grouped"], ["lead_utm_term"],
                  grouped("lead_utm_term", "utm_term_missing", "utm_term_grouped", TERM_TOP, "other", UTM_TERM_PLACEHOLDERS)),
        Transform("utm_sky", ["lead_utm_sky"], ["utm_sky_missing", "utm_sky_autotarget"] + [n for n, _ in UTM_SKY_TOPICS],
                  ["lead_utm_sky", "rejected_dt"], utm_sky),
        Transform("lead_group", ["lead_group"], ["lead_group_missing", "lead_group_grouped"], ["lead_group"],
                  whitelisted("lead_group", "lead_group_missing", "lead_group_grouped", R.LEAD_GROUP_MAIN)),
        Transform("problem_group", ["lead_Проблема"], ["problem_missing", "problem_grouped"], ["lead_Проблема"],
                  whitelisted("lead_Проблема", "problem_missing", "problem_grouped", PROBLEM_MAIN)),
    ]


def plan(df: DataFrame, steps: list[Transform]) -> DataFrame:
    """(transform, required, available, missing, runnable) without running anything."""
    rows = [(t.name, ",".join(t.needs), ",".join(c for c in t.needs if c in df.columns),
             ",".join(c for c in t.needs if c not in df.columns), all(c in df.columns for c in t.needs)) for t in steps]
    return df.sparkSession.createDataFrame(
        rows, "transform string, required string, available string, missing string, runnable boolean")


def _transformed(df: DataFrame, steps: list[Transform], strict: bool) -> tuple[DataFrame, list[str], list[Transform]]:
    """(all columns after the transforms, columns to drop, transforms that ran)."""
    out, gone, ran = df, [], []
    for t in steps:
        missing = [c for c in t.needs if c not in out.columns]
        if missing and strict:
            raise KeyError(f"transform {t.name} needs {missing}")
        if not missing:
            out = t.apply(out)
            gone += [c for c in t.drops if c in df.columns]
            ran.append(t)
    return out, gone, ran


def apply(df: DataFrame, steps: list[Transform], strict: bool = True) -> tuple[DataFrame, list[str]]:
    """(features, dropped columns): every transform in order, then the deferred drops.

    ``strict`` raises on a missing column; otherwise such a transform is left out, and its drops with it.
    """
    out, gone, _ = _transformed(df, steps, strict)
    return out.drop(*gone, *[c for c in out.columns if c.startswith(CLIPPED)]), gone


def write_observed(df: DataFrame, steps: list[Transform], path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Write the features under ``path``; returns (plan, statistics) observed while they were written.

    plan: (transform, required, missing, runnable, new_columns, dropped, skipped_drops, rows, filled, clipped), a row
    per transform; ``skipped_drops`` are columns to drop that the input lacks, ``filled`` the values of the new columns
    that are not NULL, ``clipped`` the dates that became NULL. statistics: (transform, feature, filled, mean, levels)
    with the mean of a numeric feature or the distinct values of a text feature. No second pass reads the features.
    """
    out, gone, ran = _transformed(df, steps, strict)
    text = {f.name for f in out.schema.fields if f.dataType.simpleString() == "string"}
    made = [(t.name, c) for t in ran for c in t.makes]
    clips = [t.name for t in ran if CLIPPED + t.name in out.columns]
    # text features are grouped: at most a few dozen levels by construction
    seen = [F.count(F.lit(1)).alias("rows")]
    for i, (_, c) in enumerate(made):
        seen.append(F.count(c_(c)).alias(f"n{i}"))
        seen.append((F.size(F.collect_set(c_(c))) if c in text else F.avg(c_(c).cast("double"))).alias(f"s{i}"))
    seen += [F.sum(F.col(CLIPPED + name)).alias(f"c{i}") for i, name in enumerate(clips)]
    watch = Observation("structured transforms")
    out.observe(watch, *seen).drop(*gone, *[CLIPPED + name for name in clips]).write.mode("overwrite").parquet(path)
    got = watch.get
    filled: dict[str, int] = {}
    stats = []
    for i, (name, c) in enumerate(made):
        filled[name] = filled.get(name, 0) + got[f"n{i}"]
        value = got[f"s{i}"]
        stats.append((name, c, got[f"n{i}"], None if c in text or value is None else float(value), value if c in text else None))
    lost = {name: got[f"c{i}"] or 0 for i, name in enumerate(clips)}
    rows = []
    for t in steps:
        runs = t in ran
        rows.append((t.name, ",".join(t.needs), ",".join(c for c in t.needs if c not in df.columns), runs,
                     ",".join(t.makes) if runs else "", ",".join(c for c in t.drops if runs and c in df.columns),
                     ",".join(c for c in t.drops if c not in df.columns), got["rows"] if runs else None,
                     filled.get(t.name) if runs else None, lost.get(t.name, 0) if runs else None))
    spark = df.sparkSession
    return (spark.createDataFrame(rows, "transform string, required string, missing string, runnable boolean, new_columns string, "
                                        "dropped string, skipped_drops string, rows long, filled long, clipped long"),
            spark.createDataFrame(stats, "transform string, feature string, filled long, mean double, levels long"))
