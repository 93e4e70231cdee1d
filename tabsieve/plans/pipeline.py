"""Composed plans: the audit (cleaning) pipeline and the feature transform chain.

Each step sees the previous step's output. Findings are small tables; drops
and new columns are lazy projections, so Catalyst collapses the whole chain
into one projection over the scan. The input is checkpointed once to the
shared checkpoint folder so that every audit pass reads the same snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions import rules as R
from tabsieve.functions import text as X
from tabsieve.operators import dates as D
from tabsieve.operators import encode as E
from tabsieve.operators import profile as P
from tabsieve.operators import transform as T


ROW_INDEX = "_row_index"


@dataclass
class AuditReport:
    target: str
    initial_shape: tuple
    steps: list = field(default_factory=list)   # (name, Findings, shape_before, shape_after)
    final_shape: tuple = (0, 0)

    def steps_table(self, spark) -> DataFrame:
        rows = []
        for i, (name, f, before, after) in enumerate(self.steps):
            for c in (f.drop or [None]):
                rows.append((i, name, c, before[0], before[1], after[1]))
        return spark.createDataFrame(rows, "step int, analyzer string, feature string, rows_before long, "
                                           "cols_before int, cols_after int")


def cleaning_pipeline(df: DataFrame, target: str, manual: dict[str, str] | None = None,
                      empty_threshold: float = 0.95, dominant_threshold: float = 1.0,
                      high_cardinality: bool = False, near_threshold: float = 0.95,
                      row_id: str | None = "row_id", order_cols: list[str] | None = None,
                      snapshot: bool = True) -> tuple[DataFrame, AuditReport]:
    """empty -> dominant -> (high cardinality) -> duplicates -> manual drop, then ``row_id``.

    The target is never dropped. ``row_id`` is the distributed 0..n-1 index in
    ``order_cols`` order (default: all input columns, so the id is deterministic).
    Rows are numbered first: the index settles the sorted input, and that one copy
    is what all audits read.
    """
    from tabsieve.operators.ordered import global_index
    if row_id:
        numbered = global_index(df, order_cols or list(df.columns), ROW_INDEX)
        df = numbered.drop(ROW_INDEX)
    elif snapshot:
        df = df.checkpoint(eager=True)
    n = df.count()
    rep = AuditReport(target, (n, len(df.columns)))
    cur = df

    def step(name, f):
        nonlocal cur
        f.drop = [c for c in f.drop if c != target]
        before = (n, len(cur.columns))
        cur = f.apply(cur)
        rep.steps.append((name, f, before, (n, len(cur.columns))))

    step("empty_features", P.drop_empty_columns(cur, empty_threshold))
    step("dominant_value", P.dominant_value(cur, threshold=dominant_threshold))
    if high_cardinality:
        step("high_cardinality", P.high_cardinality(cur))
    exact, _near = P.duplicate_columns(cur, near_threshold=near_threshold)
    step("duplicate_features", exact)
    step("manual_drop", P.manual_drop(cur, manual or {}))
    if row_id:
        kept = [P.c_(c) for c in cur.columns if c != row_id]
        cur = numbered.select(*kept, F.col(ROW_INDEX).alias(row_id))
    rep.final_shape = (n, len(cur.columns))
    return cur, rep


# ------------------------------------------------------------ feature chain
def transform_chain(df: DataFrame, steps: list) -> DataFrame:
    """Apply ``steps`` (DataFrame -> DataFrame) in order: ``df.transform(f1).transform(f2)...``.

    The two fitting steps (height quartiles, top groups) scan only the column they need, pruned down to the source.
    """
    for s in steps:
        df = df.transform(s)
    return df


def lead_feature_steps(time_col: str = "sale_ts", created_col: str = "lead_created_at") -> list:
    """The order-domain feature chain (column names of the raw lead table); the seconds->timestamp
    conversion of the sale time comes last, as in the reference chain."""
    def has(df, c):
        return c in df.columns

    def utm_campaign(df):
        if not has(df, "lead_utm_campaign"):
            return df
        v = X.placeholder_to_null("lead_utm_campaign", R.UTM_CAMPAIGN_PLACEHOLDERS)
        return df.withColumn("lead_utm_campaign", v).withColumn("lead_utm_campaign_missing", v.isNull().cast("int"))

    def height(df):
        c = "lead_Высота"
        if not has(df, c):
            return df
        df = df.withColumn("lead_height_known", F.col(c).isNotNull().cast("int"))
        df = T.iqr_clip_upper(df, c, 2.0, out="_h_clip")
        return (df.withColumn("lead_height_bin", R.height_bin("_h_clip")).drop("_h_clip")
                .withColumn(c, F.coalesce(F.col(c), F.lit(-1.0))))

    def weight(df):
        c = "lead_Вес (грамм)*"
        return df.withColumn("has_weight", F.col(f"`{c}`").isNotNull().cast("int")) if has(df, c) else df

    def payment(df):
        c = "lead_Вид оплаты"
        return df.withColumn("lead_payment_type", R.payment_type(F.col(f"`{c}`"))) if has(df, c) else df

    def delivery(df):
        c = "lead_Служба доставки"
        return df.withColumn("lead_delivery_type", R.delivery_type(F.col(f"`{c}`"), "other")) if has(df, c) else df

    def group(df):
        if not has(df, "lead_group"):
            return df
        return (df.withColumn("lead_group_missing", F.col("lead_group").isNull().cast("int"))
                .withColumn("lead_group_grouped", X.whitelist_group("lead_group", R.LEAD_GROUP_MAIN)))

    def delivery_cost(df):
        c = "lead_Стоимость доставки"
        if not has(df, c):
            if not has(df, "lead_shipping_cost"):
                return df
            v = F.col("lead_shipping_cost")
            return df.withColumns({"delivery_cost_missing": v.isNull().cast("int"),
                                   "lead_shipping_cost": F.coalesce(v, F.lit(-1.0))})
        v = T.parse_localised_number(F.col(f"`{c}`"))
        return df.withColumns({"delivery_cost_missing": v.isNull().cast("int"),
                               "lead_shipping_cost": F.coalesce(v, F.lit(-1.0)), c: F.coalesce(v, F.lit(-1.0))})

    def utm_group(df):
        if not has(df, "lead_utm_group"):
            return df
        df = df.withColumn("lead_utm_group", X.leading_letters("lead_utm_group"))
        return E.top_k_group(df, "lead_utm_group", 5, other="rare_utm_group", exclude_from_ranking=["unknown"])

    def referrer(df):
        if not has(df, "lead_utm_referrer"):
            return df
        return (df.withColumn("lead_utm_referrer_site", R.referrer_site("lead_utm_referrer"))
                .withColumn("lead_utm_referrer", R.referrer_category("lead_utm_referrer")))

    def tags(df):
        return df.withColumn("lead_tags", R.tag_category("lead_tags")) if has(df, "lead_tags") else df

    def utm_content(df):
        if not has(df, "lead_utm_content"):
            return df
        return (df.withColumn("lead_utm_device_type", R.utm_device("lead_utm_content"))
                .withColumn("lead_utm_id_1", R.utm_id("lead_utm_content", 1))
                .withColumn("lead_utm_id_3", R.utm_id("lead_utm_content", 3)))

    def creation_date(df):
        source = next((c for c in ("lead_Дата создания сделки", created_col) if has(df, c)), None)
        if source is None:
            return df
        dt = D.to_timestamp_by_unit(F.col(f"`{source}`"), "s")
        s, _ = D.cyclic_day(dt)
        return (df.withColumn("lead_creation_date_month", F.coalesce(F.month(dt), F.lit(-1)))
                .withColumn("lead_creation_date_quarter", F.coalesce(F.quarter(dt), F.lit(-1)))
                .withColumn("lead_creation_date_sin", s))

    def created_features(df):
        if not (has(df, time_col) and has(df, created_col)):
            return df
        dt = F.timestamp_seconds(F.col(created_col).cast("double")).cast("timestamp_ntz")
        return (df.withColumn("timedelta_between_sale_and_creation",
                              T.delta_seconds(F.col(time_col), F.col(created_col)))
                .withColumn("lead_created_ts", dt)
                .withColumn("lead_created_dayofweek", F.coalesce(F.weekday(dt), F.lit(-1))))

    def length(df):
        c = "lead_Длина"
        return df.withColumn("lead_length", F.coalesce(F.col(c), F.lit(-1))) if has(df, c) else df

    def sale_time(df):
        if not has(df, time_col):
            return df
        return df.withColumn(time_col, F.timestamp_seconds(F.col(time_col).cast("double")).cast("timestamp_ntz"))

    return [height, payment, delivery, group, delivery_cost, utm_group, referrer, tags, creation_date, created_features,
            length, utm_campaign, weight, utm_content, sale_time]
