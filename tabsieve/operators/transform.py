"""Missing values, outliers and numeric transforms.

Fitted statistics (medians, quartiles, quantile edges) are exact quantiles over
narrowing histograms (``exact_quantiles``) and are applied as literals, so ``transform`` is a pure projection that also runs on a stream.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.text import col_of, regex_trim
from tabsieve.operators.profile import real
from tabsieve.operators.quantiles import exact_quantiles
from tabsieve.operators.profile import STRING_LIKE, c_


# ------------------------------------------------------------ expressions
def missing_flag(c) -> Column:
    return col_of(c).isNull().cast("int")


def known_flag(c) -> Column:
    return col_of(c).isNotNull().cast("int")


def fill_constant(c, value) -> Column:
    return F.coalesce(col_of(c), F.lit(value))


def parse_localised_number(c) -> Column:
    """'515,06' -> 515.06; '-' and '' -> NULL; junk -> NULL."""
    s = regex_trim(col_of(c).cast("string"))
    s = F.when(~s.isin("-", ""), s)
    v = F.regexp_replace(s, ",", ".").try_cast("double")
    return F.when(~F.isnan(v), v)


def log1p_nonnegative(c, fill=None) -> Column:
    x = col_of(c).cast("double")
    v = F.when(x >= 0, F.log1p(x))
    return F.coalesce(v, F.lit(float(fill))) if fill is not None else v


def clip(c, lower=None, upper=None) -> Column:
    """Clip keeping NULL (``least``/``greatest`` skip NULL arguments)."""
    x = col_of(c)
    out = x
    if lower is not None:
        out = F.when(x.isNull(), None).otherwise(F.greatest(out, F.lit(lower)))
    if upper is not None:
        out = F.when(x.isNull(), None).otherwise(F.least(out, F.lit(upper)))
    return out


def ratio(a, b, plus_one: bool = True) -> Column:
    den = col_of(b) + F.lit(1) if plus_one else col_of(b)
    return F.try_divide(col_of(a).cast("double"), den.cast("double"))


def band_flag(c, lo: float, hi: float) -> Column:
    """1 when lo < x <= hi; NULL -> 0."""
    x = col_of(c)
    return F.coalesce((x > lo) & (x <= hi), F.lit(False)).cast("int")


def days_between(start, end) -> Column:
    """(end - start) in fractional days for epoch-second columns."""
    return (col_of(end).cast("double") - col_of(start).cast("double")) / 86400.0


def days_between_ts(start, end) -> Column:
    """Timestamp difference in fractional days (exact micro-seconds)."""
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end)) / 86400e6


def _days(df: DataFrame, start: str, end: str) -> Column:
    """Fractional days between two timestamp columns or two epoch-second columns."""
    times = (T.TimestampType, T.TimestampNTZType)
    if isinstance(df.schema[start].dataType, times) and isinstance(df.schema[end].dataType, times):
        return days_between_ts(c_(start), c_(end))
    return days_between(c_(start), c_(end))


def delta_seconds(a, b) -> Column:
    return col_of(a).cast("double") - col_of(b).cast("double")


def delta_hours_floor0(a, b) -> Column:
    h = delta_seconds(a, b) / 3600.0
    return F.when(h.isNull(), None).otherwise(F.greatest(h, F.lit(0.0)))


# ---------------------------------------------------------------- fitted
def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns."""
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


def fill_median(df: DataFrame, cols: list[str], fit_df: DataFrame | None = None) -> DataFrame:
    """NULL and NaN -> median fitted on ``fit_df`` (the train split), default the frame itself."""
    med = medians(fit_df if fit_df is not None else df, cols)
    return df.withColumns({c: F.coalesce(real(df, c), F.lit(med[c])) if med[c] is not None else c_(c)
                           for c in cols})


def coerce_features(df: DataFrame, categorical: list[str] | None = None,
                    missing: str = "missing") -> DataFrame:
    """Categoricals -> text with NULL as 'missing'; everything else -> double."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if categorical is None:
        categorical = [c for c, t in types.items() if isinstance(t, STRING_LIKE)]
    out = {}
    for c, t in types.items():
        if c in categorical:
            out[c] = F.coalesce(c_(c).cast("string"), F.lit(missing))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[c] = c_(c)
        else:
            v = c_(c).try_cast("double")
            out[c] = F.when(~F.isnan(v), v)
    return df.withColumns(out)


def iqr_fences(df: DataFrame, col: str, k: float = 1.5):
    q1, med, q3 = exact_quantiles(df, [col], [0.25, 0.5, 0.75])[col]
    if med is None:
        return None, None, None
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr, med


def iqr_outlier_to_median(df: DataFrame, col: str, out: str | None = None,
                          fit_df: DataFrame | None = None) -> DataFrame:
    lo, hi, med = iqr_fences(fit_df if fit_df is not None else df, col)
    x = real(df, col)
    if med is None:
        return df.withColumn(out or col, x)
    return df.withColumn(out or col, F.when((x < lo) | (x > hi), F.lit(med)).otherwise(x))


def iqr_clip_upper(df: DataFrame, col: str, k: float = 2.0, out: str | None = None,
                   fit_df: DataFrame | None = None) -> DataFrame:
    _, hi, _ = iqr_fences(fit_df if fit_df is not None else df, col, k)
    if hi is None:
        return df.withColumn(out or col, c_(col))
    return df.withColumn(out or col, clip(real(df, col), upper=hi))


def quantile_edges(df: DataFrame, col: str, q: int = 5) -> list[float]:
    probs = [i / q for i in range(q + 1)]
    edges = [e for e in exact_quantiles(df, [col], probs)[col] if e is not None]
    uniq = []
    for e in edges or []:
        if not uniq or e != uniq[-1]:
            uniq.append(e)
    return uniq


def quantile_bins(df: DataFrame, col: str, out: str, q: int = 5,
                  fit_df: DataFrame | None = None) -> DataFrame:
    """Equal-frequency bins with duplicate edges merged; bin i covers (e_i, e_{i+1}],
    the first bin includes its lower edge; NULL and out-of-range -> NULL."""
    edges = quantile_edges(fit_df if fit_df is not None else df, col, q)
    x = real(df, col)
    if len(edges) < 2:
        return df.withColumn(out, F.lit(None).cast("int"))
    expr = F.when(x.isNull(), None)
    expr = expr.when((x >= edges[0]) & (x <= edges[1]), F.lit(0))
    for i in range(1, len(edges) - 1):
        expr = expr.when((x > edges[i]) & (x <= edges[i + 1]), F.lit(i))
    return df.withColumn(out, expr.cast("int"))


def above_median_flag(df: DataFrame, col: str, out: str, fit_df: DataFrame | None = None) -> DataFrame:
    med = medians(fit_df if fit_df is not None else df, [col])[col]
    return df.withColumn(out, F.coalesce(real(df, col) > F.lit(med), F.lit(False)).cast("int"))


def delay_days_features(df: DataFrame, start: str, end: str, prefix: str,
                        fill: str = "neg1") -> DataFrame:
    """end - start in days; negatives -> NULL; log1p; missing flag; fill -1 or the median."""
    d = _days(df, start, end)
    d = F.when(d >= 0, d)
    out = df.withColumn(f"_{prefix}_d", d)
    if fill == "median":
        med = medians(out, [f"_{prefix}_d"])[f"_{prefix}_d"]
        med = 0.0 if med is None else med
        out = out.withColumn(f"{prefix}_log", F.log1p(F.coalesce(F.col(f"_{prefix}_d"), F.lit(med))))
    else:
        lg = F.log1p(F.col(f"_{prefix}_d"))
        out = (out.withColumn(f"{prefix}_missing", lg.isNull().cast("int"))
               .withColumn(f"{prefix}_log", F.coalesce(lg, F.lit(-1.0))))
    return out.drop(f"_{prefix}_d")


def capped_delay(df: DataFrame, start: str, end: str, prefix: str, cap: float = 30.0) -> DataFrame:
    """delay + 1 day; event flag; long flag (> cap); capped value with -1 fill."""
    d = _days(df, start, end) + 1.0
    return df.withColumns({
        f"{prefix}_flag": c_(end).isNotNull().cast("int"),
        f"{prefix}_long": F.coalesce(d > cap, F.lit(False)).cast("int"),
        # least skips NULL, so a missing delay is told apart first
        f"{prefix}_days": F.when(d.isNull(), F.lit(-1.0)).otherwise(F.least(d, F.lit(cap))),
    })


def standard_scale(df: DataFrame, cols: list[str], fit_df: DataFrame | None = None) -> DataFrame:
    """Zero mean, unit *population* std (0 std -> value 0)."""
    src = fit_df if fit_df is not None else df
    row = src.agg(*[F.avg(c_(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c_(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        mu, sd = row[f"a{i}"], row[f"s{i}"]
        if sd is None or sd == 0 or math.isnan(sd):
            out[c] = F.when(c_(c).isNotNull(), F.lit(0.0))
        else:
            out[c] = (c_(c) - F.lit(mu)) / F.lit(sd)
    return df.withColumns(out)
