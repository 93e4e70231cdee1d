"""Association and correlation: Pearson (ANSI-safe), Cramér's V, leak screen.

Pearson uses pairwise-complete moments: ``covar_pop / (stddev_pop * stddev_pop)``
over rows where both values exist, with ``try_divide`` so a zero-variance
column yields NULL instead of an ANSI divide-by-zero. Cramér's V is built
from one ``groupBy(feature, value, target)`` over an unpivot of all
categorical columns (one shuffle for all of them, map-side combined).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.text import normalize_text, safe_binary_target, safe_double
from tabsieve.operators.pairs import moment_sums
from tabsieve.operators.profile import Findings, c_


def pearson(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    xb, yb = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(xb, yb), F.stddev_pop(xb) * F.stddev_pop(yb))
    return r, F.count(xb)


def pearson_table(df: DataFrame, pairs: list[tuple[str, Column, str, Column]],
                  means: dict | None = None) -> DataFrame:
    """(left, right, corr, n) for pairs of numeric expressions, pairwise complete.

    Two cheap passes instead of one heavy one: column means (used only as a
    shift against cancellation), then six plain sums per pair over shifted
    values where both sides exist. r is NULL when a side has zero variance.
    """
    exprs: dict[str, Column] = {}
    for a, xa, b, xb in pairs:
        exprs.setdefault(a, xa)
        exprs.setdefault(b, xb)
    names = list(exprs)
    idx = {n: i for i, n in enumerate(names)}
    if means is None:
        row = df.agg(*[F.avg(exprs[n]).alias(f"m{i}") for i, n in enumerate(names)]).first()
        means = {n: row[f"m{idx[n]}"] for n in names}
    shifted = {n: exprs[n] - F.lit(means.get(n) or 0.0) for n in names}
    values = {n: F.when(~F.isnan(shifted[n]), shifted[n]) for n in names}
    j = moment_sums(df, values, [(a, b) for a, _, b, _ in pairs])
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((vx > 0) & (vy > 0), F.greatest(F.least(cov / F.sqrt(vx * vy), F.lit(1.0)), F.lit(-1.0)))
    return j.select("left", "right", r.alias("corr"), F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def coerced_number(df: DataFrame, name: str) -> Column | None:
    """Numeric view of any column, as a to-number coercion would see it: numbers as they are,
    timestamps as epoch seconds, booleans as 0/1, text parsed (failures and NaN -> NULL)."""
    t = {f.name: f.dataType for f in df.schema.fields}[name]
    x = c_(name)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(x.cast("timestamp")) / 1e6) if isinstance(t, T.TimestampType) else \
            F.unix_timestamp(x).cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(t, T.BooleanType):
        return x.cast("double")
    if isinstance(t, T.StringType):
        return safe_double(x, t)
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                      T.DecimalType)):
        return x.cast("double")
    return None


def numeric_target_corr(df: DataFrame, target: str, cols=None, min_rows: int = 30,
                        min_abs: float = 0.05) -> DataFrame:
    """(feature, corr, n) of every number-coercible column with the target (pairwise complete);
    |r| >= min_abs, n >= min_rows. Without ``cols`` every column is coerced (text that parses,
    timestamps as epoch seconds); columns with no numeric rows drop out by ``min_rows``."""
    cols = [c for c in (cols if cols is not None else df.columns) if c != target]
    y = _binary(df, target)
    pairs = [(c, e, "\0target", y) for c in cols if (e := coerced_number(df, c)) is not None]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature string, corr double, n bigint")
    long = pearson_table(df, pairs)
    return (long.where(F.col("corr").isNotNull() & (F.col("n") >= min_rows) & (F.abs("corr") >= min_abs))
            .select(F.col("left").alias("feature"), F.round("corr", 4).alias("corr"), "n"))


def numeric_feature_corr(df: DataFrame, cols=None, min_rows: int = 30, min_abs: float = 0.80) -> DataFrame:
    """(left, right, corr, n) for pairs of number-coercible columns with |r| >= min_abs
    (pairwise complete). Columns with fewer than ``min_rows`` numeric values are left out
    first (counted in the same pass as the means), so only usable columns form pairs."""
    cols = list(cols) if cols is not None else list(df.columns)
    exprs = {c: e for c in cols if (e := coerced_number(df, c)) is not None}
    if not exprs:
        return df.sparkSession.createDataFrame([], "left string, right string, corr double, n bigint")
    # one pass: numeric counts (usable columns) and means (shift against cancellation)
    valid = {c: F.when(~F.isnan(e), e) for c, e in exprs.items()}
    row = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(valid.values())],
                 *[F.avg(v).alias(f"m{i}") for i, v in enumerate(valid.values())]).first()
    usable = [c for i, c in enumerate(exprs) if row[f"n{i}"] >= min_rows]
    means = {c: row[f"m{i}"] for i, c in enumerate(exprs)}
    pairs = [(a, exprs[a], b, exprs[b]) for a, b in itertools.combinations(usable, 2)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, corr double, n bigint")
    long = pearson_table(df, pairs, means)
    return (long.where(F.col("corr").isNotNull() & (F.col("n") >= min_rows) & (F.abs("corr") >= min_abs))
            .select("left", "right", F.round("corr", 4).alias("corr"), "n"))


def binary_target(df: DataFrame, target: str) -> Column:
    """0/1 view of the target; numeric targets skip the text path (same result, no string work)."""
    t = {f.name: f.dataType for f in df.schema.fields}[target]
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                      T.DecimalType)):
        x = c_(target).cast("double")
        return F.when(x.isin(0.0, 1.0), x)
    return safe_binary_target(c_(target))


_binary = binary_target


def contingency(df: DataFrame, cols: list[str], target, binary_target: bool = False) -> DataFrame:
    """(feature, value, y, o) cell counts for several columns against one target.

    Values are the trimmed text with '' treated as missing; with ``binary_target`` the
    target is first coerced to 0/1 (text such as yes/no included)."""
    y = _binary(df, target) if binary_target else c_(target)
    long = df.select(y.alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.nullif(normalize_text(c_(c)), F.lit("")).alias("value"))
        for c in cols])))
    return (long.where(F.col("value").isNotNull() & F.col("_y").isNotNull())
            .groupBy("feature", "value", F.col("_y").alias("y")).agg(F.count(F.lit(1)).alias("o")))


def cramers_v_table(cells: DataFrame) -> DataFrame:
    """(feature, cramers_v, n, levels) from cell counts.

    chi2 = n * (sum o^2 / (row * col) - 1); V = sqrt(chi2 / n / min(r-1, k-1)); 0 when degenerate.
    Empty cells contribute nothing to the sum, exactly like the full table.
    """
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("_row"))
    colsum = cells.groupBy("feature", "y").agg(F.sum("o").alias("_col"))
    j = cells.join(rows, ["feature", "value"]).join(colsum, ["feature", "y"])
    per = j.groupBy("feature").agg(
        F.sum(F.col("o") * F.col("o") / (F.col("_row") * F.col("_col"))).alias("_s"),
        F.sum("o").alias("n"), F.count_distinct("value").alias("r"), F.count_distinct("y").alias("k"))
    denom = F.least(F.col("r"), F.col("k")) - 1
    chi2 = F.col("n") * (F.col("_s") - 1)
    v = F.when(denom > 0, F.sqrt(F.greatest(chi2 / F.col("n") / denom, F.lit(0.0)))).otherwise(F.lit(0.0))
    return per.select("feature", v.alias("cramers_v"), "n", F.col("r").cast("bigint").alias("levels"))


def binary_cramers_v(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """(feature, cramers_v, n, levels) against a 0/1 target: both class counts stand in one row per level, and one
    aggregate per feature adds count^2 / row total per class, so no table of levels is joined."""
    y = _binary(df, target)
    long = df.select(y.alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.nullif(normalize_text(c_(c)), F.lit("")).alias("value")) for c in cols])))
    rows = (long.where(F.col("value").isNotNull() & F.col("_y").isNotNull()).groupBy("feature", "value")
            .agg(F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).alias("a"),
                 F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("b")))
    total = F.col("a") + F.col("b")
    per = rows.groupBy("feature").agg(
        F.sum(F.col("a") * F.col("a") / total).alias("sa"), F.sum(F.col("b") * F.col("b") / total).alias("sb"),
        F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count(F.lit(1)).alias("levels"))
    n = F.col("na") + F.col("nb")
    classes = (F.col("na") > 0).cast("int") + (F.col("nb") > 0).cast("int")
    denom = F.least(F.col("levels"), classes) - 1
    share = F.coalesce(F.try_divide("sa", "na"), F.lit(0.0)) + F.coalesce(F.try_divide("sb", "nb"), F.lit(0.0))
    v = F.when(denom > 0, F.sqrt(F.greatest((share - 1) / denom, F.lit(0.0)))).otherwise(F.lit(0.0))
    return per.select("feature", v.alias("cramers_v"), n.alias("n"), F.col("levels").cast("bigint").alias("levels"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    return cramers_v_table(contingency(df, [x], y))


def categorical_target_assoc(df: DataFrame, target: str, cols=None, min_levels: int = 2,
                             max_levels: int = 100, min_rows: int = 30, min_v: float = 0.05) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
               T.BooleanType)
    cols = [c for c in (cols if cols is not None else df.columns)
            if c != target and not isinstance(types[c], numeric)]  # every non-numeric column
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, cramers_v double, n bigint, levels bigint")
    t = binary_cramers_v(df, target, cols)
    return (t.where((F.col("levels") >= min_levels) & (F.col("levels") <= max_levels)
                    & (F.col("n") >= min_rows) & (F.col("cramers_v") >= min_v))
            .select("feature", F.round("cramers_v", 4).alias("cramers_v"), "n", "levels"))


def leak_screen(df: DataFrame, target: str, known_leaks: list[str] | None = None,
                corr_limit: float = 0.8, v_limit: float = 0.8) -> Findings:
    """Flag post-event fields: a fixed list of known leak columns plus any column whose
    |Pearson r| or Cramér's V with the target reaches the limit."""
    num = numeric_target_corr(df, target, min_abs=corr_limit).select(
        "feature", F.lit("target_corr").alias("reason"), F.abs("corr").alias("strength"))
    cat = categorical_target_assoc(df, target, min_v=v_limit).select(
        "feature", F.lit("target_assoc").alias("reason"), F.col("cramers_v").alias("strength"))
    found = num.unionByName(cat)
    if known_leaks:
        present = [c for c in known_leaks if c in df.columns]
        fixed = df.sparkSession.createDataFrame([(c, "known_leak", None) for c in present],
                                                "feature string, reason string, strength double")
        found = found.unionByName(fixed)
    names = sorted({r["feature"] for r in found.select("feature").collect()})  # <= #columns
    return Findings("leak_screen", found, names)
