"""Column profiling and audit.

Every audit looks at all requested columns in one or two distributed passes:
a single global ``agg`` (one partial aggregate per task, one tiny final
stage) or one ``inline(array(struct))`` unpivot followed by a single
``groupBy`` whose map-side partial aggregation absorbs hot values. Findings
are small DataFrames (one row per column or column pair); ``apply`` is a
lazy projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.text import (
    is_empty, non_empty_text, normalize_text,
)
from tabsieve.operators.pairs import equality_counts, similar_pairs

STRING_LIKE = (T.StringType, T.VarcharType, T.CharType)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def q(name: str) -> str:
    """Backtick-quote a column name (names may hold spaces or Cyrillic)."""
    return "`" + name.replace("`", "``") + "`"


def c_(name: str):
    return F.col(q(name))


def _cols(df: DataFrame, cols) -> list[str]:
    return list(cols) if cols is not None else list(df.columns)


def string_like_columns(df: DataFrame, cols=None) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in _cols(df, cols) if isinstance(types[c], STRING_LIKE)]


def numeric_columns(df: DataFrame, cols=None) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in _cols(df, cols) if isinstance(types[c], NUMERIC)]


def wide_row_to_long(row_df: DataFrame, names: list[str], value_cols: dict[str, str],
                     key: str = "feature") -> DataFrame:
    """Turn a one-row frame with aliases ``{prefix}{i}`` into one row per name."""
    structs = []
    for i, n in enumerate(names):
        fields = [F.lit(n).alias(key)]
        for out_name, prefix in value_cols.items():
            fields.append(F.col(f"{prefix}{i}").alias(out_name))
        structs.append(F.struct(*fields))
    if not structs:
        schema = ", ".join([f"{key} string"] + [f"{k} double" for k in value_cols])
        return row_df.sparkSession.createDataFrame([], schema)
    return row_df.select(F.inline(F.array(*structs)))


# ---------------------------------------------------------------- empty share
def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def empty_expr(name: str, dtype) -> "F.Column":
    """Type-aware form of ``is_empty``: a number's text is never blank or a token other
    than 'nan', so numbers are empty only when NULL or NaN and timestamps only when
    NULL. Same result, no per-value string formatting."""
    x = c_(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return x.isNull() | F.isnan(x)
    if isinstance(dtype, NUMERIC + (T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
        return x.isNull()
    return is_empty(x)


def value_text_expr(name: str, dtype) -> "F.Column":
    """Type-aware ``non_empty_text``: strings are trimmed; other types only need the cast."""
    x = c_(name)
    if isinstance(dtype, STRING_LIKE) or not isinstance(
            dtype, NUMERIC + (T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
        return non_empty_text(x)
    return F.when(~empty_expr(name, dtype), x.cast("string"))


def empty_share(df: DataFrame, cols=None) -> DataFrame:
    """(feature, empty_share): share of rows whose normalised text is an empty token."""
    cols = _cols(df, cols)
    ty = _types(df)
    row = df.agg(*[F.avg(empty_expr(c, ty[c]).cast("double")).alias(f"e{i}")
                   for i, c in enumerate(cols)])
    return wide_row_to_long(row, cols, {"empty_share": "e"})


def settle(findings: DataFrame) -> DataFrame:
    """Materialise a findings table (one row per column or column pair) once.

    The rows are bounded by the number of columns (or pairs), so they are
    collected and re-created as a local relation: later uses (drop list,
    report, query result) do not rerun the audit pass over the data.
    """
    rows = findings.collect()
    return findings.sparkSession.createDataFrame(rows, findings.schema)


@dataclass
class Findings:
    """Result of an audit: a small findings DataFrame plus the columns to drop."""
    name: str
    table: DataFrame
    drop: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.drop if c in df.columns])


def drop_empty_columns(df: DataFrame, threshold: float = 0.95, cols=None) -> Findings:
    shares = empty_share(df, cols)
    flagged = (shares.where(F.col("empty_share") >= threshold)
               .select("feature", F.round("empty_share", 4).alias("empty_share")))
    table = settle(flagged)
    return Findings("empty_features", table, [r["feature"] for r in table.collect()])


# ------------------------------------------------------------- value counts
def value_counts_long(df: DataFrame, cols=None) -> DataFrame:
    """(feature, value, count) of non-empty normalised values of every column.

    One unpivot + one groupBy: partial aggregation on the map side collapses a
    hot value to one row per task before the shuffle.
    """
    cols = _cols(df, cols)
    ty = _types(df)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), value_text_expr(c, ty[c]).alias("value"))
        for c in cols])))
    return (long.where(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt")))


def column_level_stats(vc: DataFrame) -> DataFrame:
    """Per column: non-empty count, distinct count and the top value (count desc, value asc)."""
    return vc.groupBy("feature").agg(
        F.sum("cnt").alias("non_empty_count"),
        F.count(F.lit(1)).alias("nunique"),
        F.min_by(F.struct(F.col("value"), F.col("cnt")),
                 F.struct((-F.col("cnt")).alias("nc"), F.col("value"))).alias("top"),
    ).select("feature", F.col("top.value").alias("top_value"),
             F.col("top.cnt").alias("top_count"), "non_empty_count", "nunique")


BUCKETS = 1024  # hash buckets per column that decide which columns can hold a dominant value


def bucket_candidates(df: DataFrame, cols: list[str], threshold: float, min_non_empty: int) -> list[str]:
    """Columns where some hash bucket of values holds the threshold's share: a value cannot hold more than its
    bucket, so no dominant value is missed. At most ``BUCKETS`` counts per column leave a task."""
    ty = _types(df)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), value_text_expr(c, ty[c]).alias("v")) for i, c in enumerate(cols)])))
    counts = (long.where("v is not null").groupBy("i", F.pmod(F.xxhash64("v"), F.lit(BUCKETS)).alias("b"))
              .agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.max("n").alias("top"), F.sum("n").alias("n")))
    rows = counts.where((F.col("n") >= min_non_empty) & (F.col("top") / F.col("n") >= threshold)).collect()
    return [cols[i] for i in sorted(r["i"] for r in rows)]


def dominant_value(df: DataFrame, cols=None, threshold: float = 1.0,
                   min_non_empty: int = 3) -> Findings:
    """Columns whose most frequent value holds at least ``threshold`` of the non-empty rows. Values are counted only
    for columns that can pass, so id-like columns are never shuffled value by value."""
    cols = bucket_candidates(df, _cols(df, cols), threshold, min_non_empty)
    if not cols:
        empty = df.sparkSession.createDataFrame(
            [], "feature string, top_value string, top_count bigint, non_empty_count bigint, top_share double, nunique bigint")
        return Findings("dominant_value", empty, [])
    st = column_level_stats(value_counts_long(df, cols))
    share = F.col("top_count") / F.col("non_empty_count")
    flagged = (st.where((F.col("non_empty_count") >= min_non_empty) & (share >= threshold))
               .select("feature", "top_value", "top_count", "non_empty_count",
                       F.round(share, 4).alias("top_share"), "nunique"))
    table = settle(flagged)
    rows = table.orderBy(F.desc("top_share"), "nunique", "feature").collect()
    return Findings("dominant_value", table, [r["feature"] for r in rows])


def hashed_levels(df: DataFrame, texts: list, aggs: list, keep=()) -> DataFrame:
    """One row per column number ``i`` and distinct non-NULL text, told apart by two independent 64-bit hashes.

    Texts stay in the task that reads them: hashes, the ``keep`` expressions over the text ``v`` and partial ``aggs``
    are all that is shuffled.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), t.alias("v")) for i, t in enumerate(texts)])))
    rows = long.where("v is not null").select("i", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"), *keep)
    return rows.groupBy(*rows.columns).agg(*aggs)


def high_cardinality(df: DataFrame, cols=None, share_threshold: float = 0.90,
                     min_unique: int = 50, only_string_like: bool = True) -> Findings:
    """Columns whose exact distinct share reaches the threshold."""
    cols = string_like_columns(df, cols) if only_string_like else _cols(df, cols)
    if not cols:
        empty = df.sparkSession.createDataFrame(
            [], "feature string, nunique bigint, non_empty_count bigint, unique_share double")
        return Findings("high_cardinality", empty, [])
    ty = _types(df)
    st = hashed_levels(df, [value_text_expr(c, ty[c]) for c in cols], [F.count(F.lit(1)).alias("cnt")]).groupBy("i").agg(
        F.sum("cnt").alias("non_empty_count"), F.count(F.lit(1)).alias("nunique"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, feature string")  # one row per column
    st = names.join(st, "i")
    share = F.col("nunique") / F.col("non_empty_count")
    flagged = (st.where((F.col("nunique") >= min_unique) & (share >= share_threshold))
               .select("feature", "nunique", "non_empty_count",
                       F.round(share, 4).alias("unique_share")))
    table = settle(flagged)
    rows = table.orderBy(F.desc("unique_share"), F.desc("nunique"), "feature").collect()
    return Findings("high_cardinality", table, [r["feature"] for r in rows])


# --------------------------------------------------------------- duplicates
def column_pair_stats(df: DataFrame, cols=None, pairs=None) -> DataFrame:
    """(left, right, mismatches, comparable, equal_comparable) for column pairs, in one pass (``pairs``)."""
    cols = _cols(df, cols)
    if pairs is None:
        pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "left string, right string, mismatches bigint, comparable bigint, "
                "equal_comparable bigint")
    texts = {c: normalize_text(c_(c)) for c in dict.fromkeys(c for p in pairs for c in p)}
    counts = equality_counts(df, texts, pairs)
    # unequal values are never both empty, so equal & comparable = comparable - mismatches
    return counts.withColumn("equal_comparable", F.col("comparable") - F.col("mismatches"))


def duplicate_columns(df: DataFrame, cols=None, near_threshold: float = 0.95) -> tuple[Findings, Findings]:
    """Exact duplicates (all normalised rows equal) and near duplicates (report only).

    Only pairs that a lower bound on their unequal rows cannot rule out are compared (``pairs.similar_pairs``).
    """
    cols = _cols(df, cols)
    texts = {c: F.coalesce(normalize_text(c_(c)), F.lit("")) for c in dict.fromkeys(cols)}
    rows = [(a, b, n, both, both - n) for a, b, n, both in similar_pairs(df, texts, near_threshold)]
    ps = df.sparkSession.createDataFrame(rows, "left string, right string, mismatches bigint, comparable bigint, "
                                               "equal_comparable bigint")
    sim = F.coalesce(F.col("equal_comparable") / F.when(F.col("comparable") > 0,
                                                         F.col("comparable")), F.lit(0.0))
    exact = ps.where(F.col("mismatches") == 0).select("left", "right",
                                                       F.lit(1.0).alias("similarity"))
    near = (ps.where((F.col("mismatches") > 0) & (sim >= near_threshold))
            .select("left", "right", F.round(sim, 4).alias("similarity")))
    order = {c: i for i, c in enumerate(cols)}
    drop: list[str] = []
    for r in sorted(exact.collect(), key=lambda r: (order[r["left"]], order[r["right"]])):
        if r["right"] not in drop:
            drop.append(r["right"])
    return Findings("exact_duplicates", exact, drop), Findings("near_duplicates", near, [])


def manual_drop(df: DataFrame, reasons: dict[str, str]) -> Findings:
    present = [(c, r) for c, r in reasons.items() if c in df.columns]
    spark = df.sparkSession
    table = spark.createDataFrame(present, "column string, reason string")
    return Findings("manual_drop", table, [c for c, _ in present])


# ------------------------------------------------------------ small ratios
def column_match_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(F.coalesce(c_(a) == c_(b), F.lit(False)).cast("double"))
                  .alias("match_rate"))


def real(df: DataFrame, col: str) -> Column:
    """The column with NaN as NULL; columns of other types as they are."""
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c_(col)), c_(col))
    return c_(col)


def order_share(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(F.coalesce(c_(a) > c_(b), F.lit(False)).cast("double"))
                  .alias("order_share"))


def missing_share(df: DataFrame, cols=None) -> DataFrame:
    """(feature, missing_pct): percent of NULL and NaN values per column."""
    cols = _cols(df, cols)
    row = df.agg(*[(F.avg(real(df, c).isNull().cast("double")) * 100.0).alias(f"m{i}")
                   for i, c in enumerate(cols)])
    return wide_row_to_long(row, cols, {"missing_pct": "m"})


def quartiles(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """Exact (q1, median, q3) per column."""
    from tabsieve.operators.quantiles import exact_quantiles
    return {c: tuple(v) for c, v in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).items()}


def outlier_share(df: DataFrame, cols=None) -> DataFrame:
    """(feature, outlier_pct): percent of non-null rows outside the 1.5*IQR fences."""
    cols = numeric_columns(df, cols)
    qs = quartiles(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        q1, _, q3 = qs[c]
        if q1 is None:
            aggs.append(F.lit(None).cast("double").alias(f"o{i}"))
            continue
        iqr = q3 - q1
        lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        x = real(df, c)
        out = (x < F.lit(lo)) | (x > F.lit(hi))
        aggs.append((F.sum(out.cast("double")) / F.count(x) * 100.0).alias(f"o{i}"))
    return wide_row_to_long(df.agg(*aggs), cols, {"outlier_pct": "o"})


def numeric_vs_text_levels(df: DataFrame, cols=None) -> DataFrame:
    """(feature, numeric_levels, text_levels): distinct values split by number-likeness."""
    cols = _cols(df, cols)
    texts = [F.when(c_(c).isNotNull(), normalize_text(c_(c))) for c in cols]
    is_num = F.col("v").try_cast("double").isNotNull().alias("is_num")
    per = (hashed_levels(df, texts, [F.lit(1).alias("one")], [is_num]).groupBy("i")
           .agg(F.sum(F.col("is_num").cast("long")).alias("n"), F.sum((~F.col("is_num")).cast("long")).alias("t")))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, feature string")  # one row per column
    return names.join(per, "i", "left").select("feature", F.coalesce("n", F.lit(0)).alias("numeric_levels"),
                                               F.coalesce("t", F.lit(0)).alias("text_levels"))


def describe_column(df: DataFrame, cols=None) -> DataFrame:
    """count / mean / sample std / min / exact quartiles / max per numeric column."""
    cols = numeric_columns(df, cols)
    qs = quartiles(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        x = real(df, c).cast("double")
        q1, q2, q3 = (F.lit(v).cast("double") for v in qs[c])
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(q1).alias(f"q1{i}"), F.max(q2).alias(f"q2{i}"), F.max(q3).alias(f"q3{i}"), F.max(x).alias(f"hi{i}")]
    return wide_row_to_long(df.agg(*aggs), cols, {
        "n": "n", "mean": "a", "std": "s", "min": "lo", "p25": "q1", "p50": "q2",
        "p75": "q3", "max": "hi"})


def split_columns_by_type(df: DataFrame, cols=None) -> DataFrame:
    """(feature, kind, non_null): kind from the schema (numeric / datetime / categorical)."""
    cols = _cols(df, cols)
    types = {f.name: f.dataType for f in df.schema.fields}

    def kind(t):
        if isinstance(t, NUMERIC):
            return "numeric"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "datetime"
        return "categorical"
    row = df.agg(*[F.count(c_(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("feature"), F.lit(kind(types[c])).alias("kind"),
                        F.col(f"n{i}").alias("non_null")) for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*structs)))


def target_rate_by_level(df: DataFrame, col: str, target: str) -> DataFrame:
    """Per level: row count of the target and its mean."""
    return df.groupBy(c_(col).alias(col)).agg(
        F.count(c_(target)).alias("n"), F.avg(c_(target).cast("double")).alias("target_rate"))


def row_number_desc(partition, *order):
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))
