"""Date detection, normalisation, pair ordering and calendar features.

Detection looks at every column in one aggregate pass (shares by ``avg`` of
predicates); ordering statistics for all column pairs come from one more
aggregate pass. Conversion is a single projection.
"""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.text import col_of, regex_trim
from tabsieve.operators.pairs import order_counts
from tabsieve.operators.profile import c_, settle, wide_row_to_long

# Name hints, accepted epoch window (2000-01-01 .. 2036-01-01 in seconds),
# date-text prefix pattern.
DATE_NAME_HINTS = ("date", "dt", "time", "created", "updated", "closed", "returned", "received", "paid")
EPOCH_S_LO, EPOCH_S_HI = 946684800, 2082758400
DATE_TEXT_PATTERN = r"^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s",
                "d-M-yyyy", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy"]


def has_date_name_hint(name: str, ts_suffix: str = "_ts") -> bool:
    low = name.lower()
    return low.endswith(ts_suffix) or any(h in low for h in DATE_NAME_HINTS)


def _shape(fmt: str) -> str:
    """Pattern of every text that ``fmt`` can parse: a number per field (four digits at least for ``yyyy``)."""
    field = lambda m: r"[+-]?[0-9]{4,}" if m[0] == "yyyy" else "T" if m[0] == "'T'" else r"[+-]?[0-9]+"
    return "(?i)^" + re.sub(r"yyyy|'T'|[A-Za-z]", field, fmt.replace(".", r"\.")) + "$"


def parse_date_text(c) -> Column:
    return parse_trimmed(regex_trim(col_of(c).cast("string")))


def parse_trimmed(s: Column) -> Column:
    """A failed parse is slow, so a format is tried only on texts of its shape."""
    return F.coalesce(*[F.when(s.rlike(_shape(f)), F.try_to_timestamp(s, F.lit(f))) for f in DATE_FORMATS]).cast("timestamp_ntz")


def date_shares(df: DataFrame, cols=None) -> DataFrame:
    """(feature, numeric_share, s_share, ms_share, pattern_share, parse_share) over the
    non-NULL values of each column, all columns in one aggregate pass (no sampling)."""
    cols = list(cols) if cols is not None else list(df.columns)
    # the trimmed text and the number of a value are made once, below the aggregate that uses them several times
    texts = df.select(*[regex_trim(c_(c).cast("string")).alias(f"x{i}") for i, c in enumerate(cols)])
    found = texts.select("*", *[F.col(f"x{i}").try_cast("double").alias(f"v{i}") for i in range(len(cols))])
    aggs = []
    for i in range(len(cols)):
        txt, num = F.col(f"x{i}"), F.col(f"v{i}")
        nn = txt.isNotNull()
        num = F.when(~F.isnan(num), num)
        share = lambda cond: F.try_divide(F.sum(F.when(nn, F.coalesce(cond, F.lit(False)).cast("double"))),
                                          F.sum(nn.cast("double")))
        aggs += [share(num.isNotNull()).alias(f"n{i}"),
                 share(num.between(EPOCH_S_LO, EPOCH_S_HI)).alias(f"s{i}"),
                 share(num.between(EPOCH_S_LO * 1000, EPOCH_S_HI * 1000)).alias(f"m{i}"),
                 share(txt.rlike(DATE_TEXT_PATTERN)).alias(f"p{i}"),
                 share(parse_trimmed(txt).isNotNull()).alias(f"d{i}")]
    return wide_row_to_long(found.agg(*aggs), cols, {
        "numeric_share": "n", "s_share": "s", "ms_share": "m", "pattern_share": "p", "parse_share": "d"})


def detect_epoch_columns(shares: DataFrame, threshold: float = 0.80, ts_suffix: str = "_ts") -> DataFrame:
    """Hinted, mostly numeric columns whose values fall in the epoch window (ms wins ties)."""
    shares = settle(shares)  # read for the names and for the result, computed once
    names = [r["feature"] for r in shares.select("feature").collect()]  # one row per column
    hinted = [n for n in names if has_date_name_hint(n, ts_suffix)]
    unit = F.when(F.col("ms_share") >= F.col("s_share"), "ms").otherwise("s")
    best = F.greatest("ms_share", "s_share")
    return (shares.where(F.col("feature").isin(*hinted) if hinted else F.lit(False))
            .where((F.col("numeric_share") >= threshold) & (best >= threshold))
            .select("feature", unit.alias("best_unit"), best.alias("best_share")))


def detect_date_strings(shares: DataFrame, threshold: float = 0.80) -> DataFrame:
    return (shares.where((F.col("pattern_share") >= 0.5) & (F.col("parse_share") >= threshold))
            .select("feature", "pattern_share", "parse_share"))


def date_candidates(df: DataFrame, cols=None, threshold: float = 0.80, ts_suffix: str = "_ts") -> DataFrame:
    """(feature, kind, best_unit, parse_success_share, has_ts_suffix); numeric wins ties."""
    sh = settle(date_shares(df, cols))
    ep = detect_epoch_columns(sh, threshold, ts_suffix).select(
        "feature", F.lit("timestamp").alias("kind"), "best_unit", F.col("best_share").alias("_share"))
    st = detect_date_strings(sh, threshold).select(
        "feature", F.lit("string_date").alias("kind"), F.lit(None).cast("string").alias("best_unit"),
        F.col("parse_share").alias("_share"))
    both = ep.unionByName(st)
    w = Window.partitionBy("feature").orderBy(F.desc("_share"), F.desc(F.col("kind") == "timestamp"))
    best = both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")  # <= 2 rows per column
    return best.select("feature", "kind", "best_unit", F.round("_share", 4).alias("parse_success_share"),
                       F.col("feature").endswith(ts_suffix).alias("has_ts_suffix"))


MIN_SECONDS, MAX_SECONDS = -62135596800, 253402300799  # years 0001 to 9999


def normalized_name(name: str) -> str:
    for suf in ("_ts", "_at"):
        if name.endswith(suf):
            return name[: -len(suf)] + "_dt"
    if name.endswith("_date"):
        return name + "_dt"
    if name.endswith("_dt"):
        return name
    return name + "_dt"


def to_timestamp_by_unit(c, unit: str | None) -> Column:
    x = col_of(c)
    # text that is no number, and values beyond the years 0001-9999, become NULL
    if unit == "s":
        v = x.try_cast("double")
        return F.timestamp_seconds(F.when(v.between(MIN_SECONDS, MAX_SECONDS), v)).cast("timestamp_ntz")
    if unit == "ms":
        v = x.try_cast("bigint")
        return F.timestamp_millis(F.when(v.between(MIN_SECONDS * 1000, MAX_SECONDS * 1000), v)).cast("timestamp_ntz")
    return parse_date_text(x)


def normalize_dates(df: DataFrame, candidates: list[tuple[str, str | None]]) -> DataFrame:
    """Convert (column, unit) pairs to timestamps under the ``_dt`` name; drop the source.

    A name that does not change is converted in place; colliding targets raise.
    """
    targets = {}
    for c, unit in candidates:
        t = normalized_name(c)
        if t in targets.values() or (t in df.columns and t != c and t not in [x for x, _ in candidates]):
            raise ValueError(f"date column {c} would overwrite {t}")
        targets[c] = t
    units = dict(candidates)
    cols = []
    for c in df.columns:
        if c in targets:
            cols.append(to_timestamp_by_unit(c_(c), units[c]).alias(targets[c]))
        else:
            cols.append(c_(c))
    return df.select(*cols)


def parse_date_best(df: DataFrame, col: str, out: str) -> DataFrame:
    """Try text parse, epoch ms and epoch s; keep the parse with most non-NULL values
    (ties in that order)."""
    cands = [("text", parse_date_text(c_(col))), ("ms", to_timestamp_by_unit(c_(col), "ms")),
             ("s", to_timestamp_by_unit(c_(col), "s"))]
    safe = cands
    row = df.agg(*[F.count(e).alias(n) for n, e in safe]).first()
    best = max(safe, key=lambda t: (row[t[0]], -[n for n, _ in safe].index(t[0])))
    return df.withColumn(out, best[1])


def date_pair_stats(df: DataFrame, cols: list[str], min_rows: int = 30) -> DataFrame:
    """(left, right, n, le_share, lt_share, eq_share) for ordered pairs with >= min_rows joint rows."""
    pairs = list(itertools.permutations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "left string, right string, n bigint, le_share double, lt_share double, eq_share double")
    counts = order_counts(df, {c: F.unix_micros(c_(c).cast("timestamp")) for c in cols}, pairs)
    return (counts.where(F.col("n") >= min_rows).select(
        "left", "right", F.col("n").cast("bigint").alias("n"), *[F.try_divide(F.col(x), F.col("n")).alias(f"{x}_share")
                                                                 for x in ("le", "lt", "eq")]))


def date_order(stats: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Score columns: for each pair with le_share >= threshold, left -1 and right +1;
    order by (score, name)."""
    ok = stats.where(F.col("le_share") >= threshold)
    votes = ok.select(F.col("left").alias("feature"), F.lit(-1).alias("v")).unionByName(
        ok.select(F.col("right").alias("feature"), F.lit(1).alias("v")))
    return votes.groupBy("feature").agg(F.sum("v").cast("bigint").alias("order_score"))


# ------------------------------------------------------------- calendar
def calendar_parts(c, prefix: str) -> dict[str, Column]:
    """month, quarter, ISO week, weekday (Mon=0), weekend flag, hour, day; NULL -> -1."""
    x = col_of(c)
    neg = lambda e: F.coalesce(e.cast("int"), F.lit(-1))
    wd = F.weekday(x)
    return {
        f"{prefix}_month": neg(F.month(x)),
        f"{prefix}_quarter": neg(F.quarter(x)),
        f"{prefix}_week": neg(F.weekofyear(x)),
        f"{prefix}_weekday": neg(wd),
        f"{prefix}_weekend": neg((wd >= 5).cast("int")),
        f"{prefix}_hour": neg(F.hour(x)),
        f"{prefix}_day": neg(F.dayofmonth(x)),
    }


def expand_datetime_columns(df: DataFrame) -> DataFrame:
    """Every timestamp/date column -> year, month, day, weekday, hour; source dropped."""
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            x = c_(f.name)
            cols += [F.year(x).alias(f"{f.name}_year"), F.month(x).alias(f"{f.name}_month"),
                     F.dayofmonth(x).alias(f"{f.name}_day"), F.weekday(x).alias(f"{f.name}_weekday"),
                     F.hour(x).alias(f"{f.name}_hour")]
        else:
            cols.append(c_(f.name))
    return df.select(*cols)


def cyclic_day(c, period: float = 30.0) -> tuple[Column, Column]:
    d = F.dayofmonth(col_of(c)).cast("double")
    ang = F.lit(2 * math.pi) * d / F.lit(period)
    return F.coalesce(F.sin(ang), F.lit(-1.0)), F.coalesce(F.cos(ang), F.lit(-1.0))


def date_range_filter(df: DataFrame, col: str, start: str, end: str) -> DataFrame:
    """Inclusive range; ``end`` is midnight of the end date (pushed down to the scan)."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz")
    return df.where((c_(col) >= lo) & (c_(col) <= hi))


def date_out_of_range_to_null(c, start: str, end: str) -> Column:
    x = col_of(c)
    return F.when((x >= F.lit(start).cast("timestamp_ntz")) & (x <= F.lit(end).cast("timestamp_ntz")), x)

