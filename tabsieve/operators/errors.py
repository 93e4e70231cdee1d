"""Error analysis and dataset comparison.

All per-feature comparisons run as one aggregate (numeric means) or one
unpivot + ``groupBy(feature, value)`` (categorical shares) over every column
at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.profile import c_


def error_partitions(labelled: DataFrame, path: str, err: str = "error_type") -> None:
    """Full table plus one folder per error type (``partitionBy``) in one write."""
    labelled.write.mode("overwrite").partitionBy(err).parquet(path)


def numeric_mean_diff(df: DataFrame, cols: list[str], group_col: str, a: str, b: str) -> DataFrame:
    """(feature, <a>_mean, <b>_mean, signed_diff, abs_diff) for two groups, all columns in one agg."""
    aggs = []
    for i, c in enumerate(cols):
        x = c_(c).cast("double")
        aggs += [F.avg(F.when(F.col(group_col) == a, x)).alias(f"a{i}"),
                 F.avg(F.when(F.col(group_col) == b, x)).alias(f"b{i}")]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias(f"{a}_mean"), F.col(f"b{i}").alias(f"{b}_mean"))
               for i, c in enumerate(cols)]
    long = row.select(F.inline(F.array(*structs)))
    d = F.col(f"{a}_mean") - F.col(f"{b}_mean")
    return long.withColumn("signed_diff", d).withColumn("abs_diff", F.abs(d))


def categorical_share_diff(df: DataFrame, cols: list[str], group_col: str, a: str, b: str) -> DataFrame:
    """(feature, value, <a>_share, <b>_share, abs_diff, signed_diff): share of each level inside
    each group; the union of both groups' levels appears (missing share = 0)."""
    sub = df.where(F.col(group_col).isin(a, b))
    long = sub.select(F.col(group_col).alias("_g"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(c_(c).cast("string"), F.lit("missing")).alias("value"))
        for c in cols])))
    cnt = long.groupBy("feature", "value").agg(
        F.sum((F.col("_g") == a).cast("long")).alias("_na"), F.sum((F.col("_g") == b).cast("long")).alias("_nb"))
    # every row has one value per feature, so group sizes are per-feature sums of the small count table
    tot = cnt.groupBy("feature").agg(F.sum("_na").alias("_ta"), F.sum("_nb").alias("_tb"))
    j = cnt.join(tot, "feature")
    sa = F.coalesce(F.col("_na") / F.when(F.col("_ta") > 0, F.col("_ta")), F.lit(0.0))
    sb = F.coalesce(F.col("_nb") / F.when(F.col("_tb") > 0, F.col("_tb")), F.lit(0.0))
    out = j.select("feature", "value", sa.alias(f"{a}_share"), sb.alias(f"{b}_share"))
    d = F.col(f"{a}_share") - F.col(f"{b}_share")
    return out.withColumn("abs_diff", F.abs(d)).withColumn("signed_diff", d)


def cluster_profile(df: DataFrame, cluster: str, cat_cols: list[str], p0: str = "p0", p1: str = "p1") -> DataFrame:
    """Per cluster: size, share, mean p0/p1 and, for each categorical, the top value and its share."""
    n = df.count()
    base = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.avg(p0).alias("mean_p0"),
                                   F.avg(p1).alias("mean_p1"))
    base = base.withColumn("share", F.col("size") / F.lit(float(max(n, 1))))
    long = df.select(cluster, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(c_(c).cast("string"), F.lit("missing")).alias("value"))
        for c in cat_cols])))
    vc = long.groupBy(cluster, "feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    top = vc.groupBy(cluster, "feature").agg(
        F.min_by(F.struct("value", "_n"), F.struct((-F.col("_n")).alias("k"), F.col("value"))).alias("_t"))
    wide = top.groupBy(cluster).pivot("feature", list(cat_cols)).agg(F.first("_t"))
    out = base.join(wide, cluster, "left")
    for c in cat_cols:
        out = (out.withColumn(f"{c}_top", F.col(f"`{c}`.value"))
               .withColumn(f"{c}_top_share", F.col(f"`{c}`._n") / F.col("size")).drop(c))
    return out


def compare_datasets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(feature, status, n_diff): columns missing on one side, else rows whose values differ
    where both are non-NULL; full outer join on the key, one aggregate for all columns."""
    lc, rc = set(left.columns) - {key}, set(right.columns) - {key}
    common = sorted(lc & rc)
    l2 = left.select(key, *[c_(c).alias(f"l__{c}") for c in common])
    r2 = right.select(key, *[c_(c).alias(f"r__{c}") for c in common])
    j = l2.join(r2, key, "full")
    aggs = [F.sum((F.col(f"l__{c}").isNotNull() & F.col(f"r__{c}").isNotNull()
                   & (F.col(f"l__{c}") != F.col(f"r__{c}"))).cast("long")).alias(f"d{i}")
            for i, c in enumerate(common)]
    spark = left.sparkSession
    rows = [(c, "missing_right", None) for c in sorted(lc - rc)] + [(c, "missing_left", None) for c in sorted(rc - lc)]
    miss = spark.createDataFrame(rows, "feature string, status string, n_diff bigint")
    if not common:
        return miss
    row = j.agg(*aggs)
    diffs = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("compared").alias("status"),
                                                   F.col(f"d{i}").alias("n_diff")) for i, c in enumerate(common)])))
    return diffs.unionByName(miss)


def difference_sample(left: DataFrame, right: DataFrame, key: str, rows: int = 100, buckets: int = 4096) -> DataFrame:
    """(key, feature, left_value, right_value): the first ``rows`` values, by key and feature, that differ where both sides
    have one.

    Buckets of keys are compared by row counts and sums of row hashes first; only rows of buckets that differ are joined.
    """
    common = sorted((set(left.columns) & set(right.columns)) - {key})
    bucket = F.pmod(F.xxhash64(c_(key).cast("string")), F.lit(buckets)).alias("_bucket")

    def digests(df, n, h):  # at most ``buckets`` rows
        row = F.xxhash64(c_(key).cast("string"), *[c_(c).cast("string") for c in common]).cast("decimal(20)")
        return df.groupBy(bucket).agg(F.count(F.lit(1)).alias(n), F.sum(row).alias(h))
    both = digests(left, "ln", "lh").join(digests(right, "rn", "rh"), "_bucket", "full")
    differing = both.where(~(F.col("ln").eqNullSafe(F.col("rn")) & F.col("lh").eqNullSafe(F.col("rh")))).select("_bucket")

    def suspects(df, prefix):
        kept = df.select(c_(key), bucket, *[c_(c).cast("string").alias(f"{prefix}{c}") for c in common])
        return kept.join(F.broadcast(differing), "_bucket", "left_semi").drop("_bucket")
    pairs = suspects(left, "l__").join(suspects(right, "r__"), key)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`l__{c}`").alias("left_value"),
                               F.col(f"`r__{c}`").alias("right_value")) for c in common])
    return (pairs.select(c_(key), F.inline(cells)).where("left_value != right_value")
            .orderBy(key, "feature", "left_value", "right_value").limit(rows))


def sanity_assert_nonnegative(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, min_value, ok): one aggregate; ``ok`` is min >= 0 (NULL-only columns pass)."""
    row = df.agg(*[F.min(c_(c)).alias(f"m{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").cast("double").alias("min_value"),
                                                  F.coalesce(F.col(f"m{i}") >= 0, F.lit(True)).alias("ok"))
                                         for i, c in enumerate(cols)])))
