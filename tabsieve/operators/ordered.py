"""Ordered operators: global row index, lag, rolling mean, per-customer history,
daily resampling and seasonal decomposition.

The building block is :func:`global_index`, a distributed ``0..n-1`` numbering
in a total order: range-partition on the sort key (sampled bounds split a hot
day or a hot customer across partitions), sort inside partitions, take the
position inside the partition, checkpoint, then add per-partition offsets
from a table with one row per partition. No window ever runs without a
partition key over row data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.operators.profile import c_


def _keys(cols) -> list[Column]:
    return [c_(c) if isinstance(c, str) else c for c in cols]


def _parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def global_index(df: DataFrame, order_cols, name: str = "row_idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0..n-1 following ``order_cols`` (which must make the order total).

    ``monotonically_increasing_id`` is documented to hold the record number
    inside the partition in its lower 33 bits; after ``sortWithinPartitions``
    that is the position in the partition's slice of the total order.
    """
    keys = _keys(order_cols)
    pid = F.spark_partition_id().cast("long")
    base = (df.repartitionByRange(_parts(df, num_partitions), *keys)
            .sortWithinPartitions(*keys)
            .withColumn("_pid", pid)
            .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(pid, 33)))
    base = base.checkpoint(eager=True)  # stable positions, lineage cut, survives executor loss
    counts = base.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    # one row per partition: a bounded table, so a global window is fine here
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    return (base.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_pos")).cast("bigint"))
            .drop("_pid", "_pos", "_off"))


def lag_rows(df: DataFrame, order_cols, value_col: str, lags=(30, 60),
             prefix: str = "lag_", bucket_rows: int = 1 << 20) -> DataFrame:
    """Value ``n`` rows earlier in the global order.

    Rows are cut into index buckets; the last ``max(lags)`` rows of each bucket are
    copied into the next one as context, and ``lag`` runs per bucket: one shuffle,
    every window partition bounded by ``bucket_rows + max(lags)`` rows.
    """
    idx = global_index(df, order_cols, "_idx")
    span = max(lags)
    bucket_rows = max(bucket_rows, span)  # context comes from the previous bucket only
    b = F.floor(F.col("_idx") / bucket_rows)
    own = idx.withColumn("_b", b).withColumn("_own", F.lit(True))
    ctx = (idx.where(F.pmod(F.col("_idx"), F.lit(bucket_rows)) >= bucket_rows - span)
           .withColumn("_b", b + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy("_b").orderBy("_idx")
    both = own.unionByName(ctx)
    for n in lags:
        # lag by position only when the row n places back really is n indexes back
        prev_idx = F.lag("_idx", n).over(w)
        both = both.withColumn(f"{prefix}{n}", F.when(prev_idx == F.col("_idx") - n,
                                                      F.lag(c_(value_col), n).over(w)))
    return both.where("_own").drop("_b", "_own")


def rolling_mean(df: DataFrame, order_cols, value_col: str, window: int = 30,
                 out: str = "rolling_mean", bucket_rows: int = 1 << 20) -> DataFrame:
    """Mean of the last ``window`` rows including the current one (min 1 row).

    Rows are cut into index buckets of ``bucket_rows``; the last ``window-1``
    rows of each bucket are copied into the next bucket as context, so each
    window partition is bounded by ``bucket_rows + window``.
    """
    idx = global_index(df, order_cols, "_idx")
    bucket_rows = max(bucket_rows, window)  # context comes from the previous bucket only
    b = F.floor(F.col("_idx") / bucket_rows)
    own = idx.withColumn("_b", b).withColumn("_own", F.lit(True))
    ctx = (idx.where(F.pmod(F.col("_idx"), F.lit(bucket_rows)) >= bucket_rows - (window - 1))
           .withColumn("_b", b + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy("_b").orderBy("_idx").rowsBetween(-(window - 1), 0)
    both = own.unionByName(ctx).withColumn(out, F.avg(c_(value_col)).over(w))
    return both.where("_own").drop("_b", "_own")


def customer_history(df: DataFrame, contact: str, time: str, order_id: str, amount: str,
                     mode: str = "cumulative", block_rows: int = 1 << 17) -> DataFrame:
    """Per contact, ordered by (time, id): spend before this order, past order count, repeat flag.

    Rows without contact or time are dropped; negative amounts count as 0.
    ``mode="previous"`` returns the previous order's amount instead of the
    cumulative spend. Skew: the rows are globally numbered in (contact, time,
    id) order and cut into blocks of ``block_rows``; running sums are local to
    a (contact, block) and a carry from earlier blocks of the same contact is
    joined in, so one huge contact is spread over many tasks.
    """
    base = df.where(c_(contact).isNotNull() & c_(time).isNotNull())
    amt = F.greatest(F.coalesce(c_(amount).cast("double"), F.lit(0.0)), F.lit(0.0))
    base = base.withColumn("_amt", amt)
    g = global_index(base, [contact, time, order_id], "_g")
    g = g.withColumn("_blk", F.floor(F.col("_g") / block_rows))
    w = (Window.partitionBy(c_(contact), F.col("_blk")).orderBy("_g")
         .rowsBetween(Window.unboundedPreceding, -1))
    local = (g.withColumn("_ls", F.coalesce(F.sum("_amt").over(w), F.lit(0.0)))
             .withColumn("_lc", F.count(F.lit(1)).over(w)))
    tot = g.groupBy(c_(contact).alias("_ct"), F.col("_blk").alias("_bk")).agg(
        F.sum("_amt").alias("_bs"), F.count(F.lit(1)).alias("_bc"))
    wc = Window.partitionBy("_ct").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select("_ct", "_bk", F.coalesce(F.sum("_bs").over(wc), F.lit(0.0)).alias("_cs"),
                       F.coalesce(F.sum("_bc").over(wc), F.lit(0)).alias("_cc"))
    j = local.join(carry, (c_(contact) == F.col("_ct")) & (F.col("_blk") == F.col("_bk")), "left")
    past = (F.col("_lc") + F.col("_cc")).cast("bigint")
    res = (j.withColumn("past_orders", past)
           .withColumn("spend_before", F.col("_ls") + F.col("_cs"))
           .withColumn("is_repeat", (past > 0).cast("int")))
    if mode == "previous":
        prev = g.select((F.col("_g") + 1).alias("_g"), c_(contact).alias("_pc"),
                        F.col("_amt").alias("_pa"))
        res = (res.join(prev, "_g", "left")
               .withColumn("spend_before", F.when(F.col("_pc") == c_(contact), F.col("_pa"))
                           .otherwise(F.lit(0.0)))
               .drop("_pc", "_pa"))
    return res.drop("_amt", "_g", "_blk", "_ls", "_lc", "_ct", "_bk", "_cs", "_cc")


def rank_scores(df: DataFrame, feature: str, score: str, top_k: int, prefix: str) -> DataFrame:
    """Rank a (feature, score) list: best score first, one row per feature, top k,
    score (k - rank + 1) / k, vote 1. Only the ``top_k`` best rows reach the ranking window."""
    w1 = Window.partitionBy(c_(feature)).orderBy(F.desc(score), F.asc(feature))
    best = df.withColumn("_r1", F.row_number().over(w1)).where("_r1 = 1")
    best = best.orderBy(F.desc(score), F.asc(feature)).limit(top_k)
    w2 = Window.orderBy(F.desc(score), F.asc(feature))  # at most top_k rows
    ranked = best.withColumn("_rank", F.row_number().over(w2)).where(F.col("_rank") <= top_k)
    return ranked.select(c_(feature).alias("feature"),
                         F.col("_rank").cast("bigint").alias(f"rank_{prefix}"),
                         ((F.lit(top_k) - F.col("_rank") + 1) / F.lit(float(top_k))).alias(f"score_{prefix}"),
                         F.lit(1).cast("bigint").alias(f"vote_{prefix}"))


def dedupe_keep_best(df: DataFrame, key: str, order: list) -> DataFrame:
    """First row per key after sorting (``row_number() = 1`` per key)."""
    w = Window.partitionBy(c_(key)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def daily_resample_mean(df: DataFrame, time: str, value: str, out: str = "value") -> DataFrame:
    """Calendar-day mean; days without rows -> 0 (day spine from min to max day)."""
    day = F.to_date(c_(time))
    daily = df.groupBy(day.alias("day")).agg(F.avg(c_(value).cast("double")).alias("_m"))
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return (spine.join(daily, "day", "left")
            .select("day", F.coalesce(F.col("_m"), F.lit(0.0)).alias(out)))


def seasonal_decompose(daily: DataFrame, day: str, value: str, period: int) -> DataFrame:
    """Additive decomposition of a daily series (one row per day: calendar-bounded).

    trend: centred moving average (even period: 2 x MA, half weights at the
    ends), NULL where the window does not fit; seasonal: mean detrended value
    per phase ``i mod period``, centred to mean 0; resid = value - trend - seasonal.
    """
    lo = F.min(c_(day)).over(Window.partitionBy())
    d = daily.withColumn("_i", F.datediff(c_(day), lo).cast("bigint"))
    half = period // 2
    w = Window.orderBy("_i")
    frame = w.rowsBetween(-half, half)
    if period % 2 == 0:
        full = F.sum(c_(value)).over(frame)
        ends = 0.5 * (F.lag(c_(value), half).over(w) + F.lead(c_(value), half).over(w))
        ma = (full - ends) / period
        fits = F.lag(c_(value), half).over(w).isNotNull() & F.lead(c_(value), half).over(w).isNotNull()
    else:
        ma = F.sum(c_(value)).over(frame) / period
        fits = F.lag(c_(value), half).over(w).isNotNull() & F.lead(c_(value), half).over(w).isNotNull()
    t = d.withColumn("trend", F.when(fits, ma))
    t = t.withColumn("_phase", F.pmod(F.col("_i"), F.lit(period)))
    ph = t.groupBy("_phase").agg(F.avg(c_(value) - F.col("trend")).alias("_pm"))
    ph = ph.withColumn("_pm", F.coalesce("_pm", F.lit(0.0)))
    ph = ph.withColumn("seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy()))
    res = t.join(F.broadcast(ph.select("_phase", "seasonal")), "_phase")  # <= period rows
    return res.select(c_(day), c_(value), "trend", "seasonal",
                      (c_(value) - F.col("trend") - F.col("seasonal")).alias("resid"))


def prefix_sums(df: DataFrame, order_cols, sum_cols: list[str], num_partitions: int | None = None,
                prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of integer ``sum_cols`` in a total order, distributed.

    Range partitions are scanned in order by ``mapInPandas`` (vectorised
    ``cumsum`` inside each task), then per-partition totals (one row per
    partition) give each partition's carry-in.
    """
    import pandas as pd  # noqa: F401  (tasks only)
    from pyspark.sql import types as T

    keys = _keys(order_cols)
    part = (df.repartitionByRange(_parts(df, num_partitions), *keys).sortWithinPartitions(*keys)
            .withColumn("_pid", F.spark_partition_id().cast("long")))
    schema = T.StructType(part.schema.fields + [T.StructField(f"{prefix}{c}", T.LongType())
                                                for c in sum_cols])
    cols = list(sum_cols)

    def local_cumsum(batches):
        carry = {c: 0 for c in cols}
        for pdf in batches:
            for c in cols:
                cs = pdf[c].fillna(0).astype("int64").cumsum() + carry[c]
                if len(cs):
                    carry[c] = int(cs.iloc[-1])
                pdf[f"{prefix}{c}"] = cs
            yield pdf

    local = part.mapInPandas(local_cumsum, schema).checkpoint(eager=True)
    tot = local.groupBy("_pid").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(cols)])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    off = tot.select("_pid", *[F.coalesce(F.sum(f"_t{i}").over(w), F.lit(0)).alias(f"_o{i}")
                               for i in range(len(cols))])
    out = local.join(F.broadcast(off), "_pid")
    for i, c in enumerate(cols):
        out = out.withColumn(f"{prefix}{c}", (F.col(f"{prefix}{c}") + F.col(f"_o{i}")).cast("bigint"))
    return out.drop("_pid", *[f"_o{i}" for i in range(len(cols))])
