"""Categorical encoders: fit -> small state, transform -> expression or join.

* Bounded state (top-k lists, ranks 1..10) is collected as at most k literals
  and applied with ``isin`` -- no join at all.
* Level tables (frequency, target mean, out-of-fold sums, ordinal codes) can
  grow with the data (ids), so they are checkpointed and joined with a
  checked broadcast; above the limit the planner's shuffle join (with AQE skew
  splitting) takes over. A hot level never lands in one task: level
  statistics come from map-side-combined aggregations, not windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.operators.joins import checked_broadcast, materialize, stored
from tabsieve.operators.profile import c_


# ----------------------------------------------------------------- top-k
def top_k_levels(df: DataFrame, col: str, k: int, exclude: list[str] | None = None) -> list:
    """K most frequent non-NULL values, ties by value ascending (<= k literals)."""
    cnt = df.where(c_(col).isNotNull())
    if exclude:
        cnt = cnt.where(~c_(col).isin(*exclude))
    rows = (cnt.groupBy(c_(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("v")).limit(k).collect())
    return [r["v"] for r in rows]


def top_k_group_expr(col: str, top: list, other: str = "other",
                     always_keep: list[str] | None = None) -> Column:
    keep = list(top) + list(always_keep or [])
    return F.when(F.coalesce(c_(col).isin(*keep), F.lit(False)) if keep else F.lit(False),
                  c_(col)).otherwise(F.lit(other))


def top_k_group(df: DataFrame, col: str, k: int, out: str | None = None, other: str = "other",
                exclude_from_ranking: list[str] | None = None, keep_excluded: bool = True,
                fit_df: DataFrame | None = None) -> DataFrame:
    """Keep the K most frequent values; other values and NULL -> ``other``.

    ``exclude_from_ranking`` (e.g. "unknown") is left out of the ranking and,
    with ``keep_excluded``, always kept.
    """
    top = top_k_levels(fit_df if fit_df is not None else df, col, k, exclude_from_ranking)
    keep = exclude_from_ranking if (exclude_from_ranking and keep_excluded) else None
    return df.withColumn(out or col, top_k_group_expr(col, top, other, keep))


def rank_tier(df: DataFrame, col: str, out: str, top: int = 5, middle: int = 10,
              labels=("top", "middle", "rare")) -> DataFrame:
    """Rank ids by frequency: 1..top -> 'top', ..middle -> 'middle', else 'rare'."""
    ranked = top_k_levels(df, col, middle)
    t, m = ranked[:top], ranked[top:middle]
    expr = (F.when(F.coalesce(c_(col).isin(*t), F.lit(False)) if t else F.lit(False), F.lit(labels[0]))
            .when(F.coalesce(c_(col).isin(*m), F.lit(False)) if m else F.lit(False), F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))
    return df.withColumn(out, expr)


# --------------------------------------------------------- level tables
@dataclass
class LevelTable:
    col: str
    table: DataFrame      # columns: _lvl + value columns
    rows: int

    def join(self, df: DataFrame, key: Column | None = None) -> DataFrame:
        k = key if key is not None else c_(self.col)
        t = checked_broadcast(self.table, known_rows=self.rows)
        return df.join(t, k.eqNullSafe(t["_lvl"]), "left").drop("_lvl")


def fit_counts(df: DataFrame, col: str, key: Column | None = None) -> LevelTable:
    k = key if key is not None else c_(col)
    t = df.groupBy(k.alias("_lvl")).agg(F.count(F.lit(1)).alias("_cnt"))
    t, n = materialize(t)
    return LevelTable(col, t, n)


def rare_by_min_count(df: DataFrame, col: str, min_count: int = 10, label: str = "OTHER",
                      out: str | None = None) -> DataFrame:
    """Values seen fewer than ``min_count`` times -> label (NULL stays NULL)."""
    lt = fit_counts(df, col)
    j = lt.join(df)
    return j.withColumn(out or col, F.when(F.col("_cnt") < min_count, F.lit(label))
                        .otherwise(c_(col))).drop("_cnt")


def frequency_encode(df: DataFrame, col: str, out: str, null_label: str = "unknown") -> DataFrame:
    """value -> relative frequency over all rows; NULL counted as ``null_label``."""
    key = F.coalesce(c_(col).cast("string"), F.lit(null_label))
    t, n = materialize(df.groupBy(key.alias("_lvl")).agg(F.count(F.lit(1)).alias("_cnt")))
    total = t.agg(F.sum("_cnt")).first()[0] or 0
    t = t.select("_lvl", (F.col("_cnt") / F.lit(float(max(total, 1)))).alias("_freq"))
    return LevelTable(col, t, n).join(df, key).withColumnRenamed("_freq", out)


def frequency_encode_fit(train: DataFrame, col: str) -> LevelTable:
    """Relative frequency of each train level; the total comes from the level table itself."""
    t, n = materialize(train.groupBy(c_(col).alias("_lvl")).agg(F.count(F.lit(1)).alias("_cnt")))
    total = t.agg(F.sum("_cnt")).first()[0] or 0
    t = t.select("_lvl", (F.col("_cnt") / F.lit(float(max(total, 1)))).alias("_freq"))
    return LevelTable(col, t, n)


def frequency_encode_apply(df: DataFrame, state: LevelTable, out: str) -> DataFrame:
    """Unseen levels -> 0.0."""
    return state.join(df).withColumn(out, F.coalesce(F.col("_freq"), F.lit(0.0))).drop("_freq")


def target_mean_encode(df: DataFrame, col: str, target: str, out: str) -> DataFrame:
    """Group mean of the target over the full sample (leaky; kept for parity)."""
    t = df.groupBy(c_(col).alias("_lvl")).agg(F.avg(c_(target).cast("double")).alias("_te"))
    t, n = materialize(t)
    return LevelTable(col, t, n).join(df).withColumnRenamed("_te", out)


def oof_target_encode(df: DataFrame, col: str, target: str, out: str, fold: Column,
                      k: int = 5) -> DataFrame:
    """Out-of-fold target mean: level statistics of the other folds; unseen -> global mean.

    Built from (level, fold) sums and counts -- levels x k rows -- then level
    totals minus the row's own fold. No window over rows, so a hot level does
    not concentrate in one task.
    """
    y = c_(target).cast("double")
    base = df.withColumn("_fold", fold)
    lf = base.groupBy(c_(col).alias("_lvl"), F.col("_fold").alias("_f")).agg(
        F.sum(y).alias("_s"), F.count(y).alias("_n"))
    lf, n = materialize(lf)
    tot = lf.groupBy("_lvl").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    stats = (lf.join(tot, "_lvl")
             .select("_lvl", "_f", (F.col("_ts") - F.col("_s")).alias("_os"),
                     (F.col("_tn") - F.col("_n")).alias("_on")))
    g = lf.agg(F.sum("_s"), F.sum("_n")).first()  # global mean from the (level, fold) table
    gmean = (g[0] / g[1]) if g[1] else None
    st = checked_broadcast(stats, known_rows=n)
    j = base.join(st, c_(col).eqNullSafe(st["_lvl"]) & (F.col("_fold") == st["_f"]), "left")
    enc = F.when(F.col("_on") > 0, F.col("_os") / F.col("_on"))
    return (j.withColumn(out, F.coalesce(enc, F.lit(gmean)))
            .drop("_lvl", "_f", "_os", "_on", "_fold"))


def loo_group_mean(df: DataFrame, col: str, target: str, out: str) -> DataFrame:
    """Leave-one-out group mean: (group sum - own value) / (group count - 1); NULL if alone."""
    y = c_(target).cast("double")
    t = df.groupBy(c_(col).alias("_lvl")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    t, n = materialize(t)
    j = LevelTable(col, t, n).join(df)
    own_n = F.when(y.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    val = F.try_divide(F.col("_s") - F.coalesce(y, F.lit(0.0)), (F.col("_n") - own_n).cast("double"))
    return j.withColumn(out, F.when(F.col("_n") - own_n > 0, val)).drop("_s", "_n")


def ordinal_encode_fit(train: DataFrame, col: str, missing: str = "missing") -> LevelTable:
    """Alphabetical 0-based codes of the train levels (NULL -> 'missing')."""
    from tabsieve.operators.ordered import global_index
    lv = train.select(F.coalesce(c_(col).cast("string"), F.lit(missing)).alias("_lvl")).distinct()
    idx = global_index(lv, ["_lvl"], name="_code")
    t, n = materialize(idx.select("_lvl", "_code"))
    return LevelTable(col, t, n)


def ordinal_encode_apply(df: DataFrame, state: LevelTable, out: str,
                         missing: str = "missing") -> DataFrame:
    key = F.coalesce(c_(state.col).cast("string"), F.lit(missing))
    return (state.join(df, key).withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("bigint"))
            .drop("_code"))


def level_codes(train: DataFrame, col: str, by: str = "value") -> LevelTable:
    """Codes 0.. of the levels, NULL left out: in order of their text, or the most frequent first (ties by text)."""
    from tabsieve.operators.ordered import global_index
    counts = train.where(c_(col).isNotNull()).groupBy(c_(col).cast("string").alias("_lvl")).agg(F.count(F.lit(1)).alias("_n"))
    order = ["_lvl"] if by == "value" else [F.desc("_n"), F.col("_lvl")]
    t, n = materialize(global_index(counts, order, name="_code").select("_lvl", "_code"))
    return LevelTable(col, t, n)


def target_prior(df: DataFrame, target: str, counted: Column | None = None) -> float:
    """Mean of the target over the rows that count; 0 without any."""
    y = c_(target).cast("double")
    return df.agg(F.avg(F.when(counted, y) if counted is not None else y)).first()[0] or 0.0


def ordered_target_encode(df: DataFrame, col: str, target: str, out: str, order_cols: list, prior: float | None = None,
                          strength: float = 1.0, counted: Column | None = None, block_rows: int = 1 << 18,
                          path: str | None = None) -> DataFrame:
    """Mean target of the earlier rows of the same level, drawn towards ``prior`` with ``strength`` rows' weight.

    ``order_cols`` must make a total order; NULL is a level. Rows without a target, or where ``counted`` is false, get
    a value and add nothing. Rows are range-partitioned by (level, order), which is the one shuffle, and summed in that
    order, ``block_rows`` at a time (``level_prefix_sums``); what earlier partitions hold of a partition's first level
    is added from a row per partition. So a level with a third of all rows spreads over many tasks, and any number of
    levels takes the same path. The summed rows are stored once (``path``, see ``stored``).
    """
    y = c_(target).cast("double")
    use = y.isNotNull() if counted is None else y.isNotNull() & F.coalesce(counted, F.lit(False))
    prior = target_prior(df, target, counted) if prior is None else prior
    rows = df.withColumns({"_lvl": c_(col).cast("string"), "_ys": F.when(use, y).otherwise(0.0), "_yn": use.cast("long")})
    g = stored(level_prefix_sums(rows, ["_lvl", *order_cols], block_rows), path)
    j = g.join(F.broadcast(level_carries(g)), "_pid", "left")  # at most a row per partition
    head = lambda c: F.when(F.col("_head"), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0))
    value = ((F.col("_ls") + head("_cs") + F.lit(float(prior * strength)))
             / (F.col("_ln") + head("_cn") + F.lit(float(strength))))
    return j.withColumn(out, value).select(*[c_(c) for c in df.columns if c != out], out)


def level_prefix_sums(rows: DataFrame, order_cols: list, block_rows: int = 1 << 18) -> DataFrame:
    """``rows`` (with _lvl, _ys, _yn) in order, with the sums over the rows before in the same level and partition.

    Adds _pid, _ls and _ln (the sums), _head (whether the row is of its partition's first level) and _edge (1 on a
    partition's first row, 2 on its last, 3 on an only row, else 0). ``order_cols`` begin with _lvl.
    """
    from pyspark.sql.pandas.functions import ArrowUDFType

    from tabsieve.operators.ordered import _keys, _parts
    keys = _keys(order_cols)
    part = (rows.repartitionByRange(_parts(rows, None), *keys).sortWithinPartitions(*keys)
            .withColumn("_pid", F.spark_partition_id()))
    @F.arrow_udf(returnType="struct<_ls: double, _ln: long, _head: boolean, _edge: int>", functionType=ArrowUDFType.SCALAR_ITER)
    def sums(batches):  # only these columns travel to Python, the rest of a row waits in the task
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        level, total, head, edge, held = None, None, True, 1, None

        def made(parts):
            return pa.StructArray.from_arrays([pa.array(x) for x in parts], ["_ls", "_ln", "_head", "_edge"])

        for level_batch, y_batch, n_batch in batches:
            for start in range(0, len(level_batch), block_rows):
                block = level_batch.slice(start, block_rows)
                code = block.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new = np.concatenate([[True], code[1:] != code[:-1]])
                y = y_batch.slice(start, block_rows).to_numpy(zero_copy_only=False)
                nan = np.isnan(y)
                inclusive = pd.Series(np.where(nan, 0.0, y)).groupby(code).cumsum().to_numpy()
                if nan.any():  # cumsum goes on behind a NaN, a sum does not
                    inclusive = np.where(pd.Series(nan).groupby(code).cumsum().to_numpy() > 0, np.nan, inclusive)
                counts = pd.Series(n_batch.slice(start, block_rows).to_numpy(zero_copy_only=False)).groupby(code).cumsum().to_numpy()
                ends = np.flatnonzero(new[1:])
                first = slice(0, ends[0] + 1 if len(ends) else len(code))  # the rows of the block's first level
                goes_on = total is not None and block[0].as_py() == level
                head = head and (total is None or goes_on)
                before, number = (np.concatenate([[0], x[:-1]]) for x in (inclusive, counts))
                before[new], number[new] = 0, 0
                if goes_on:
                    before[first] += total[0]
                    number[first] += total[1]
                one = not len(ends)
                total = tuple(x[-1] + (old if goes_on and one else 0) for x, old in zip((inclusive, counts), total or (0, 0)))
                level = block[len(code) - 1].as_py()
                heads = np.zeros(len(code), bool)
                heads[first] = head
                head = head and one
                edges = np.zeros(len(code), np.int32)
                edges[0], edge = edge, 0
                # the last row is held back, since it is marked when no other follows
                parts = [np.concatenate([h, x]) for h, x in zip(held or [[]] * 4, (
                    before.astype(np.float64), number.astype(np.int64), heads, edges))]
                parts = [x.astype(k) for x, k in zip(parts, (np.float64, np.int64, bool, np.int32))]
                held = [x[-1:] for x in parts]
                yield made([x[:-1] for x in parts])
        if held is not None:
            held[3] = held[3] + np.int32(2)
            yield made(held)
    return part.withColumn("_sums", sums("_lvl", "_ys", "_yn")).select(*part.columns, "_sums.*")


def level_carries(summed: DataFrame) -> DataFrame:
    """(_pid, _cs, _cn): what earlier partitions of ``level_prefix_sums`` hold of the first level of a partition."""
    edges = (summed.where("_edge > 0").select("_pid", "_edge", "_lvl", (F.col("_ls") + F.col("_ys")).alias("s"),
                                              (F.col("_ln") + F.col("_yn")).alias("n"), "_head").collect())  # two rows a partition
    carries, level, total = [], None, None
    for r in sorted(edges, key=lambda r: (r["_pid"], r["_edge"])):
        if r["_edge"] & 1 and total is not None and r["_lvl"] == level:
            carries.append((r["_pid"], *total))
        if r["_edge"] & 2:
            old = total if r["_head"] and total is not None and r["_lvl"] == level else (0.0, 0)
            level, total = r["_lvl"], (old[0] + r["s"], old[1] + r["n"])
    return summed.sparkSession.createDataFrame(carries, "_pid int, _cs double, _cn long")


#: Most pairs of a partition and a level whose sums are carried on as one small table.
CARRIED_SUMS = 1 << 16


def shared_target_encode(df: DataFrame, cols: list[str], target: str, outs: list[str], order_by: list[str], prior: float,
                         keep: list[str], strength: float = 1.0, counted: Column | None = None,
                         path: str | None = None) -> DataFrame | None:
    """``ordered_target_encode`` of several categories of few levels by one sort, for an ``order_by`` without ties.

    Rows are range-partitioned and sorted by the order alone, and every category is summed level by level in that one
    stream; what earlier partitions hold of a level is a row per partition and level (at most ``CARRIED_SUMS`` a
    category, as the caller sees to). Returns ``keep``, which must hold the target and what ``counted`` reads, and
    ``outs``; ``None`` if two rows are equal in ``order_by``, since a category's ties are ordered by what was encoded
    before it.
    """
    from tabsieve.operators.ordered import _keys, _parts
    def used():
        y = c_(target).cast("double")
        use = y.isNotNull() if counted is None else y.isNotNull() & F.coalesce(counted, F.lit(False))
        return F.when(use, y).otherwise(0.0), use.cast("long")
    levels = [f"_lvl{i}" for i in range(len(cols))]
    y, n = used()
    rows = df.withColumns({**{v: c_(c).cast("string") for v, c in zip(levels, cols)}, "_ys": y, "_yn": n,
                           "_tie": F.xxhash64(*[c_(c) for c in order_by])})
    keys = _keys([*order_by, F.xxhash64(*[c_(c) for c in df.columns])])
    part = (rows.repartitionByRange(_parts(df, None), *keys).sortWithinPartitions(*keys)
            .withColumn("_pid", F.spark_partition_id()))
    summed = part.withColumn("_sums", _running_sums(len(cols))("_tie", "_ys", "_yn", *levels))
    g = stored(summed.select(*[c_(c) for c in keep], *levels, "_pid", "_sums.*"), path)
    ends = g.groupBy("_pid").agg(F.max("_tied").alias("tied"), F.max("_first").alias("first"), F.max("_last").alias("last"))
    ends = sorted(ends.collect(), key=lambda r: r["_pid"])  # a row per partition
    if any(r["tied"] for r in ends) or any(a["last"] == b["first"] for a, b in zip(ends, ends[1:])):
        return None
    y, n = used()
    for i, (level, out) in enumerate(zip(levels, outs)):
        sums = g.groupBy("_pid", F.col(level).alias("_lvl")).agg(F.sum(y).alias("s"), F.sum(n).alias("n")).collect()
        carries = [(*k, *v) for k, v in _sums_before(sums).items()]
        t = F.broadcast(df.sparkSession.createDataFrame(carries, "_at int, _lvl string, _cs double, _cn long"))
        value = ((F.col(f"_s{i}") + F.col("_cs") + F.lit(float(prior * strength)))
                 / (F.col(f"_n{i}") + F.col("_cn") + F.lit(float(strength))))
        g = (g.join(t, (F.col("_pid") == F.col("_at")) & F.col(level).eqNullSafe(F.col("_lvl")), "left")
             .withColumn(out, value).drop("_at", "_lvl", "_cs", "_cn"))
    return g.select(*[c_(c) for c in [*keep, *outs]])


def _sums_before(sums: list) -> dict:
    """{(_pid, _lvl): (s, n)} of the partitions before, from rows of _pid, _lvl, s and n."""
    before, total = {}, {}
    for r in sorted(sums, key=lambda r: r["_pid"]):
        s, n = before[r["_pid"], r["_lvl"]] = total.get(r["_lvl"], (0.0, 0))
        total[r["_lvl"]] = (s + r["s"], n + r["n"])
    return before


def _running_sums(width: int):
    """Arrow function of (_tie, _ys, _yn, levels of ``width`` categories) in order: for each category, sum and count of
    the rows before in the same level and partition (_s0, _n0, ..); _tied, whether a row ties with the one before; and
    the tie value on the partition's first and last row (_first, _last)."""
    from pyspark.sql.pandas.functions import ArrowUDFType
    names = [f"_{k}{i}" for i in range(width) for k in "sn"] + ["_tied", "_first", "_last"]
    types = ["double", "long"] * width + ["boolean", "long", "long"]

    @F.arrow_udf(returnType="struct<" + ", ".join(f"{a}: {b}" for a, b in zip(names, types)) + ">",
                 functionType=ArrowUDFType.SCALAR_ITER)
    def sums(batches):
        import numpy as np
        import pyarrow as pa
        totals, last, held = [{} for _ in range(width)], None, None

        def made(parts, end):
            tie, first = parts[-1], np.where(parts[-2], parts[-1], 0)
            ends = [pa.array(first, mask=~parts[-2]), pa.array(tie, mask=np.full(len(tie), not end))]
            return pa.StructArray.from_arrays([*map(pa.array, parts[:-2]), *ends], names)

        for tie, y, n, *levels in batches:
            if not len(tie):
                continue
            tie, y, n = (x.to_numpy(zero_copy_only=False) for x in (tie, y, n))
            parts = []
            for level, total in zip(levels, totals):
                encoded = level.dictionary_encode()
                texts = [*encoded.dictionary.to_pylist(), None]
                code = encoded.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False)
                order = np.argsort(code.astype(np.min_scalar_type(len(texts))), kind="stable")  # short integers sort faster
                s, c = np.empty(len(code)), np.empty(len(code), np.int64)
                for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                    s0, c0 = total.get(texts[code[at[0]]], (0.0, 0))
                    sums, counts = np.cumsum(np.concatenate([[s0], y[at]])), np.cumsum(np.concatenate([[c0], n[at]]))
                    s[at], c[at] = sums[:-1], counts[:-1]
                    total[texts[code[at[0]]]] = float(sums[-1]), int(counts[-1])
                parts += [s, c]
            before = np.concatenate([[tie[0] if last is None else last], tie[:-1]])
            tied, first = tie == before, np.zeros(len(tie), bool)
            if last is None:
                tied[0], first[0] = False, True
            last = tie[-1]
            parts += [tied, first, tie]
            if held is not None:  # the last row is held back, since it is marked when no other follows
                parts = [np.concatenate([h, x]) for h, x in zip(held, parts)]
            held = [x[-1:] for x in parts]
            yield made([x[:-1] for x in parts], False)
        if held is not None:
            yield made(held, True)
    return sums


def hashed_target_encode(df: DataFrame, col: str, target: str, out: str, prior: float, strength: float = 1.0,
                         counted: Column | None = None, path: str | None = None) -> DataFrame:
    """``ordered_target_encode`` in the order of a hash of the whole row, for a category of few levels.

    A hash spreads evenly, so its leading bits name a row's partition, without a pass that samples bounds. What each
    partition holds of a level comes from one aggregate (levels x partitions, at most ``CARRIED_SUMS`` as the caller
    sees to), so rows get their value behind the one shuffle; they are sorted by one number.
    """
    from tabsieve.operators.ordered import _parts
    y = c_(target).cast("double")
    use = y.isNotNull() if counted is None else y.isNotNull() & F.coalesce(counted, F.lit(False))
    parts = _parts(df, None)
    rows = df.withColumns({"_lvl": c_(col).cast("string"), "_ys": F.when(use, y).otherwise(0.0), "_yn": use.cast("long"),
                           "_order": F.xxhash64(*[c_(c) for c in df.columns])})
    rows = rows.withColumn("_pid", F.shiftright((F.shiftright("_order", 32) + (1 << 31)) * parts, 32).cast("int"))
    sums = rows.groupBy("_lvl", "_pid").agg(F.sum("_ys").alias("s"), F.sum("_yn").alias("n")).collect()
    values = _running_means(_sums_before(sums), float(prior * strength), float(strength))
    sorted_rows = rows.repartitionById(parts, F.col("_pid")).sortWithinPartitions("_order")
    valued = sorted_rows.withColumn("_value", values("_lvl", "_ys", "_yn", "_pid"))
    return stored(valued.select(*[c_(c) for c in df.columns if c != out], F.col("_value").alias(out)), path)


def _running_means(starts: dict, prior_sum: float, strength: float):
    """Arrow function of (_lvl, _ys, _yn, _pid) in order: the mean of the rows before in the same level, from the sums
    (s, n) in ``starts`` under (_pid, _lvl) on."""
    from pyspark.sql.pandas.functions import ArrowUDFType

    @F.arrow_udf(returnType="double", functionType=ArrowUDFType.SCALAR_ITER)
    def values(batches):
        import numpy as np
        import pyarrow as pa
        held = {}
        for level, y, n, pid in batches:
            if not len(level):
                yield pa.array([], pa.float64())
                continue
            encoded = level.dictionary_encode()
            names = [*encoded.dictionary.to_pylist(), None]
            code = encoded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            y, n, pid = (x.to_numpy(zero_copy_only=False) for x in (y, n, pid))
            group = (pid - pid.min()) * np.int64(len(names)) + code
            order = np.argsort(group.astype(np.min_scalar_type(group.max())), kind="stable")  # short integers sort faster
            value = np.empty(len(code))
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                key = int(pid[at[0]]), names[code[at[0]]]
                s, c = held.get(key) or starts.get(key, (0.0, 0))
                s, c = np.cumsum(np.concatenate([[s], y[at]])), np.cumsum(np.concatenate([[c], n[at]]))
                value[at] = (s[:-1] + prior_sum) / (c[:-1] + strength)
                held[key] = float(s[-1]), int(c[-1])
            yield pa.array(value)
    return values


def target_levels(df: DataFrame, col: str, target: str, prior: float, strength: float = 1.0,
                  counted: Column | None = None) -> LevelTable:
    """(_lvl, _val): the statistic of ``ordered_target_encode`` after all rows, for rows that come later."""
    y = c_(target).cast("double")
    y = y if counted is None else F.when(counted, y)
    t = df.groupBy(c_(col).cast("string").alias("_lvl")).agg(
        ((F.coalesce(F.sum(y), F.lit(0.0)) + F.lit(float(prior * strength))) / (F.count(y) + F.lit(float(strength)))).alias("_val"))
    t, n = materialize(t)
    return LevelTable(col, t, n)


def fill_mode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """NULL -> most frequent value (ties by value ascending)."""
    top = top_k_levels(df, col, 1)
    if not top:
        return df
    return df.withColumn(out or col, F.coalesce(c_(col), F.lit(top[0])))


def mode_value(df: DataFrame, col: str):
    """Most frequent value (ties by value ascending); ``None`` for a column without values."""
    top = top_k_levels(df, col, 1)
    return top[0] if top else None
