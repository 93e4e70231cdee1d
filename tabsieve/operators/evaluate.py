"""Splits, folds, classification metrics, threshold tables and error labels.

Ordered metrics (ROC-AUC, average precision) aggregate by distinct score
first, then take distributed prefix sums; threshold tables bin every score to
its threshold and work on at most 92 bins. Time-ordered splits use the
distributed global index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.operators.ordered import global_index, prefix_sums
from tabsieve.operators.profile import c_, real

# Threshold grid 0.05 + i * 0.01, i = 0..90 (computed in floating point).
THRESHOLD_START, THRESHOLD_STEP, THRESHOLD_COUNT = 0.05, 0.01, 91
MAX_CLASSES = 1000  # a target with more values is not a class


def thresholds() -> list[float]:
    return [THRESHOLD_START + i * THRESHOLD_STEP for i in range(THRESHOLD_COUNT)]


# ------------------------------------------------------------------ splits
def time_cuts(df: DataFrame, time: str, key: str, positions: list[int]) -> tuple[int, dict]:
    """(n, {position: (time, key)}): the row found at each 0-based position of the (time, key)
    order, without numbering every row.

    One aggregate gives rows per calendar day (a calendar-bounded table); the cumulative
    counts place every position in its day, and only those boundary days are numbered
    with the distributed global index (range-partitioned, so a hot day is still split).
    """
    day = F.to_date(c_(time))
    counted = df.groupBy(day.alias("_d")).count().collect()
    null_rows = sum(r[1] for r in counted if r[0] is None)  # NULL times sort first, as in Spark
    days = sorted((r[0], r[1]) for r in counted if r[0] is not None)
    n = sum(c for _, c in days) + null_rows
    want: dict = {}
    start, j = null_rows, 0
    targets = sorted(p for p in set(positions) if 0 <= p < n)
    for d, c in days:
        while j < len(targets) and targets[j] < start + c:
            want.setdefault(d, []).append((targets[j], targets[j] - start))
            j += 1
        start += c
    if not want:
        return n, {}
    sub = df.where(day.isin(list(want))).select(c_(time).alias("_t"), c_(key).alias("_k"), day.alias("_d"))
    idx = global_index(sub, ["_t", "_k"], "_i")
    # position inside the union of boundary days -> position inside each day
    offsets, acc = {}, 0
    for d, c in days:
        if d in want:
            offsets[d] = acc
            acc += c
    picks = [offsets[d] + r for d, lst in want.items() for _, r in lst]
    rows = {r["_i"]: (r["_t"], r["_k"]) for r in idx.where(F.col("_i").isin(picks)).collect()}  # <= #positions
    out = {}
    for d, lst in want.items():
        for p, r in lst:
            out[p] = rows[offsets[d] + r]
    return n, out


def before(time: str, key: str, cut) -> Column:
    """Row strictly before the cut row in (time, key) order."""
    t, k = cut
    strictly = (c_(time) < F.lit(t)) | ((c_(time) == F.lit(t)) & (c_(key) < F.lit(k)))
    return c_(time).isNull() | F.coalesce(strictly, F.lit(False))


def segment_by_positions(df: DataFrame, time: str, key: str, positions: list[int],
                         out: str = "_seg") -> tuple[DataFrame, int]:
    """Segment number of each row: how many of the cut positions lie at or before it."""
    n, cuts = time_cuts(df, time, key, positions)
    seg = F.lit(0)
    for p in sorted(positions):
        if p in cuts:
            seg = seg + F.when(~before(time, key, cuts[p]), F.lit(1)).otherwise(F.lit(0))
        elif p <= 0:
            seg = seg + F.lit(1)
    return df.withColumn(out, seg.cast("int")), n


def time_split(df: DataFrame, time: str, key: str, test_size: float = 0.2,
               out: str = "split") -> DataFrame:
    """First ``int(n * (1 - test))`` rows in (time, key) order are train, the rest test."""
    n = df.count()
    seg, _ = segment_by_positions(df, time, key, [int(n * (1 - test_size))])
    return seg.withColumn(out, F.when(F.col("_seg") == 0, "train").otherwise("test")).drop("_seg")


def time_split_val(df: DataFrame, time: str, key: str, test_size: float = 0.2,
                   val_share: float = 0.1, out: str = "split") -> DataFrame:
    """train / val / test = [0, int(int(.8n)*.9)), [.., int(.8n)), [.., n)."""
    n = df.count()
    tv = int(n * (1 - test_size))
    tr = int(tv * (1 - val_share))
    seg, _ = segment_by_positions(df, time, key, [tr, tv])
    lab = F.when(F.col("_seg") == 0, "train").when(F.col("_seg") == 1, "val").otherwise("test")
    return seg.withColumn(out, lab).drop("_seg")


def expanding_fold_ranges(n: int, k: int) -> list[tuple[int, int, int]]:
    ts = n // (k + 1)
    return [(i, n - (k - i) * ts, n - (k - i - 1) * ts) for i in range(k)]


def expanding_folds(df: DataFrame, time: str, key: str, k: int = 5) -> DataFrame:
    """TimeSeriesSplit folds: ``test_fold`` (NULL if in no test fold) and ``_seg``;
    fold i tests rows [n - (k-i)*ts, n - (k-i-1)*ts) and trains on every row with
    ``_seg <= i`` (all rows before its test block)."""
    n = df.count()
    ranges = expanding_fold_ranges(n, k)
    seg, _ = segment_by_positions(df, time, key, [lo for _, lo, _ in ranges])
    fold = F.when((F.col("_seg") >= 1) & (F.col("_seg") <= k), F.col("_seg") - 1)
    return seg.withColumn("test_fold", fold.cast("int"))


def expanding_folds_blocks(df: DataFrame, time: str, key: str, k: int = 5) -> DataFrame:
    """n // k blocks; fold j (j = 1..k-1) tests block j and trains on blocks < j."""
    n = df.count()
    size = max(n // k, 1)
    seg, _ = segment_by_positions(df, time, key, [j * size for j in range(1, k)])
    return (seg.withColumn("block", F.col("_seg")).withColumn(
        "test_fold", F.when(F.col("_seg") >= 1, F.col("_seg")))
        # relabel so that "train on _seg <= fold" means every block before the test block
        .withColumn("_seg", F.col("_seg") + 1))


def fold_summary(folded: DataFrame, time: str, k: int, blocks: bool = False) -> DataFrame:
    """Per fold: train/test row counts and time ranges (train = all rows before the test block)."""
    per = folded.groupBy("_seg").agg(F.count(F.lit(1)).alias("_n"))
    segs = sorted((r[0], r[1]) for r in per.collect())  # one row per segment (<= k + 2)
    before_rows, acc = {}, 0
    for sg, c in segs:
        before_rows[sg] = acc
        acc += c
    tests = folded.where(F.col("test_fold").isNotNull()).groupBy("test_fold", "_seg").agg(
        F.count(F.lit(1)).alias("n_test"), F.min(c_(time)).alias("test_min_time"),
        F.max(c_(time)).alias("test_max_time"))
    ntrain = F.lit(0).cast("bigint")
    for sg, b in before_rows.items():
        ntrain = F.when(F.col("_seg") == sg, F.lit(b).cast("bigint")).otherwise(ntrain)
    return tests.select(F.col("test_fold").cast("bigint").alias("fold"), ntrain.alias("n_train"),
                        "n_test", "test_min_time", "test_max_time")


def _within_class_position(df: DataFrame, y: str, key: str, seed: int, shuffle: bool = True) -> DataFrame:
    """Position of each row inside its class, in a seeded hash order (``shuffle``) or in key
    order; numbered by the distributed global index, never by a per-class window."""
    h = F.xxhash64(F.lit(seed), c_(key)) if shuffle else F.lit(0).cast("long")
    idx = global_index(df.withColumn("_h", h), [y, "_h", key], "_gi")
    starts = idx.groupBy(c_(y).alias("_y")).agg(F.min("_gi").alias("_start"), F.count(F.lit(1)).alias("_n"))
    # one row per value of y: the planner broadcasts it if it is small
    return (idx.join(starts, c_(y).eqNullSafe(F.col("_y")))
            .withColumn("_pos", F.col("_gi") - F.col("_start")).drop("_y", "_start", "_gi", "_h"))


def stratified_split(df: DataFrame, y: str, key: str, test_size: float = 0.2, seed: int = 42,
                     out: str = "split", shuffle: bool = True) -> DataFrame:
    """Per class, the first ``floor(n_c * test + 0.5)`` rows in a seeded hash order are test."""
    pos = _within_class_position(df, y, key, seed, shuffle)
    quota = F.floor(F.col("_n") * F.lit(test_size) + F.lit(0.5))
    return pos.withColumn(out, F.when(F.col("_pos") < quota, "test").otherwise("train")).drop("_pos", "_n")


def stratified_kfold(df: DataFrame, y: str, key: str, k: int = 5, seed: int = 42,
                     out: str = "fold", shuffle: bool = True) -> DataFrame:
    """Fold = position inside the class (seeded hash order) mod k."""
    pos = _within_class_position(df, y, key, seed, shuffle)
    return pos.withColumn(out, F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_pos", "_n")


# ------------------------------------------------------------ confusion
def confusion_labels(df: DataFrame, y: str, p0: str, thr: float, out: str = "error_type") -> DataFrame:
    """Class 0 is the positive class: predicted 0 when p0 >= thr.

    A row without a score has no prediction; a row outside the four cells (no score, or a label that is neither
    0 nor 1) is ``unknown``."""
    pred0 = c_(p0) >= F.lit(thr)
    yv = c_(y)
    lab = (F.when(pred0 & (yv == 0), "tp_0").when(~pred0 & (yv == 0), "fn_0")
           .when(pred0 & (yv == 1), "fp_0").when(~pred0 & (yv == 1), "tn_0").otherwise("unknown"))
    return df.withColumn("pred_label", F.when(pred0, 0).when(~pred0, 1)).withColumn(out, lab)


def confusion_summary(labelled: DataFrame, thr: float, err: str = "error_type") -> DataFrame:
    """(metric, value) rows: threshold, total and the four counts."""
    row = labelled.agg(F.count(F.lit(1)).alias("total"),
                       *[F.sum((F.col(err) == t).cast("long")).alias(t)
                         for t in ("tp_0", "fn_0", "fp_0", "tn_0")])
    stack = F.array(F.struct(F.lit("threshold").alias("metric"), F.lit(float(thr)).alias("value")),
                    *[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("double").alias("value"))
                      for m in ("total", "tp_0", "fn_0", "fp_0", "tn_0")])
    return row.select(F.inline(stack))


def split_time_ranges(df: DataFrame, split: str, time: str) -> DataFrame:
    return df.groupBy(split).agg(F.min(c_(time)).alias("min_time"), F.max(c_(time)).alias("max_time"),
                                 F.count(F.lit(1)).alias("rows"))


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _fbeta(p, r, beta):
    b2 = beta * beta
    return F.coalesce(F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0))


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """2x2 counts as (y_true, y_pred, n) including empty cells."""
    cells = df.groupBy(c_(y).cast("int").alias("y_true"), c_(pred).cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "y_true int, y_pred int")
    return grid.join(cells, ["y_true", "y_pred"], "left").fillna({"n": 0})


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class precision, recall, F1, support; macro and weighted averages (zero_division=0)."""
    c = df.agg(*[F.sum(((c_(y) == a) & (c_(pred) == b)).cast("long")).alias(f"c{a}{b}")
                 for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        p, r = _div(tp, tp + fp), _div(tp, tp + fn)
        rows.append((str(k), p, r, _fbeta(p, r, 1.0), (tp + fn).cast("double")))
    sup = rows[0][4] + rows[1][4]
    macro = tuple((rows[0][i] + rows[1][i]) / 2 for i in (1, 2, 3))
    weighted = tuple(_div(rows[0][i] * rows[0][4] + rows[1][i] * rows[1][4], sup) for i in (1, 2, 3))
    acc = _div(F.col("c00") + F.col("c11"), sup)
    allrows = rows + [("macro avg", *macro, sup), ("weighted avg", *weighted, sup),
                      ("accuracy", acc, acc, acc, sup)]
    return c.select(F.inline(F.array(*[F.struct(F.lit(n).alias("label"), p.alias("precision"),
                                                  r.alias("recall"), f.alias("f1"), s.alias("support"))
                                         for n, p, r, f, s in allrows])))


def class_metrics(df: DataFrame, y: str, pred: str, betas=(1.0, 2.0)) -> DataFrame:
    """precision / recall of both classes (zero_division=0) and F-beta of each class."""
    c = df.agg(*[F.sum(((c_(y) == a) & (c_(pred) == b)).cast("long")).alias(f"c{a}{b}")
                 for a in (0, 1) for b in (0, 1)])
    cols = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        p, r = _div(tp, tp + fp), _div(tp, tp + fn)
        cols += [p.alias(f"precision_{k}"), r.alias(f"recall_{k}")]
        cols += [_fbeta(p, r, b).alias(f"f{int(b)}_{k}") for b in betas]
    return c.select(*cols)


# ------------------------------------------------------- ordered metrics
def _score_counts(df: DataFrame, y: str, score: str, positive: int) -> DataFrame:
    """(_s, pos, neg) per distinct score; rows whose score is NULL or NaN are left out."""
    return df.where(real(df, score).isNotNull()).groupBy(c_(score).alias("_s")).agg(
        F.sum((c_(y) == positive).cast("long")).alias("pos"),
        F.sum((c_(y) != positive).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str, positive: int = 1) -> DataFrame:
    """ROC-AUC with ties counted half (Mann-Whitney over distinct scores)."""
    sc = prefix_sums(_score_counts(df, y, score, positive), ["_s"], ["neg"])
    return sc.agg(F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg"))),
                               F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, positive: int = 1) -> DataFrame:
    """Step-wise AP: sum over distinct scores (descending) of delta-recall x precision."""
    sc = prefix_sums(_score_counts(df, y, score, positive), [F.desc("_s")], ["pos", "neg"])
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return sc.agg(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos").cast("double"))
                  .alias("average_precision"))


def log_loss(df: DataFrame, y: str, p1: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    # greatest and least skip NULL and NaN passes them, so a row without a score is left out first
    p = F.when(real(df, p1).isNotNull(), F.least(F.greatest(c_(p1).cast("double"), F.lit(eps)), F.lit(1 - eps)))
    yv = c_(y).cast("double")
    return df.agg(F.avg(-(yv * F.log(p) + (1 - yv) * F.log(1 - p))).alias("log_loss"))


# ------------------------------------------------------------ thresholds
def _threshold_bin(p0: Column) -> Column:
    """Index of the highest grid threshold <= p0 (-1 below the grid), exact in floating point."""
    i = F.floor((p0 - THRESHOLD_START) / THRESHOLD_STEP).cast("int")
    t = lambda k: F.lit(THRESHOLD_START) + k.cast("double") * F.lit(THRESHOLD_STEP)
    i = F.when(p0 >= t(i + 1), i + 1).when(p0 < t(i), i - 1).otherwise(i)
    return F.least(F.greatest(i, F.lit(-1)), F.lit(THRESHOLD_COUNT - 1))


def threshold_table(df: DataFrame, y: str, p0: str) -> DataFrame:
    """For each of the 91 thresholds: precision, recall, F1, F2 of both classes
    (class 0 predicted when p0 >= threshold). Rows without a score are left out."""
    bins = df.where(c_(p0).isNotNull() & ~F.isnan(c_(p0).cast("double"))).groupBy(_threshold_bin(c_(p0)).alias("_b")).agg(
        F.sum((c_(y) == 0).cast("long")).alias("_n0"), F.sum((c_(y) == 1).cast("long")).alias("_n1"))
    spark = df.sparkSession
    # one distributed pass; the result has at most 92 rows (one per grid bin), kept locally
    brows = bins.collect()
    n0_total = sum(r["_n0"] or 0 for r in brows)
    n1_total = sum(r["_n1"] or 0 for r in brows)
    grid = spark.createDataFrame(
        [(i, t, next((r["_n0"] for r in brows if r["_b"] == i), 0) or 0,
          next((r["_n1"] for r in brows if r["_b"] == i), 0) or 0) for i, t in enumerate(thresholds())],
        "_i int, threshold double, _n0 long, _n1 long")
    # reverse running sum over the 91 grid rows: predicted class 0 = every bin at or above
    w = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    a = grid.select("_i", "threshold", F.sum("_n0").over(w).alias("tp0"), F.sum("_n1").over(w).alias("fp0"),
                    F.lit(n0_total).alias("_N0"), F.lit(n1_total).alias("_N1"))
    fn0 = F.col("_N0") - F.col("tp0")
    tn0 = F.col("_N1") - F.col("fp0")
    p0_, r0 = _div(F.col("tp0"), F.col("tp0") + F.col("fp0")), _div(F.col("tp0"), F.col("_N0"))
    p1_, r1 = _div(tn0, tn0 + fn0), _div(tn0, F.col("_N1"))
    return a.select("threshold", F.col("tp0").alias("tp_0"), fn0.alias("fn_0"), F.col("fp0").alias("fp_0"),
                    tn0.alias("tn_0"), p0_.alias("precision_0"), r0.alias("recall_0"),
                    _fbeta(p0_, r0, 1.0).alias("f1_0"), _fbeta(p0_, r0, 2.0).alias("f2_0"),
                    p1_.alias("precision_1"), r1.alias("recall_1"), _fbeta(p1_, r1, 2.0).alias("f2_1"))


def threshold_best_f1(table: DataFrame) -> DataFrame:
    """First maximum of F1 of class 0 (ties -> lowest threshold)."""
    return table.orderBy(F.desc("f1_0"), F.asc("threshold")).limit(1)


def threshold_constrained(table: DataFrame, min_recall_0: float = 0.5, min_precision_0: float = 0.0,
                          min_precision_1: float = 0.0) -> DataFrame:
    """Max precision_0 under recall_0 / precision_0 / precision_1 minima; if nothing
    qualifies, max of 0.5 * recall_0 + 0.5 * precision_0."""
    ok = table.where((F.col("recall_0") >= min_recall_0) & (F.col("precision_0") >= min_precision_0)
                     & (F.col("precision_1") >= min_precision_1))
    best = ok.orderBy(F.desc("precision_0"), F.asc("threshold")).limit(1).withColumn("rule", F.lit("constrained"))
    fb = (table.withColumn("_bal", 0.5 * F.col("recall_0") + 0.5 * F.col("precision_0"))
          .orderBy(F.desc("_bal"), F.asc("threshold")).limit(1).drop("_bal").withColumn("rule", F.lit("fallback")))
    if ok.limit(1).count() > 0:
        return best
    return fb


def class_weight_column(df: DataFrame, y: str, mode: str = "balanced", ratio: dict | None = None,
                        out: str = "weight") -> DataFrame:
    """Row weights: none / balanced (n / (2 * n_class)) / fixed ratios."""
    if mode == "none":
        return df.withColumn(out, F.lit(1.0))
    if mode == "fixed":
        w = F.lit(1.0)
        for k, v in (ratio or {}).items():
            w = F.when(c_(y) == k, F.lit(float(v))).otherwise(w)
        return df.withColumn(out, w)
    found = df.groupBy(y).count().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{y} has more than {MAX_CLASSES} values: not a class")
    counts = {r[0]: r[1] for r in found}
    n = sum(counts.values())
    w = F.lit(1.0)
    for k, v in counts.items():
        w = F.when(c_(y) == k, F.lit(n / (len(counts) * v))).otherwise(w)
    return df.withColumn(out, w)

