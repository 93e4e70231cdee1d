"""Spark ML: encoders, model fits, importance, tuning, scoring.

Everything trains through ``pyspark.ml`` estimators on an assembled vector
column; no model code runs outside Spark.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.operators import boosting
from tabsieve.operators.joins import drop_stored, scratch_path
from tabsieve.operators.encode import (
    CARRIED_SUMS, LevelTable, hashed_target_encode, level_codes, ordered_target_encode, ordinal_encode_apply, ordinal_encode_fit,
    shared_target_encode, target_levels, target_prior,
)
from tabsieve.operators.ordered import _parts
from tabsieve.operators.packed import Packed, encoded_bins, pack


def onehot_encode(df: DataFrame, cols: list[str], fit_df: DataFrame | None = None) -> DataFrame:
    """One-hot vectors ``<col>_ohe`` over the alphabetically ordered train levels, which get their codes in Spark.

    Unseen levels and NULL get the code past the last one, which the encoder drops: all-zero vectors. A column
    without a level gives empty vectors.
    """
    train = df if fit_df is None else fit_df
    for c in cols:
        codes = level_codes(train, c)
        if not codes.rows:
            df = df.withColumn(f"{c}_ohe", array_to_vector(F.array().cast("array<double>")))
            continue
        encoder = OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe", dropLast=True, handleInvalid="keep")
        model = encoder.fit(codes.table.select(F.col("_code").cast("double").alias(f"{c}_idx")))
        coded = codes.join(df, F.col(_quoted(c)).cast("string"))
        df = model.transform(coded.withColumn(f"{c}_idx", F.coalesce("_code", F.lit(codes.rows)).cast("double")))
        df = df.drop("_code", f"{c}_idx")
    return df


# --------------------------------------------------------------- assembly
#: Bins of a tree's numeric splits.
BINS = 64
#: Fits that run at once.
THREADS = 4


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class CategoryEncoder:
    """A category as one number: ``levels`` has (_lvl, _val); NULL and unseen levels get their own values."""

    levels: LevelTable
    out: str
    missing: float
    unseen: float

    def apply(self, df: DataFrame) -> DataFrame:
        level = F.col(_quoted(self.levels.col)).cast("string")
        rest = F.when(level.isNull(), F.lit(self.missing)).otherwise(F.lit(self.unseen))
        return self.levels.join(df, level).withColumn(self.out, F.coalesce("_val", rest).cast("double")).drop("_val")


def tree_encoders(train: DataFrame, cols: list[str], label: str, counted: Column | None) -> list[CategoryEncoder]:
    """Encoders of the rows that come later: they get the statistic over all of ``train``; NULL is a level, an unseen
    level gets the mean label."""
    prior = target_prior(train, label, counted)
    return [CategoryEncoder(target_levels(train, c, label, prior, counted=counted), f"{c}__ts", prior, prior) for c in cols]


def encode_for_trees(train: DataFrame, encoders: list[CategoryEncoder], label: str, order_by: list[str], counted: Column | None,
                     keep: list[str], paths: list[str]) -> DataFrame:
    """``train`` with the encoders' columns: ordered target statistics, so a row's own label is not in its feature.

    Equal rows of ``order_by`` are ordered by a hash of the whole row; without ``order_by`` that hash is a permutation.
    The rows have at least the columns ``keep``; where they are stored (see ``stored``) is added to ``paths``.
    """
    spark, cols, others = train.sparkSession, [e.levels.col for e in encoders], list(paths)
    few = [_few(e, train) for e in encoders]
    if order_by and all(few):
        paths.append(scratch_path(spark))
        rows = shared_target_encode(train, cols, label, [e.out for e in encoders], order_by, encoders[0].unseen, keep,
                                    counted=counted, path=paths[-1])
        if rows is not None:
            return rows
    for e, c, some in zip(encoders, cols, few):  # every encoding stores its rows, and the one before is not read any more
        paths.append(scratch_path(spark))
        if some and not order_by:
            train = hashed_target_encode(train, c, label, e.out, e.unseen, counted=counted, path=paths[-1])
        else:
            order = [*order_by, F.xxhash64(*[F.col(_quoted(k)) for k in train.columns])]
            train = ordered_target_encode(train, c, label, e.out, order, e.unseen, counted=counted, path=paths[-1])
        for path in [p for p in paths[:-1] if p not in others]:
            drop_stored(spark, path)
            paths.remove(path)
    return train


def _few(encoder: CategoryEncoder, train: DataFrame) -> bool:
    return encoder.levels.rows * _parts(train, None) <= CARRIED_SUMS


def encode_for_linear(train: DataFrame, col: str):
    """(encoder, ``train`` with its column): codes of the levels by frequency, for one-hot slots.

    NULL is taken for the most frequent level; unseen levels get the code past the last one, a row of zeros.
    """
    codes = level_codes(train, col, by="frequency")
    levels = LevelTable(col, codes.table.select("_lvl", F.col("_code").cast("double").alias("_val")), codes.rows)
    encoder = CategoryEncoder(levels, f"{col}__code", 0.0, float(codes.rows))
    return encoder, encoder.apply(train)


def filled_expr(col: str, med: dict) -> str:
    """SQL of a numeric whose NULL and NaN are its median, or 0 without one."""
    return f"coalesce(nanvl(CAST({_quoted(col)} AS DOUBLE), NULL), {float(med[col] or 0.0)!r}D)"


def feature_stages(df: DataFrame, num_cols: list[str], encoders: list[CategoryEncoder], linear: bool = False,
                   med: dict | None = None) -> list:
    """Stages that assemble ``features``; the encoders' columns are there already.

    Numerics: exact medians fill NULL (0 when a column has no value). ``linear`` also standardises them by population
    deviation and one-hot encodes the categories' codes; slots keep the name of their source before ``__``.
    """
    from tabsieve.operators.transform import medians
    med = med if med is not None else medians(df, num_cols) if num_cols else {}
    filled = {c: filled_expr(c, med) for c in num_cols}
    if linear and filled:
        row = df.agg(*[f(F.expr(e)).alias(f"{n}{i}") for i, e in enumerate(filled.values())
                       for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        filled = {c: f"({e} - {float(row[f'm{i}'] or 0.0)!r}D) / {float(row[f's{i}'] or 0.0) or 1.0!r}D"
                  for i, (c, e) in enumerate(filled.items())}
    stages, slots = [], [f"{c}__num" for c in filled]
    if filled:
        picks = [f"{e} AS {_quoted(c + '__num')}" for c, e in filled.items()]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(picks)} FROM __THIS__"))
    for e in encoders:
        if linear:
            stages.append(OneHotEncoder(inputCol=e.out, outputCol=f"{e.levels.col}__ohe", dropLast=True, handleInvalid="keep"))
        slots.append(f"{e.levels.col}__ohe" if linear else e.out)
    stages.append(VectorAssembler(inputCols=slots, outputCol="features", handleInvalid="keep"))
    return stages


def _classifier(kind: str, label: str, weight: str | None, params: dict, seed: int = 42):
    if kind == "gbt":
        m = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, **{"maxBins": BINS, **params})
    elif kind == "rf":
        m = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed, **{"maxBins": BINS, **params})
    elif kind == "lr":  # numerics are standardised already; one-hot columns are penalised as they are
        m = LogisticRegression(labelCol=label, featuresCol="features", standardization=False, **params)
    else:
        raise ValueError(kind)
    if weight:
        m.setWeightCol(weight)
    return m


@dataclass
class FittedModel:
    model: PipelineModel
    num_cols: list
    cat_cols: list
    kind: str
    encoders: list[CategoryEncoder]

    def transform(self, df: DataFrame) -> DataFrame:
        for e in self.encoders:
            df = e.apply(df)
        return self.model.transform(df).drop(*[e.out for e in self.encoders])

    def slot_sources(self, df: DataFrame) -> list[str]:
        """Source column of every slot of the assembled vector (from ML attribute metadata)."""
        out = self.transform(df.limit(0))
        meta = out.schema["features"].metadata.get("ml_attr", {})
        attrs = []
        for group in meta.get("attrs", {}).values():
            attrs.extend(group)
        attrs.sort(key=lambda a: a["idx"])
        srcs = []
        for a in attrs:
            name = a.get("name", "")
            srcs.append(name.split("__")[0])
        size = meta.get("num_attrs", len(srcs))
        return srcs if len(srcs) == size else srcs + ["?"] * (size - len(srcs))


@dataclass
class Prepared:
    """What fits of one set of rows and features share: their medians, and the rows with their categories encoded or as
    bins, both made when a fit first asks for them."""

    src: DataFrame
    encode: Callable[[], DataFrame]
    label: str
    num_cols: list
    cat_cols: list
    kind: str
    weight: str | None
    val: str | None
    encoders: list[CategoryEncoder]
    med: dict
    paths: list
    hashed: bool = False
    records: Packed | None = None
    made: DataFrame | None = None
    binned: dict = field(default_factory=dict)
    lock: Lock = field(default_factory=Lock)

    def fit(self, params: dict | None = None, seed: int = 42) -> FittedModel:
        stages = feature_stages(self.src, self.num_cols, self.encoders, linear=(self.kind == "lr"), med=self.med)
        classifier = _classifier(self.kind, self.label, self.weight, params or {}, seed)
        if self.kind == "gbt" and boosting.trains(classifier, len(stages[-1].getInputCols())):
            model = PipelineModel([*stages, boosting.boost(self._bins(stages, classifier), classifier)])
        else:
            with self.lock:
                rows = self._rows()
            model = Pipeline(stages=[*stages, classifier]).fit(rows)
        _drop_summary(self.src.sparkSession, model.stages[-1])
        return FittedModel(model, self.num_cols, self.cat_cols, self.kind, self.encoders)

    def _rows(self) -> DataFrame:
        if self.made is None:
            self.made = self.encode()
        return self.made

    def _bins(self, stages: list, classifier) -> boosting.Binned:
        """The rows as bins, stored once for all fits with the same bins."""
        val = classifier.getOrDefault("validationIndicatorCol") if classifier.isSet("validationIndicatorCol") else None
        key = classifier.getMaxBins(), classifier.getSeed(), val
        column = lambda name: F.col(_quoted(name)) if name else None
        with self.lock:
            if key in self.binned:
                return self.binned[key]
            spark, records = self.src.sparkSession, self.records
            if self.hashed and val == self.val:  # statistics in hash order need no rows
                if records is None or not records.holds(self.src.columns, key):
                    self.paths.append(scratch_path(spark))
                    records = pack_rows(self.src, self.num_cols, self.encoders, [self.src.columns], self.label, self.weight, val,
                                        self.med, *key[:2], self.paths[-1])
                if records is not None and records.holds(self.src.columns, key):
                    self.paths.append(scratch_path(spark))
                    self.binned[key] = encoded_bins(records, self.src.columns, self.num_cols, self.cat_cols, key[1], self.paths[-1])
                    return self.binned[key]
            rows = self._rows()
            for stage in stages[:-1]:
                rows = stage.transform(rows)
            self.paths.append(scratch_path(spark))
            self.binned[key] = boosting.bin_rows(rows, [column(c) for c in stages[-1].getInputCols()], column(self.label),
                                                 column(self.weight), column(val), *key[:2], self.paths[-1])
            return self.binned[key]


def pack_rows(src: DataFrame, num_cols, encoders: list[CategoryEncoder], orders: list[list[str]], label: str, weight: str | None,
              val: str | None, med: dict, bins: int, seed: int, path: str) -> Packed | None:
    """``src`` as records (see ``pack``) with its numerics filled by their medians."""
    return pack(src, {c: F.expr(filled_expr(c, med)) for c in num_cols}, [e.levels.col for e in encoders],
                {e.levels.col: e.levels for e in encoders}, orders, label, weight, val, encoders[0].unseen, bins, seed, path)


@contextmanager
def prepared(train: DataFrame, label: str, num_cols, cat_cols, kind: str = "gbt", weight: str | None = None,
             val: str | None = None, order_by: list[str] | None = None, med: dict | None = None, held: bool = False,
             encoders: list[CategoryEncoder] | None = None, records: Packed | None = None):
    """The ``Prepared`` rows of a fit, or of several that differ in their parameters only; released at the end.

    ``held`` says that the caller keeps the columns of ``train`` in the cache already. ``encoders`` (of trees) and
    ``records`` (of these rows, with more features) are made if they are not known.
    """
    from tabsieve.operators.transform import medians
    # without stored rows, the statistics and the estimator each scan the input: read it once, then release it
    spark, paths, codes = train.sparkSession, [], None
    cols = dict.fromkeys([*num_cols, *cat_cols, label, *(order_by or []), *filter(None, [weight, val])])
    src = train.select(*[F.col(_quoted(c)) for c in cols])
    stores = bool(cat_cols) and kind != "lr"  # ordered statistics store the rows, and the passes before read few columns
    held = held or stores
    src = src if held else src.persist()
    try:
        rows, hashed, encode = src, False, lambda: src
        counted = ~F.col(_quoted(val)) if val else None
        if stores:
            keep = list(dict.fromkeys([*num_cols, label, *filter(None, [weight, val])]))
            encoders = encoders or tree_encoders(src, list(cat_cols), label, counted)
            encode = lambda: encode_for_trees(src, encoders, label, order_by or [], counted, keep, paths)
            hashed = kind == "gbt" and not order_by and all(_few(e, src) for e in encoders)
            rows = None if hashed else encode()
        else:
            encoders = []
        for c in cat_cols if kind == "lr" else []:
            encoder, rows = encode_for_linear(rows, c)
            if encoder.levels.rows:  # a category without a level has no slot
                encoders.append(encoder)
        codes = rows.persist() if encoders and kind == "lr" else None
        med = med if med is not None else medians(src if rows is None else rows, list(num_cols)) if num_cols else {}
        yield Prepared(src, encode, label, list(num_cols), list(cat_cols), kind, weight, val, encoders, med, paths, hashed, records, rows)
    finally:
        if codes is not None:
            codes.unpersist()
        if not held:
            src.unpersist()
        for path in paths:
            drop_stored(spark, path)


def fit_classifier(train: DataFrame, label: str, num_cols: list[str], cat_cols: list[str], kind: str = "gbt",
                   weight: str | None = None, params: dict | None = None, seed: int = 42,
                   order_by: list[str] | None = None, med: dict | None = None, encoders: list[CategoryEncoder] | None = None,
                   records: Packed | None = None) -> FittedModel:
    """Fit on numerics and categories of any width. Trees read a category as ordered target statistics in the order of
    ``order_by`` (a hash order without it), linear models as one-hot slots of its levels. ``med`` holds the medians of the numerics, if they are known;
    ``encoders`` and ``records`` are those of ``prepared``."""
    val = (params or {}).get("validationIndicatorCol")
    with prepared(train, label, num_cols, cat_cols, kind, weight, val, order_by, med, encoders=encoders, records=records) as rows:
        return rows.fit(params, seed)


def _drop_summary(spark: SparkSession, model) -> None:
    """Forests and linear models keep a training summary, which holds the session and travels with every task that
    scores; a session that has seen an observation cannot be serialised, so scoring would fail."""
    if hasattr(model, "hasSummary") and model.hasSummary:
        model._java_obj.setSummary(spark._jvm.scala.Option.empty())


def fit_boosted_trees(train: DataFrame, label: str, num_cols, cat_cols, weight=None, max_iter: int = 20,
                      depth: int = 5, step: float = 0.1, val_col: str | None = None, seed: int = 42,
                      order_by: list[str] | None = None) -> FittedModel:
    params = dict(maxIter=max_iter, maxDepth=depth, stepSize=step)
    if val_col:
        params["validationIndicatorCol"] = val_col
    return fit_classifier(train, label, num_cols, cat_cols, "gbt", weight, params, seed, order_by)


def fit_random_forest(train: DataFrame, label: str, num_cols, cat_cols, n_trees: int = 20, depth: int = 5,
                      seed: int = 42, order_by: list[str] | None = None) -> FittedModel:
    return fit_classifier(train, label, num_cols, cat_cols, "rf", None, dict(numTrees=n_trees, maxDepth=depth), seed, order_by)


def fit_elastic_net(train: DataFrame, label: str, num_cols, cat_cols, C: float = 1.0, l1_ratio: float = 0.5,
                    weight=None, class_weight: str | None = None) -> FittedModel:
    """``C`` divides the summed log loss, so the penalty per unit of weight is 1 / (C * sum of weights)."""
    if class_weight:
        from tabsieve.operators.evaluate import class_weight_column
        weight = "_class_weight"
        train = class_weight_column(train, label, class_weight, out=weight)
    total = train.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 0
    params = dict(regParam=1.0 / (C * max(float(total), 1.0)), elasticNetParam=l1_ratio, maxIter=100)
    return fit_classifier(train, label, num_cols, cat_cols, "lr", weight, params)


def probability_of(scored: DataFrame, cls: int = 1, out: str = "p") -> DataFrame:
    return scored.withColumn(out, vector_to_array(F.col("probability"))[cls])


def feature_importance(fm: FittedModel, df: DataFrame) -> DataFrame:
    """(feature, importance): tree importances summed per source column (normalised to 1);
    for linear models |coefficient| rolled up by source column."""
    spark = df.sparkSession
    srcs = fm.slot_sources(df)
    clf = fm.model.stages[-1]
    if fm.kind == "lr":
        vals = [abs(x) for x in clf.coefficients.toArray()]
    else:
        vals = list(clf.featureImportances.toArray())
    rows = [(srcs[i] if i < len(srcs) else f"f{i}", float(v)) for i, v in enumerate(vals)]
    t = spark.createDataFrame(rows, "feature string, importance double")  # one row per vector slot
    return t.groupBy("feature").agg(F.sum("importance").alias("importance"))


def coefficient_rollup(fm: FittedModel, df: DataFrame) -> DataFrame:
    """Linear model: (base_feature, sum_abs_coef, max_abs_coef, nonzero_count) over one-hot slots."""
    spark = df.sparkSession
    srcs = fm.slot_sources(df)
    coefs = fm.model.stages[-1].coefficients.toArray()
    t = spark.createDataFrame([(srcs[i], float(abs(c))) for i, c in enumerate(coefs)],
                              "base_feature string, abs_coef double")
    return (t.where(F.col("abs_coef") > 0).groupBy("base_feature")
            .agg(F.sum("abs_coef").alias("sum_abs_coef"), F.max("abs_coef").alias("max_abs_coef"),
                 F.count(F.lit(1)).alias("nonzero_count")))


# ------------------------------------------------------------ tuning & loops
def ap_of(scored: DataFrame, label: str, positive: int = 0) -> float:
    """Average precision of ``positive`` computed by Spark (distinct-score prefix sums)."""
    from tabsieve.operators.evaluate import average_precision
    p = probability_of(scored, positive, "_p")
    ap = average_precision(p, label, "_p", positive=positive).first()[0]
    if ap is None:
        raise ValueError(f"no rows of class {positive} to score")
    return ap


def _folds(df: DataFrame, fold_col: str, seg: str) -> list[tuple[int, int]]:
    """(fold, first segment of its test rows) of every test fold, in order; its training rows lie before that."""
    rows = (df.where(F.col(fold_col).isNotNull()).groupBy(fold_col).agg(F.min(seg).alias("s"))
            .orderBy(fold_col).collect())  # one row per test block
    return [(r[0], r["s"]) for r in rows]


def concurrently(spark: SparkSession, tasks: list, threads: int = THREADS) -> list:
    """Results of the calls in ``tasks``, in their order; at most ``threads`` run at once, each in a scheduler pool of
    its own, so that short stages of one fit fill what another leaves free."""
    def run(place, task):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{place % threads}")
        return task()
    with ThreadPoolExecutor(max(1, threads)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), i, t) for i, t in enumerate(tasks)]]


def oof_scores(df: DataFrame, label: str, num_cols, cat_cols, fold_col: str = "test_fold", kind: str = "gbt",
               params: dict | None = None, positive: int = 0, seg: str = "_seg", threads: int = THREADS) -> DataFrame:
    """Out-of-fold probabilities over expanding time folds: every fold trains on the rows before its test block.

    The folds are fitted concurrently. Rows in no test fold keep NULL. Scored folds and unscored rows are put together
    by union, so keys may repeat.
    """
    def scored(i, first):
        fm = fit_classifier(df.where(F.col(seg) < first), label, num_cols, cat_cols, kind, None, params or {})
        return probability_of(fm.transform(df.where(F.col(fold_col) == i)), positive, "oof_p").select(*df.columns, "oof_p")
    folds = _folds(df, fold_col, seg)
    parts = concurrently(df.sparkSession, [functools.partial(scored, *f) for f in folds], threads)
    rest = df.where(F.col(fold_col).isNull()).withColumn("oof_p", F.lit(None).cast("double"))
    return functools.reduce(lambda a, b: a.unionByName(b), [rest, *parts])


def draw_params(space: dict, n_trials: int, seed: int) -> list[dict]:
    """Seeded draws: a list is a choice, ("log", low, high) log-uniform, ("float", low, high) uniform, ("int", low, high)
    a whole number. ``n_trials`` of 0 is the whole grid of the lists, in order."""
    import itertools
    import math
    import random
    if not n_trials:
        return [dict(zip(space, values)) for values in itertools.product(*space.values())]
    rng = random.Random(seed)

    def draw(v):
        if not isinstance(v, tuple):
            return rng.choice(v)
        kind, low, high = v
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.randint(low, high) if kind == "int" else rng.uniform(low, high)
    return [{p: draw(v) for p, v in space.items()} for _ in range(n_trials)]


def objective_score(scored: DataFrame, label: str, objective: str, positive: int) -> float:
    """"ap" and "auc" of class ``positive``, or "f2": the best F2 of class 0 over the threshold grid."""
    from tabsieve.operators import evaluate as V
    if objective == "ap":
        return ap_of(scored, label, positive)
    p = probability_of(scored, 0 if objective == "f2" else positive, "_p")
    if objective == "f2":
        value = V.threshold_table(p, label, "_p").agg(F.max("f2_0")).first()[0]
    else:
        value = V.roc_auc(p, label, "_p", positive=positive).first()[0]
    if value is None:
        raise ValueError(f"{objective} needs rows of both classes")
    return float(value)


@contextmanager
def prepared_trials(train: DataFrame, label: str, num_cols, cat_cols, kind: str, class_weight="none", held: bool = False):
    """(``Prepared`` rows, sum of weights or None) of the trials with this ``class_weight`` ("none", "balanced" or a ratio
    per class), which becomes row weights; linear models need the sum."""
    from tabsieve.operators.evaluate import class_weight_column
    weight = None if class_weight == "none" else "_class_weight"
    if weight:
        train = class_weight_column(train, label, class_weight if isinstance(class_weight, str) else "fixed",
                                    class_weight if isinstance(class_weight, dict) else None, out=weight)
    total = (train.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 0) if kind == "lr" else None
    with prepared(train, label, num_cols, cat_cols, kind, weight, held=held and not weight) as rows:
        yield rows, total


def fit_trial(rows: Prepared, total, params: dict) -> FittedModel:
    """Fit with drawn parameters; a linear model takes ``C`` and ``l1_ratio``."""
    params = {k: v for k, v in params.items() if k != "class_weight"}
    if rows.kind == "lr" and "C" in params:
        params["regParam"] = 1.0 / (params.pop("C") * max(float(total), 1.0))
        params["elasticNetParam"] = params.pop("l1_ratio", 0.0)
    return rows.fit(params)


def tune_params(df: DataFrame, label: str, num_cols, cat_cols, space: dict, n_trials: int = 4, fold_col: str = "test_fold",
                kind: str = "gbt", seed: int = 42, positive: int = 0, seg: str = "_seg", objective: str = "ap",
                fixed: dict | None = None, startup: int = 5, warmup: int = 1, threads: int = THREADS) -> DataFrame:
    """Seeded random search over expanding time folds with median stopping: (trial, params, folds, mean_score, state).

    A fold is fitted for all trials that are left, concurrently, before the next one starts; they share its encoded rows. From fold ``warmup`` on
    (counted from 0) a trial whose running mean lies below the median of all trials' running means at that fold is
    pruned, but the first ``startup`` trials never are. So the table is the same for any number of threads. A fold
    without class ``positive`` is an error.
    """
    import json
    import statistics
    spark = df.sparkSession
    drawn = draw_params(space, n_trials, seed)
    draws = [{**(fixed or {}), **d} for d in drawn]
    scores: list[list[float]] = [[] for _ in draws]
    alive = list(range(len(draws)))
    used = dict.fromkeys([*num_cols, *cat_cols, label, fold_col, seg])
    df = df.select(*[F.col(_quoted(c)) for c in used]).persist()
    try:
        folds = _folds(df, fold_col, seg)
        if not folds:
            raise ValueError("no test folds")
        for step, (i, first) in enumerate(folds):
            train, test = df.where(F.col(seg) < first), df.where(F.col(fold_col) == i)
            with ExitStack() as stack:  # trials of equal weights share their encoded rows and medians
                weights = {json.dumps(draws[t].get("class_weight", "none"), sort_keys=True): t for t in alive}
                shared = {w: stack.enter_context(prepared_trials(train, label, num_cols, cat_cols, kind,
                                                                 draws[t].get("class_weight", "none"), held=True))
                          for w, t in weights.items()}

                def score(t):
                    rows, total = shared[json.dumps(draws[t].get("class_weight", "none"), sort_keys=True)]
                    return objective_score(fit_trial(rows, total, draws[t]).transform(test), label, objective, positive)
                found = concurrently(spark, [functools.partial(score, t) for t in alive], threads)
            for t, value in zip(alive, found):
                scores[t].append(value)
            if warmup <= step < len(folds) - 1:
                middle = statistics.median(statistics.fmean(scores[t]) for t in alive)
                alive = [t for t in alive if t < startup or statistics.fmean(scores[t]) >= middle]
    finally:
        df.unpersist()
    rows = [(t, json.dumps(p, sort_keys=True), len(scores[t]), statistics.fmean(scores[t]),
             "complete" if t in alive else "pruned") for t, p in enumerate(drawn)]
    return spark.createDataFrame(rows, "trial int, params string, folds int, mean_score double, state string")


class Refits:
    """Fits on subsets of the features, scored on ``valid``: the columns that they read are cached, and medians, level
    statistics and the records of boosted trees are made once for all ``subsets`` (of numerics and categories)."""

    def __init__(self, train: DataFrame, valid: DataFrame, label: str, num_cols, cat_cols, subsets: list, kind: str, params: dict | None):
        from tabsieve.operators.transform import medians
        self.train, self.valid = (df.select(*[F.col(_quoted(c)) for c in dict.fromkeys([*num_cols, *cat_cols, label])]).persist()
                                  for df in (train, valid))
        self.spark, self.label, self.kind, self.params, self.path = train.sparkSession, label, kind, params or {}, None
        self.med, self.encoders, self.records = medians(self.train, num_cols), [], None
        if cat_cols and kind != "lr":
            self.encoders = tree_encoders(self.train, list(cat_cols), label, None)
        classifier = _classifier(kind, label, None, self.params)
        if (kind == "gbt" and self.encoders and all(_few(e, self.train) for e in self.encoders)
                and boosting.trains(classifier, len(num_cols) + len(cat_cols))):
            self.path = scratch_path(self.spark)
            orders = [list(dict.fromkeys([*n, *c, label])) for n, c in subsets if c]
            self.records = pack_rows(self.train, num_cols, self.encoders, orders, label, None, self.params.get("validationIndicatorCol"),
                                     self.med, classifier.getMaxBins(), classifier.getSeed(), self.path)

    def ap(self, num_cols, cat_cols, positive: int) -> float:
        own = [e for e in self.encoders if e.levels.col in cat_cols]
        fm = fit_classifier(self.train, self.label, num_cols, cat_cols, self.kind, None, self.params, med=self.med, encoders=own,
                            records=self.records)
        return ap_of(fm.transform(self.valid), self.label, positive)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.train.unpersist()
        self.valid.unpersist()
        if self.path:
            drop_stored(self.spark, self.path)


def drop_one_ablation(train: DataFrame, valid: DataFrame, label: str, num_cols, cat_cols, kind: str = "gbt",
                      params: dict | None = None, positive: int = 0, threads: int = THREADS) -> DataFrame:
    """Refit without each feature, concurrently; (feature, ap, delta_vs_baseline). Inputs are cached once, without other
    columns."""
    features = [*num_cols, *cat_cols]
    subsets = [tuple([x for x in cols if x != drop] for cols in (num_cols, cat_cols)) for drop in [None, *features]]
    with Refits(train, valid, label, num_cols, cat_cols, subsets, kind, params) as refits:
        base, *found = concurrently(train.sparkSession, [functools.partial(refits.ap, n, c, positive) for n, c in subsets], threads)
    return train.sparkSession.createDataFrame([("<baseline>", base, 0.0)] + [(c, ap, ap - base) for c, ap in zip(features, found)],
                                              "feature string, ap double, delta double")


def tail_pruning(train: DataFrame, valid: DataFrame, label: str, ranked: list[str], num_cols, cat_cols,
                 sizes: list[int], kind: str = "gbt", params: dict | None = None, positive: int = 0) -> DataFrame:
    """Drop the n least important features for n in ``sizes``; stop at the first improvement."""
    def without(n):
        drop = set(ranked[-n:]) if n > 0 else set()
        return [c for c in num_cols if c not in drop], [c for c in cat_cols if c not in drop]
    subsets = [(n, without(n)) for n in sizes if any(without(n))]
    with Refits(train, valid, label, num_cols, cat_cols, [(num_cols, cat_cols), *(s for _, s in subsets)], kind, params) as refits:
        base = refits.ap(num_cols, cat_cols, positive)
        rows = [(0, base, False)]
        for n, own in subsets:
            ap = refits.ap(*own, positive)
            rows.append((n, ap, ap > base))
            if ap > base:
                break
    return train.sparkSession.createDataFrame(rows, "dropped int, ap double, improved boolean")


def score_rows(model: FittedModel, df: DataFrame, id_col: str, cls: int = 0) -> DataFrame:
    """(id, score) = probability of class ``cls``; works on unlabelled rows."""
    return probability_of(model.transform(df), cls, "score").select(F.col(id_col).alias("id"), "score")


def score_metrics(scored: DataFrame, label: str, score: str = "score", cls: int = 0) -> DataFrame:
    """(metric, value) of labelled rows scored with the probability of class ``cls``: rows, roc_auc, average_precision,
    log_loss, and the best F1 and F2 of that class over the threshold grid (for class 0)."""
    from tabsieve.operators import evaluate as V
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.col(label).alias("_y"), F.col(score).alias("_p0"), (1 - F.col(score)).alias("_p1"))
    p1 = "_p1" if cls == 0 else "_p0"
    parts = {"rows": rows.agg(F.count(F.lit(1)).cast("double")), "roc_auc": V.roc_auc(rows, "_y", "_p0", positive=cls),
             "average_precision": V.average_precision(rows, "_y", "_p0", positive=cls), "log_loss": V.log_loss(rows, "_y", p1)}
    if cls == 0:
        table = V.threshold_table(rows, "_y", "_p0")
        parts |= {"best_f1": table.agg(F.max("f1_0")), "best_f2": table.agg(F.max("f2_0"))}
    return functools.reduce(lambda a, b: a.unionByName(b), [
        part.toDF("value").select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        for name, part in parts.items()])


def save_model(fm: FittedModel, path: str) -> None:
    """The pipeline, a table per category and a row per category with its settings, under ``path``."""
    fm.model.write().overwrite().save(f"{path}/model")
    for i, e in enumerate(fm.encoders):
        e.levels.table.write.mode("overwrite").parquet(f"{path}/levels/{i}")
    spark = SparkSession.active()
    rows = [(i, e.levels.col, e.out, e.missing, e.unseen, e.levels.rows) for i, e in enumerate(fm.encoders)]
    spark.createDataFrame(rows, "i int, col string, out string, missing double, unseen double, rows long").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/encoders")
    spark.createDataFrame([(fm.num_cols, fm.cat_cols, fm.kind)], "num array<string>, cat array<string>, kind string").write.mode(
        "overwrite").parquet(f"{path}/columns")


def load_model(path: str) -> FittedModel:
    spark = SparkSession.active()
    about = spark.read.parquet(f"{path}/columns").first()
    encoders = [CategoryEncoder(LevelTable(r["col"], spark.read.parquet(f"{path}/levels/{r['i']}"), r["rows"]), r["out"],
                                r["missing"], r["unseen"])
                for r in spark.read.parquet(f"{path}/encoders").orderBy("i").collect()]  # a row per category
    return FittedModel(PipelineModel.load(f"{path}/model"), list(about["num"]), list(about["cat"]), about["kind"], encoders)


# ----------------------------------------------------------- error clusters
def cluster_errors(df: DataFrame, num_cols, cat_cols, k: int = 4, max_pcs: int = 10, seed: int = 42) -> DataFrame:
    """Numeric NULL -> 0, categories as codes in sorted order ("missing" is a level), standardised, PCA (<= 10),
    k-means (<= 4). With fewer than two rows there is nothing to cluster and ``cluster`` is NULL."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    n = df.limit(max(k, 2)).count()
    if n < 2:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    filled = df.fillna(0, subset=list(num_cols))
    stages, codes = [], [f"{c}__code" for c in cat_cols]
    for c in cat_cols:  # codes are given out in Spark, whatever the number of levels
        filled = ordinal_encode_apply(filled, ordinal_encode_fit(df, c), f"{c}__code")
    stages.append(VectorAssembler(inputCols=list(num_cols) + codes, outputCol="_raw", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True))
    n_pc = max(1, min(max_pcs, len(num_cols) + len(codes)))
    stages.append(PCA(k=n_pc, inputCol="_z", outputCol="_pc"))
    stages.append(KMeans(k=min(k, n), seed=seed, featuresCol="_pc", predictionCol="cluster"))
    model = Pipeline(stages=stages).fit(filled)
    return model.transform(filled).drop("_raw", "_z", "_pc", *codes)
