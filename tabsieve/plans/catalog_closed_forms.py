"""Model keys whose result has a closed form, so that SQL can check fits, folds, tuning and ablation on the whole table.

One 0/1 feature carries the signal. A tree of one split then scores a row with the share of its cell, one boosting
step with the logistic of twice the mean of the +-1 labels, and a logistic fit without penalty with the share again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import evaluate as V
from tabsieve.operators import models as M
from tabsieve.plans.inputs import read, with_cte
from tabsieve.plans.registry import query

CELL_COLUMNS = [
    ("lead_id", "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
                "CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))"),
    ("ship_dt", "l_shipdate"),
    ("x", "CASE WHEN l_quantity > 25 THEN 1.0D ELSE 0.0D END"),
    ("k", "1.0D"),
    ("flag", "l_returnflag"),
    ("y", "CAST((l_orderkey * 7919 + l_linenumber * 104729) % 100 < CASE WHEN l_quantity > 25 THEN 70 ELSE 30 END AS INT)"),
]
CELLS = "SELECT " + ", ".join(f"{e.replace('.0D', '.0::DOUBLE')} AS {a}" for a, e in CELL_COLUMNS) + " FROM lineitem"
ONE_SPLIT = dict(numTrees=1, maxDepth=1, bootstrap=False, featureSubsetStrategy="all")

_NUMBERED = "SELECT *, row_number() OVER (ORDER BY ship_dt, lead_id) - 1 AS rn, count(*) OVER () AS n FROM c"
_SPLIT = "SELECT *, rn < CAST(floor(n * 0.8) AS BIGINT) AS train FROM r"
_RATES = "SELECT x, avg(y) AS p1, avg(CASE y WHEN 0 THEN -5.0 ELSE 1.0 END) / avg(CASE y WHEN 0 THEN 5.0 ELSE 1.0 END) AS m FROM s WHERE train GROUP BY x"
_TEST = "SELECT lead_id, y, 1 - p1 AS p0, p1, m FROM s JOIN q USING (x) WHERE NOT train"
_CTES = dict(c=CELLS, r=_NUMBERED, s=_SPLIT, q=_RATES, t=_TEST)


def _ap(rel: str, score: str = "p0") -> str:
    """Average precision of class 0 in SQL."""
    return (f"(SELECT sum(pos * cp / (cp + cn)) / sum(pos) FROM (SELECT pos, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM "
            f"(SELECT {score} AS sc, sum(CAST(y = 0 AS BIGINT)) AS pos, sum(CAST(y <> 0 AS BIGINT)) AS neg FROM {rel} GROUP BY 1) "
            f"WINDOW w AS (ORDER BY sc DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))")


def cells(spark, sf):
    return read(spark, sf, "lineitem").selectExpr(*[f"{e} AS {a}" for a, e in CELL_COLUMNS])


def _train_test(spark, sf):
    s = V.time_split(cells(spark, sf), "ship_dt", "lead_id", 0.2)
    return s.where("split = 'train'"), s.where("split = 'test'")


def _rounded(scored, digits=9):
    return scored.select(F.col("id").alias("lead_id"), F.round("score", digits).alias("score"))


@query("fit_random_forest_cells", with_cte("SELECT lead_id, round(p0, 9) AS score FROM t", **_CTES))
def _forest(spark, sf):
    train, test = _train_test(spark, sf)
    return _rounded(M.score_rows(M.fit_classifier(train, "y", ["x", "k"], [], "rf", None, ONE_SPLIT), test, "lead_id"))


@query("fit_boosted_trees_cells", with_cte("SELECT lead_id, round(1 - 1 / (1 + exp(-2 * m)), 9) AS score FROM t", **_CTES))
def _boosted(spark, sf):
    train, test = _train_test(spark, sf)
    train = V.class_weight_column(train, "y", "fixed", {0: 5.0, 1: 1.0})
    fm = M.fit_boosted_trees(train, "y", ["x", "k"], [], weight="weight", max_iter=1, depth=1)
    return _rounded(M.score_rows(fm, test, "lead_id"))


@query("fit_elastic_net_cells", with_cte(
    "SELECT lead_id, round(1 - p, 5) AS score FROM s JOIN (SELECT flag, avg(y) AS p FROM s WHERE train GROUP BY flag) USING (flag) "
    "WHERE NOT train", **_CTES))
def _linear(spark, sf):
    train, test = _train_test(spark, sf)
    fm = M.fit_classifier(train, "y", [], ["flag"], "lr", None, dict(regParam=0.0, maxIter=500, tol=1e-13))
    return _rounded(M.score_rows(fm, test, "lead_id"), 5)


@query("fold_onehot_to_base_cells", with_cte(
    "SELECT 'x' AS base_feature, round(abs(b), 4) AS sum_abs_coef, round(abs(b), 4) AS max_abs_coef, CAST(1 AS BIGINT) AS nonzero_count "
    "FROM (SELECT (SELECT ln(p1 / (1 - p1)) FROM q WHERE x = 1) - (SELECT ln(p1 / (1 - p1)) FROM q WHERE x = 0) AS d, "
    "(SELECT stddev_pop(x) FROM s WHERE train) AS sd) z(d, sd), (SELECT 1) u, LATERAL (SELECT d * sd AS b)", **_CTES))
def _slope(spark, sf):
    train, _ = _train_test(spark, sf)
    fm = M.fit_classifier(train, "y", ["x"], [], "lr", None, dict(regParam=0.0, maxIter=500, tol=1e-13))
    return M.coefficient_rollup(fm, train).select("base_feature", F.round("sum_abs_coef", 4).alias("sum_abs_coef"),
                                                  F.round("max_abs_coef", 4).alias("max_abs_coef"), "nonzero_count")


_GAIN = ("SELECT 'x' AS feature, (SELECT 2 * avg(y) * (1 - avg(y)) FROM s WHERE train) - (SELECT sum(n * 2 * p * (1 - p)) / sum(n) FROM "
         "(SELECT count(*) AS n, avg(y) AS p FROM s WHERE train GROUP BY x)) AS g UNION ALL SELECT 'k', (SELECT 2 * avg(y) * (1 - avg(y)) "
         "FROM s WHERE train) - (SELECT sum(n * 2 * p * (1 - p)) / sum(n) FROM (SELECT count(*) AS n, avg(y) AS p FROM s WHERE train GROUP BY k))")


@query("feature_importance_cells", with_cte(
    "SELECT feature, round(abs(g) / (SELECT sum(abs(g)) FROM g), 9) AS importance FROM g", **_CTES, g=_GAIN))
def _importance(spark, sf):
    train, _ = _train_test(spark, sf)
    fm = M.fit_classifier(train, "y", ["x", "k"], [], "rf", None, ONE_SPLIT)
    return M.feature_importance(fm, train).withColumn("importance", F.round("importance", 9))


@query("select_by_importance_cells", with_cte(
    "SELECT feature FROM g ORDER BY g DESC, feature LIMIT 1", **_CTES, g=_GAIN))
def _selected(spark, sf):
    train, _ = _train_test(spark, sf)
    imp = M.feature_importance(M.fit_boosted_trees(train, "y", ["x", "k"], [], max_iter=1, depth=1), train)
    return imp.orderBy(F.desc("importance"), "feature").limit(1).select("feature")


@query("drop_one_ablation_cells", with_cte(
    f"SELECT feature, round(ap, 9) AS ap, round(ap - {_ap('t')}, 9) AS delta FROM (SELECT '<baseline>' AS feature, {_ap('t')} AS ap "
    f"UNION ALL SELECT 'k', {_ap('t')} UNION ALL SELECT 'x', {_ap('t', '0')})", **_CTES))
def _ablation(spark, sf):
    train, test = _train_test(spark, sf)
    out = M.drop_one_ablation(train, test, "y", ["x", "k"], [], "rf", ONE_SPLIT)
    return out.select("feature", F.round("ap", 9).alias("ap"), F.round("delta", 9).alias("delta"))


@query("tail_pruning_cells", with_cte(
    f"SELECT CAST(d AS INT) AS dropped, round({_ap('t')}, 9) AS ap, false AS improved FROM (VALUES (0), (1)) v(d)", **_CTES))
def _tail(spark, sf):
    train, test = _train_test(spark, sf)
    out = M.tail_pruning(train, test, "y", ["x", "k"], ["x", "k"], [], [1], "rf", ONE_SPLIT)
    return out.withColumn("ap", F.round("ap", 9))


_FOLDS = 3
_FOLD_SQL = ("SELECT *, " + " ".join(
    f"CASE WHEN rn >= n - {_FOLDS - i} * (n // {_FOLDS + 1}) AND rn < n - {_FOLDS - i - 1} * (n // {_FOLDS + 1}) THEN {i} ELSE"
    for i in range(_FOLDS)) + " NULL" + " END" * _FOLDS + " AS fold FROM r")
_FOLD_RATES = " UNION ALL ".join(
    f"SELECT {i} AS fold, x, 1 - avg(y) AS p0 FROM r WHERE rn < n - {_FOLDS - i} * (n // {_FOLDS + 1}) GROUP BY x" for i in range(_FOLDS))


@query("oof_scores_cells", with_cte(
    "SELECT lead_id, CAST(fold AS INT) AS test_fold, round(p0, 9) AS oof_p FROM f LEFT JOIN fr USING (fold, x)",
    c=CELLS, r=_NUMBERED, f=_FOLD_SQL, fr=_FOLD_RATES))
def _oof(spark, sf):
    f = V.expanding_folds(cells(spark, sf), "ship_dt", "lead_id", _FOLDS)
    out = M.oof_scores(f, "y", ["x", "k"], [], kind="rf", params=ONE_SPLIT)
    return out.select("lead_id", "test_fold", F.round("oof_p", 9).alias("oof_p"))


@query("tune_params_cells", with_cte(
    "SELECT CAST(trial AS INT) AS trial, params, CAST(3 AS INT) AS folds, round(mean_score, 9) AS mean_score, 'complete' AS state FROM ("
    "SELECT 0 AS trial, '{\"maxDepth\": 0}' AS params, (" + " + ".join(_ap(f"(SELECT y, 0 AS p0 FROM f WHERE fold = {i})") for i in range(_FOLDS))
    + ") / 3 AS mean_score UNION ALL SELECT 1, '{\"maxDepth\": 1}', ("
    + " + ".join(_ap(f"(SELECT y, p0 FROM f JOIN fr USING (fold, x) WHERE fold = {i})") for i in range(_FOLDS)) + ") / 3)",
    c=CELLS, r=_NUMBERED, f=_FOLD_SQL, fr=_FOLD_RATES))
def _tuned(spark, sf):
    f = V.expanding_folds(cells(spark, sf), "ship_dt", "lead_id", _FOLDS)
    fixed = {k: v for k, v in ONE_SPLIT.items() if k != "maxDepth"}
    out = M.tune_params(f, "y", ["x", "k"], [], {"maxDepth": [0, 1]}, 0, kind="rf", fixed=fixed)
    return out.withColumn("mean_score", F.round("mean_score", 9))


_F = "coalesce((1 + {b} * {b}) * p * r / nullif({b} * {b} * p + r, 0), 0)"


@query("score_metrics", with_cte(
    "SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM t "
    f"UNION ALL SELECT 'average_precision', round({_ap('t')}, 9) "
    "UNION ALL SELECT 'roc_auc', round((SELECT sum(pos * (cn - 0.5 * neg)) / (sum(pos) * sum(neg)) FROM (SELECT pos, neg, sum(neg) OVER "
    "(ORDER BY p0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM (SELECT p0, sum((y = 0)::INT) AS pos, sum((y = 1)::INT) AS neg "
    "FROM t GROUP BY p0))), 9) "
    "UNION ALL SELECT 'log_loss', round(avg(-(y * ln(p1) + (1 - y) * ln(1 - p1))), 9) FROM t "
    f"UNION ALL SELECT 'best_f1', round(max({_F.format(b=1)}), 9) FROM g UNION ALL SELECT 'best_f2', round(max({_F.format(b=2)}), 9) FROM g",
    **_CTES, g="SELECT tp / nullif(tp + fp, 0) AS p, tp / n0 AS r FROM (SELECT (SELECT count(*) FROM t WHERE y = 0 AND p0 >= thr) AS tp, "
      "(SELECT count(*) FROM t WHERE y = 1 AND p0 >= thr) AS fp, (SELECT count(*) FROM t WHERE y = 0) AS n0 FROM "
      "(SELECT 0.05::DOUBLE + i::DOUBLE * 0.01::DOUBLE AS thr FROM range(91) x(i)))"))
def _metrics(spark, sf):
    train, test = _train_test(spark, sf)
    fm = M.fit_classifier(train, "y", ["x", "k"], [], "rf", None, ONE_SPLIT)
    out = M.score_metrics(M.probability_of(fm.transform(test), 0, "score"), "y")
    return out.withColumn("value", F.round("value", 9))


@query("cluster_errors_cells", with_cte("SELECT count(*) AS size, min(x) AS least, max(x) AS most FROM c GROUP BY x", c=CELLS))
def _clusters(spark, sf):
    """Two separate points, two clusters."""
    out = M.cluster_errors(cells(spark, sf).select("x"), ["x"], [], k=2)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("least"), F.max("x").alias("most")).drop("cluster")
