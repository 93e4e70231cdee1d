"""Nothing is cut: all folds, wide categories, missing scores, junk dates, table folders, wide tables."""

import itertools
import json
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import assoc as A
from tabsieve.operators import dates as D
from tabsieve.operators import encode as E
from tabsieve.operators import evaluate as V
from tabsieve.operators import models as M
from tabsieve.operators import pairs as PR
from tabsieve.operators import profile as P
from tabsieve.operators import quantiles as Q
from tabsieve.operators import transform as T

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def labelled(spark, n=600):
    rng = random.Random(3)
    rows = [(i, float(i), f"lv{i % 1200}", rng.choice("ab"), int(rng.random() < 0.3 + 0.4 * (i % 2))) for i in range(n)]
    return spark.createDataFrame(rows, "lead_id long, t double, wide string, cat string, y int").withColumn(
        "when", F.timestamp_seconds(F.col("t") * 86400).cast("timestamp_ntz"))


def test_every_test_fold_is_scored(spark):
    f = V.expanding_folds(labelled(spark), "when", "lead_id", 5)
    out = M.oof_scores(f, "y", ["t"], ["cat"], params=dict(maxIter=2, maxDepth=2))
    rows = out.groupBy("test_fold").agg(F.count("oof_p").alias("scored"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.test_fold for r in rows} == {None, 0, 1, 2, 3, 4}
    assert all(r.scored == (0 if r.test_fold is None else r.n) for r in rows)
    blocks = V.expanding_folds_blocks(labelled(spark), "when", "lead_id", 3)
    tuned = M.tune_params(blocks, "y", ["t"], [], {"maxDepth": [2]}, n_trials=1, kind="rf").first()
    assert 0 < tuned.mean_score <= 1 and tuned.state == "complete" and tuned.folds == 2
    one_class = f.where("y = 1")
    with pytest.raises(ValueError):
        M.tune_params(one_class, "y", ["t"], [], {"maxDepth": [2]}, n_trials=1, kind="rf")


@pytest.mark.parametrize("levels", [3, 1001, 1_000_000])
def test_categories_of_any_width_train_on_one_path(spark, levels):
    n = max(2400, levels)
    df = spark.range(n).select("id", F.concat(F.lit("c"), F.col("id") % levels).alias("c"), (F.col("id") % 2).cast("int").alias("y"))
    fm = M.fit_random_forest(df, "y", [], ["c"], n_trees=1, depth=2, order_by=["id"])
    assert [type(s).__name__ for s in fm.model.stages] == ["VectorAssembler", "RandomForestClassificationModel"]
    assert fm.encoders[0].levels.rows == levels
    assert M.score_rows(fm, df.limit(500).union(spark.createDataFrame([(-1, None, 0), (-2, "new", 0)], df.schema)), "id").count() == 502
    if levels <= 1001:
        lin = M.fit_elastic_net(df, "y", [], ["c"])
        assert lin.model.stages[-1].numFeatures == levels


def test_ordered_statistics_follow_their_definition(spark):
    """Against a running mean in Python; a hot level over many blocks, null levels, rows that do not count."""
    rng = random.Random(11)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, f"lv{rng.randint(0, 40)}"]), rng.choice([0, 1, 1, None]), rng.random() < 0.8)
            for i in range(900)]
    df = spark.createDataFrame(rows, "id long, c string, y int, used boolean")
    got = {r.id: r.ts for r in E.ordered_target_encode(df, "c", "y", "ts", ["id"], prior=0.25, strength=2.0,
                                                       counted=F.col("used"), block_rows=50).collect()}
    sums = {}
    for i, c, y, used in rows:
        s, n = sums.get(c, (0, 0))
        assert got[i] == pytest.approx((s + 0.5) / (n + 2.0)), i
        sums[c] = (s + y, n + 1) if used and y is not None else (s, n)
    after = {r._lvl: r._val for r in E.target_levels(df, "c", "y", 0.25, 2.0, F.col("used")).table.collect()}
    assert after == {c: pytest.approx((s + 0.5) / (n + 2.0)) for c, (s, n) in sums.items()}


def test_saved_models_score_the_same(spark, tmp_path):
    df = labelled(spark)
    fm = M.fit_boosted_trees(df, "y", ["t"], ["wide", "cat"], max_iter=2, depth=2, order_by=["lead_id"])
    M.save_model(fm, str(tmp_path / "m"))
    a, b = (sorted(map(tuple, M.score_rows(m, df, "lead_id").collect())) for m in (fm, M.load_model(str(tmp_path / "m"))))
    assert a == b and len(a) == 600


def test_saturated_logistic_gives_group_rates(spark):
    """Without a penalty, a model with one slot per level reproduces the share of each level."""
    rows = [("a", int(i < 30)) for i in range(100)] + [("b", int(i < 80)) for i in range(100)] + [(None, int(i < 1)) for i in range(4)]
    df = spark.createDataFrame(rows, "c string, y int")
    fm = M.fit_classifier(df, "y", [], ["c"], "lr", None, dict(regParam=0.0, maxIter=200, tol=1e-10))
    got = {r.c: r.p for r in M.probability_of(fm.transform(df), 1, "p").select("c", "p").distinct().collect()}
    # ties in frequency: the missing level is filled with "a" (100 against 100, first by value)
    assert got["a"] == pytest.approx(31 / 104, abs=1e-3) and got["b"] == pytest.approx(0.8, abs=1e-3)
    assert got[None] == pytest.approx(got["a"])


UNBAGGED = dict(numTrees=1, maxDepth=4, bootstrap=False, featureSubsetStrategy="all")


def test_unbagged_tree_splits_cells(spark):
    # siblings predict different classes; Spark merges leaves that predict the same one
    cells = {(0.0, 0.0): 10, (0.0, 1.0): 60, (1.0, 0.0): 30, (1.0, 1.0): 90}
    rows = [(x, c, int(i < k)) for (x, c), k in cells.items() for i in range(100)]
    df = spark.createDataFrame(rows, "x double, c double, y int")
    fm = M.fit_classifier(df, "y", ["x", "c"], [], "rf", None, UNBAGGED)
    got = {(r.x, r.c): r.p for r in M.probability_of(fm.transform(df), 1, "p").select("x", "c", "p").distinct().collect()}
    assert got[(0.0, 1.0)] > 0.5 > got[(0.0, 0.0)] and got[(1.0, 1.0)] > 0.5 > got[(1.0, 0.0)]
    assert sum(got.values()) / 4 == pytest.approx(0.475, abs=0.1)
    imp = {r.feature: r.importance for r in M.feature_importance(fm, df).collect()}
    assert imp["c"] > imp.get("x", 0.0) and sum(imp.values()) == pytest.approx(1)


def test_tree_learns_a_category(spark):
    """Training rows carry the statistic of earlier rows, which settles on the level's rate."""
    rng = random.Random(5)
    rate = {"a": 0.1, "b": 0.6, "c": 0.3, "d": 0.9, None: 0.75}
    rows = [(i, v, int(rng.random() < rate[v])) for i, v in enumerate(rng.choices(list(rate), k=8000))]
    df = spark.createDataFrame(rows, "id long, v string, y int")
    fm = M.fit_classifier(df, "y", [], ["v"], "rf", None, UNBAGGED, order_by=["id"])
    got = {r.v: r.p for r in M.probability_of(fm.transform(df), 1, "p").select("v", "p").distinct().collect()}
    assert sorted(got, key=got.get)[:2] in (["a", "c"], ["c", "a"]) and all((got[v] > 0.5) == (rate[v] > 0.5) for v in rate)
    assert V.roc_auc(M.probability_of(fm.transform(df), 1, "p"), "y", "p").first()[0] > 0.75


def test_tuning_prunes_the_same_trials_on_any_number_of_threads(spark):
    rows = [(i, float(i), float(i % 2), int(i % 10 != 9 if i % 2 else i % 10 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "lead_id long, t double, x double, y int").withColumn(
        "when", F.timestamp_seconds(F.col("t") * 86400).cast("timestamp_ntz"))
    f = V.expanding_folds(df, "when", "lead_id", 3)
    space = {"maxDepth": [0, 1, 1], "class_weight": ["none", "balanced", {0: 3.0, 1: 1.0}], "minInfoGain": ("log", 1e-6, 1e-4)}
    runs = [M.tune_params(f, "y", ["x"], [], space, n_trials=6, kind="rf", objective="auc", startup=2, seed=6, threads=n,
                          fixed=dict(numTrees=1, bootstrap=False, featureSubsetStrategy="all")).collect() for n in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) == 6
    depth = [json.loads(r.params)["maxDepth"] for r in runs[0]]
    assert {0, 1} == set(depth)
    for d, r in zip(depth, runs[0]):
        assert r.mean_score == pytest.approx(0.5 if d == 0 else 0.8, abs=0.03)
        assert r.state == "complete" if d == 1 or r.trial < 2 else r.state in ("pruned", "complete")
        assert r.folds == (3 if r.state == "complete" else 2)
    assert any(r.state == "pruned" for r in runs[0])
    lin = M.tune_params(f, "y", ["x"], [], {"C": ("log", 0.1, 3.0), "l1_ratio": [0.5, 1.0], "class_weight": ["balanced"]},
                        n_trials=2, kind="lr", objective="f2").collect()
    assert all(0.5 < r.mean_score <= 1 for r in lin)


def test_planted_clusters(spark):
    rows = [(float(100 * g + i % 3), "k%d" % g) for g, n in enumerate((20, 30, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "x double, c string")
    sizes = sorted(r["count"] for r in M.cluster_errors(df, ["x"], ["c"], k=3).groupBy("cluster").count().collect())
    assert sizes == [20, 30, 50]
    assert M.cluster_errors(df.limit(1), ["x"], ["c"]).first().cluster is None


def test_rows_without_score_or_label(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.01), (1, 0.9), (1, 0.01), (0, None), (None, 0.9), (7, 0.9)], "y int, p0 double")
    lab = V.confusion_labels(df, "y", "p0", 0.5).collect()
    assert [r.error_type for r in lab] == ["tp_0", "fn_0", "fp_0", "tn_0", "unknown", "unknown", "unknown"]
    assert lab[4].pred_label is None
    first = V.threshold_table(df, "y", "p0").orderBy("threshold").first()
    assert (first.tp_0, first.fn_0, first.fp_0, first.tn_0) == (1, 1, 1, 1)


def test_junk_dates_become_null(spark):
    df = spark.createDataFrame([("1700000000",), ("n/a",), (None,), ("9" * 30,)], "a string")
    out = [r[0] for r in D.normalize_dates(df, [("a", "s")]).collect()]
    assert out[0] is not None and out[1:] == [None, None, None]
    texts = spark.createDataFrame([("2024-01-05",), ("x",)], "a string")
    assert D.parse_date_best(texts, "a", "d").where("d is not null").count() == 1


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(2001) < 0.4, 5.0, rng.normal(size=2001)).round(3)
    df = spark.createDataFrame([(float(v), None, float(i % 7)) for i, v in enumerate(x)], "x double, e double, z double")
    q = Q.exact_quantiles(df, ["x", "e", "z"], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert q["x"] == pytest.approx(np.quantile(x, [0, 0.25, 0.5, 0.9, 1]).tolist()) and q["e"] == [None] * 5
    assert q["z"] == pytest.approx(np.quantile(np.arange(2001) % 7, [0, 0.25, 0.5, 0.9, 1]).tolist())
    assert T.medians(df.limit(0), ["x"]) == {"x": None}


def test_quantiles_of_three_hundred_columns_with_nan(spark):
    rng = np.random.default_rng(4)
    n, width = 400, 300
    table = rng.normal(size=(n, width)) * 10.0 ** rng.integers(-300, 300, width)
    table[rng.random((n, width)) < 0.1] = np.nan
    table[:, 0] = np.nan
    table[:5, 1] = [np.inf, -np.inf, -0.0, 0.0, 5e-324]
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame(pd.DataFrame(table, columns=names)).repartition(5)
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = Q.exact_quantiles(df, names, probs)
    assert got["c0"] == [None] * 5
    for i in range(2, width):
        own = table[:, i][~np.isnan(table[:, i])]
        assert got[f"c{i}"] == pytest.approx(np.quantile(own, probs).tolist(), rel=1e-12), i
    assert got["c1"][2] == pytest.approx(np.nanmedian(table[:, 1]))
    rows = {r.feature: r for r in P.describe_column(df.select("c0", "c2")).collect()}
    assert rows["c2"].n == (~np.isnan(table[:, 2])).sum() and rows["c2"].mean == pytest.approx(np.nanmean(table[:, 2]))
    assert rows["c0"].n == 0 and rows["c0"].p50 is None
    missing = {r.feature: r.missing_pct for r in P.missing_share(df.select("c0", "c2")).collect()}
    assert missing == {"c0": 100.0, "c2": pytest.approx(np.isnan(table[:, 2]).mean() * 100)}
    flags = T.above_median_flag(df, "c2", "f").agg(F.sum("f")).first()[0]
    assert flags == (table[:, 2] > np.nanmedian(table[:, 2])).sum()
    assert T.fill_median(df, ["c2"]).where(F.isnan("c2") | F.col("c2").isNull()).count() == 0
    assert {r.feature for r in P.outlier_share(df).collect()} == set(names)


def test_metrics_leave_out_scores_that_are_nan(spark):
    rows = [(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6), (1, 0.7)]
    clean = spark.createDataFrame(rows, "y int, p double")
    dirty = spark.createDataFrame(rows + [(0, float("nan")), (1, None)], "y int, p double")
    for metric in (V.roc_auc, V.average_precision, V.log_loss):
        assert metric(dirty, "y", "p").first()[0] == pytest.approx(metric(clean, "y", "p").first()[0])


def test_quantiles_shuffle_bins_not_values(spark):
    rows = spark.range(100000).select((F.col("id") * 0.7).alias("v0"))
    plan = plan_of(Q.interval_histogram(rows, [(0, 0, 2**62)]))
    for line in re.findall(r"Exchange ([^\n]*)", plan):
        assert "interval" in line and "v0" not in line, line


def test_two_hundred_columns_in_one_pass(spark):
    n = 200
    df = spark.range(50).select(*[((F.col("id") * (i % 23 + 1)) % 17).cast("string").alias(f"c{i}") for i in range(n)])
    exact, _ = P.duplicate_columns(df)
    want = {(f"c{i}", f"c{j}") for i, j in itertools.combinations(range(n), 2) if (i % 23) % 17 == (j % 23) % 17}
    assert {(r.left, r.right) for r in exact.table.collect()} == want
    texts = {c: F.col(c) for c in df.columns}
    pairs = list(itertools.combinations(df.columns, 2))
    for plan in (plan_of(PR.equality_counts(df, texts, pairs)),
                 plan_of(A.pearson_table(df, [(a, F.col(a).cast("double"), b, F.col(b).cast("double")) for a, b in pairs[:50]]))):
        assert "stack(" not in plan and "Generate" not in plan


def brute_pairs(table, threshold):
    exact, near = set(), {}
    for a, b in itertools.combinations(table.columns, 2):
        x, y = table[a], table[b]
        unequal, both = int((x != y).sum()), int(((x != "") | (y != "")).sum())
        if unequal == 0:
            exact.add((a, b))
        elif (both - unequal) / max(both, 1) >= threshold:
            near[a, b] = round((both - unequal) / both, 4)
    return exact, near


@pytest.mark.parametrize("threshold", [0.95, 0.6])
def test_duplicates_by_bound_lose_no_pair(spark, threshold):
    rng = np.random.default_rng(3)
    n, table = 700, {}
    for k in range(12):
        base = rng.choice(["", "a", "b", "c", "dd"], n, p=[0.5, 0.2, 0.1, 0.1, 0.1])
        for j, share in enumerate([0, 0, 0.01, 0.03, 0.05, 0.3]):
            values = base.copy()
            values[rng.random(n) < share] = "other"
            table[f"c{k}_{j}"] = values
    table |= {"blank1": [""] * n, "blank2": [""] * n, "id": [f"v{i}" for i in range(n)],
              "shuffled": [f"v{i}" for i in rng.permutation(n)]}
    table = pd.DataFrame(table)
    df = spark.createDataFrame(table)
    exact, near = P.duplicate_columns(df, near_threshold=threshold)
    want, want_near = brute_pairs(table, threshold)
    assert {(r.left, r.right) for r in exact.table.collect()} == want
    assert {(r.left, r.right): r.similarity for r in near.table.collect()} == pytest.approx(want_near)
    assert PR.similar_pairs(df.limit(0), {c: F.col(c) for c in ("id", "blank1")}, 0.95) == [("id", "blank1", 0, 0)]


def test_columns_that_agree_by_sketch_only_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([("x", "x", "y"), ("x", "x", "z"), ("x", "x", "x")], "a string, b string, c string")
    sketch = PR.column_sketches
    monkeypatch.setattr(PR, "column_sketches", lambda df, texts: sketch(df, {c: F.lit("x") for c in texts}))
    got = PR.similar_pairs(df, {c: F.col(c) for c in df.columns}, 0.95)
    assert got == [("a", "b", 0, 3), ("a", "c", 2, 3), ("b", "c", 2, 3)]


def test_two_thousand_columns_compare_few_pairs(spark, monkeypatch):
    n, seen = 2000, []
    count = PR.value_counts_of_pairs
    monkeypatch.setattr(PR, "value_counts_of_pairs", lambda df, texts, pairs: seen.extend(pairs) or count(df, texts, pairs))
    table = np.random.default_rng(1).integers(0, 50, (300, n)).astype(str)
    table[:, 1500] = table[:, 7]
    table[:, 1600] = table[:, 8]
    table[0, 1600] = "other"
    df = spark.createDataFrame(pd.DataFrame(table, columns=[f"c{i}" for i in range(n)]))
    exact, near = P.duplicate_columns(df)
    assert [(r.left, r.right) for r in exact.table.collect()] == [("c7", "c1500")]
    assert [(r.left, r.right) for r in near.table.collect()] == [("c8", "c1600")]
    assert len(seen) < n


CITY_ROWS = [None, "", "  ", "Omsk", "omsk", "123456 OMSK , centre", "Tver", "tver oblast omsk", "Nowhere", "ab", "xabcx",
             "New  Omsk,Tver", "x" * 9000 + " tver " + "y" * 1000, "123456"]


def by_plain_search(value, regions, cities):
    def normal(t):
        return re.sub(r"[\s,]+", " ", re.sub(r"\d{6}", "", t)).strip(" ").lower()
    if value is None or value in regions:
        return value
    own = {n: min(r for m, r in cities if m == n) for n, _ in cities}
    if value in own:
        return own[value]
    inside = [r for r in regions if normal(r) and normal(r) in normal(value)]
    if inside:
        return max(inside, key=lambda r: (len(normal(r)), r))
    inside = [c for c in own if normal(c) and normal(c) in normal(value)]
    return own[max(inside, key=lambda c: (len(normal(c)), c))] if inside else value


@pytest.mark.parametrize("limit", [1 << 20, 12])
def test_city_names_by_automaton(spark, limit):
    from tabsieve.operators import joins as J
    regions = ["Tver oblast", "abc", "ABC", "Omsk region", "", "Ivanovo"]
    cities = [("Omsk", "Omsk region"), ("New Omsk", "Far"), ("Tver", "Tver oblast"), ("b", "B-land"), ("ab", "AB-land"),
              ("ab", "AA-land"), ("123456", "digits"), ("", "blank")]
    reg = spark.createDataFrame([(r,) for r in regions + [None]], "region string")
    cit = spark.createDataFrame(cities + [(None, "none")], "city string, region string")
    df = spark.createDataFrame(list(enumerate(CITY_ROWS * 2)), "id int, city string")
    out = J.map_city_to_region(df, "city", reg, "region", cit, "city", "region", "to", max_bytes=limit)
    got = {r["id"]: r["to"] for r in out.collect()}
    assert got == {i: by_plain_search(v, regions, cities) for i, v in enumerate(CITY_ROWS * 2)}
    names = spark.createDataFrame([("c", n, n, "r") for n in ("aa", "bbb", "cccc")], "kind string, name string, normal string, region string")
    assert sum(b.count() for b in J.name_blocks(names, 4)) == 3 and len(J.name_blocks(names, 4)) == 6


def test_stored_blocks_join_without_exchange(spark, tmp_path):
    from tabsieve.operators import joins as J
    parts = [spark.range(k, 1000).select(F.col("id").alias("row_id"), (F.col("id") * k).alias(f"x{k}")) for k in (1, 2, 3)]
    names = [J.store_block(p, f"part_{i}", str(tmp_path / str(i)), buckets=4) for i, p in enumerate(parts)]
    out = J.assemble_stored(spark, names)
    assert "Exchange" not in plan_of(out) and plan_of(out).count("SortMergeJoin") == 2
    assert sorted(map(tuple, out.collect())) == [(i, i, 2 * i, 3 * i) for i in range(3, 1000)]
    J.store_block(parts[0], "part_0", str(tmp_path / "0"), buckets=4)  # written again: same rows
    assert J.assemble_stored(spark, names).count() == 997
    J.store_block(parts[1], "part_1", str(tmp_path / "1"), buckets=5)
    with pytest.raises(ValueError, match="bucketed differently"):
        J.assemble_stored(spark, names)
    J.store_block(parts[0], "part_1", str(tmp_path / "1"), buckets=4)
    with pytest.raises(ValueError, match="appears in blocks"):
        J.assemble_stored(spark, names)
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_level_audits_shuffle_hashes_not_texts(spark):
    rows = [(f"id{i}", ["1", "2.0", "abc", None][i % 4], "x" if i % 3 else f"y{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    levels = P.hashed_levels(df, [F.col("a"), F.col("b")], [F.count(F.lit(1)).alias("n")])
    for line in re.findall(r"Exchange ([^\n]*)", plan_of(levels)):
        assert "v#" not in line, line
    assert {(r.i, r.n) for r in levels.groupBy("i").agg(F.sum("n").alias("n")).collect()} == {(0, 300), (1, 225)}
    got = {r.feature: tuple(r)[1:] for r in P.high_cardinality(df, share_threshold=0.3).table.collect()}
    assert got == {"a": (300, 300, 1.0), "c": (101, 300, 0.3367)}
    assert {tuple(r) for r in P.numeric_vs_text_levels(df).collect()} == {("a", 0, 300), ("b", 2, 1), ("c", 0, 101)}


def test_cleaning_settles_one_copy(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from tabsieve.plans import pipeline as PL
    rows = [(i % 50, f"t{i}", "one", f"t{i}", None, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a string, b string, a2 string, e string, y int")
    seen, settle = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: seen.append(len(self.columns)) or settle(self, *a, **k))
    out, rep = PL.cleaning_pipeline(df, "y", order_cols=["k", "a"])
    assert out.columns == ["k", "a", "y", "row_id"] and rep.final_shape == (200, 4)
    want = sorted((r[0], r[1]) for r in rows)
    assert [(r.k, r.a) for r in out.orderBy("row_id").collect()] == want
    assert [n for n in seen if n >= len(df.columns)] == [8]  # the columns, partition and position: written once
    with_own, _ = PL.cleaning_pipeline(df.withColumnRenamed("k", "row_id"), "y")
    assert sorted(r.row_id for r in with_own.collect()) == list(range(200)) and "k" not in with_own.columns


def test_dominant_value_needs_no_shuffle_of_ids(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 != 0, "x").otherwise(
        F.col("id").cast("string")).alias("most"), F.lit("k").alias("one"))
    assert P.bucket_candidates(df, df.columns, 0.85, 3) == ["most", "one"]
    assert set(P.dominant_value(df, threshold=0.85).drop) == {"most", "one"}


def test_stream_reads_a_folder_table(spark, tmp_path):
    from tabsieve.streaming.stream import fitted_transform_stream
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    assert fitted_transform_stream(spark, str(tmp_path)).count() == orders.count()


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from tabsieve.streaming import stream as S
    orders = spark.read.parquet(f"{SF}/orders.parquet").repartition(6)
    halves = orders.randomSplit([0.5, 0.5], 3)
    src, base = str(tmp_path / "in"), str(tmp_path / "run")
    halves[0].write.parquet(f"{src}/orders.parquet")
    first = S.fitted_transform_stream(spark, src, base)
    assert first.count() == halves[0].count() == S.fitted_transform_stream(spark, src, base).count()
    state = spark.read.parquet(f"{base}/state").first()
    halves[1].write.mode("append").parquet(f"{src}/orders.parquet")
    out = S.fitted_transform_stream(spark, src, base)
    assert out.count() == orders.count() == out.select("o_orderkey").distinct().count()
    assert spark.read.parquet(f"{base}/state").first() == state


def test_only_differing_buckets_are_joined(spark):
    from tabsieve.operators import errors as ER
    a = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 > 0, F.lit("t")).alias("s"))
    b = a.withColumn("x", F.when(F.col("k").isin(17, 4000), F.lit(99)).otherwise(F.col("x"))).withColumn(
        "s", F.when(F.col("k").isin(3, 4), F.lit("u")).otherwise(F.col("s")))
    got = [tuple(r) for r in ER.difference_sample(a, b, "k").collect()]
    assert got == [(4, "s", "t", "u"), (17, "x", "3", "99"), (4000, "x", "3", "99")]
    assert ER.difference_sample(a, b, "k", rows=1).count() == 1 and ER.difference_sample(a, a, "k").count() == 0


PLAN_KEYS = """outlier_share describe_column fill_median iqr_outlier_to_median iqr_clip_upper quantile_bins above_median_flag
exact_duplicate_columns numeric_target_corr numeric_feature_corr date_pair_stats numeric_vs_text_levels
categorical_target_assoc map_city_to_region lookup_region_by_prefix left_join_raw_columns compare_datasets rolling_mean_30
lag_n customer_history stratified_split oof_target_encode loo_group_mean transform_chain lead_feature_set""".split()


def test_plans_have_no_cross_joins_or_single_task_quantiles(spark):
    import __spark_entry__ as E
    q = E.queries()
    for key in PLAN_KEYS:
        plan = plan_of(q[key](spark, SF))
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|percentile\(|median\(|stack\(", plan), key


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tabsieve.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc))
