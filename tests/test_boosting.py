"""Boosted trees over binned rows are Spark's own: same trees, same stopping, one byte per feature and row."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tabsieve.operators import boosting as B
from tabsieve.operators import models as M

NUM = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(rng.choice([0.0, 1.0, 2.5, -3.0]), rng.gauss(0, 1), float(rng.randrange(200)), 1.0, rng.choice([1.0, 5.0, 0.5]),
             rng.choice([True, False, False, False, None])) for _ in range(3000)]
    made = [(a, b, c, d, int(a + b + c / 100 > 1.5 + rng.gauss(0, 0.5)), w, v) for a, b, c, d, w, v in made]
    df = spark.createDataFrame(made, "a double, b double, c double, d double, y int, w double, v boolean").repartition(3).cache()
    yield df
    df.unpersist()


def ours(df, params, weight=None):
    return M.fit_classifier(df, "y", NUM, [], "gbt", weight, params)


@pytest.mark.parametrize("params, weight", [
    ({"maxIter": 3, "maxDepth": 4, "stepSize": 0.2}, None), ({"maxIter": 2, "maxDepth": 6, "maxBins": 200}, None),
    ({"maxIter": 12, "maxDepth": 2, "validationIndicatorCol": "v"}, "w"),
    ({"maxIter": 2, "maxDepth": 3, "minInstancesPerNode": 60, "minInfoGain": 0.01}, "w"), ({"maxIter": 1, "maxDepth": 0}, None)])
def test_trees_are_those_of_spark(rows, params, weight, monkeypatch):
    spark_says = GBTClassifier(labelCol="y", seed=42, **{"maxBins": M.BINS, **params}, **({"weightCol": weight} if weight else {}))
    old = Pipeline(stages=[*M.feature_stages(rows, NUM, []), spark_says]).fit(rows)
    monkeypatch.setattr(GBTClassifier, "_fit", None)  # a row is no object of Spark's trainer any more
    monkeypatch.setattr(B, "REFRESH", 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 400)
    new = ours(rows, params, weight)
    assert new.model.stages[-1].getNumTrees == old.stages[-1].getNumTrees
    assert new.model.stages[-1].featureImportances.toArray() == pytest.approx(old.stages[-1].featureImportances.toArray(), abs=1e-9)
    raw = [[r[0][1] for r in m.transform(rows).select("rawPrediction").collect()] for m in (old, new)]
    assert raw[0] == pytest.approx(raw[1], abs=1e-9)


def test_sums_that_do_not_fit_the_driver_are_shared_out(rows, monkeypatch):
    plain = ours(rows, {"maxIter": 2, "maxDepth": 4})
    monkeypatch.setattr(B, "PAIR_CELLS", 1)  # feature by feature
    monkeypatch.setattr(B, "trains", lambda *a: True)
    monkeypatch.setattr(B, "DRIVER_BYTES", 4 * 4 * 8 * 64 * 2)  # two nodes a pass, added by a shuffle
    assert ours(rows, {"maxIter": 2, "maxDepth": 4}).model.stages[-1].featureImportances.toArray() == pytest.approx(
        plain.model.stages[-1].featureImportances.toArray(), abs=1e-9)


def test_refused_rows_and_what_stays_with_spark(spark, rows):
    for bad in (F.lit(None).cast("int"), F.lit(2)):
        with pytest.raises(Exception, match="Labels MUST"):
            ours(rows.withColumn("y", F.when(F.col("c") == 7, bad).otherwise(F.col("y"))), {"maxIter": 1})
    with pytest.raises(Exception, match="NaN or Infinity"):
        ours(rows.withColumn("b", F.when(F.col("c") == 7, F.lit(float("inf"))).otherwise(F.col("b"))), {"maxIter": 1})
    with pytest.raises(ValueError, match="no rows"):
        ours(rows.where("a > 9"), {"maxIter": 1})
    assert not B.trains(GBTClassifier(subsamplingRate=0.5), 4) and not B.trains(GBTClassifier(maxBins=300), 4)
    assert not B.trains(GBTClassifier(featureSubsetStrategy="sqrt"), 4) and B.trains(GBTClassifier(), 4)


def test_a_model_is_stored_and_read_again(rows, tmp_path):
    fm = ours(rows, {"maxIter": 2, "maxDepth": 3})
    M.save_model(fm, str(tmp_path / "m"))
    again = M.load_model(str(tmp_path / "m"))
    assert fm.transform(rows).select("probability").collect() == again.transform(rows).select("probability").collect()
    assert fm.model.stages[-1].getOrDefault("maxDepth") == 3 == again.model.stages[-1].getOrDefault("maxDepth")


def test_trials_share_their_bins(spark, rows, monkeypatch):
    made, bin_rows = [], B.bin_rows
    monkeypatch.setattr(B, "bin_rows", lambda *a, **k: made.append(1) or bin_rows(*a, **k))
    with M.prepared(rows, "y", NUM, []) as shared:
        M.concurrently(spark, [lambda d=d: shared.fit({"maxIter": 1, "maxDepth": d}) for d in (1, 2, 3)])
        assert len(made) == 1
        shared.fit({"maxIter": 1, "maxBins": 16})
    assert len(made) == 2
