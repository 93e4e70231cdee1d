"""Statistics in hash order over packed rows are those of ``hashed_target_encode``, and fits on subsets share the records."""

import random

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import encode as E
from tabsieve.operators import models as M
from tabsieve.operators import packed as P


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    made = []
    for i in range(1500):
        c, d = rng.choice(["hot"] * 6 + ["", None, "b", "c"]), rng.choice(["x", "y", None])
        x, z = rng.choice([0.5, 1.5, None]), rng.choice([None, float("nan"), -0.0, *map(float, range(9))])
        made.append((x, z, c, d, int((c == "hot") + (d == "x") + rng.random() > 1.2), rng.choice([1.0, 4.0]), rng.choice([True, False, False, None])))
    made += made[:40] * 3  # equal rows
    df = spark.createDataFrame(made, "x double, z double, c string, d string, y int, w double, v boolean").repartition(5).cache()
    yield df
    df.unpersist()


@pytest.mark.parametrize("num, cat, weight, val", [
    (["x", "z"], ["c", "d"], None, None), (["x"], ["c"], "w", "v"), ([], ["d", "c"], None, None), (["z"], ["c", "d"], "w", None)])
def test_fits_are_those_on_encoded_rows(rows, num, cat, weight, val, monkeypatch):
    params = {"maxIter": 3, "maxDepth": 3, **({"validationIndicatorCol": val} if val else {})}

    def scores():
        fm = M.fit_classifier(rows, "y", num, cat, "gbt", weight, params)
        return [r[0][1] for r in fm.transform(rows).select("rawPrediction").collect()], fm.model.stages[-1].featureImportances.toArray()
    encode = E.hashed_target_encode
    monkeypatch.setattr(M, "hashed_target_encode", None)  # rows are not moved as a whole any more
    new = scores()
    monkeypatch.setattr(M, "hashed_target_encode", encode)
    monkeypatch.setattr(P, "_largest_part", lambda *a: P.PART_ROWS + 1)  # a part that no worker holds: encoded rows
    old = scores()
    assert new[0] == pytest.approx(old[0], abs=1e-9) and new[1] == pytest.approx(old[1], abs=1e-9)


def test_hashes_go_on_as_in_spark(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id = 0 THEN 0.0D ELSE rand(4) * id END AS v")
    got = df.select(F.xxhash64("id").alias("a"), "v", F.xxhash64("id", "v").alias("b")).toPandas()
    _, _, gone_on = P._steps([], 1, 0.0)
    assert (gone_on(got["a"].to_numpy(), got["v"].to_numpy()) == got["b"].to_numpy()).all()


def test_too_many_levels_are_encoded_as_rows(rows, monkeypatch):
    monkeypatch.setattr(P, "CARRIED", 1)
    monkeypatch.setattr(M, "encoded_bins", None)
    fm = M.fit_classifier(rows, "y", ["x"], ["c"], "gbt", None, {"maxIter": 1, "maxDepth": 1})
    assert fm.transform(rows).count() == rows.count()


@pytest.mark.parametrize("run", [
    lambda df: M.drop_one_ablation(df, df, "y", ["x", "z"], ["c", "d"], params={"maxIter": 2, "maxDepth": 2}),
    lambda df: M.tail_pruning(df, df, "y", ["d", "x", "c", "z"], ["x", "z"], ["c", "d"], [3, 2, 1, 4], params={"maxIter": 2, "maxDepth": 2})])
def test_fits_on_subsets_share_records_and_levels(rows, run, monkeypatch):
    packed, levels, pack, target_levels = [], [], P.pack, E.target_levels
    monkeypatch.setattr(M, "pack", lambda *a, **k: packed.append(1) or pack(*a, **k))
    monkeypatch.setattr(M, "target_levels", lambda *a, **k: levels.append(a[1]) or target_levels(*a, **k))
    shared = [tuple(r) for r in run(rows).collect()]
    assert len(packed) == 1 and levels == ["c", "d"]
    monkeypatch.setattr(M.Packed, "holds", lambda *a: False)
    plain = [tuple(r) for r in run(rows).collect()]
    assert [r[0] for r in shared] == [r[0] for r in plain] and [r[1] for r in shared] == pytest.approx([r[1] for r in plain], abs=1e-9)
