"""Fits, ordered statistics and date detection: they work in any session, and move and read no row more than they need."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabsieve.operators import dates as D
from tabsieve.operators import encode as E
from tabsieve.operators import models as M


def rows_of(spark, n=400):
    rng = random.Random(5)
    rows = [(i, float(rng.random() < 0.5), rng.choice("abc"), int(rng.random() < 0.5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, c string, y int")


@pytest.mark.parametrize("kind", ["rf", "lr"])
def test_models_score_in_a_session_with_observations(spark, kind):
    """A training summary would carry the session, and an observed session cannot be serialised."""
    df, watch = rows_of(spark), Observation()
    assert df.observe(watch, F.count(F.lit(1)).alias("n")).count() == 400 and watch.get["n"] == 400
    fm = M.fit_classifier(df, "y", ["x"], ["c"], kind, None, {"maxIter": 5} if kind == "lr" else {"numTrees": 2})
    assert len(M.score_rows(fm, df, "id").collect()) == 400


def test_ordered_statistics_across_partitions_levels_and_nan(spark):
    """Levels that end, span and fill partitions, blocks of one row, a NaN target that stays in its level."""
    rng = random.Random(2)
    rows = [(i, c, float("nan") if c == "n" and i % 9 == 0 else rng.choice([0.5, 1.0, None]))
            for i, c in enumerate(rng.choices(["hot", "n", None, "", "lone", *map(str, range(30))], [400, 30, 30, 5, 1] + [1] * 30, k=500))]
    df = spark.createDataFrame(rows, "id long, c string, y double").repartition(5)
    for block in (1, 7, 1 << 18):
        got = {r.id: r.ts for r in E.ordered_target_encode(df, "c", "y", "ts", ["id"], prior=0.25, block_rows=block).collect()}
        sums = {}
        for i, c, y in rows:
            s, n = sums.get(c, (0.0, 0))
            assert got[i] == pytest.approx((s + 0.25) / (n + 1.0), nan_ok=True), (block, i)
            sums[c] = (s + y, n + 1) if y is not None else (s, n)


def test_ordered_statistics_shuffle_rows_once(spark):
    rows = rows_of(spark).select("id", "y", F.col("c").alias("_lvl"), F.col("y").cast("double").alias("_ys"), F.lit(1).cast("long").alias("_yn"))
    plan = E.level_prefix_sums(rows, ["_lvl", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_stored_rows_keep_names_that_differ_in_case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = rows_of(spark).withColumn("C", F.lit("other"))
        assert set(E.ordered_target_encode(df, "c", "y", "ts", ["id"]).columns) == {"id", "x", "c", "y", "C", "ts"}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_date_shapes_lose_no_text_that_parses(spark):
    texts = ["2020-1-2", "02020-1-2", "+2020-1-2", "+12345-1-2", "-2020-1-2", "2020/01/02", "2020.1.2", "2020-1-2 3:4:5", "2020-01-02T03:04:05",
             "2020-01-02t03:04:05", "1-2-2020", "1.2.2020", "1/2/2020", "13/2/2020", "2/13/2020", "20-1-2", "2020-13-1", "2020-1-2 3:4",
             "1-2-20", "2020 1 2", "", "x", "47", "1e3", "2020-1-2x", " 2020-1-2\n", "-1-2-2020", "1-+2-2020", "٢٠٢٠-١-٢", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    s = D.regex_trim(F.col("t"))
    plain = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in D.DATE_FORMATS]).cast("timestamp_ntz")
    rows = df.select("t", plain.cast("string").alias("plain"), D.parse_date_text(F.col("t")).cast("string").alias("got")).collect()
    assert all(r.plain == r.got for r in rows) and sum(r.got is not None for r in rows) >= 12


def test_epoch_detection_reads_the_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    df = spark.createDataFrame([(1_000_000_000 + i,) for i in range(50)], "made_ts long").mapInArrow(seen, "made_ts long")
    assert [tuple(r) for r in D.detect_epoch_columns(D.date_shares(df)).collect()] == [("made_ts", "s", 1.0)]
    assert read.value == 50


def odd_rows(spark, n=600):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 6 + ["", None, "b", "c"]), rng.choice(["x", "y", None]), rng.choice([0, 1, None]), rng.random() < 0.8)
            for i in range(n)]
    rows += [rows[3], rows[3], rows[9]]  # equal rows
    return spark.createDataFrame(rows, "id long, c string, d string, y int, used boolean").repartition(5)


@pytest.mark.parametrize("counted", [None, "used"])
def test_statistics_in_hash_order_are_those_of_the_general_way(spark, counted):
    df, counted = odd_rows(spark), counted and F.col(counted)
    for col in ("c", "d"):
        plain = E.ordered_target_encode(df, col, "y", "ts", [F.xxhash64(*df.columns)], 0.25, counted=counted)
        hashed = E.hashed_target_encode(df, col, "y", "ts", 0.25, counted=counted)
        assert hashed.columns == plain.columns
        assert sorted(map(repr, hashed.collect())) == sorted(map(repr, plain.collect()))
    nan = df.withColumn("y", F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    plain, hashed = (f.select("id", F.round("ts", 9).alias("ts")) for f in (
        E.ordered_target_encode(nan, "c", "y", "ts", [F.xxhash64(*nan.columns)], 0.25), E.hashed_target_encode(nan, "c", "y", "ts", 0.25)))
    assert sorted(map(repr, hashed.collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("counted", [None, "used"])
def test_categories_that_share_a_sort_are_as_encoded_one_by_one(spark, counted):
    df, counted = odd_rows(spark).dropDuplicates(["id"]), counted and F.col(counted)
    shared = E.shared_target_encode(df, ["c", "d"], "y", ["c_ts", "d_ts"], ["id"], 0.25, ["id", "y", "used"], counted=counted)
    plain = E.ordered_target_encode(df, "c", "y", "c_ts", ["id"], 0.25, counted=counted)
    plain = E.ordered_target_encode(plain, "d", "y", "d_ts", ["id"], 0.25, counted=counted).select(shared.columns)
    assert shared.count() == 600 and sorted(map(repr, shared.collect())) == sorted(map(repr, plain.collect()))


def test_ties_in_the_order_are_seen_in_and_across_partitions(spark):
    df = odd_rows(spark).dropDuplicates(["id"])
    for order in (["d"], ["used"]):
        assert E.shared_target_encode(df, ["c"], "y", ["ts"], order, 0.25, ["id", "y"]) is None
    pair = spark.createDataFrame([(1, "a", 1), (1, "b", 0)], "t long, c string, y int").repartition(2)
    assert E.shared_target_encode(pair, ["c"], "y", ["ts"], ["t"], 0.25, ["y"]) is None
    assert E.shared_target_encode(pair.where("c = 'a'"), ["c"], "y", ["ts"], ["t"], 0.5, ["y"]).first().ts == 0.5
    assert E.shared_target_encode(pair.where("t > 1"), ["c"], "y", ["ts"], ["t"], 0.5, ["y"]).count() == 0


@pytest.mark.parametrize("order_by", [None, ["id"]])
def test_a_fit_moves_its_rows_as_often_as_its_order_asks(spark, monkeypatch, order_by):
    calls = []
    for name in ("ordered_target_encode", "hashed_target_encode", "shared_target_encode"):
        monkeypatch.setattr(M, name, lambda *a, _f=getattr(E, name), _n=name, **k: calls.append(_n) or _f(*a, **k))
    df = rows_of(spark).withColumn("d", F.col("c"))
    fm = M.fit_classifier(df, "y", ["x"], ["c", "d"], "rf", None, {"numTrees": 2}, order_by=order_by)
    assert calls == (["shared_target_encode"] if order_by else ["hashed_target_encode"] * 2)
    assert M.score_rows(fm, df, "id").count() == 400
    M.fit_classifier(df.unionAll(df), "y", ["x"], ["c", "d"], "rf", None, {"numTrees": 2}, order_by=["id"])
    assert calls[-3:] == ["shared_target_encode"] + ["ordered_target_encode"] * 2  # ties


def test_trials_of_a_fold_share_their_encoded_rows(spark, monkeypatch):
    calls, encode = [], E.hashed_target_encode
    monkeypatch.setattr(M, "hashed_target_encode", lambda df, *a, **k: calls.append(df.columns) or encode(df, *a, **k))
    df = rows_of(spark).withColumn("_seg", (F.col("id") / 134).cast("int")).withColumn(
        "test_fold", F.when(F.col("_seg") > 0, F.col("_seg") - 1)).withColumn("key", F.col("id").cast("string"))
    out = M.tune_params(df, "y", ["x"], ["c"], {"maxDepth": [1, 2, 3]}, 0, kind="rf", fixed={"numTrees": 2}).collect()
    assert [r.folds for r in out] == [2, 2, 2] and calls == [["x", "c", "y"]] * 2
    calls.clear()
    M.tune_params(df, "y", ["x"], ["c"], {"class_weight": ["none", "balanced", {0: 2.0}]}, 0, kind="rf", fixed={"numTrees": 2})
    assert len(calls) == 6 and ["x", "c", "y", "_class_weight"] in calls
