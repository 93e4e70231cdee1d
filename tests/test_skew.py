"""Hot keys: one key holds a third of the rows; results stay exact and work stays spread."""

from pyspark.sql import functions as F

from tabsieve.operators import encode as E
from tabsieve.operators import ordered as O
from tabsieve.operators import profile as P


def skewed(spark, n=3000):
    # every third row belongs to contact 0 / day 0 / level 'hot'
    rows = [(i, 0 if i % 3 == 0 else i, 0 if i % 3 == 0 else i % 97, "hot" if i % 3 == 0 else f"v{i % 50}",
             float(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, contact long, day long, level string, amount double")


def test_range_partitions_split_a_hot_sort_key(spark):
    df = skewed(spark)
    parts = (df.repartitionByRange(8, "day", "id").withColumn("p", F.spark_partition_id())
             .groupBy("p").count().collect())
    sizes = [r["count"] for r in parts]
    assert max(sizes) <= 2 * (sum(sizes) / len(sizes))  # the hot day is cut by id


def test_global_index_exact_under_skew(spark):
    idx = O.global_index(skewed(spark), ["day", "id"], "i", num_partitions=8)
    got = [r.id for r in idx.orderBy("i").collect()]
    want = [r.id for r in skewed(spark).orderBy("day", "id").collect()]
    assert got == want


def test_hot_contact_history_matches_window(spark):
    df = skewed(spark)
    from pyspark.sql import Window
    w = Window.partitionBy("contact").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.id: (r.c, r.s) for r in df.select(
        "id", F.count(F.lit(1)).over(w).alias("c"),
        F.coalesce(F.sum("amount").over(w), F.lit(0.0)).alias("s")).collect()}
    got = O.customer_history(df, "contact", "day", "id", "amount", block_rows=64).collect()
    assert len(got) == len(want)
    for r in got:
        c, s = want[r.id]
        assert r.past_orders == c and abs(r.spend_before - s) < 1e-6


def test_hot_level_encoders_and_audits(spark):
    df = skewed(spark)
    freq = {r.level: r.f for r in E.frequency_encode(df, "level", "f").select("level", "f").distinct().collect()}
    assert abs(freq["hot"] - 1 / 3) < 1e-12
    top = E.top_k_levels(df, "level", 1)
    assert top == ["hot"]
    dom = P.dominant_value(df, ["level"], threshold=0.3).table.collect()
    assert dom[0].top_value == "hot" and dom[0].top_count == 1000


def test_time_split_cut_points_match_brute_force(spark):
    from datetime import datetime, timedelta
    from tabsieve.operators import evaluate as V
    base = datetime(2024, 1, 1)
    # a third of the rows on one day, the rest spread; plus NULL times (ordered first)
    rows = [(i, None if i % 50 == 0 else base + timedelta(days=0 if i % 3 == 0 else i % 40, seconds=i % 7))
            for i in range(900)]
    df = spark.createDataFrame(rows, "id long, t timestamp_ntz")
    got = {r.id: r.split for r in V.time_split_val(df, "t", "id").collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or base, r[0]))
    n = len(rows)
    tv = int(n * 0.8)
    tr = int(tv * 0.9)
    want = {r[0]: ("train" if i < tr else "val" if i < tv else "test") for i, r in enumerate(ordered)}
    assert got == want
    folds = V.expanding_folds(df, "t", "id", 4)
    s = {r.fold: (r.n_train, r.n_test) for r in V.fold_summary(folds, "t", 4).collect()}
    ts = n // 5
    assert s == {i: (n - (4 - i) * ts, ts) for i in range(4)}


def test_lag_buckets_match_window(spark):
    from pyspark.sql import Window
    df = spark.createDataFrame([(i, float(i * 3 % 11)) for i in range(500)], "id long, v double")
    got = {r.id: (r.lag_3, r.lag_7) for r in O.lag_rows(df, ["id"], "v", lags=(3, 7), bucket_rows=16).collect()}
    w = Window.orderBy("id")
    want = {r.id: (r.a, r.b) for r in df.select("id", F.lag("v", 3).over(w).alias("a"),
                                                F.lag("v", 7).over(w).alias("b")).collect()}
    assert got == want


def test_previous_order_mode(spark):
    df = skewed(spark, 600)
    from pyspark.sql import Window
    w = Window.partitionBy("contact").orderBy("day", "id")
    want = {r.id: r.p for r in df.select("id", F.coalesce(F.lag("amount", 1).over(w), F.lit(0.0)).alias("p")).collect()}
    got = {r.id: r.spend_before for r in
           O.customer_history(df, "contact", "day", "id", "amount", mode="previous", block_rows=32).collect()}
    assert got == want
