"""Layer 2: hand-written frames for the semantic traps."""

import math

from pyspark.sql import functions as F

from tabsieve.functions import rules as R
from tabsieve.functions import text as X
from tabsieve.operators import assoc as A
from tabsieve.operators import encode as E
from tabsieve.operators import profile as P
from tabsieve.operators import transform as T


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_cyrillic_case_insensitive_regex(spark):
    df = spark.createDataFrame([("ВАРИКОЗ лечение",), ("нет",), (None,)], "t string")
    out = df.select(X.regex_flag("t", "варикоз").alias("f")).collect()
    assert [r.f for r in out] == [1, 0, 0]


def test_url_without_slash_keeps_whole_string(spark):
    df = spark.createDataFrame([("a/b/c",), ("noslash",)], "u string")
    assert [r.s for r in df.select(X.url_last_segment("u").alias("s")).collect()] == ["c", "noslash"]


def test_empty_tokens_and_all_null_column(spark):
    df = spark.createDataFrame([(None, " NaN "), (None, "x"), (None, "null")], "a string, b string")
    shares = dict(rows(P.empty_share(df), "feature", "empty_share"))
    assert shares["a"] == 1.0 and abs(shares["b"] - 2 / 3) < 1e-12


def test_zero_variance_correlation_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, float(i % 2)) for i in range(40)], "x double, y double")
    out = A.numeric_target_corr(df, "y", ["x"], min_abs=0.0)
    assert out.count() == 0  # NULL correlation is dropped, no ANSI divide-by-zero


def test_top_k_ties_break_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert E.top_k_levels(df, "v", 2) == ["c", "a"]
    out = E.top_k_group(df, "v", 2, out="g").collect()
    assert sorted((r.v or "", r.g) for r in out) == [("", "other"), ("a", "a"), ("b", "other"), ("c", "c"), ("c", "c")]


def test_utm_hex_ids_and_decimal_text(spark):
    df = spark.createDataFrame([("12.0_x_ff1_a_b_mobile_c_d_e_f",), ("1_2_3_4_undefined_6_7_8_9_10",), (None,)],
                               "u string")
    out = df.select(R.utm_id("u", 1).alias("i1"), R.utm_id("u", 3).alias("i3"), R.utm_device("u").alias("d")).collect()
    # ten parts: '12.0' parses to 12 through double, hex 'ff1' -> -1; NULL is one part -> all unknown
    assert [(r.i1, r.i3, r.d) for r in out] == [(12, -1, "b"), (1, 3, "unknown"), (-1, -1, "unknown")]
    df2 = spark.createDataFrame([("12.0_a_7_b_mob_c_d_e_f_g",)], "u string")
    r = df2.select(R.utm_id("u", 1).alias("i1"), R.utm_id("u", 3).alias("i3"), R.utm_device("u").alias("d")).first()
    assert (r.i1, r.i3, r.d) == (12, 7, "mob")


def test_nan_text_is_null_number(spark):
    df = spark.createDataFrame([("nan",), ("515,06",), ("-",), ("",)], "s string")
    out = [r.v for r in df.select(T.parse_localised_number("s").alias("v")).collect()]
    assert out[0] is None and abs(out[1] - 515.06) < 1e-12 and out[2] is None and out[3] is None


def test_binary_target_text_and_numbers(spark):
    df = spark.createDataFrame([("1",), ("Yes",), ("false",), ("maybe",), (None,)], "t string")
    assert [r.y for r in df.select(X.safe_binary_target("t").alias("y")).collect()] == [1.0, 1.0, 0.0, None, None]


def test_log1p_negative_is_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (math.e - 1,)], "x double")
    out = [r.v for r in df.select(T.log1p_nonnegative("x").alias("v")).collect()]
    assert out[0] is None and out[1] == 0.0 and abs(out[2] - 1.0) < 1e-12


def test_empty_frame_audits(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert P.dominant_value(df).table.count() == 0
    assert P.empty_share(df).where(F.col("empty_share").isNotNull()).count() == 0


def test_weekday_monday_zero(spark):
    from tabsieve.operators.dates import calendar_parts
    df = spark.createDataFrame([("2024-01-01 10:00:00",), (None,)], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("t"))
    out = df.select(*[v.alias(k) for k, v in calendar_parts("t", "c").items()]).collect()
    assert (out[0].c_weekday, out[0].c_weekend, out[0].c_hour, out[0].c_week) == (0, 0, 10, 1)
    assert out[1].c_weekday == -1


def test_site_family_rules_apply_in_order(spark):
    df = spark.createDataFrame([("ya.ru",), ("news.ria.ru",), ("dzen.ru",), ("ok.ru",), ("other.com",)], "h string")
    assert [r.f for r in df.select(R.site_family("h").alias("f")).collect()] == ["yandex", "ria", "dzen", "ok", "other.com"]


def test_rank_conflict_greedy_by_position(spark):
    from tabsieve.operators.select import weighted_rank_conflict
    mk = lambda names: spark.createDataFrame([(f, i + 1) for i, f in enumerate(names)], "feature string, rank int")
    lists = {"lr": mk(["a", "b", "c"]), "rf": mk(["d", "a", "e"]), "cb": mk(["a", "f"])}
    out = weighted_rank_conflict(lists, {"lr": 40.0, "rf": 10.0, "cb": 50.0}, n_final=5, shuffle=False).collect()
    # pos1: cb 'a'; pos2: cb 'f'; pos3: lr 'c'; leftovers cb -> lr 'b' -> rf 'd'
    assert [(r.feature, r.source, r.rank_position) for r in out] == [
        ("a", "cb", 1), ("f", "cb", 2), ("c", "lr", 3), ("b", "lr", 2), ("d", "rf", 1)]


def test_target_corr_coerces_numeric_text(spark):
    rows = [(str(i), float(i), "yes" if i >= 20 else "no") for i in range(40)]
    df = spark.createDataFrame(rows, "txt string, num double, y string")
    out = {r.feature: r.corr for r in A.numeric_target_corr(df, "y", min_abs=0.0).collect()}
    assert set(out) == {"txt", "num"} and abs(out["txt"] - out["num"]) < 1e-12 and out["num"] > 0.8


def test_onehot_ignores_unseen_and_null(spark):
    from tabsieve.operators.models import onehot_encode
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    test = spark.createDataFrame([("b",), ("zzz",), (None,)], "v string")
    out = onehot_encode(test, ["v"], fit_df=train).collect()
    assert [list(r.v_ohe.toArray()) for r in out] == [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
