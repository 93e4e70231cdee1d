"""Property tests: random small frames, Spark operators vs plain-Python brute force."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabsieve.operators import encode as E
from tabsieve.operators import ordered as O

SETTINGS = dict(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))

levels = st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d", "e"])), min_size=1, max_size=40)


@settings(**SETTINGS)
@given(levels, st.integers(min_value=1, max_value=4))
def test_top_k_group_matches_counter(spark, values, k):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v string")
    counts = Counter(v for v in values if v is not None)
    top = [v for v, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:k]]
    got = {r.id: r.g for r in E.top_k_group(df, "v", k, out="g").collect()}
    assert got == {i: (v if v in top else "other") for i, v in enumerate(values)}


@settings(**SETTINGS)
@given(levels)
def test_frequency_encode_matches_counter(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v string")
    keys = [v if v is not None else "unknown" for v in values]
    counts = Counter(keys)
    got = {r.id: r.f for r in E.frequency_encode(df, "v", "f").collect()}
    assert all(abs(got[i] - counts[k] / len(values)) < 1e-12 for i, k in enumerate(keys))


@settings(**SETTINGS)
@given(st.lists(st.floats(min_value=-100, max_value=100, allow_nan=False), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=7))
def test_rolling_mean_matches_python(spark, xs, window):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x double")
    got = {r.id: r.m for r in O.rolling_mean(df, ["id"], "x", window, out="m", bucket_rows=8).collect()}
    for i in range(len(xs)):
        part = xs[max(0, i - window + 1): i + 1]
        assert abs(got[i] - sum(part) / len(part)) < 1e-9
