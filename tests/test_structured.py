"""Structured lead features: plan, deferred drops, statistics, and the length step of the chain."""

import pytest

from tabsieve.plans import structured as S
from tabsieve.plans.catalog_models import raw_leads, structured_leads

SF = "/root/testdata/sf0.001"


def test_eighteen_transforms_and_drops(spark):
    steps = S.transforms()
    df = structured_leads(spark, SF)
    out, gone = S.apply(df, steps)
    assert len(steps) == 18 and out.count() == df.count()
    made = [c for t in steps for c in t.makes]
    assert len(made) == 33 and set(made) <= set(out.columns) and not set(gone) & set(out.columns)


def test_statistics_come_with_the_write(spark, tmp_path):
    steps, df = S.transforms(start="1993-01-01", end="1998-01-01"), structured_leads(spark, SF)
    plan, stats = S.write_observed(df, steps, str(tmp_path / "f"))
    plan, stats = {r.transform: r for r in plan.collect()}, {(r.transform, r.feature): r for r in stats.collect()}
    out = spark.read.parquet(str(tmp_path / "f"))
    assert sorted(out.columns) == sorted(S.apply(df, steps)[0].columns) and out.count() == df.count()
    assert len(plan) == 18 and len(stats) == 33 and 0 < stats[("mass", "lead_mass_known")].mean < 1
    assert stats[("utm_campaign", "lead_utm_campaign_grouped")].levels <= S.CAMPAIGN_TOP + 1
    outside = df.where("lead_created_dt not between timestamp_ntz'1993-01-01' and timestamp_ntz'1998-01-01'").count()
    assert plan["delivery_delays"].clipped > outside > 0 and plan["width"].clipped == 0
    assert plan["mass"].skipped_drops == "lead_closed_dt" and all(r.rows == df.count() for r in plan.values())
    plan, _ = S.write_observed(raw_leads(spark, SF), S.transforms(), str(tmp_path / "g"), strict=False)
    ran = {r.transform: r for r in plan.collect()}
    assert {t for t, r in ran.items() if r.runnable} == {"payment_type", "delivery_type", "utm_campaign", "lead_group"}
    assert ran["width"].rows is None and ran["width"].missing == "lead_Ширина"


def test_missing_columns(spark):
    steps = S.transforms()
    df = raw_leads(spark, SF)
    runnable = {r.transform for r in S.plan(df, steps).collect() if r.runnable}
    assert runnable == {"payment_type", "delivery_type", "utm_campaign", "lead_group"}
    with pytest.raises(KeyError):
        S.apply(df, steps)
    out, gone = S.apply(df, steps, strict=False)
    assert "lead_payment_type" in out.columns and "lead_Вид оплаты" in gone


def test_length_step(spark):
    from tabsieve.plans.pipeline import lead_feature_steps
    steps = lead_feature_steps()
    assert len(steps) == 15 and steps[-1].__name__ == "sale_time"
    out = {s.__name__: s for s in steps}["length"](raw_leads(spark, SF))
    assert out.where("lead_length = -1 and `lead_Длина` is null").count() == out.where("`lead_Длина` is null").count() > 0
