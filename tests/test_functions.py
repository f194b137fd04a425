import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions import exprs
from panelspark.operators import margin


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(("text", "want"), [("1,234", 1234.0), ("-", None), ("--", None), ("X0.5", 0.5), ("12.5%", 12.5), (" 7 ", 7.0), ("", None), (None, None)])
def test_number(spark, text, want):
    assert one(spark, exprs.number(F.lit(text).cast("string")), exprs.number(F.lit(text).cast("string"), zero=True)) == (want, want or 0.0)


def test_dates(spark):
    got = one(spark, exprs.roc_date(F.lit("115/04/17")), exprs.roc_date(F.lit("99/1/1")), exprs.compact_date(F.lit("20260415")), exprs.to_roc(F.lit("2026-04-17").cast("date")))
    assert got == (dt.date(2026, 4, 17), None, dt.date(2026, 4, 15), "115/04/17")


def test_lots_round_down(spark):
    assert one(spark, exprs.lots(F.lit(-1500)), exprs.lots(F.lit(1500))) == (-2, 1)


@pytest.mark.parametrize(("minute", "want"), [(0, 0.0667), (30, 0.2506), (60, 0.3704), (240, 0.8547), (270, 1.0), (266, 0.9434), (-5, 0.0667), (400, 1.0)])
def test_curve(spark, minute, want):
    assert one(spark, exprs.pct_done(F.lit(minute)))[0] == pytest.approx(want, abs=1e-9)


def test_blend_and_interval(spark):
    blend = lambda c, p, prior: one(spark, exprs.bayes_blend(F.lit(c), F.lit(p), F.lit(prior)))[0]
    assert blend(5e11, 0.5, 1e12) == pytest.approx(1e12)
    assert blend(5e11, 0.0, 1e12) == 1e12
    low, high = one(spark, *exprs.forecast_ci(F.lit(1e12), F.lit(0.5)))
    assert 7e11 < low < 8e11 and 1.2e12 < high < 1.3e12
    assert one(spark, *exprs.forecast_ci(F.lit(5.0), F.lit(1.0))) == (5.0, 5.0)
    assert one(spark, *exprs.forecast_ci(F.lit(5.0), F.lit(0.0))) == (0.0, 10.0)


def test_ratio_and_warning(spark):
    ratio = lambda p, c: one(spark, margin.maintenance_ratio(F.lit(p).cast("double"), F.lit(c).cast("double")))[0]
    assert ratio(120, 100) == 200.0 and ratio(166.67, 100) == 277.78
    assert ratio(120, None) is None and ratio(120, 0) is None and ratio(120, -5) is None
    level = lambda r: one(spark, margin.warning_level(F.lit(r).cast("double")))[0]
    assert [level(x) for x in (129.9, 130.0, 166.66, 166.67, None)] == ["danger", "warn", "warn", "safe", "na"]


def test_text_functions(spark):
    assert one(spark, exprs.rating(F.lit("A Strong Buy case")), exprs.rating(F.lit("評等：持有")), exprs.rating(F.lit("none"))) == ("strong buy", "hold", None)
    assert one(spark, *exprs.report_name(F.lit("visit_2330_Foo Corp.pdf"))) == ("visit", "2330", "Foo Corp")
    assert one(spark, exprs.contract_label(F.lit("202604W2")), exprs.contract_label(F.lit("202604"))) == ("2026/04 W2", "2026/04")
    assert one(spark, exprs.disposition_interval(F.lit("約每二十分鐘撮合一次")), exprs.disposition_interval(F.lit("x"))) == (20, None)
    assert one(spark, exprs.last_k_average(F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0)), 2))[0] == 4.0
    assert one(spark, *exprs.regime_label(F.lit(3.0), F.lit(1.0))) == ("stress", 100.0, 2.0)
    assert one(spark, exprs.in_session(F.lit("2024-01-05 10:00:00").cast("timestamp")), exprs.session_minute(F.lit("2024-01-05 10:00:00").cast("timestamp"))) == (True, 60)
