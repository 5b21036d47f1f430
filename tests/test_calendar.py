from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cellseason.functions import calendar as cal

from .conftest import rows


def test_campaign_labels_and_decades(spark):
    days = ["2001-10-15", "2002-07-15", "2002-01-15", "2001-12-15", "2002-08-15", "2002-09-15", "2002-03-10", "2002-03-31"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    got = {str(r[0]): r[1:] for r in rows(df.select("d", cal.campaign_label("d"), cal.decade_intra("d"), cal.campaign_decade("d")))}
    assert [got[d][0] for d in days[:4]] == ["2001-2002"] * 4
    assert got["2002-08-15"][0] is None and got["2002-08-15"][2] is None and got["2002-09-15"][0] is None
    assert got["2002-03-10"][1:] == (1, 16) and got["2002-03-31"][1:] == (3, 18)


def test_excel_serials(spark):
    df = spark.createDataFrame([(40466.0,), (40466.5,), (None,), (1.0,), (59.0,)], "v double")
    got = [r[0] for r in df.select(cal.excel_serial("v")).collect()]
    assert got == [datetime(2010, 10, 15), datetime(2010, 10, 15, 12), None, datetime(1900, 1, 1), datetime(1900, 2, 28)]
    text = spark.createDataFrame([("2010-10-15",), ("40466",), (None,), ("soon",)], "v string")
    assert [r[0] for r in text.select(cal.survey_date(text, "v")).collect()] == [datetime(2010, 10, 15), datetime(2010, 10, 15), None, None]


def test_season_calendar(spark):
    c = cal.season_calendar(spark, [2010, 2023, 2024])
    assert {(r["year"], r["n"]) for r in c.groupBy("year").agg(F.count("*").alias("n")).collect()} == {(2010, 30), (2023, 30), (2024, 30)}
    first = c.filter("year = 2010 and month = 10 and decade_part = 1").first()
    assert first["legacy_decade_id"] == 201001 and first["campaign"] == "2010-2011" and first["decade_num"] == 1
    w = cal.with_window(c, 0, 1).filter("year = 2010 and decade_num = 1").first()
    assert (w["window_start"], w["window_end"]) == (date(2010, 10, 1), date(2010, 10, 11))
    w = cal.with_window(c, 8, 9).filter("year = 2010 and decade_num = 1").first()
    assert (w["window_start"], w["window_end"]) == (date(2010, 9, 23), date(2010, 10, 19))
    feb = c.filter("year = 2024 and month = 2 and decade_part = 3").first()
    assert feb["date_end"] == date(2024, 2, 29) and feb["midpoint"] == date(2024, 2, 25)


def test_range_calendar_crosses_years_and_ids_do_not_collide(spark):
    c = cal.range_calendar(spark, 2009, 35, 2010, 2)
    assert [r[0] for r in c.orderBy("decade_ord").select("decade_id").collect()] == [200935, 200936, 201001, 201002]
    wide = cal.range_calendar(spark, 2010, 1, 2010, 36)
    assert wide.select("decade_id").distinct().count() == 36 and wide.filter("campaign is null").count() == 6


def test_slices(spark):
    assert cal.month_bounds("2026-06", 2) == (2026 * 36 + 13, 2026 * 36 + 17)
    assert cal.month_bounds("2026-01", 2) == (2025 * 36 + 34, 2026 * 36 + 2)
    assert cal.range_bounds("2026-14:2026-18") == (2026 * 36 + 13, 2026 * 36 + 17)
    for bad in ("2026", "2026-13", "x-1"):
        with pytest.raises(ValueError):
            cal.month_bounds(bad)
    for bad in ("2026-14", "2026-0:2026-3", "2026-1:2026-37"):
        with pytest.raises(ValueError):
            cal.range_bounds(bad)


@pytest.mark.parametrize("campaign,decade,expected", [
    ("2016-2017", 1, "2016-10-01"), ("2016-2017", 3, "2016-10-21"), ("2016-2017", 10, "2017-01-01"),
    ("2016-2017", 30, "2017-07-21"), ("2010-2011", 4, "2010-11-01")])
def test_campaign_dates(spark, campaign, decade, expected):
    df = spark.createDataFrame([(campaign, decade)], "c string, d int")
    r = df.select(cal.campaign_date("c", "d"), cal.decade_ordinal(cal.campaign_date("c", "d")), cal.campaign_ordinal("c", "d")).first()
    assert str(r[0]) == expected and r[1] == r[2]


def test_panel_dates_have_no_summer_gap(spark):
    df = spark.createDataFrame([("2001-2002", 1), ("2001-2002", 30), ("2002-2003", 1)], "c string, d int")
    assert [str(r[0]) for r in df.select(cal.panel_date("c", "d")).collect()] == ["2001-10-01", "2002-07-18", "2002-07-28"]


def test_window_ordinals_match_the_window_definition(spark):
    days = spark.range(0, 800).select(F.expr("date_add(DATE'2019-11-15', cast(id as int))").alias("day"))
    for lead, lag in ((0, 1), (8, 9), (4, 5)):
        fast = days.select("day", F.explode(cal.window_ordinals("day", lead, lag)).alias("decade_ord"))
        c = cal.with_window(cal.range_calendar(spark, 2019, 1, 2022, 36), lead, lag)
        slow = days.join(c, (F.col("day") >= F.col("window_start")) & (F.col("day") < F.col("window_end"))).select("day", "decade_ord")
        assert fast.exceptAll(slow).isEmpty() and slow.exceptAll(fast).isEmpty()
