import random
from datetime import date

from pyspark.sql import functions as F

from cellseason.functions import calendar as cal
from cellseason.operators import features, training

from .conftest import rows


def table(spark, data, extra=""):
    """Rows of (cell, decade ordinal, rain, ...) with calendar columns."""
    df = spark.createDataFrame(data, "cell_id string, decade_ord int, chirps_sum_mean double" + extra)
    f = cal.decade_fields("decade_ord")
    names = {"campaign": "campagne_calc", "decade_num": "campagne_decade"}
    return df.select("*", *[c.alias(names.get(n, n)) for n, c in f.items()])


def streaks(flags):
    out, n = [], 0
    for v in flags:
        n = n + 1 if v else 0
        out.append(n)
    return out


def test_counter_resets_on_false_and_null(spark):
    for flags, want in (([True, True, False, True], [1, 2, 0, 1]), ([True, True, None, True], [1, 2, 0, 1])):
        df = spark.createDataFrame([("a", i, v) for i, v in enumerate(flags)], "k string, i int, f boolean")
        assert [r[0] for r in rows(features.with_streak(df, "f", ["k"], ["i"]).orderBy("i").select("streak"))] == want


def month_rows(cell, year, month, total):
    return [(cell, year * 36 + (month - 1) * 3 + p, v) for p, v in enumerate((total, 0.0, None))]


def test_rain_streak_months(spark):
    data = month_rows("a", 2010, 10, 80.0) + month_rows("a", 2010, 11, 50.0) + month_rows("a", 2010, 12, 125.0) + month_rows("a", 2011, 1, 126.0) + month_rows("a", 2011, 2, 60.0)
    got = rows(features.with_rain_streak(table(spark, data)).select("decade_ord", "pop_consecutive"), "decade_ord")
    assert [g[1] for g in got] == [1] * 3 + [2] * 3 + [3] * 3 + [0] * 3 + [1] * 3


def test_streak_restarts_per_campaign_and_skips_the_gap(spark):
    data = month_rows("a", 2011, 7, 80.0) + month_rows("a", 2011, 8, 80.0) + month_rows("a", 2011, 10, 80.0) + month_rows("a", 2011, 11, 80.0)
    got = rows(features.with_rain_streak(table(spark, data)).select("month", "pop_consecutive").distinct(), "month")
    assert got == [(7, 1), (8, None), (10, 1), (11, 2)]


def test_streak_agrees_with_the_monthly_form_on_random_series(spark):
    rnd = random.Random(3)
    data = []
    for cell in "abcdefgh":
        for o in range(2000 * 36 + 20, 2003 * 36):
            if rnd.random() < 0.9:  # decades may be missing
                data.append((cell, o, None if rnd.random() < 0.1 else rnd.choice([0.0, 10.0, 30.0, 45.0, 60.0])))
    t = table(spark, data)
    m = features.monthly_rain(t).withColumn("ok", F.col("chirps_monthly_sum").between(50, 125))
    keys = ["cell_id", "campagne_calc", "year", "month"]
    want = features.with_streak(m, "ok", keys[:2], keys[2:]).select(*keys, "streak")
    both = features.with_rain_streak(t).join(want, keys, "left").filter("not (pop_consecutive <=> streak)")
    assert both.isEmpty() and want.filter("streak > 1").count() > 10


def test_lags_and_rolling_sums_do_not_leak_between_cells(spark):
    start = 2010 * 36 + 27
    data = [(c, start + i, 100.0 * k + i) for k, c in ((1, "a"), (2, "b")) for i in range(5)]
    t = features.with_rolling_rain(features.with_lags(table(spark, data)))
    a = rows(t.filter("cell_id = 'a'").select("chirps_sum_mean_lag1d", "chirps_sum_mean_lag2d", "chirps_cumul_2d", "chirps_cumul_3d", "decade_ord"), "decade_ord")
    assert a[0][:4] == (None, None, None, None) and a[1][2] == 201.0 and a[4][2] == 207.0 and a[2][3] == 303.0 and a[1][3] is None
    b = rows(t.filter("cell_id = 'b'").select("chirps_sum_mean_lag1d", "decade_ord"), "decade_ord")
    assert b[0][0] is None and b[1][0] == 200.0
    assert "ndvi_mean_lag1d" not in t.columns


def test_rolling_needs_every_value(spark):
    t = features.with_rolling_rain(table(spark, [("a", 72000 + i, v) for i, v in enumerate([1.0, None, 2.0, 3.0, 4.0])]))
    got = rows(t.select("decade_ord", "chirps_cumul_2d", "chirps_cumul_3d"), "decade_ord")
    assert [g[1:] for g in got] == [(None, None), (None, None), (None, None), (5.0, None), (7.0, 9.0)]


def test_severity_history_drops_the_target(spark):
    data = [("a", 72360 + i, 0.0, s) for i, s in enumerate([0, 1, 2, 3, 1])]
    out = features.with_severity_lags(table(spark, data, ", severite int"))
    got = rows(out.select("decade_ord", "severite_lag1", "severite_lag2"), "decade_ord")
    assert got[2][1] == 1 and got[3][2] == 1 and got[0][1] is None and "severite" not in out.columns


def test_build_features_keeps_one_sort_and_no_exchange_after_partitioning(spark):
    t = table(spark, [("a", 72360 + i, 1.0, 1) for i in range(40)], ", severite int").repartition("cell_id")
    plan = features.build_features(t, keep_target=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_training_table_separates_absence_from_surface(spark):
    f = spark.createDataFrame([(1, "2010-2011", 1, 0.5), (2, "2010-2011", 1, 0.6)], "cell_id bigint, campagne_calc string, campagne_decade int, ndvi_mean double")
    l = spark.createDataFrame([(1, "2010-2011", 1, 0, 0, None, 2)], "cell_id bigint, campagne_calc string, campagne_decade int, severite int, binaire int, intensite double, effort_prospection int")
    got = rows(training.training_table(f, l).select("cell_id", "severite", "a_predire"), "cell_id")
    assert got == [(1, 0, False), (2, None, True)]


def test_horizon_shift(spark):
    df = spark.createDataFrame([("a", date(2010, 1, d), s) for d, s in ((1, 0), (11, 2), (21, 3))], "cell_id string, date_start date, severite int")
    got = rows(training.shift_target(df, 1).select("severite", "a_predire", "date_start"), "date_start")
    assert [g[:2] for g in got] == [(2, False), (3, False), (None, True)]
