from datetime import date

import pytest
from pyspark.sql import functions as F

from cellseason.functions import calendar as cal
from cellseason.functions import quality
from cellseason.operators import clean, composites, cube

from .conftest import rows


@pytest.fixture()
def cells(spark):
    return spark.createDataFrame([("a", "1"), ("b", "2")], "cell_id string, AIRE_CODE string")


def ords(y, d):
    return y * 36 + d - 1


def test_cube_is_cells_by_decades_and_missing_pairs_are_null(spark, cells):
    sp = cube.spine(cells, F.lit(ords(2010, 28)), F.lit(ords(2011, 3)))
    rain = spark.createDataFrame([("a", ords(2010, 28), 5.0)], "cell_id string, decade_ord int, chirps_sum_mean double")
    for out in (cube.left_join_sources(sp, [rain, None]), cube.stack_on_spine(sp, [rain, None])):
        assert out.count() == 2 * 12
        assert rows(out.filter("chirps_sum_mean is not null").select("cell_id", "AIRE_CODE", "chirps_sum_mean")) == [("a", "1", 5.0)]


def test_season_only_skips_august_and_september(cells):
    sp = cube.with_calendar(cube.spine(cells, F.lit(ords(2010, 1)), F.lit(ords(2010, 36))))
    assert sp.count() == 60 and sp.filter("month in (8, 9)").isEmpty()


def test_stacking_ignores_source_rows_off_the_spine(spark, cells):
    sp = cube.spine(cells, F.lit(ords(2010, 1)), F.lit(ords(2010, 2)))
    rain = spark.createDataFrame([("zz", ords(2010, 1), 5.0), ("a", ords(2010, 9), 5.0)], "cell_id string, decade_ord int, chirps_sum_mean double")
    out = cube.stack_on_spine(sp, [rain])
    assert out.count() == 4 and out.filter("chirps_sum_mean is not null").isEmpty()


def test_anomaly(spark):
    df = spark.createDataFrame([("a", 1, 1, 50.0), ("b", 1, 1, None), ("c", 1, 1, 50.0)], "cell_id string, month int, decade_part int, chirps_sum_mean double")
    base = spark.createDataFrame([("a", 1, 1, 40.0), ("b", 1, 1, 40.0)], "cell_id string, month int, decade_part int, chirps_baseline_mean double")
    assert rows(composites.with_anomaly(df, base).select("cell_id", "chirps_anomaly_mean"), "cell_id") == [("a", 10.0), ("b", None), ("c", None)]


def test_climatology_is_the_mean_of_yearly_sums(spark):
    s = spark.createDataFrame([("a", ords(y, 1), v) for y, v in ((1981, 10.0), (1990, 20.0), (2011, 99.0))], "cell_id string, decade_ord int, chirps_sum_mean double")
    assert rows(composites.climatology(s)) == [("a", 1, 1, 15.0)]


def test_latest_composite_keeps_masked_pixels_null(spark):
    img = spark.createDataFrame([("a", date(2010, 10, 1), 100, 0), ("a", date(2010, 10, 9), 200, 3), ("b", date(2010, 10, 1), 300, 1)],
                                "cell_id string, image_time date, raw int, qa int")
    vals = {"ndvi_mean": quality.masked("raw", quality.vegetation_ok("qa"), 0.0001)}
    at = F.col("decade_ord") == ords(2010, 28)
    assert rows(composites.latest_composite(img, vals, "image_time", (0, 1)).filter(at).select("cell_id", "ndvi_mean")) == [("a", None)]
    best = rows(composites.best_valid_composite(img, vals, "image_time", (0, 1)).filter(at).select("cell_id", F.round("ndvi_mean", 6)), "cell_id")
    assert best == [("a", 0.01), ("b", 0.03)]


def test_quality_bits(spark):
    df = spark.createDataFrame([(q,) for q in range(8)], "qa int")
    assert [r[0] for r in df.select(quality.vegetation_ok("qa")).collect()] == [True, True, False, False] * 2
    assert [r[0] for r in df.select(quality.temperature_ok("qa")).collect()] == [True, False, False, False] * 2


def test_checks(spark, cells):
    full = cube.with_calendar(cube.spine(cells, F.lit(ords(2010, 1)), F.lit(ords(2010, 3))))
    assert clean.completeness_violations(full, cells).isEmpty()
    hole = full.filter("not (cell_id = 'b' and decade_part = 2)")
    assert rows(clean.completeness_violations(hole, cells).select("campagne_decade", "n_cells", "n_expected")) == [(11, 1, 2)]
    with pytest.raises(AssertionError):
        clean.require_empty(clean.completeness_violations(hole, cells), "incomplete")
    bad = full.withColumn("ndvi_mean", F.lit(1.5)).withColumn("lst_mean", F.lit(300.0)).withColumn("chirps_sum_mean", F.lit(None).cast("double"))
    got = dict(rows(clean.range_violations(bad)))
    assert got["range_ndvi_mean"] == 6 and got["range_lst_mean"] == 0 and got["range_chirps_sum_mean"] == 0 and got["null_cell_id"] == 0


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "cell_id string, date_start int, v double")
    new = spark.createDataFrame([("b", 1, 9.0), ("c", 2, 3.0)], "cell_id string, date_start int, v double")
    assert rows(cube.upsert(old, new).select("cell_id", "v"), "cell_id") == [("a", 1.0), ("b", 9.0), ("c", 3.0)]
    assert cal.with_decade_fields(spark.range(1).select(F.lit(ords(2010, 28)).alias("decade_ord"))).first()["decade_num"] == 1
