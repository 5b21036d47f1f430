from pyspark.sql import functions as F

from cellseason.operators import outputs

from .conftest import rows


def test_monthly_map_takes_the_worst_decade(spark):
    df = spark.createDataFrame([("a", 1, "2010-2011", d, s) for d, s in ((1, 1), (2, 3), (3, 0), (4, 2))],
                               "cell_id string, AIRE_CODE int, campagne_calc string, campagne_decade int, severite int")
    assert rows(outputs.monthly_map(df).select("mois_campagne", "severite"), "mois_campagne") == [(1, 3), (2, 2)]


def test_area_roll_up(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 1, 2), ("c", 1, 3), ("d", 2, 1)], "cell_id string, AIRE_CODE int, severite int").withColumns(
        {"campagne_calc": F.lit("2010-2011"), "mois_campagne": F.lit(1)})
    assert rows(outputs.area_month(df).select("AIRE_CODE", "severite_max", "n_cellules", "n_cellules_foyer"), "AIRE_CODE") == [(1, 3, 3, 2), (2, 1, 1, 0)]


def test_target_campaign(spark):
    df = spark.createDataFrame([("2001-2002", 0.1), ("2002-2003", 0.2), ("2002-2003", None), ("2003-2004", None)], "campagne_calc string, ndvi_mean double")
    pick = lambda **k: outputs.target_campaign(df, **k).first()[0]
    assert pick() == "2002-2003" and pick(minimum=0.9) == "2001-2002" and pick(minimum=1.1) == "2003-2004" and pick(forced="1999-2000") == "1999-2000"


def test_decade_map_falls_back_to_the_last(spark):
    df = spark.createDataFrame([(1,), (2,), (5,)], "campagne_decade int")
    assert rows(outputs.decade_map(df, 2)) == [(2,)] and rows(outputs.decade_map(df, 9)) == [(5,)] and rows(outputs.decade_map(df)) == [(5,)]


def test_raster_is_complete_and_top_down(spark):
    grid = spark.createDataFrame([("5_7", 5, 7), ("6_9", 6, 9), ("9_9", 9, 9)], "cell_id string, cell_col int, cell_row int")
    m = spark.createDataFrame([("5_7", 3), ("6_9", 1)], "cell_id string, severite int")
    assert rows(outputs.raster_pixels(m, grid), "px_row", "px_col") == [(0, 0, 255), (0, 1, 1), (1, 0, 255), (1, 1, 255), (2, 0, 3), (2, 1, 255)]


def test_quartiles_merge_equal_edges(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 0), (9, 1)], "effort_prospection int, label int")
    assert rows(outputs.effort_quartiles(df), "quartile") == [(1, 0.4, 5)]
    wide = spark.createDataFrame([(i, int(i > 4)) for i in range(1, 9)], "effort_prospection int, label int")
    assert rows(outputs.effort_quartiles(wide), "quartile") == [(1, 0.0, 2), (2, 0.0, 2), (3, 1.0, 2), (4, 1.0, 2)]


def test_compare_maps_picks_the_key(spark):
    p = spark.createDataFrame([(1, 7, "x", 2)], "AIRE_CODE int, rn_num int, campagne_calc string, niveau int")
    assert outputs.compare_maps(p.drop("rn_num"), spark.createDataFrame([(1, "x", 3)], "AIRE_CODE int, campagne_calc string, ext int")).count() == 1
    assert outputs.compare_maps(p.drop("AIRE_CODE"), spark.createDataFrame([(7, "x", 3)], "rn_num int, campagne_calc string, ext int")).count() == 1
