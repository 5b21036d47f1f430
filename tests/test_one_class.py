"""Tables on which no region is labeled positive, as large ones are: the share of presences of every group stays below one half."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellseason.operators import models, outputs

from .oracle import compare, connect

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def one_class(spark, tmp_path_factory):
    """The smallest tables with order keys that give only absences."""
    folder = str(tmp_path_factory.mktemp("one-class"))
    for f in os.listdir(SOURCE):
        if f != "orders.parquet":
            os.symlink(f"{SOURCE}/{f}", f"{folder}/{f}")
    orders = spark.read.parquet(f"{SOURCE}/orders.parquet")
    orders.withColumn("o_orderkey", F.col("o_orderkey") * (3 * 4 * 5 * 19 * 23 * 31) + 1).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["F18_positive_weight", "F21_effort_trend", "L19_fold_gates", "M12_horizon_report", "P4_panel_walk_forward"])
def test_same_as_sql(spark, one_class, name):
    con = connect(one_class)
    con.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM '{one_class}/orders.parquet/*.parquet'")
    assert compare(entry.queries()[name](spark, one_class), con, entry.oracle_sql()[name]) == ""


def test_no_density_without_presences(spark, one_class):
    assert entry.queries()["L13_density_model"](spark, one_class).count() == 0
    got = entry.queries()["L15_hierarchical"](spark, one_class)
    assert got.count() > 0 and got.filter("presence_pred <> 0 or densite_pred is not null or phase_pred is not null").count() == 0


def test_density_is_unknown_without_rows_to_train_on(spark):
    df = models.assemble(spark.createDataFrame([(i, 1.0, None) for i in range(3)], "row_id bigint, x double, densite_imago_median double"), ["x"], None)
    assert [r["densite_pred"] for r in models.DensityModel(rounds=2).fit(df).predict(df).collect()] == [None] * 3


def test_trend_of_constant_rates_or_efforts(spark):
    def trend(*data):
        return tuple(map(str, outputs.effort_trend(spark.createDataFrame(data, "effort_mean double, taux_presence double")).first()))

    assert trend((1.0, 0.0), (2.0, 0.0), (4.0, 0.0)) == ("0.0", "0.0", "nan")
    assert trend((1.0, 0.0), (1.0, 1.0)) == ("nan", "None", "nan")
    assert trend((None, 0.0), (1.0, None)) == ("None", "None", "None")
    assert trend((1.0, 2.0), (2.0, 4.0), (None, 9.0)) == ("2.0", "0.0", "1.0")
