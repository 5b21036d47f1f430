import random

import numpy as np
import pytest

from cellseason.operators import models


@pytest.fixture(scope="module")
def table(spark):
    rnd, data = random.Random(5), []
    for i in range(3000):
        f = [float(rnd.randrange(20)), rnd.random(), float(rnd.randrange(3)), 1.0]
        data.append((i, *f, int(min(3, max(0, round((f[0] / 4 + 3 * f[1] - f[2]) / 2 + rnd.gauss(0, 0.5)))))))
    names = [f"f{i}" for i in range(4)]
    return models.assemble(spark.createDataFrame(data, "row_id bigint, " + ", ".join(f"{n} double" for n in names) + ", severite int"), names).cache()


def shares(model, df):
    return np.array([list(r["__p"]) for r in model._probabilities(df).orderBy("row_id").collect()])


@pytest.mark.parametrize("depth, bins, weighted", [(5, 32, True), (4, 64, False)])
def test_boosting_equals_that_of_spark_ml(table, depth, bins, weighted):
    want = shares(models.Classifier(models._boosted(6, depth, maxBins=bins), weighted=weighted, one_vs_rest=True).fit(table), table)
    for small in (1 << 20, 0):  # by one task a class, by passes over all rows
        got = shares(models.Boosted(6, depth, bins=bins, weighted=weighted, small=small).fit(table.repartition(3)), table)
        assert (abs(got - want).max(1) < 1e-6).mean() > 0.98  # equal gains may be cut elsewhere


def test_cuts_after_a_heavy_value_are_those_of_spark_ml(spark):
    rnd, data = random.Random(8), []
    for i in range(1500):  # a value that fills gaps weighs several shares
        f = [50.0 if rnd.random() < 0.4 else rnd.random() * 100, rnd.random()]
        data.append((i, *f, int(min(3, max(0, round(f[0] / 25 + f[1] + rnd.gauss(0, 0.5)))))))
    t = models.assemble(spark.createDataFrame(data, "row_id bigint, f0 double, f1 double, severite int"), ["f0", "f1"]).cache()
    want = shares(models.Classifier(models._boosted(5, 4), one_vs_rest=True).fit(t), t)
    assert (abs(shares(models.Boosted(5, 4).fit(t), t) - want).max(1) < 1e-6).mean() > 0.98


def test_boosting_of_two_classes_and_of_one(table):
    two = table.filter("y in (0, 2)")
    want = models.Classifier(models._boosted(4, 3), one_vs_rest=True).fit(two)
    got = models.Boosted(4, 3).fit(two)
    assert got.classes == want.classes and (abs(shares(got, table) - shares(want, table)).max(1) < 1e-6).mean() > 0.98
    assert (shares(models.Boosted(4, 3).fit(table.filter("y = 1")), table) == 1.0).all()


def test_many_rounds_by_passes_equal_those_of_one_task(table):
    few = table.filter("row_id < 400")
    a, b = (models.Boosted(20, 3, small=small).fit(few) for small in (1 << 20, 0))  # beyond 16 rounds the lineage is cut
    assert abs(shares(a, few) - shares(b, few)).max() < 1e-6


def test_registry_boosts_over_binned_rows(table):
    reg = models.registry(trees=3)
    assert all(isinstance(reg[n].make(), models.Boosted) for n in ("xgboost", "lightgbm", "catboost", "histgb", "gradient_boosting"))
