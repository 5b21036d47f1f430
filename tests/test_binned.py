import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier

from cellseason.operators import binned, models


@pytest.fixture(scope="module")
def table(spark):
    rnd, data = random.Random(3), []
    for i in range(3000):
        f = [float(rnd.randrange(20)) for _ in range(3)]
        data.append((i, *f, int(min(3, max(0, round((f[0] + f[1] - f[2]) / 8 + rnd.gauss(0, 0.7)))))))
    return models.assemble(spark.createDataFrame(data, "row_id bigint, f0 double, f1 double, f2 double, severite int"), ["f0", "f1", "f2"]).cache()


def shares(model, df):
    return np.array([list(r["__p"]) for r in model._probabilities(df).orderBy("row_id").collect()])


def test_one_tree_equals_that_of_spark_ml(table):
    want = shares(models.Classifier(lambda n, k: RandomForestClassifier(numTrees=1, maxDepth=6, seed=1, bootstrap=False)).fit(table), table)
    for small in (1 << 21, 300, 0):  # finished by one task, in part by counts, by counts alone
        got = shares(models.Forest(1, 6, bootstrap=False, small=small).fit(table), table)
        assert (abs(got - want).max(1) < 1e-6).mean() > 0.98  # equal gains may be cut elsewhere


def test_forest_does_not_depend_on_tasks_or_on_who_finishes_a_node(table):
    want = shares(models.Forest(12, 7).fit(table), table)
    assert np.array_equal(shares(models.Forest(12, 7, small=200).fit(table), table), want)
    assert np.array_equal(shares(models.Forest(12, 7).fit(table.repartition(3)), table), want)
    whole = models.Classifier(models._forest(12, maxDepth=7)).fit(table)
    y = np.array([r["y"] for r in table.orderBy("row_id").collect()])
    assert (want.argmax(1) == y).mean() > (shares(whole, table).argmax(1) == y).mean() - 0.03


def test_registry_grows_its_forest_over_binned_rows(table):
    assert isinstance(models.registry(trees=3)["random_forest"].make(), models.Forest)


def test_a_task_that_finishes_a_node_holds_few_rows():
    assert binned.SMALL * (21 + 2) < 16 << 20  # bytes of bins, codes and bags; working arrays are about ten times as large
