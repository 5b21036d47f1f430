import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier

from cellseason.operators import models, net


@pytest.fixture(scope="module")
def table(spark):
    rnd, data = random.Random(7), []
    for i in range(128 * 16):  # whole blocks, in one partition: there a row weighs the same in Spark ML
        f = [rnd.gauss(0, 1) for _ in range(3)]
        data.append((i, *f, int(min(3, max(0, round(1.5 + f[0] + f[1] * f[2] + rnd.gauss(0, 0.3)))))))
    return models.assemble(spark.createDataFrame(data, "row_id bigint, f0 double, f1 double, f2 double, severite int").coalesce(1), ["f0", "f1", "f2"]).cache()


def shares(model, df):
    return np.array([list(r["__p"]) for r in model._probabilities(df).orderBy("row_id").collect()])


def test_net_equals_that_of_spark_ml(table, monkeypatch):
    made = lambda n, k: MultilayerPerceptronClassifier(layers=[n, 8, 5, k], maxIter=12, seed=models.SEED)
    want = models.Classifier(made, weighted=False).fit(table)
    got = models.DenseNet((8, 5), 12).fit(table)
    assert got.classes == want.classes and abs(shares(got, table) - shares(want, table)).max() < 1e-4
    monkeypatch.setattr(net, "ALONE", 0)  # by passes instead of one task
    assert abs(shares(got, table) - shares(models.DenseNet((8, 5), 12).fit(table.repartition(5)), table)).max() < 1e-6


def test_single_precision_learns_as_well(table, monkeypatch):
    y = np.array([r["y"] for r in table.orderBy("row_id").collect()])
    right = lambda m: (shares(m.fit(table), table).argmax(1) == y).mean()
    want = right(models.DenseNet((16, 8), 60))
    monkeypatch.setattr(net, "ALONE", 0)
    monkeypatch.setattr(net, "DOUBLE", 0)
    assert want > 0.7 and abs(right(models.DenseNet((16, 8), 60)) - want) < 0.03


def test_slope_is_that_of_the_loss():
    rnd = np.random.default_rng(1)
    sizes, block = [3, 4, 2, 3], [(rnd.normal(size=(700, 3)), rnd.integers(0, 3, 700).astype(np.uint8))]
    w = rnd.normal(size=4 * 4 + 5 * 2 + 3 * 3)
    got = net.loss_and_slope(block, w, sizes, np.float64)
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-5
        up, down = (net.loss_and_slope(block, w + s * e, sizes, np.float64)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - got[1 + i]) < 1e-3


def test_net_of_one_class(table):
    assert (shares(models.DenseNet().fit(table.filter("y = 2")), table) == 1.0).all()


def test_registry_fits_its_net_by_blocks():
    assert isinstance(models.registry(max_iter=3)["mlp"].make(), models.DenseNet)
