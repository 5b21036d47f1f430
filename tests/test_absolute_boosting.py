import random
import statistics

import pytest
from pyspark.sql import functions as F

from cellseason.operators import models


def frame(spark, data):
    return models.assemble(spark.createDataFrame(data, "row_id bigint, x double, y0 double, held boolean"), ["x"], None)


def test_leaves_are_medians_of_the_residuals(spark):
    rng = random.Random(4)
    data = [(i, float(i % 2), (100.0 if i % 2 else 0.0) + rng.choice([0, 1, 2, 3, 50]) + rng.random(), False) for i in range(101)]
    model = models.AbsoluteBoosting(rounds=1, depth=1, step=1.0).fit(frame(spark, data), "y0")
    assert model.start == statistics.median(d[2] for d in data)
    want = sorted(statistics.median(d[2] - model.start for d in data if d[1] == x) for x in (0.0, 1.0))
    assert sorted(model.trees[0][1].values()) == pytest.approx(want, abs=1e-12)
    got = {r["x"]: r["p"] for r in model.predict(frame(spark, data), "p").select("x", "p").distinct().collect()}
    assert got == pytest.approx({x: statistics.median(d[2] for d in data if d[1] == x) for x in (0.0, 1.0)}, abs=1e-9)


def test_outliers_do_not_move_a_leaf(spark):
    data = [(i, float(i % 2), float(i % 2) * 10 + i % 5, False) for i in range(100)]
    wild = [(i, x, 1e9 if i % 20 == 1 else y, h) for i, x, y, h in data]
    a, b = (models.AbsoluteBoosting(rounds=2, depth=1, step=0.5).fit(frame(spark, d), "y0") for d in (data, wild))
    assert abs(a.predict(frame(spark, data), "p").agg(F.max("p")).first()[0] - b.predict(frame(spark, data), "p").agg(F.max("p")).first()[0]) <= 2


def test_held_rows_stop_it(spark):
    rng = random.Random(5)
    data = [(i, rng.random(), rng.random(), i % 3 == 0) for i in range(120)]  # nothing to learn
    model = models.AbsoluteBoosting(rounds=40, depth=4, step=0.5, patience=2).fit(frame(spark, data), "y0", "held")
    assert len(model.errors) < 40 and len(model.trees) <= len(model.errors) - 2
    errors = model.errors
    assert not model.trees or errors[len(model.trees) - 1] == min(errors)


def test_labels_missing_constant_or_none(spark):
    data = [(1, 0.0, None, False), (2, 1.0, 3.0, False), (3, 2.0, 3.0, None)]
    model = models.AbsoluteBoosting(rounds=5).fit(frame(spark, data), "y0", "held")
    assert model.start == 3.0 and model.trees == []
    with pytest.raises(ValueError):
        models.AbsoluteBoosting(rounds=1).fit(frame(spark, data[:1]), "y0")
