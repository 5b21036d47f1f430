import math

import pytest
from pyspark.sql import functions as F

from cellseason.constants import POTENTIAL
from cellseason.functions import scoring as sc

from .conftest import rows


def test_phase_levels(spark):
    cases = [(0, 0, 0, "absent"), (5, 0, 0, "S"), (3, 2, 0, "St"), (3, 5, 0, "T"), (3, 3, 0, "T"), (0, 4, 0, "St"),
             (2, 1, 3, "G"), (0, 0, 1, "G"), (None, 0, 0, None), (0, None, 1, None), (1, 1, None, None)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in c[:3]) + (c[3],) for c in cases], "s double, t double, g double, e string")
    for got, want in rows(df.select(sc.phase_level("s", "t", "g"), "e")):
        assert got == want


def test_density(spark):
    cases = [(100, 90, 110), (0, 0, 0), (50, 0, 50), (0, 18, 2), (None, 0, 0), (0, None, 0), (None, None, None)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in c) for c in cases], "a double, l double, e double")
    for got, want in rows(df.select(sc.equivalent_density("a", "l"), "e")):
        assert got == want


def test_potential_matrix(spark):
    densities = (0, 5, 50, 200, 800, 2000, 5000, 15000)
    data = [(n, float(d), row[i]) for n, row in POTENTIAL.items() for i, d in enumerate(densities)]
    data += [(None, 100.0, None), ("S", None, None), ("inconnu", 100.0, None), ("absent", None, 0)]
    df = spark.createDataFrame(data, "n string, d double, e int")
    bad = df.withColumn("p", sc.potential("n", "d")).filter("not (p <=> e)")
    assert bad.isEmpty()


@pytest.mark.parametrize("d,cls", [(0.0, 0), (10.0, 1), (10.001, 2), (10000.0, 6), (10001.0, 7)])
def test_density_bins_are_right_closed(spark, d, cls):
    assert spark.range(1).select(sc.density_class(F.lit(d))).first()[0] == cls


def test_ordinal_framing_rounds_half_to_even(spark):
    df = spark.createDataFrame([(-0.4,), (0.6,), (1.5,), (2.49,), (3.8,), (0.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(sc.to_ordinal("x")).collect()] == [0, 1, 2, 2, 3, 0, 2]


def test_presence_scores(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1],), ([0.1, 0.3, 0.6],)], "p array<double>")
    assert [round(r[0], 9) for r in df.select(sc.presence_from_probabilities("p", [0, 1, 2])).collect()] == [0.3, 0.9]
    two = spark.createDataFrame([([0.4, 0.6],)], "p array<double>")
    assert two.select(sc.presence_from_probabilities("p", [2, 3])).first()[0] == 1.0
    assert math.isclose(spark.range(1).select(sc.presence_from_score(F.lit(0.5))).first()[0], 0.5)
    sev = spark.createDataFrame([(0,), (1,), (3,), (None,)], "s int")
    assert [r[0] for r in sev.select(sc.presence("s")).collect()] == [0, 1, 1, None]


def test_thresholded_phase(spark):
    df = spark.createDataFrame([([0.5, 0.2, 0.1, 0.2],), ([0.3, 0.4, 0.2, 0.1],), ([0.4, 0.4, 0.1, 0.1],)], "p array<double>")
    assert [r[0] for r in df.select(sc.thresholded_phase("p", F.lit(0.15))).collect()] == [3, 1, 0]


def test_category_codes(spark):
    df = spark.createDataFrame([("absent",), ("G",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(sc.category_code("c", ("absent", "S", "St", "T", "G"))).collect()] == [0, 4, None, None]
