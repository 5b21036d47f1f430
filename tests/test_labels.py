import math

from cellseason.operators import labels

from .conftest import rows

SCHEMA = ("cell_id string, campagne_calc string, campagne_decade int, Sol double, Sol_larve double, Trans double, "
          "Trans_larve double, Greg double, Greg_larve double, densite_imago double")


def record(cell="100_200", camp="2010-2011", dec=5, d=None, **c):
    base = {k: 0.0 for k in ("Sol", "Sol_larve", "Trans", "Trans_larve", "Greg", "Greg_larve")}
    base.update(c)
    return (cell, camp, dec, *base.values(), d)


ALL_NULL = {k: None for k in ("Sol", "Sol_larve", "Trans", "Trans_larve", "Greg", "Greg_larve")}


def label(spark, *recs):
    return labels.aggregate_labels(spark.createDataFrame(list(recs), SCHEMA))


def test_severity_is_the_highest_phase(spark):
    data = [record("a", Sol=2.0), record("a", Trans_larve=1.0), record("b", Greg_larve=1.0), record("b"), record("c"), record("c", **ALL_NULL),
            record("d", **ALL_NULL), record("e", **{**ALL_NULL, "Sol": 3.0})]
    got = {r["cell_id"]: (r["severite"], r["binaire"], r["effort_prospection"]) for r in label(spark, *data).collect()}
    assert got == {"a": (2, 1, 2), "b": (3, 1, 2), "c": (0, 0, 2), "d": (None, None, 1), "e": (1, 1, 1)}


def test_intensity(spark):
    data = [record("a", d=99.0), record("a", d=199.0), record("b", d=None), record("b", d=9.0), record("c", d=None), record("d", d=0.0)]
    got = {r["cell_id"]: r["intensite"] for r in label(spark, *data).collect()}
    assert math.isclose(got["a"], math.log1p(149)) and math.isclose(got["b"], math.log1p(9)) and got["c"] is None and got["d"] == 0.0


def test_rows_without_key_are_left_out(spark):
    data = [record(None), record(camp=None), record(dec=None), record("ok")]
    assert [r[0] for r in rows(label(spark, *data))] == ["ok"]
