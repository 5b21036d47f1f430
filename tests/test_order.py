import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellseason.operators import order

from .conftest import rows


def test_running_sums_under_skew(spark):
    rnd = random.Random(1)
    vals = {k: sorted({round(rnd.gauss(0, 1) ** 3, 6) for _ in range(n)}) for k, n in (("hot", 4000), ("cold", 7), ("one", 1))}
    data = [(k, v, rnd.randint(0, 5)) for k, vs in vals.items() for v in vs]
    got = order.running_before(spark.createDataFrame(data, "k string, v double, n int"), "v", ["n"], ["k"], 16).collect()
    by = {}
    for k, v, n in sorted(data):
        by[(k, v)] = by.get(k, 0)
        by[k] = by.get(k, 0) + n
    assert len(got) == len(data) and all(r["n_before"] == by[(r["k"], r["v"])] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 2001])
def test_exact_quantiles(spark, n):
    rnd = random.Random(n)
    xs = [rnd.choice([0.0, 0.0, rnd.uniform(-5, 5)]) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    got = order.exact_quantiles(df, "x", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(xs, p), abs=1e-12)


def test_column_medians_fill(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, 5.0), (10.0, 7.0)], "a double, b double")
    out = order.with_median_fill(df, ["a", "b"], order.column_medians(df, ["a", "b"]))
    assert sorted(rows(out)) == [(1.0, 6.0), (3.0, 5.0), (3.0, 6.0), (10.0, 7.0)] or sorted(rows(out)) == [(1.0, 6.0), (3.0, 5.0), (3.0, 6.0), (10.0, 7.0)]
    assert dict(rows(order.column_medians(df, ["a", "b"]))) == {"a": 3.0, "b": 6.0}
    assert out.filter(F.col("a").isNull()).isEmpty()


def test_expanding_medians_against_plain_ones(spark):
    import random
    import statistics

    rnd = random.Random(2)
    data = [(y, rnd.choice([None, float("nan"), 1.0, 2.0, 2.5, rnd.random()]), rnd.randint(0, 9) if y > 2003 else None) for y in range(2001, 2009) for _ in range(rnd.randint(0, 40))]
    df = spark.createDataFrame(data, "y int, a double, b int")
    parts = [order.counts_by_season(df.filter(c), ["a", "b"], F.col("y")) for c in ("y <= 2004", "y > 2004")]
    starts = [2001, 2002, 2005, 2009]
    for buckets in (None, 5):
        got = {(r["start"], r["feature"]): r["median"] for r in order.expanding_medians(parts[0].unionByName(parts[1]), starts, buckets).collect()}
        want = {}
        for s in starts:
            for i, c in ((1, "a"), (2, "b")):
                own = [r[i] for r in data if r[0] < s and r[i] is not None and r[i] == r[i]]
                if own:
                    want[s, c] = statistics.median(own)
        assert got == want
    assert order.expanding_medians(parts[0], []).collect() == []
    filled = order.with_fold_fill(df, ["a"], order.expanding_medians(parts[0], [2005]), 2005)
    assert filled.filter("a is null").isEmpty()


def test_rows_and_totals_use_the_same_cuts(spark):
    """On a cluster the parts of an approximate percentile are merged in any order, so a plan that evaluates it again may get other cuts."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    for keys in (["k"], []):
        got = order.exact_median(df, "x", keys, buckets=8)
        assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["median"] for r in got.collect()) == ([1498.5, 1499.5, 1500.5] if keys else [1499.5])


def test_column_medians_exchange_few_values(spark):
    import random
    import statistics

    rnd = random.Random(5)
    data = [(rnd.choice([None, float("nan"), rnd.random()]), i % 3, rnd.gauss(0, 1), None) for i in range(30000)]
    df = spark.createDataFrame(data, "a double, b int, c double, d double")
    got = {r["feature"]: r["median"] for r in order.column_medians(df, ["a", "b", "c", "d"]).collect()}
    want = {c: statistics.median(v for r in data if (v := r[i]) is not None and v == v) for i, c in enumerate("abc")}
    assert got == want
    seen = []
    real, order.exact_median = order.exact_median, lambda long, *a, **k: seen.append(long.distinct().count()) or real(long, *a, **k)
    try:
        order.column_medians(df, ["c"])
    finally:
        order.exact_median = real
    assert seen[0] < 300  # of 30,000 different values
