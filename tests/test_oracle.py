"""Every registered query with an oracle, against DuckDB at the smallest scale."""

import re

import pytest

import __spark_entry__ as entry

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# results that may rightly be empty on so few rows
SPARSE = {"B14_completeness", "C7_month_slice", "C8_range_slice"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    msg = compare(QUERIES[key](spark, SF), con, ORACLES[key])
    assert msg == "" or (msg == "EMPTY" and key in SPARSE), msg


def test_every_operator_has_a_query():
    ids = {re.match(r"[A-Z]+\d+", k).group() for k in QUERIES if re.match(r"[A-Z]+\d+_", k)}
    want = {f"{p}{i}" for p, n in (("A", 14), ("B", 17), ("C", 15), ("D", 11), ("E", 18), ("F", 26), ("G", 11), ("H", 9), ("J", 12),
                                   ("L", 20), ("M", 14), ("N", 7), ("P", 4), ("T", 12), ("S", 2)) for i in range(1, n + 1)}
    assert want <= ids, sorted(want - ids)


def test_labels_meet_covariates(spark):
    """The label join must not be empty by construction."""
    from cellseason.plans.bindings import Views

    t = Views(spark, SF).training
    assert t.filter("severite is not null").count() > 300 and t.filter("severite is not null and ndvi_mean is not null").count() > 20
