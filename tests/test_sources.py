import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cellseason.operators import clean
from cellseason.session import scratch_dir
from cellseason.sources import readers, sinks
from cellseason.streaming import upsert

from .conftest import rows

CUBE = "cell_id string, campagne_calc string, date_start int, v double"


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_upsert_rewrites_only_touched_campaigns(spark):
    path, staging = folder() + "/cube", folder()
    old = spark.createDataFrame([(f"c{i}", c, i, 1.0) for i in range(6) for c in ("2001-2002", "2002-2003")], CUBE)
    sinks.write_cube(old, path)
    kept = sorted(os.listdir(path + "/campagne_calc=2001-2002"))
    new = spark.createDataFrame([("c1", "2002-2003", 1, 9.0), ("c9", "2002-2003", 9, 3.0), ("c9", "2003-2004", 30, 4.0)], CUBE)
    sinks.upsert_cube(spark, new, path, staging + "/a", ("cell_id", "campagne_calc", "date_start"))
    out = readers.read_stage(spark, path)
    assert out.count() == 14 and out.filter("v = 9").count() == 1 and clean.duplicate_keys(out, ("cell_id", "campagne_calc", "date_start")).isEmpty()
    assert sorted(os.listdir(path + "/campagne_calc=2001-2002")) == kept


def test_streamed_batches_end_in_the_same_cube(spark):
    path, staging, src, ckpt = folder() + "/cube", folder(), folder() + "/in", folder()
    sinks.write_cube(spark.createDataFrame([("a", "2001-2002", 1, 1.0), ("b", "2001-2002", 1, 1.0)], CUBE), path)
    spark.createDataFrame([("a", "2001-2002", 1, 5.0), ("c", "2001-2002", 2, 2.0)], CUBE).coalesce(1).write.parquet(src)
    q = upsert.start(spark.readStream.schema(CUBE).parquet(src), path, staging, ckpt)
    q.awaitTermination(120)
    assert rows(readers.read_stage(spark, path).select("cell_id", "v"), "cell_id") == [("a", 5.0), ("b", 1.0), ("c", 2.0)]


def test_first_streamed_batch_makes_the_cube(spark):
    path, staging, src, ckpt = folder() + "/cube", folder(), folder() + "/in", folder()
    spark.createDataFrame([("a", "2001-2002", 1, 5.0), ("c", "2001-2002", 2, 2.0)], CUBE).coalesce(1).write.parquet(src)
    assert not readers.path_exists(spark, path)
    upsert.start(spark.readStream.schema(CUBE).parquet(src), path, staging, ckpt).awaitTermination(120)
    assert rows(readers.read_stage(spark, path).select("cell_id", "v"), "cell_id") == [("a", 5.0), ("c", 2.0)]


def test_versions_decide_ties_late_batches_and_replays(spark):
    path, staging = folder() + "/cube", folder()
    kind = "cell_id string, campagne_calc string, date_start int, ndvi_mean double, seen int"
    merge = upsert.cube_upserter(path, staging, per_date=2, version="seen")
    frame = lambda *data: spark.createDataFrame(data, kind)
    merge(frame(("a", "2001-2002", 1, 0.5, 3), ("a", "2001-2002", 1, 0.4, 2), ("a", "2001-2002", 1, 0.6, 3), ("b", "2001-2002", 1, 0.1, None)), 0)
    want = [("a", 0.6, 3), ("b", 0.1, None)]
    read = lambda: rows(readers.read_stage(spark, path).select("cell_id", "ndvi_mean", "seen"), "cell_id")
    assert read() == want
    merge(frame(("a", "2001-2002", 1, 0.9, 1), ("b", "2001-2002", 1, 0.2, 1)), 1)  # late for a, new for b
    assert read() == [("a", 0.6, 3), ("b", 0.2, 1)]
    merge(frame(("a", "2001-2002", 1, 0.0, 99)), 1)  # a replay of a committed batch
    assert read() == [("a", 0.6, 3), ("b", 0.2, 1)]
    with pytest.raises(AssertionError, match="all cells"):
        merge(frame(("a", "2001-2002", 2, 0.3, 5)), 2)
    assert read() == [("a", 0.6, 3), ("b", 0.2, 1)]
    merge(frame(("a", "2001-2002", 2, 0.3, 5), ("b", "2001-2002", 2, 0.3, 5)), 2)  # the batch that failed is done again
    assert len(read()) == 4


def test_adding_years_to_the_climatology_equals_a_recount(spark):
    import random

    from cellseason.operators import composites

    rnd = random.Random(1)
    data = [(f"c{c}", y * 36 + d, rnd.choice([None, rnd.random() * 50])) for c in range(4) for y in range(2001, 2006) for d in range(36) if rnd.random() < 0.7]
    sums = spark.createDataFrame(data, "cell_id string, decade_ord int, chirps_sum_mean double")
    path, span = folder() + "/clim", (2001, 2005)
    year = lambda *ys: sums.filter((F.col("decade_ord") / 36).cast("int").isin(*ys))
    assert sinks.update_climatology(spark, sums.limit(0), path, years=span).collect() == []
    for part in (year(2001), year(2003, 2002), year(2002), year(2004, 2005, 2001)):
        out = sinks.update_climatology(spark, part, path, years=span)
    got = {r[:3]: r[3] for r in rows(out)}
    want = {r[:3]: r[3] for r in rows(composites.climatology(sums, years=span).select("cell_id", "month", "decade_part", "chirps_baseline_mean"))}
    assert got.keys() == want.keys() and all(got[k] == want[k] if want[k] is None else got[k] == pytest.approx(want[k]) for k in want)


def test_a_merge_that_fails_its_checks_leaves_the_cube(spark):
    path, staging = folder() + "/cube", folder()
    kind = "cell_id string, campagne_calc string, date_start int, ndvi_mean double"
    sinks.upsert_cube(spark, spark.createDataFrame([("a", "2001-2002", 1, 0.5), ("b", "2001-2002", 1, 0.5)], kind), path, staging + "/0", per_date=2)
    for bad, error in (([("a", "2001-2002", 1, 7.0)], "range"), ([(None, "2001-2002", 1, 0.1)], "range"), ([("a", "2001-2002", 2, 0.1)], "all cells")):
        with pytest.raises(AssertionError, match=error):
            sinks.upsert_cube(spark, spark.createDataFrame(bad, kind), path, staging + "/1", per_date=2)
    assert rows(readers.read_stage(spark, path).select("cell_id", "ndvi_mean"), "cell_id") == [("a", 0.5), ("b", 0.5)]


def test_survey_sheet_to_clean_records(spark):
    path = folder() + "/sheet"
    data = [(1, 40466.0, -20.0, 45.0, 1.0, 0.0, 0.0, 0.0, None, 0.0, 5.0, None, 29, "2010", 1.0),
            (2, 40466.0, None, 45.0, *[0.0] * 6, 5.0, None, 29, "2010", 1.0), (3, 40466.0, -50.0, 45.0, *[0.0] * 6, 5.0, None, 29, "2010", 1.0)]
    sinks.write_csv(spark.createDataFrame(data, readers.SURVEY_SCHEMA), path)
    raw = readers.read_surveys(spark, path)
    assert rows(clean.position_audit(raw)) == [(3, 1, 1, 1)]
    out = clean.clean_surveys(raw)
    r = out.first().asDict()
    assert out.count() == 1 and r["campagne_calc"] == "2010-2011" and r["campagne_decade"] == 2 and r["campagne_xls"] == "2010"
    assert "Sol_NSE" not in out.columns and "Sol_larve" in out.columns
    assert rows(clean.decade_mismatch(out)) == [(1, 0)]


def test_cached_table_computes_once(spark):
    path, calls = folder() + "/t", []

    def make():
        calls.append(1)
        return spark.range(3)

    assert readers.cached_table(spark, path, make).count() == 3 and readers.cached_table(spark, path, make).count() == 3 and calls == [1]


def test_cached_table_recovers_from_a_write_that_broke_off(spark):
    path = folder() + "/t"
    with pytest.raises(Exception, match="lost"):
        readers.cached_table(spark, path, lambda: spark.range(3).select(F.raise_error(F.lit("lost")).cast("int").alias("id")))
    os.makedirs(path, exist_ok=True)  # as a lost driver leaves it
    assert readers.cached_table(spark, path, lambda: spark.range(3)).count() == 3


def test_chosen_model_falls_back(spark):
    path = folder() + "/c"
    sinks.write_choice(spark.createDataFrame([("b", 2), ("a", 1)], "modele string, rang int"), path)
    rec = spark.read.json(path)
    assert rec.select(sinks.chosen_model(rec)).first()[0] == "a" and rec.first()["classement"] == ["a", "b"]
    assert sinks.chosen_model(None) == "regression_ordinale"
    none = spark.createDataFrame([(None,)], "modele_retenu string")
    assert none.select(sinks.chosen_model(none)).first()[0] == "regression_ordinale"


def test_empty_sources_keep_their_columns(spark):
    e = clean.keep_columns(None, {}, ["cell_id"], "cell_id string, v double", spark)
    assert e.columns == ["cell_id", "v"] and e.isEmpty()
    df = spark.createDataFrame([("a", 1.0, 2)], "cell_id string, chirps_sum double, junk int")
    assert clean.keep_columns(df, {"chirps_sum": "chirps_sum_mean"}, ["chirps_sum_mean", "cell_id", "none"]).columns == ["chirps_sum_mean", "cell_id"]


def test_scratch_follows_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    at = scratch_dir(spark, "x")
    assert at.startswith(root) if root else "spark-" in at
    assert scratch_dir(spark, "x") != at


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (None, None), (1, 2)], "a int, b int")
    assert dict(rows(clean.null_rates(df, ["a", "b"]))) == {"a": 0.333, "b": 0.667}
    assert dict(rows(clean.value_counts(df, "a"))) == {1: 2, None: 1}
    assert df.filter(F.col("a").isNull()).count() == 1
