"""Queries for sources, sinks, projections, audits, calendar and scalar functions (A, B, C, J)."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import functions as F

from ..constants import PHASE_LEVELS, VEGETATION_WINDOW
from ..functions import calendar as cal
from ..functions import quality, scoring
from ..operators import clean, composites, cube, metrics, models, order, selection, training
from ..session import scratch_dir
from ..sources import readers, sinks
from .bindings import MODELS, Views, camp, ordinal, part, season_decade, u
from .registry import query

r6 = lambda c: F.round(c, 6)


# --- A. sources and sinks ------------------------------------------------------------------------------

@query("A1_read_surveys", """
SELECT id, Date_, round(LAT_DD, 6) AS lat, round(LNG_DD, 6) AS lng, Sol, "Sol larve" AS sol_larve, Decade, Campagne FROM survey_raw_v""")
def _(v: Views):
    path = scratch_dir(v.spark, "surveys")
    raw = v.survey_raw.select("id", "Date_", "LAT_DD", "LNG_DD", "Sol", "Trans", "Greg", "Sol larve", "Trans larve", "Greg larve", "DI_dif_moy", "DL_dif_moy", "Decade", "Campagne", "Sol_NSE")
    sinks.write_csv(raw, path)
    df = readers.read_surveys(v.spark, path)
    return df.select("id", "Date_", r6("LAT_DD").alias("lat"), r6("LNG_DD").alias("lng"), "Sol", F.col("Sol larve").alias("sol_larve"), "Decade", "Campagne")


def area_rings(v: Views, name: str = "areas_v"):
    """Diamond areas as rings of four vertices."""
    a = v.raw(name)
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    cx, cy, hx, hy = (F.col(c) for c in ("cx", "cy", "hx", "hy"))
    return a.select("poly_id", "AIRE_CODE", "SECT_NO", "AIRE_NOM",
                    F.array(pt(cx + hx, cy), pt(cx, cy + hy), pt(cx - hx, cy), pt(cx, cy - hy)).alias("ring"))


@query("A2_read_areas", """
SELECT poly_id, AIRE_CODE, SECT_NO, AIRE_NOM, 0 AS ring_no, n AS pt_no,
  round(CASE n WHEN 0 THEN cx + hx WHEN 2 THEN cx - hx ELSE cx END, 6) AS lon, round(CASE n WHEN 1 THEN cy + hy WHEN 3 THEN cy - hy ELSE cy END, 6) AS lat
FROM areas_v CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS n) k""")
def _(v: Views):
    path = scratch_dir(v.spark, "areas")
    rings = area_rings(v)
    closed = F.concat("ring", F.slice("ring", 1, 1))
    feature = rings.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct("poly_id", "AIRE_CODE", "SECT_NO", "AIRE_NOM").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")).alias("geometry"))).alias("t"))
    sinks.write_lines(feature, "t", path)
    df = readers.read_areas(v.spark, path)
    return df.select("poly_id", "AIRE_CODE", "SECT_NO", "AIRE_NOM", "ring_no", F.posexplode("ring").alias("pt_no", "p")).select(
        "poly_id", "AIRE_CODE", "SECT_NO", "AIRE_NOM", "ring_no", "pt_no", r6("p.lon").alias("lon"), r6("p.lat").alias("lat"))


@query("A3_stage_table", "SELECT cell_id, campagne_calc, campagne_decade, severite, round(intensite, 6) AS intensite, effort_prospection, binaire FROM labels_v")
def _(v: Views):
    path = scratch_dir(v.spark, "labels")
    sinks.write_stage(v.labels, path)
    return readers.read_stage(v.spark, path).withColumn("intensite", r6("intensite"))


@query("A4_partitioned_cube", "SELECT campagne_calc, count(*) AS n, round(sum(chirps_sum_mean), 6) AS rain FROM cube_v GROUP BY 1")
def _(v: Views):
    path = scratch_dir(v.spark, "cube")
    sinks.write_cube(v.cube, path)
    df = readers.read_stage(v.spark, path)
    return df.groupBy("campagne_calc").agg(F.count("*").alias("n"), r6(F.sum("chirps_sum_mean")).alias("rain"))


def write_shards(v: Views, df, source: str, folder: str) -> None:
    """CSV shards of a source, one folder per tile, named like the export files."""
    name = f"v04_{source}_all_t"
    shards = df.withColumn(name, F.lpad(F.col("tile").cast("string"), 3, "0")).drop("tile")
    shards.write.mode("append").option("header", True).partitionBy(name).csv(folder)


@query("A5_read_shards", """
SELECT r.cell_id, r.decade_ord AS decade_id, r.chirps_sum_mean, CAST((c.cell_col + c.cell_row) % 3 AS INTEGER) AS tile
FROM rain_v r JOIN cells_v c USING (cell_id)""")
def _(v: Views):
    folder = scratch_dir(v.spark, "shards")
    tiled = v.rain.join(v.cells, "cell_id").select("cell_id", F.col("decade_ord").alias("decade_id"), F.col("chirps_sum_mean").alias("chirps_sum"),
                                                    F.pmod(F.col("cell_col") + F.col("cell_row"), F.lit(3)).alias("tile"))
    write_shards(v, tiled, "CHIRPS", folder)
    return readers.read_shards(v.spark, folder, "CHIRPS", "cell_id STRING, decade_id INT, chirps_sum DOUBLE", ["cell_id", "decade_id", "chirps_sum_mean"])


CLIMATOLOGY_SQL = """SELECT cell_id, CAST((decade_ord % 36) // 3 + 1 AS INTEGER) AS month, CAST(decade_ord % 3 + 1 AS INTEGER) AS decade_part,
  round(avg(chirps_sum_mean), 6) AS chirps_baseline_mean FROM rain_v WHERE decade_ord // 36 BETWEEN 1995 AND 1999 GROUP BY 1, 2, 3"""


def baseline(v: Views):
    return composites.climatology(v.rain, years=(1995, 1999))


@query("A6_read_climatology", CLIMATOLOGY_SQL)
def _(v: Views):
    folder = scratch_dir(v.spark, "shards")
    b = baseline(v).select("cell_id", cal.climatology_key("month", "decade_part").alias("doy_id"), F.col("chirps_baseline_mean").alias("chirps_baseline"), F.lit(0).alias("tile"))
    write_shards(v, b, "BASELINE", folder)
    return readers.read_climatology(v.spark, folder).withColumn("chirps_baseline_mean", r6("chirps_baseline_mean"))


@query("A7_climatology_cache", CLIMATOLOGY_SQL)
def _(v: Views):
    path = scratch_dir(v.spark, "baseline")
    readers.cached_table(v.spark, path, lambda: baseline(v))
    again = readers.cached_table(v.spark, path, lambda: (_ for _ in ()).throw(RuntimeError("computed twice")))
    return again.withColumn("chirps_baseline_mean", r6("chirps_baseline_mean"))


@query("A7_climatology_by_year", CLIMATOLOGY_SQL)
def _(v: Views):
    """Years arrive one by one, one of them twice; each is merged into the stored sums and counts."""
    path = scratch_dir(v.spark, "climatology")
    year = cal.decade_fields("decade_ord")["year"]
    for part in (year < 1997, year == 1997, year <= 1997, year > 1997):
        out = sinks.update_climatology(v.spark, v.rain.filter(part), path, years=(1995, 1999))
    return out.withColumn("chirps_baseline_mean", r6("chirps_baseline_mean"))


@query("A8_cell_ids", "SELECT DISTINCT cell_id FROM labels_v")
def _(v: Views):
    path = scratch_dir(v.spark, "ids")
    sinks.write_stage(v.labels, path)
    return readers.read_cell_ids(v.spark, path)


REPORT_SQL = """
SELECT campagne_calc, round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (sum(y_true * y_true) + sum(y_pred * y_pred) - 2e0 * sum(y_true) * sum(y_pred) / count(*)), 4) AS qwk,
  round(count(*) FILTER (WHERE y_true >= 2 AND y_pred >= 2) / CAST(count(*) FILTER (WHERE y_true >= 2) AS DOUBLE), 4) AS recall_23, count(*) AS n
FROM preds_v GROUP BY 1"""


@query("A9_report_csv", REPORT_SQL)
def _(v: Views):
    path = scratch_dir(v.spark, "report")
    sinks.write_csv(metrics.ordinal_report(v.preds), path)
    return v.spark.read.schema("campagne_calc STRING, qwk DOUBLE, recall_23 DOUBLE, n BIGINT").option("header", True).csv(path)


@query("A13_model_store", """
WITH s AS (SELECT regr_slope(y_true, score) AS b, avg(score) AS mx, avg(y_true) AS my, stddev_pop(y_true) AS sy FROM preds_v)
SELECT id, round(my + b / (1 + 0.01e0 / sy) * (score - mx), 6) AS fit FROM preds_v CROSS JOIN s""")
def _(v: Views):
    path = scratch_dir(v.spark, "model")
    rows = models.assemble(v.preds.withColumn("f0", F.col("score") * 1.0), ["f0"], "y_true")
    sinks.save_model(LinearRegression(featuresCol="features", labelCol="y", predictionCol="fit", regParam=0.01).fit(rows), path)
    again = LinearRegressionModel.load(path)
    return again.transform(rows).select("id", r6("fit").alias("fit"))


@query("A14_chosen_model", """
SELECT coalesce((SELECT modele FROM summary_v WHERE qwk >= (SELECT max(qwk) FROM summary_v WHERE modele = 'model_2')
  ORDER BY recall_23 DESC, variance_inter_folds, pire_campagne DESC, complexite, modele LIMIT 1), 'model_2') AS modele, 'regression_ordinale' AS repli""")
def _(v: Views):
    path = scratch_dir(v.spark, "choice")
    s = selection.model_summary(detail(v), MODELS)
    ranking = selection.rank_robust(s, selection.baseline_value(s, "model_2"))
    sinks.write_choice(ranking, path)
    record = v.spark.read.schema("classement ARRAY<STRING>, modele_retenu STRING").json(path)
    return record.select(sinks.chosen_model(record, "model_2").alias("modele"), F.lit(sinks.chosen_model(None)).alias("repli")).limit(1)


def detail(v: Views):
    return metrics.ordinal_report(v.model_preds, ("modele", "campagne_calc")).drop("n")


# --- B. projections, filters, audits -----------------------------------------------------------------------

@query("B1_drop_columns", 'SELECT id, Sol, "Sol larve" AS sol_larve, Decade FROM survey_raw_v')
def _(v: Views):
    out = clean.drop_matching(v.survey_raw)
    assert "Sol_NSE" not in out.columns
    return out.select("id", "Sol", F.col("Sol larve").alias("sol_larve"), "Decade")


@query("B2_rename_existing", 'SELECT id, Campagne AS campagne_xls, "Sol larve" AS Sol_larve, "Trans larve" AS Trans_larve, "Greg larve" AS Greg_larve FROM survey_raw_v')
def _(v: Views):
    out = clean.rename_existing(v.survey_raw, {**clean.SURVEY_RENAMES, "absent": "never"})
    return out.select("id", "campagne_xls", "Sol_larve", "Trans_larve", "Greg_larve")


@query("B3_position_filter", "SELECT id, round(LAT_DD, 6) AS lat FROM survey_raw_v WHERE LAT_DD BETWEEN -26 AND -11 AND LNG_DD BETWEEN 43 AND 51")
def _(v: Views):
    return clean.valid_positions(v.survey_raw).select("id", r6("LAT_DD").alias("lat"))


@query("B3_position_audit", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE LAT_DD IS NULL OR LNG_DD IS NULL) AS n_missing,
  count(*) FILTER (WHERE LAT_DD IS NOT NULL AND LNG_DD IS NOT NULL AND NOT (LAT_DD BETWEEN -26 AND -11 AND LNG_DD BETWEEN 43 AND 51)) AS n_out_of_bounds,
  count(*) FILTER (WHERE LAT_DD BETWEEN -26 AND -11 AND LNG_DD BETWEEN 43 AND 51) AS n_valid FROM survey_raw_v""")
def _(v: Views):
    return clean.position_audit(v.survey_raw)


@query("B4_meta_columns_first", """SELECT cell_id, AIRE_CODE, campagne_calc, campagne_decade, date_start, date_end, year, month, decade_part, chirps_sum_mean FROM cube_v""")
def _(v: Views):
    out = clean.cube_columns(cal.with_decade_fields(cube.left_join_sources(v.spine, [v.rain])))
    assert out.columns[:2] == ["cell_id", "AIRE_CODE"] and out.columns[-1] == "chirps_sum_mean"
    return out


@query("B5_keep_columns", "SELECT cell_id, decade_ord AS decade_id, chirps_sum_mean FROM rain_v")
def _(v: Views):
    raw = v.rain.withColumnsRenamed({"chirps_sum_mean": "chirps_sum", "decade_ord": "decade_id"}).withColumn("noise", F.lit(1))
    keep = ["cell_id", "decade_id", "chirps_sum_mean"]
    empty = clean.keep_columns(None, {}, keep, "cell_id STRING, decade_id INT, chirps_sum_mean DOUBLE", v.spark)
    return clean.keep_columns(raw, {"chirps_sum": "chirps_sum_mean"}, keep).unionByName(empty)


def _columns(view: str) -> str:
    """The column names of a view, as rows."""
    return f"(SELECT name FROM (UNPIVOT (SELECT COUNT(COLUMNS(*)) AS '\\0' FROM {view}) ON COLUMNS(*) INTO NAME name VALUE n) c0)"


@query("B6_predictors", f"""
SELECT name AS feature, (SELECT count(*) FROM training_v) AS n_rows FROM {_columns("training_v")} c
WHERE name NOT IN ('cell_id', 'decade_ord', 'year', 'date_start', 'date_end', 'campagne_calc', 'severite', 'intensite', 'effort_prospection', 'binaire', 'a_predire')""")
def _(v: Views):
    t = clean.cube_columns(v.training)
    names = training.predictors(t)
    return t.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n_rows")


@query("B7_region_predictors", f"""
SELECT name AS feature, CASE WHEN name IN ('niveau_gregarite_dominant', 'densite_imago_median') THEN 'presence' ELSE 'both' END AS models, (SELECT count(*) FROM regions_v) AS n_rows
FROM {_columns("regions_v")} c WHERE name NOT IN ('rn_num', 'rn_nom', 'campagne_calc', 'campagne_decade', 'split', 'effort_prospection', 'label', 'date_start', 'k')""")
def _(v: Views):
    one, two = training.region_predictors(v.regions), training.region_predictors(v.regions, with_targets=True)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit("both" if n in two else "presence").alias("models")) for n in one])
    return v.regions.agg(F.count("*").alias("n_rows")).select(F.inline(rows), "n_rows").select("feature", "models", "n_rows")


@query("B8_observed_and_surface", """
SELECT a_predire, count(*) AS n, count(severite) AS n_observed FROM training_v GROUP BY 1""")
def _(v: Views):
    t = v.training
    agg = lambda df: df.groupBy("a_predire").agg(F.count("*").alias("n"), F.count("severite").alias("n_observed"))
    return agg(clean.observed(t)).unionByName(agg(clean.to_predict(t)))


@query("B8_labeled_splits", "SELECT split, count(*) AS n FROM regions_v WHERE split IN ('train', 'validation') GROUP BY 1")
def _(v: Views):
    return clean.labeled_splits(v.regions).groupBy("split").agg(F.count("*").alias("n"))


@query("B9_decade_mismatch", """
SELECT count(*) AS n_checked, count(*) FILTER (WHERE (Decade - 1) % 3 + 1 <> decade_intra) AS n_mismatch FROM surveys_v WHERE Decade IS NOT NULL AND decade_intra IS NOT NULL""")
def _(v: Views):
    return clean.decade_mismatch(v.surveys)


QA = "CAST(event_id % 7 AS INT)"


@query("B10_quality_masks", f"""
SELECT event_id, CASE WHEN ({QA} & 3) <= 1 THEN value END AS veg, CASE WHEN ({QA} & 3) = 0 THEN value END AS temp FROM events""")
def _(v: Views):
    e = v.table("events").withColumn("qa", F.pmod(F.col("event_id"), F.lit(7)).cast("int"))
    return e.select("event_id", quality.masked("value", quality.vegetation_ok("qa")).alias("veg"), quality.masked("value", quality.temperature_ok("qa")).alias("temp"))


@query("B11_scale_factors", "SELECT event_id, round(value * 0.0001e0, 6) AS ndvi, round(value * 0.02e0, 6) AS lst FROM events")
def _(v: Views):
    ok = F.lit(True)
    return v.table("events").select("event_id", r6(quality.masked("value", ok, 0.0001)).alias("ndvi"), r6(quality.masked("value", ok, 0.02)).alias("lst"))


@query("B12_phase_rows", "SELECT rn_num, campagne_calc, campagne_decade, niveau_gregarite_dominant FROM regions_v WHERE label = 1 AND niveau_gregarite_dominant IN ('S', 'St', 'T', 'G')")
def _(v: Views):
    return clean.phase_rows(v.regions).select("rn_num", "campagne_calc", "campagne_decade", "niveau_gregarite_dominant")


@query("B13_range_violations", """
WITH b AS (SELECT *, chirps_sum_mean - 20 AS rain FROM cube_v)
SELECT 'null_cell_id' AS rule, count(*) FILTER (WHERE cell_id IS NULL) AS n_violations FROM b UNION ALL
SELECT 'null_campagne_calc', count(*) FILTER (WHERE campagne_calc IS NULL) FROM b UNION ALL
SELECT 'range_ndvi_mean', count(*) FILTER (WHERE ndvi_mean < -1 OR ndvi_mean > 1) FROM b UNION ALL
SELECT 'range_lst_mean', count(*) FILTER (WHERE lst_mean < 200 OR lst_mean > 400) FROM b UNION ALL
SELECT 'range_chirps_sum_mean', count(*) FILTER (WHERE rain < 0) FROM b""")
def _(v: Views):
    return clean.range_violations(v.cube.withColumn("chirps_sum_mean", F.col("chirps_sum_mean") - 20), ("cell_id", "campagne_calc"))


@query("B14_completeness", """
SELECT year, campagne_decade, count(DISTINCT cell_id) AS n_cells, (SELECT count(*) FROM cells_v) AS n_expected FROM cube_v
WHERE chirps_sum_mean IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT cell_id) <> (SELECT count(*) FROM cells_v)""")
def _(v: Views):
    return clean.completeness_violations(v.cube.filter("chirps_sum_mean is not null"), v.cells)


@query("B15_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(v: Views):
    return clean.duplicate_keys(v.table("lineitem"), ("l_orderkey", "l_linenumber"))


@query("B16_null_rates", """
SELECT unnest(['pop_consecutive', 'ndvi_mean_lag1d', 'chirps_cumul_3d', 'severite_lag1']) AS feature,
  unnest([round(avg(CASE WHEN pop_consecutive IS NULL THEN 1 ELSE 0 END), 3), round(avg(CASE WHEN ndvi_mean_lag1d IS NULL THEN 1 ELSE 0 END), 3),
    round(avg(CASE WHEN chirps_cumul_3d IS NULL THEN 1 ELSE 0 END), 3), round(avg(CASE WHEN severite_lag1 IS NULL THEN 1 ELSE 0 END), 3)]) AS null_rate FROM features_v""")
def _(v: Views):
    return clean.null_rates(v.training, ["pop_consecutive", "ndvi_mean_lag1d", "chirps_cumul_3d", "severite_lag1"])


@query("B17_value_counts", "SELECT niveau_gregarite AS value, count(*) AS n FROM surveys_v GROUP BY 1")
def _(v: Views):
    return clean.value_counts(v.surveys, "niveau_gregarite")


# --- C. calendar ----------------------------------------------------------------------------------------------

@query("C1_excel_serial", "SELECT id, CAST(DATE '1899-12-30' + CAST(Date_ AS INTEGER) AS TIMESTAMP) AS date FROM survey_raw_v")
def _(v: Views):
    return v.survey_raw.select("id", cal.survey_date(v.survey_raw, "Date_").alias("date"))


@query("C2_campaign_label", f"SELECT o_orderkey, {camp('o_orderdate')} AS campagne FROM orders")
def _(v: Views):
    return v.table("orders").select("o_orderkey", cal.campaign_label("o_orderdate").alias("campagne"))


@query("C3_decades", f"SELECT o_orderkey, {part('o_orderdate')} AS decade_intra, {season_decade('o_orderdate')} AS campagne_decade FROM orders")
def _(v: Views):
    return v.table("orders").select("o_orderkey", cal.decade_intra("o_orderdate").alias("decade_intra"), cal.campaign_decade("o_orderdate").alias("campagne_decade"))


@query("C4_decade_bounds", f"""
SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), ({part('o_orderdate')} - 1) * 10 + 1) AS date_start,
  CASE WHEN day(o_orderdate) > 20 THEN last_day(CAST(o_orderdate AS DATE)) ELSE make_date(year(o_orderdate), month(o_orderdate), {part('o_orderdate')} * 10) END AS date_end FROM orders""")
def _(v: Views):
    d = F.col("o_orderdate")
    p = (F.year(d), F.month(d), cal.decade_intra(d))
    return v.table("orders").select("o_orderkey", cal.decade_start_of(*p).alias("date_start"), cal.decade_end_of(*p).alias("date_end"))


def calendar_of(v: Views, season: bool):
    """Calendar of the civil years met in the orders, with the orders of each decade."""
    o = v.table("orders").select(cal.decade_ordinal("o_orderdate").alias("decade_ord"))
    n = o.groupBy("decade_ord").agg(F.count("*").alias("n_orders"))
    lo, hi = n.agg(F.min("decade_ord"), F.max("decade_ord")).first()
    if season:
        df = cal.season_calendar(v.spark, range(lo // 36, hi // 36 + 1))
    else:
        df = cal.range_calendar(v.spark, lo // 36, lo % 36 + 1, hi // 36, hi % 36 + 1)
    return df.join(n, "decade_ord", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)).cast("bigint"))


CALENDAR_SQL = """SELECT d.decade_ord, d.year, d.month, d.decade_part, d.date_start, d.date_end, d.date_start + CAST((d.date_end - d.date_start) // 2 AS INTEGER) AS midpoint,
  d.campagne_calc AS campaign, CAST(d.decade_ord % 36 + 1 AS INTEGER) AS cal_decade, d.campagne_decade AS decade_num, CAST(d.year * 100 + d.decade_ord % 36 + 1 AS INTEGER) AS decade_id{extra},
  coalesce(n_orders, 0) AS n_orders FROM {base} d LEFT JOIN (SELECT {orders} AS decade_ord, count(*) AS n_orders FROM orders GROUP BY 1) n ON n.decade_ord = d.decade_ord"""


@query("C5_season_calendar", CALENDAR_SQL.format(orders=ordinal("o_orderdate"), base="decades_all_v", extra=", CAST(d.year * 100 + d.campagne_decade AS INTEGER) AS legacy_decade_id")
       + " WHERE d.campagne_decade IS NOT NULL AND d.year BETWEEN (SELECT min(year(o_orderdate)) FROM orders) AND (SELECT max(year(o_orderdate)) FROM orders)")
def _(v: Views):
    return calendar_of(v, season=True)


@query("C6_range_calendar", CALENDAR_SQL.format(orders=ordinal("o_orderdate"), base="decades_all_v", extra="")
       + f" WHERE d.decade_ord BETWEEN (SELECT min({ordinal('o_orderdate')}) FROM orders) AND (SELECT max({ordinal('o_orderdate')}) FROM orders)")
def _(v: Views):
    return calendar_of(v, season=False)


@query("C7_month_slice", "SELECT cell_id, decade_ord, chirps_sum_mean FROM rain_v WHERE decade_ord BETWEEN 1998 * 36 - 2 AND 1998 * 36 + 2")
def _(v: Views):
    return cal.slice_month(v.rain, "1998-01", 2)


@query("C8_range_slice", "SELECT cell_id, decade_ord, chirps_sum_mean FROM rain_v WHERE decade_ord BETWEEN 1997 * 36 + 29 AND 1998 * 36 + 3")
def _(v: Views):
    return cal.slice_range(v.rain, "1997-30:1998-04")


@query("C9_windows", "SELECT cell_id, decade_ord, date_start - 8 AS window_start, date_end + 9 AS window_end FROM rain_v JOIN decades_all_v USING (decade_ord)")
def _(v: Views):
    f = cal.decade_fields("decade_ord")
    df = v.rain.select("cell_id", "decade_ord", f["date_start"].alias("date_start"), f["date_end"].alias("date_end"))
    return cal.with_window(df, *VEGETATION_WINDOW).drop("date_start", "date_end")


@query("C10_campaign_date", """
SELECT l.cell_id, l.campagne_calc, l.campagne_decade, d.date_start AS first_day FROM labels_v l JOIN decades_all_v d USING (campagne_calc, campagne_decade)""")
def _(v: Views):
    return v.labels.select("cell_id", "campagne_calc", "campagne_decade", cal.campaign_date("campagne_calc", "campagne_decade").alias("first_day"))


@query("C11_panel_date", """
SELECT cell_id, campagne_calc, campagne_decade,
  DATE '2001-10-01' + CAST(10 * ((CAST(substr(campagne_calc, 1, 4) AS INTEGER) - 2001) * 30 + campagne_decade - 1) AS INTEGER) AS ds FROM labels_v""")
def _(v: Views):
    return v.labels.select("cell_id", "campagne_calc", "campagne_decade", cal.panel_date("campagne_calc", "campagne_decade").alias("ds"))


@query("C12_campaign_month", "SELECT cell_id, campagne_calc, campagne_decade, CAST((campagne_decade - 1) // 3 + 1 AS INTEGER) AS mois_campagne FROM labels_v")
def _(v: Views):
    return v.labels.select("cell_id", "campagne_calc", "campagne_decade", cal.campaign_month("campagne_decade").alias("mois_campagne"))


@query("C13_campaign_start", "SELECT campagne_calc, CAST(split_part(campagne_calc, '-', 1) AS INTEGER) AS start_year, count(*) AS n FROM labels_v GROUP BY 1, 2")
def _(v: Views):
    return v.labels.groupBy("campagne_calc", cal.campaign_start_year("campagne_calc").alias("start_year")).agg(F.count("*").alias("n"))


@query("C14_climatology_key", f"""
SELECT CAST(month(l_shipdate) * 10 + {part('l_shipdate')} AS INTEGER) AS doy_id, CAST(month(l_shipdate) AS INTEGER) AS month, CAST({part('l_shipdate')} AS INTEGER) AS decade_part, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def _(v: Views):
    key = cal.climatology_key(F.month("l_shipdate"), cal.decade_intra("l_shipdate"))
    n = v.table("lineitem").groupBy(key.alias("doy_id")).agg(F.count("*").alias("n"))
    return cal.with_climatology_parts(n.withColumn("k", F.col("doy_id")), "k")


@query("C15_year_batches", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST((dense_rank() OVER (ORDER BY year(o_orderdate)) - 1) // 3 AS INTEGER) AS year_batch, count(*) AS n FROM orders GROUP BY year(o_orderdate)""")
def _(v: Views):
    y = v.table("orders").select(F.year("o_orderdate").alias("year"))
    return cal.with_year_batch(y, "year", 3).groupBy("year", "year_batch").agg(F.count("*").alias("n"))


# --- J. scoring functions -------------------------------------------------------------------------------------

@query("J1_phase_level", "SELECT id, niveau_gregarite FROM surveys_v")
def _(v: Views):
    return v.surveys.select("id", scoring.phase_level("Sol", "Trans", "Greg").alias("niveau_gregarite"))


@query("J2_equivalent_density", "SELECT id, round(densite_imago, 6) AS densite_imago FROM surveys_v")
def _(v: Views):
    return v.surveys.select("id", r6(scoring.equivalent_density("DI_dif_moy", "DL_dif_moy")).alias("densite_imago"))


CLASS_SQL = """CASE WHEN densite_imago IS NULL THEN NULL WHEN densite_imago <= 0 THEN 0 WHEN densite_imago <= 10 THEN 1 WHEN densite_imago <= 100 THEN 2
  WHEN densite_imago <= 500 THEN 3 WHEN densite_imago <= 1500 THEN 4 WHEN densite_imago <= 2500 THEN 5 WHEN densite_imago <= 10000 THEN 6 ELSE 7 END"""


@query("J3_density_class", f"SELECT id, {CLASS_SQL} AS classe FROM surveys_v")
def _(v: Views):
    return v.surveys.select("id", scoring.density_class("densite_imago").alias("classe"))


# Potential by level and density class 0 to 7.
POTENTIAL_SQL = f"""CASE WHEN niveau_gregarite = 'absent' THEN 0 ELSE (SELECT m.potential[{CLASS_SQL} + 1] FROM (VALUES
  ('S', [0, 1, 1, 2, 2, 3, 3, 3]),
  ('St', [0, 1, 2, 2, 3, 3, 3, 3]),
  ('T', [0, 2, 2, 2, 3, 3, 3, 4]),
  ('G', [0, 2, 2, 3, 3, 3, 4, 5])) m(level, potential) WHERE m.level = niveau_gregarite) END"""


@query("J4_potential", f"SELECT id, {POTENTIAL_SQL} AS potentiel_acridien FROM surveys_v")
def _(v: Views):
    return v.surveys.select("id", scoring.potential("niveau_gregarite", "densite_imago").alias("potentiel_acridien"))


@query("J5_score_records", f"SELECT id, niveau_gregarite, round(densite_imago, 6) AS densite_imago, {POTENTIAL_SQL} AS potentiel_acridien FROM surveys_v")
def _(v: Views):
    out = scoring.score_records(clean.rename_existing(v.survey_raw))
    return out.select("id", "niveau_gregarite", r6("densite_imago").alias("densite_imago"), "potentiel_acridien")


@query("J6_presence", "SELECT cell_id, campagne_calc, campagne_decade, CASE WHEN severite IS NULL THEN NULL WHEN severite >= 1 THEN 1 ELSE 0 END AS binaire FROM labels_v")
def _(v: Views):
    return v.labels.select("cell_id", "campagne_calc", "campagne_decade", scoring.presence("severite").alias("binaire"))


@query("J7_to_ordinal", "SELECT id, CAST(greatest(0, least(3, round_even(score * 4.5e0 - 0.5e0, 0))) AS INTEGER) AS niveau FROM preds_v")
def _(v: Views):
    return v.preds.select("id", scoring.to_ordinal(F.col("score") * 4.5 - 0.5).alias("niveau"))


PROBS = ("p0", "p1", "p2", "p3")
PROBS_SQL = f"""(SELECT id, campagne_calc, y_true, r0 / s AS p0, r1 / s AS p1, r2 / s AS p2, r3 / s AS p3 FROM (
  SELECT *, r0 + r1 + r2 + r3 AS s FROM (SELECT id, campagne_calc, y_true, {', '.join(f'0.05e0 + ({u("id", 40 + i)}) + CASE WHEN y_true = {i} THEN 0.6e0 ELSE 0e0 END AS r{i}' for i in range(4))} FROM preds_v) a) b)"""


def probabilities(v: Views):
    """Four class probabilities per row, tilted to the true class."""
    raw = [F.lit(0.05) + scoring.draw("id", 40 + i) + F.when(F.col("y_true") == i, 0.6).otherwise(0.0) for i in range(4)]
    df = v.preds.select("id", "campagne_calc", "y_true", *[r.alias(f"r{i}") for i, r in enumerate(raw)])
    s = F.col("r0") + F.col("r1") + F.col("r2") + F.col("r3")
    return df.select("id", "campagne_calc", "y_true", F.array(*[F.col(f"r{i}") / s for i in range(4)]).alias("p"))


@query("J8_presence_probability", f"SELECT id, round(p1 + p2 + p3, 6) AS presence, round(p2, 6) AS seen_2 FROM {PROBS_SQL} q")
def _(v: Views):
    p = probabilities(v)
    return p.select("id", r6(scoring.presence_from_probabilities("p", [0, 1, 2, 3])).alias("presence"),
                    r6(scoring.presence_from_probabilities(F.slice("p", 3, 1), [2])).alias("seen_2"))


@query("J9_presence_score", "SELECT id, round(1 / (1 + exp(-(score * 3 - 0.5e0))), 6) AS presence FROM preds_v")
def _(v: Views):
    return v.preds.select("id", r6(scoring.presence_from_score(F.col("score") * 3)).alias("presence"))


PHASE_AT = "CASE WHEN p3 >= {t} THEN 3 WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"


@query("J10_thresholded_phase", f"SELECT id, {PHASE_AT.format(t='0.28e0')} AS phase FROM {PROBS_SQL} q")
def _(v: Views):
    return probabilities(v).select("id", scoring.thresholded_phase("p", F.lit(0.28)).alias("phase"))


@query("J11_category_code", "SELECT id, CASE niveau_gregarite WHEN 'absent' THEN 0 WHEN 'S' THEN 1 WHEN 'St' THEN 2 WHEN 'T' THEN 3 WHEN 'G' THEN 4 END AS code FROM surveys_v")
def _(v: Views):
    return v.surveys.select("id", scoring.category_code("niveau_gregarite", PHASE_LEVELS).alias("code"))


@query("J12_median_fill", """
SELECT cell_id, decade_ord, round(coalesce(ndvi_mean, (SELECT median(ndvi_mean) FROM cube_v)), 6) AS ndvi_mean, round(coalesce(lst_mean, (SELECT median(lst_mean) FROM cube_v)), 6) AS lst_mean FROM cube_v""")
def _(v: Views):
    cols = ["ndvi_mean", "lst_mean"]
    out = order.with_median_fill(v.cube, cols, order.column_medians(v.cube, cols))
    return out.select("cell_id", "decade_ord", *[r6(c).alias(c) for c in cols])
