"""Queries for aggregations, windows, ordering and set operations (F, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import VEGETATION_WINDOW
from ..functions import calendar as cal
from ..operators import clean, composites, cube, features, labels, metrics, order, outputs, panel, selection, training
from ..operators import text as kit
from ..session import scratch_dir
from ..sources import readers, sinks
from ..streaming import upsert
from .bindings import MODELS, Views, u
from .catalog_data import CLIMATOLOGY_SQL, baseline, detail, r6
from .catalog_space import ANOMALY_SQL, MAP_SQL, maps
from .registry import query

KEYS = ["cell_id", "campagne_calc", "campagne_decade"]


@query("F1_severity", "SELECT cell_id, campagne_calc, campagne_decade, severite FROM labels_v")
def _(v: Views):
    return clean.drop_keyless(v.surveys).groupBy(*KEYS).agg(labels.severity().alias("severite"))


@query("F2_intensity", "SELECT cell_id, campagne_calc, campagne_decade, round(intensite, 6) AS intensite FROM labels_v")
def _(v: Views):
    return clean.drop_keyless(v.surveys).groupBy(*KEYS).agg(r6(labels.intensity()).alias("intensite"))


@query("F3_effort", "SELECT cell_id, campagne_calc, campagne_decade, effort_prospection FROM labels_v")
def _(v: Views):
    return v.labels.select(*KEYS, "effort_prospection")


@query("F4_labels", "SELECT cell_id, campagne_calc, campagne_decade, severite, round(intensite, 6) AS intensite, effort_prospection, binaire FROM labels_v")
def _(v: Views):
    return v.labels.withColumn("intensite", r6("intensite"))


@query("F5_monthly_rain", "SELECT cell_id, campagne_calc, year, month, monthly AS chirps_monthly_sum FROM month_v")
def _(v: Views):
    return features.monthly_rain(v.cube)


@query("F6_decade_rain", "SELECT * FROM rain_v")
def _(v: Views):
    return composites.sum_composite(v.rain_raw, "rain")


@query("F6_wide_window_rain", """
SELECT r.cell_id, d.decade_ord, sum(r.rain) AS rain_wide FROM rain_raw_v r JOIN decades_all_v d ON r.day >= d.date_start - 8 AND r.day < d.date_end + 9 GROUP BY 1, 2""")
def _(v: Views):
    return composites.sum_composite(v.rain_raw, "rain", window=VEGETATION_WINDOW, name="rain_wide")


@query("F7_climatology", CLIMATOLOGY_SQL)
def _(v: Views):
    return baseline(v).withColumn("chirps_baseline_mean", r6("chirps_baseline_mean"))


@query("F8_anomaly", ANOMALY_SQL)
def _(v: Views):
    out = composites.with_anomaly(cal.with_decade_fields(cube.left_join_sources(v.spine, [v.rain])), baseline(v))
    return out.select("cell_id", "decade_ord", "chirps_sum_mean", r6("chirps_anomaly_mean").alias("chirps_anomaly_mean"))


@query("F9_median_density", """
SELECT rn_num, campagne_calc, campagne_decade, round(median(densite_imago), 6) AS densite_imago_median FROM region_rows_v WHERE densite_imago IS NOT NULL GROUP BY 1, 2, 3""")
def _(v: Views):
    return training.median_density(v.region_rows).withColumn("densite_imago_median", r6("densite_imago_median"))


MONTHLY_SQL = f"(SELECT cell_id, AIRE_CODE, campagne_calc, CAST((campagne_decade - 1) // 3 + 1 AS INTEGER) AS mois_campagne, max(severite) AS severite FROM {MAP_SQL} m GROUP BY 1, 2, 3, 4)"


@query("F10_monthly_map", f"SELECT * FROM {MONTHLY_SQL} q")
def _(v: Views):
    return outputs.monthly_map(maps(v))


@query("F11_area_month", f"""
SELECT AIRE_CODE, campagne_calc, mois_campagne, max(severite) AS severite_max, count(*) AS n_cellules, count(*) FILTER (WHERE severite >= 2) AS n_cellules_foyer FROM {MONTHLY_SQL} q GROUP BY 1, 2, 3""")
def _(v: Views):
    return outputs.area_month(outputs.monthly_map(maps(v)))


@query("F12_cell_map", f"SELECT cell_id, AIRE_CODE, max(severite) AS severite, round(max(proba_presence), 6) AS proba_presence FROM {MAP_SQL} m GROUP BY 1, 2")
def _(v: Views):
    return outputs.cell_map(maps(v)).withColumn("proba_presence", r6("proba_presence"))


COVERAGE_SQL = "(SELECT campagne_calc, avg(CASE WHEN ndvi_mean IS NOT NULL THEN 1e0 ELSE 0e0 END) AS couverture FROM training_v WHERE a_predire GROUP BY 1)"


@query("F13_coverage", f"SELECT campagne_calc, round(couverture, 6) AS couverture FROM {COVERAGE_SQL} q")
def _(v: Views):
    return outputs.coverage(clean.to_predict(v.training)).withColumn("couverture", r6("couverture"))


@query("F14_target_campaign", f"""
SELECT coalesce(max(CASE WHEN couverture >= 0.4 THEN campagne_calc END), max(campagne_calc)) AS auto, max(campagne_calc) AS repli, '1997-1998' AS forcee FROM {COVERAGE_SQL} q""")
def _(v: Views):
    t = clean.to_predict(v.training)
    one = lambda **kw: outputs.target_campaign(t, **kw).scalar()
    return outputs.target_campaign(t, minimum=0.4).select(
        F.col("campagne_cible").alias("auto"), one(minimum=2.0).alias("repli"), one(forced="1997-1998").alias("forcee"))


@query("F15_varied_decades", "SELECT campagne_decade, count(DISTINCT severite) AS n_niveaux FROM labels_v GROUP BY 1 HAVING count(DISTINCT severite) >= 4")
def _(v: Views):
    return outputs.varied_decades(v.labels, 4)


@query("F15_decade_map", "SELECT cell_id, campagne_calc, campagne_decade, severite FROM labels_v WHERE campagne_decade = (SELECT max(campagne_decade) FROM labels_v)")
def _(v: Views):
    return outputs.decade_map(v.labels, 77).select(*KEYS, "severite")


@query("F16_column_medians", """
SELECT unnest(['ndvi_mean', 'lst_mean', 'chirps_sum_mean']) AS feature, unnest([round(median(ndvi_mean), 6), round(median(lst_mean), 6), round(median(chirps_sum_mean), 6)]) AS median FROM cube_v""")
def _(v: Views):
    return order.column_medians(v.cube, ["ndvi_mean", "lst_mean", "chirps_sum_mean"]).withColumn("median", r6("median"))


@query("F17_class_weights", """
SELECT severite, count(*) AS n, round((SELECT count(severite) FROM labels_v) / (CAST((SELECT count(DISTINCT severite) FROM labels_v) AS DOUBLE) * count(*)), 6) AS weight FROM labels_v WHERE severite IS NOT NULL GROUP BY 1""")
def _(v: Views):
    return training.class_weights(v.labels).withColumn("weight", r6("weight"))


@query("F18_positive_weight", "SELECT CASE WHEN count(*) FILTER (WHERE label = 1) = 0 THEN 1e0 ELSE round(count(*) FILTER (WHERE label = 0) / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 6) END AS scale_pos_weight, 1e0 AS sans_positif FROM regions_v")
def _(v: Views):
    none = training.positive_weight(v.regions.withColumn("label", F.lit(0))).scalar()
    return training.positive_weight(v.regions).select(r6("scale_pos_weight").alias("scale_pos_weight"), none.alias("sans_positif"))


BY_REGION = "(SELECT rn_nom, campagne_calc, avg(effort_prospection) AS effort_mean, avg(label) AS taux_presence, count(campagne_decade) AS n_decades FROM regions_v WHERE split = 'validation' GROUP BY 1, 2)"


def validation(v: Views):
    return v.regions.filter("split = 'validation'")


@query("F19_effort_by_region", f"SELECT rn_nom, campagne_calc, round(effort_mean, 6) AS effort_mean, round(taux_presence, 6) AS taux_presence, n_decades FROM {BY_REGION} q")
def _(v: Views):
    return outputs.effort_by_region(validation(v)).withColumns({"effort_mean": r6("effort_mean"), "taux_presence": r6("taux_presence")})


@query("F20_effort_quartiles", """
WITH e AS (SELECT DISTINCT unnest([quantile_cont(effort_prospection, 0.0), quantile_cont(effort_prospection, 0.25), quantile_cont(effort_prospection, 0.5), quantile_cont(effort_prospection, 0.75), quantile_cont(effort_prospection, 1.0)]) AS x FROM regions_v WHERE split = 'validation')
SELECT CAST(greatest(1, (SELECT count(*) FROM e WHERE x < effort_prospection)) AS INTEGER) AS quartile, round(avg(label), 6) AS taux_presence, count(label) AS n_obs FROM regions_v WHERE split = 'validation' GROUP BY 1""")
def _(v: Views):
    return outputs.effort_quartiles(validation(v)).withColumn("taux_presence", r6("taux_presence"))


@query("F21_effort_trend", f"SELECT round(regr_slope(taux_presence, effort_mean), 6) AS pente, round(regr_intercept(taux_presence, effort_mean), 6) AS origine, round(corr(taux_presence, effort_mean), 6) AS r FROM {BY_REGION} q")
def _(v: Views):
    t = outputs.effort_trend(outputs.effort_by_region(validation(v)))
    return t.select(*[r6(c).alias(c) for c in t.columns])


@query("F22_importance_summary", """
SELECT rn_nom AS feature, round(avg(effort_mean), 2) AS importance_mean, round(stddev_samp(effort_mean), 2) AS importance_std FROM (
  SELECT rn_nom, campagne_calc, avg(effort_prospection) AS effort_mean FROM regions_v GROUP BY 1, 2) q GROUP BY 1""")
def _(v: Views):
    imp = v.regions.groupBy(F.col("rn_nom").alias("feature"), "campagne_calc").agg(F.avg("effort_prospection").alias("importance"))
    return selection.importance_summary(imp)


@query("F23_robustness", """
SELECT round(avg(qwk), 4) AS qwk_moyen, round(var_pop(qwk), 4) AS qwk_variance_inter_folds, round(min(qwk), 4) AS qwk_pire_campagne,
 round(avg(recall_23), 4) AS recall_23_moyen, round(var_pop(recall_23), 4) AS recall_23_variance_inter_folds, round(min(recall_23), 4) AS recall_23_pire_campagne FROM detail_v WHERE modele = 'model_5'""")
def _(v: Views):
    return selection.robustness(detail(v).filter("modele = 'model_5'"), ("qwk", "recall_23"))


@query("F24_metric_pivot", "SELECT campagne_calc, " + ", ".join(f"avg(CASE WHEN modele = '{m}' THEN recall_23 END) AS {m}" for m in MODELS) + " FROM detail_v GROUP BY 1")
def _(v: Views):
    return selection.metric_pivot(detail(v), list(MODELS))


@query("F25_confusion", """
SELECT CAST(a.i AS INTEGER) AS y_true, CAST(b.j AS INTEGER) AS y_pred, count(p.id) AS n FROM (SELECT unnest(range(4)) AS i) a CROSS JOIN (SELECT unnest(range(4)) AS j) b
LEFT JOIN preds_v p ON p.y_true = a.i AND p.y_pred = b.j GROUP BY 1, 2""")
def _(v: Views):
    return metrics.confusion(v.preds)


@query("F26_global_row", """
SELECT coalesce(campagne_calc, 'GLOBAL') AS campagne_calc, count(*) AS n, count(*) FILTER (WHERE y_true >= 1) AS n_positifs, count(*) FILTER (WHERE y_true = y_pred) AS n_exact,
  round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (sum(y_true * y_true) + sum(y_pred * y_pred) - 2e0 * sum(y_true) * sum(y_pred) / count(*)), 4) AS qwk,
  round(count(*) FILTER (WHERE y_true >= 2 AND y_pred >= 2) / CAST(count(*) FILTER (WHERE y_true >= 2) AS DOUBLE), 4) AS recall_23
FROM preds_v GROUP BY GROUPING SETS ((campagne_calc), ())""")
def _(v: Views):
    return metrics.pooled_counts(v.preds)


# --- G. windows -----------------------------------------------------------------------------------------------

@query("G1_streak", """
SELECT cell_id, decade_ord, CAST(CASE WHEN ok THEN sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id, isl ORDER BY decade_ord) ELSE 0 END AS INTEGER) AS streak FROM (
  SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id ORDER BY decade_ord) AS isl FROM (
    SELECT cell_id, decade_ord, coalesce(ndvi_mean > 0.4, false) AS ok FROM cube_v) a) b""")
def _(v: Views):
    out = features.with_streak(v.cube.withColumn("ok", F.col("ndvi_mean") > 0.4), "ok", ["cell_id"], ["decade_ord"])
    return out.select("cell_id", "decade_ord", "streak")


@query("G2_rain_streak", "SELECT cell_id, decade_ord, pop_consecutive FROM features_v")
def _(v: Views):
    return features.with_rain_streak(v.cube).select("cell_id", "decade_ord", "pop_consecutive")


LAGS = [f"{c}_lag{k}d" for c in ("chirps_sum_mean", "ndvi_mean", "evi_mean", "lst_mean") for k in (1, 2)]


@query("G3_lags", "SELECT cell_id, decade_ord, " + ", ".join(f"round({c}, 6) AS {c}" for c in LAGS) + " FROM features_v")
def _(v: Views):
    return features.with_lags(v.cube).select("cell_id", "decade_ord", *[r6(c).alias(c) for c in LAGS])


@query("G4_rolling_rain", "SELECT cell_id, decade_ord, chirps_cumul_2d, chirps_cumul_3d FROM features_v")
def _(v: Views):
    return features.with_rolling_rain(v.cube).select("cell_id", "decade_ord", "chirps_cumul_2d", "chirps_cumul_3d")


@query("G5_severity_lags", "SELECT cell_id, decade_ord, severite_lag1, severite_lag2 FROM features_v")
def _(v: Views):
    return v.training.select("cell_id", "decade_ord", "severite_lag1", "severite_lag2")


@query("G5_adjacency", "SELECT cell_id, decade_ord, decade_ord - lag(decade_ord) OVER (PARTITION BY cell_id ORDER BY date_start) = 1 AS adjacent_1 FROM cube_v")
def _(v: Views):
    return features.with_adjacency(v.cube).select("cell_id", "decade_ord", "adjacent_1")


@query("G6_keep_latest", """
SELECT user_id, CAST(ts AS DATE) AS day, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC) = 1""")
def _(v: Views):
    e = v.table("events").select("user_id", F.col("ts").cast("date").alias("day"), "ts", "event_type", "value")
    return cube.keep_latest(e, ("user_id", "day"), "ts")


@query("G7_keep_first", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def _(v: Views):
    o = v.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return cube.keep_first(o, ["o_custkey"], "o_orderkey")


FIT_SQL = """(SELECT CAST(rn_num AS VARCHAR) AS ID, DATE '2001-10-01' + CAST(10 * ((CAST(substr(campagne_calc, 1, 4) AS INTEGER) - 2001) * 30 + campagne_decade - 1) AS INTEGER) AS ds,
  CAST(label AS DOUBLE) AS y, round(chirps_sum_mean / 100, 6) AS yhat1 FROM regions_v)"""


def fitted_panel(v: Views):
    return v.regions.select(F.col("rn_num").cast("string").alias("ID"), cal.panel_date("campagne_calc", "campagne_decade").alias("ds"),
                            F.col("label").cast("double").alias("y"), r6(F.col("chirps_sum_mean") / 100).alias("yhat1"))


@query("G8_forecast_shift", f"""
SELECT ID, ds, y, lag(yhat1, 1) OVER w AS pred_1, lag(yhat1 + 1, 3) OVER w AS pred_3, lag(yhat1, 1) OVER w AS pred_10 FROM {FIT_SQL} q WINDOW w AS (PARTITION BY ID ORDER BY ds)""")
def _(v: Views):
    p = fitted_panel(v).withColumn("yhat3", F.col("yhat1") + 1)
    return panel.shift_forecast(p).select("ID", "ds", "y", "pred_1", "pred_3", "pred_10")


GAIN_SQL = """
WITH s AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rn FROM preds_v), n AS (SELECT count(*) AS n, sum(label) AS pos FROM preds_v),
c AS (SELECT q, CASE WHEN q = 10 THEN n ELSE CAST(floor(q * (n / 10e0)) AS BIGINT) END AS cut, n, pos FROM n CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS q) k)
SELECT c.q AS quantile, round(cut / CAST(n AS DOUBLE), 4) AS pop_cumulee, round(sum(s.label) / CAST(pos AS DOUBLE), 4) AS gain_cumule,
  round((sum(s.label) / CAST(pos AS DOUBLE)) / (cut / CAST(n AS DOUBLE)), 4) AS lift FROM c JOIN s ON s.rn <= c.cut GROUP BY c.q, cut, n, pos"""


@query("G9_gain_lift", GAIN_SQL)
def _(v: Views):
    return metrics.gain_lift(v.preds, "label", "score", "id")


FOLDS_SQL = """
WITH c AS (SELECT DISTINCT campagne_calc AS campagne, CAST(substr(campagne_calc, 1, 4) AS INTEGER) AS y FROM preds_v WHERE campagne_calc <> '1997-1998'),
t AS (SELECT *, CAST(row_number() OVER (ORDER BY y) AS INTEGER) AS fold_id FROM c WHERE y > (SELECT min(y) FROM c))
SELECT fold_id, 'test' AS role, campagne FROM t UNION ALL SELECT t.fold_id, 'train', c.campagne FROM t JOIN c ON c.y < t.y"""


@query("G10_expanding_folds", FOLDS_SQL)
def _(v: Views):
    return training.walk_forward_folds(v.preds, skip=("1997-1998",))


@query("G11_neighbour_titles", """
SELECT doc_id, n AS section_no, title, lag(title) OVER w AS prev_title, lead(title) OVER w AS next_title FROM (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS n, trim(regexp_extract(l, '^(#{1,6})\\s+(.+)$', 2), ' ') AS title FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md_v) a WHERE regexp_matches(l, '^#{1,6}\\s+.+$')) b WINDOW w AS (PARTITION BY doc_id ORDER BY n)""")
def _(v: Views):
    return kit.sections(v.markdown).select("doc_id", "section_no", "title", "prev_title", "next_title")


# --- H. sort, limit, sets --------------------------------------------------------------------------------------

@query("H1_sorted_series", "SELECT cell_id, decade_ord, chirps_sum_mean FROM rain_v")
def _(v: Views):
    return v.rain.repartition("cell_id").sortWithinPartitions("cell_id", "decade_ord")


RANK_SQL = """SELECT *, CAST(row_number() OVER (ORDER BY recall_23 DESC, variance_inter_folds, pire_campagne DESC, complexite, modele) AS INTEGER) AS rang FROM summary_v WHERE qwk >= (SELECT max(qwk) FROM summary_v WHERE modele = 'model_2')"""


@query("H2_mixed_ranking", RANK_SQL)
def _(v: Views):
    s = selection.model_summary(detail(v), MODELS)
    return selection.rank_robust(s, selection.baseline_value(s, "model_2"))


@query("H3_top_k", "SELECT cell_id, decade_ord, chirps_sum_mean FROM rain_v ORDER BY chirps_sum_mean DESC, cell_id, decade_ord LIMIT 10")
def _(v: Views):
    return v.rain.orderBy(F.desc("chirps_sum_mean"), "cell_id", "decade_ord").limit(10)


@query("H4_latest_campaign", "SELECT arg_max(campagne_calc, substr(campagne_calc, 1, 4)) AS derniere, arg_min(campagne_calc, substr(campagne_calc, 1, 4)) AS premiere FROM preds_v")
def _(v: Views):
    return outputs.latest_campaign(v.preds)


@query("H5_union", "SELECT cell_id, decade_ord, chirps_sum_mean, CAST(NULL AS DOUBLE) AS ndvi_mean FROM rain_v UNION ALL SELECT cell_id, decade_ord, NULL, round(ndvi_mean, 6) FROM veg_v")
def _(v: Views):
    return v.rain.unionByName(v.vegetation.select("cell_id", "decade_ord", r6("ndvi_mean").alias("ndvi_mean")), allowMissingColumns=True)


@query("H6_difference", "SELECT cell_id, decade_ord FROM rain_v EXCEPT SELECT cell_id, decade_ord FROM lst_v WHERE lst_mean IS NOT NULL")
def _(v: Views):
    return v.rain.select("cell_id", "decade_ord").exceptAll(v.temperature.filter("lst_mean is not null").select("cell_id", "decade_ord"))


@query("H7_intersection", "SELECT cell_id, campagne_calc FROM labels_v WHERE severite = 3 INTERSECT SELECT cell_id, campagne_calc FROM labels_v WHERE severite = 2")
def _(v: Views):
    pick = lambda s: v.labels.filter(F.col("severite") == s).select("cell_id", "campagne_calc")
    return pick(3).intersect(pick(2))


@query("H8_distinct", "SELECT DISTINCT campagne_calc AS campagne, CAST(substr(campagne_calc, 1, 4) AS INTEGER) AS start_year FROM labels_v")
def _(v: Views):
    return training.campaigns(v.labels, skip=())


@query("H9_stratified_holdout", f"""
SELECT id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY {u('id', 42)}) <= round_even(0.2e0 * count(*) OVER (PARTITION BY y_true), 0) AS is_holdout FROM preds_v""")
def _(v: Views):
    return training.stratified_holdout(v.preds.select("id", "y_true"), "id", "y_true")


# --- S. incremental ---------------------------------------------------------------------------------------------

UPSERT_SQL = """
SELECT cell_id, campagne_calc, date_start, coalesce(max(fresh), max(old)) AS chirps_sum_mean FROM (
  SELECT cell_id, campagne_calc, date_start, coalesce(chirps_sum_mean, 0) AS old, CAST(NULL AS DOUBLE) AS fresh FROM cube_v
  UNION ALL SELECT cell_id, campagne_calc, date_start, NULL, coalesce(chirps_sum_mean, 0) + 1000 FROM cube_v WHERE decade_ord BETWEEN 1998 * 36 + 10 AND 1998 * 36 + 14) b
GROUP BY cell_id, campagne_calc, date_start"""


def batches(v: Views):
    """The cube, and a corrected slice of it as a second batch. The cube is derived once: an upsert reads a batch several times."""
    base = order.stored(v.cube.select("cell_id", "campagne_calc", "date_start", "decade_ord", F.coalesce("chirps_sum_mean", F.lit(0.0)).alias("chirps_sum_mean")))
    new = cal.slice_month(base, "1998-05", 2).withColumn("chirps_sum_mean", F.col("chirps_sum_mean") + 1000)
    return base.drop("decade_ord"), new.drop("decade_ord")


@query("S1_upsert", UPSERT_SQL)
def _(v: Views):
    old, new = batches(v)
    return cube.upsert(old, new)


@query("S1_upsert_table", UPSERT_SQL)
def _(v: Views):
    old, new = batches(v)
    path, staging = scratch_dir(v.spark, "cube"), scratch_dir(v.spark, "staging")
    sinks.upsert_cube(v.spark, old, path, staging + "-0")  # the first batch makes the cube
    sinks.upsert_cube(v.spark, new, path, staging + "-1")
    out = readers.read_stage(v.spark, path)
    clean.require_empty(clean.duplicate_keys(out, ("cell_id", "date_start")), "duplicate cells after upsert")
    return out.select("cell_id", "campagne_calc", "date_start", "chirps_sum_mean")


@query("S1_late_batches", UPSERT_SQL)
def _(v: Views):
    """The correction comes first, the old rows late and twice: versions decide, not the order of arrival."""
    old, new = batches(v)
    old, new = old.withColumn("version", F.lit(1)), new.withColumn("version", F.lit(2))
    path, staging = scratch_dir(v.spark, "cube"), scratch_dir(v.spark, "staging")
    merge = upsert.cube_upserter(path, staging, version="version")
    for number, batch in enumerate((new, old.withColumn("chirps_sum_mean", F.col("chirps_sum_mean") - 1).unionByName(old), old)):
        merge(batch, number)
    merge(new.withColumn("chirps_sum_mean", F.lit(-1.0)).withColumn("version", F.lit(9)), 0)  # a replay of batch 0 is left out
    return readers.read_stage(v.spark, path).select("cell_id", "campagne_calc", "date_start", "chirps_sum_mean")


@query("S2_month_update", "SELECT cell_id, decade_ord, chirps_sum_mean, pop_consecutive, chirps_sum_mean_lag2d FROM features_v WHERE decade_ord BETWEEN 1998 * 36 + 12 AND 1998 * 36 + 14")
def _(v: Views):
    """Features of one month from the slice that holds its campaign so far (lags need only two decades)."""
    hi = cal.month_bounds("1998-05", 0)[1]
    campaign = v.cube.filter(F.col("campagne_calc") == "1997-1998").filter(F.col("decade_ord") <= hi)
    out = features.build_features(campaign)
    return cal.slice_month(out, "1998-05", 0).select("cell_id", "decade_ord", "chirps_sum_mean", "pop_consecutive", "chirps_sum_mean_lag2d")
