"""Queries for spatial operators and joins (D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CELL_SIZE_M, TEMPERATURE_WINDOW
from ..functions import geo
from ..operators import clean, composites, cube, features, order, outputs, panel, spatial, training
from .bindings import Views, spread
from .catalog_data import CLIMATOLOGY_SQL, area_rings, baseline, r6
from .registry import query

# Transverse Mercator series for the oracles (x, y in metres), WGS 84 and zone 38 South.
# Fixed values, written out: scale times radius, first eccentricity, and the series to the third order.
METRES, ECCENTRICITY = "6364902.166165086e0", "0.08181919084262149e0"
FORWARD = ("8.377318188192541e-4", "7.608496958699166e-7", "1.2034877875966646e-9")
INVERSE = ("8.37732164082144e-4", "5.906110863719917e-8", "1.6769911794379754e-10")
LATITUDE = ("3.356551448628875e-3", "6.571913193172695e-6", "1.76774599620756e-8")


def utm_sql(lon: str, lat: str, source: str, keep: str) -> str:
    series = lambda f, g: " + ".join(f"{a} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(FORWARD, 1))
    return f"""(SELECT {keep}, 500000e0 + {METRES} * (eta + {series('cos', 'sinh')}) AS x, 10000000e0 + {METRES} * (xi + {series('sin', 'cosh')}) AS y FROM (
  SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM (
    SELECT *, sinh(atanh(sin(phi)) - {ECCENTRICITY} * atanh({ECCENTRICITY} * sin(phi))) AS t FROM (
      SELECT *, radians({lat}) AS phi, radians({lon} - 45e0) AS lam FROM {source}) a) b) c)"""


def degrees_sql(x: str, y: str, source: str, keep: str) -> str:
    series = lambda f, g: " - ".join(f"{b} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, b in enumerate(INVERSE, 1))
    lat = "chi + " + " + ".join(f"{d} * sin({2 * j} * chi)" for j, d in enumerate(LATITUDE, 1))
    return f"""(SELECT {keep}, 45e0 + degrees(atan2(sinh(eta1), cos(xi1))) AS lon, degrees({lat}) AS lat FROM (
  SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM (
    SELECT *, xi - {series('sin', 'cosh')} AS xi1, eta - {series('cos', 'sinh')} AS eta1 FROM (
      SELECT *, ({y} - 10000000e0) / {METRES} AS xi, ({x} - 500000e0) / {METRES} AS eta FROM {source}) a) b) c)"""


VALID = "(SELECT * FROM survey_raw_v WHERE LAT_DD BETWEEN -26 AND -11 AND LNG_DD BETWEEN 43 AND 51)"
SNAP = f"""(SELECT id, LNG_DD, LAT_DD, x, y, CAST(floor(x / 1000) AS INTEGER) AS cell_col, CAST(floor(y / 1000) AS INTEGER) AS cell_row
  FROM {utm_sql('LNG_DD', 'LAT_DD', VALID + ' v0', 'id, LNG_DD, LAT_DD')} s)"""


def points(v: Views):
    return clean.valid_positions(v.survey_raw).select("id", "LNG_DD", "LAT_DD")


@query("D1_project", f"SELECT id, round(x, 3) AS x_m, round(y, 3) AS y_m FROM {SNAP} q")
def _(v: Views):
    x, y = geo.utm_xy("LNG_DD", "LAT_DD")
    return points(v).select("id", F.round(x, 3).alias("x_m"), F.round(y, 3).alias("y_m"))


@query("D2_snap_to_grid", f"SELECT id, cell_col, cell_row, concat(cell_col, '_', cell_row) AS cell_id FROM {SNAP} q")
def _(v: Views):
    return spatial.snap_to_grid(points(v)).drop("LNG_DD", "LAT_DD")


@query("D3_cell_id", f"SELECT concat(cell_col, '_', cell_row) AS cell_id, count(*) AS n FROM {SNAP} q GROUP BY 1")
def _(v: Views):
    return spatial.snap_to_grid(points(v)).groupBy(geo.cell_id("cell_col", "cell_row").alias("cell_id")).agg(F.count("*").alias("n"))


EDGES = """(SELECT poly_id, AIRE_CODE, SECT_NO, AIRE_NOM, cx + CASE n WHEN 0 THEN hx WHEN 2 THEN -hx ELSE 0 END AS x1, cy + CASE n WHEN 1 THEN hy WHEN 3 THEN -hy ELSE 0 END AS y1,
  cx + CASE n WHEN 3 THEN hx WHEN 1 THEN -hx ELSE 0 END AS x2, cy + CASE n WHEN 0 THEN hy WHEN 2 THEN -hy ELSE 0 END AS y2 FROM {areas} CROSS JOIN (SELECT unnest(range(4)) AS n) k)"""
INSIDE = f"""SELECT p.id, e.poly_id, any_value(e.AIRE_CODE) AS AIRE_CODE, any_value(e.SECT_NO) AS SECT_NO, any_value(e.AIRE_NOM) AS AIRE_NOM
  FROM {VALID} p JOIN {EDGES.format(areas='areas_v')} e ON (e.y1 <= p.LAT_DD) <> (e.y2 <= p.LAT_DD) AND p.LNG_DD < e.x1 + (p.LAT_DD - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY p.id, e.poly_id HAVING count(*) % 2 = 1"""


@query("D4_clip_to_areas", f"SELECT id, AIRE_CODE, SECT_NO, AIRE_NOM FROM ({INSIDE}) q")
def _(v: Views):
    return spatial.clip_to_areas(spread(points(v), "id"), area_rings(v)).drop("LNG_DD", "LAT_DD")


def grid(v: Views):
    return spatial.build_grid(area_rings(v, "plots_v"))


def grid_sql() -> str:
    """Candidate centres of the bounds of each plot, kept by parity, lowest plot first."""
    e = EDGES.format(areas="plots_v")
    p1 = utm_sql("x1", "y1", e + " e0", "poly_id, AIRE_CODE, SECT_NO, AIRE_NOM, x2 AS lx2, y2 AS ly2")
    p2 = utm_sql("lx2", "ly2", f"(SELECT poly_id, AIRE_CODE, SECT_NO, AIRE_NOM, lx2, ly2, x AS mx1, y AS my1 FROM {p1} f0) f1", "poly_id, AIRE_CODE, SECT_NO, AIRE_NOM, mx1, my1")
    edges = f"(SELECT poly_id, AIRE_CODE, SECT_NO, AIRE_NOM, mx1 AS x1, my1 AS y1, x AS x2, y AS y2 FROM {p2} g0)"
    return f"""
WITH m AS MATERIALIZED (SELECT * FROM {edges} z),
box AS (SELECT poly_id, floor(min(least(x1, x2)) / 1000) AS c0, floor(max(greatest(x1, x2)) / 1000) AS c1, floor(min(least(y1, y2)) / 1000) AS r0, floor(max(greatest(y1, y2)) / 1000) AS r1 FROM m GROUP BY 1),
cand AS (SELECT poly_id, c AS cell_col, unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT) + 1)) AS cell_row FROM (SELECT *, unnest(range(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT) + 1)) AS c FROM box) b),
hit AS (SELECT k.poly_id, k.cell_col, k.cell_row, any_value(m.AIRE_CODE) AS AIRE_CODE, any_value(m.SECT_NO) AS SECT_NO, any_value(m.AIRE_NOM) AS AIRE_NOM FROM cand k JOIN m ON m.poly_id = k.poly_id
  AND (m.y1 <= (k.cell_row + 0.5e0) * 1000) <> (m.y2 <= (k.cell_row + 0.5e0) * 1000)
  AND (k.cell_col + 0.5e0) * 1000 < m.x1 + ((k.cell_row + 0.5e0) * 1000 - m.y1) * (m.x2 - m.x1) / (m.y2 - m.y1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
grid AS (SELECT CAST(cell_col AS INTEGER) AS cell_col, CAST(cell_row AS INTEGER) AS cell_row, concat(cell_col, '_', cell_row) AS cell_id, AIRE_CODE, SECT_NO, AIRE_NOM FROM hit
  QUALIFY row_number() OVER (PARTITION BY cell_col, cell_row ORDER BY poly_id) = 1)
"""


@query("D5_build_grid", grid_sql() + "SELECT * FROM grid")
def _(v: Views):
    return grid(v)


BOX_TEXT = "concat('{\"type\":\"Polygon\",\"coordinates\":[[[', x1, ',', y0, '],[', x1, ',', y1, '],[', x0, ',', y1, '],[', x0, ',', y0, '],[', x1, ',', y0, ']]]}')"


@query("D6_cell_boxes", f"""SELECT cell_id, CAST(x0 AS DOUBLE) AS x_min, CAST(y0 AS DOUBLE) AS y_min, CAST(x1 AS DOUBLE) AS x_max, CAST(y1 AS DOUBLE) AS y_max, {BOX_TEXT} AS geometry FROM (
  SELECT cell_id, cell_col * 1000 AS x0, cell_row * 1000 AS y0, (cell_col + 1) * 1000 AS x1, (cell_row + 1) * 1000 AS y1 FROM cells_v) b""")
def _(v: Views):
    return spatial.with_corners(v.cells).select("cell_id", "x_min", "y_min", "x_max", "y_max", "geometry")


@query("D7_centroids", f"""
SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat, CAST(1 AS INTEGER) AS same_cell, CAST(CASE WHEN abs(LNG_DD) > 0 THEN 1 ELSE 0 END AS INTEGER) AS near
FROM {degrees_sql('(cell_col + 0.5e0) * 1000', '(cell_row + 0.5e0) * 1000', SNAP + ' q', 'id, LNG_DD')} d""")
def _(v: Views):
    """Cell centres in degrees; snapping one gives its cell back, and it is within a cell of the point."""
    df = spatial.with_centroid(spatial.snap_to_grid(points(v)))
    x, y = geo.utm_xy("lon", "lat")
    px, py = geo.utm_xy("LNG_DD", "LAT_DD")
    same = (geo.cell_index(x) == F.col("cell_col")) & (geo.cell_index(y) == F.col("cell_row"))
    near = (F.abs(x - px) <= CELL_SIZE_M / 2 + 0.01) & (F.abs(y - py) <= CELL_SIZE_M / 2 + 0.01)
    return df.select("id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), same.cast("int").alias("same_cell"), near.cast("int").alias("near"))


@query("D8_sample_raster", """
SELECT c.cell_id, r.image_time, r.ndvi_raw FROM cells_v c JOIN (
  SELECT CAST(split_part(cell_id, '_', 1) AS INTEGER) // 2 AS px_col, CAST(split_part(cell_id, '_', 2) AS INTEGER) // 2 AS px_row, image_time, max(ndvi_raw) AS ndvi_raw FROM veg_raw_v GROUP BY 1, 2, 3) r
ON floor((c.cell_col + 0.5e0) / 2) = r.px_col AND floor((c.cell_row + 0.5e0) / 2) = r.px_row""")
def _(v: Views):
    """A raster with pixels of two cells, sampled at the cell centres."""
    c = F.split("cell_id", "_")
    raster = (v.veg_images.groupBy(F.floor(c[0].cast("int") / 2).cast("int").alias("px_col"), F.floor(c[1].cast("int") / 2).cast("int").alias("px_row"), "image_time")
              .agg(F.max("ndvi_raw").alias("ndvi_raw")))
    return spatial.sample_raster(v.cells, raster, 2 * CELL_SIZE_M).select("cell_id", "image_time", "ndvi_raw")


@query("D9_select_cells", "SELECT cell_id, cell_col, cell_row, AIRE_CODE FROM cells_v WHERE cell_id IN (SELECT cell_id FROM labels_v WHERE severite >= 3)")
def _(v: Views):
    return spatial.select_cells(v.cells, "observed", v.labels.filter("severite >= 3")).select("cell_id", "cell_col", "cell_row", "AIRE_CODE")


@query("D10_tiles", """
SELECT cell_id, CAST((row_number() OVER (ORDER BY cell_row, cell_col) - 1) // 7 AS INTEGER) AS tile FROM cells_v""")
def _(v: Views):
    return spatial.with_tile(v.cells, 7).select("cell_id", "tile")


@query("D11_bounds", "SELECT min(cell_col) * 1000e0 AS min_x, min(cell_row) * 1000e0 AS min_y, (max(cell_col) + 1) * 1000e0 AS max_x, (max(cell_row) + 1) * 1000e0 AS max_y FROM cells_v")
def _(v: Views):
    return spatial.bounds(spatial.with_corners(v.cells), "x_min", "y_min", "x_max", "y_max")


# --- E. joins --------------------------------------------------------------------------------------------

@query("E1_within_join", f"SELECT poly_id, count(*) AS n_points FROM ({INSIDE}) q GROUP BY 1")
def _(v: Views):
    edges = spatial.rings_to_edges(area_rings(v))
    return spatial.count_within(spread(points(v), "id"), edges, "LNG_DD", "LAT_DD", 0.25)


@query("E2_cells_by_decades", "SELECT cell_id, AIRE_CODE, decade_ord FROM cells_v CROSS JOIN decades_v")
def _(v: Views):
    return v.spine


CUBE_COLS = "cell_id, AIRE_CODE, decade_ord, chirps_sum_mean, round(ndvi_mean, 6) AS ndvi_mean, round(evi_mean, 6) AS evi_mean, round(lst_mean, 6) AS lst_mean"


def _cube_out(df):
    return df.select("cell_id", "AIRE_CODE", "decade_ord", "chirps_sum_mean", *[r6(c).alias(c) for c in ("ndvi_mean", "evi_mean", "lst_mean")])


@query("E3_left_join_sources", f"SELECT {CUBE_COLS} FROM cube_v")
def _(v: Views):
    return _cube_out(cube.left_join_sources(v.spine, [v.rain, None, v.vegetation, v.temperature]))


@query("E3_stacked_cube", f"SELECT {CUBE_COLS} FROM cube_v")
def _(v: Views):
    return _cube_out(v.cube)


ANOMALY_SQL = f"""WITH b AS ({CLIMATOLOGY_SQL.replace('round(avg(chirps_sum_mean), 6)', 'avg(chirps_sum_mean)')})
SELECT c.cell_id, c.decade_ord, c.chirps_sum_mean, round(c.chirps_sum_mean - b.chirps_baseline_mean, 6) AS chirps_anomaly_mean
FROM cube_v c LEFT JOIN b ON b.cell_id = c.cell_id AND b.month = c.month AND b.decade_part = c.decade_part"""


@query("E4_join_climatology", ANOMALY_SQL)
def _(v: Views):
    out = composites.with_anomaly(v.cube, baseline(v))
    return out.select("cell_id", "decade_ord", "chirps_sum_mean", r6("chirps_anomaly_mean").alias("chirps_anomaly_mean"))


@query("E5_streak_on_decades", "SELECT c.cell_id, c.decade_ord, CAST(m.streak AS INTEGER) AS pop_consecutive FROM cube_v c JOIN month_v m USING (cell_id, campagne_calc, year, month)")
def _(v: Views):
    """Monthly aggregate, streak on months, joined back to decades: the other form of the rain streak."""
    rain = order.stored(cube.with_calendar(cube.stack_on_spine(v.spine, [v.rain])).select("cell_id", "campagne_calc", "year", "month", "decade_ord", "chirps_sum_mean"))
    m = features.monthly_rain(rain).withColumn("ok", F.col("chirps_monthly_sum").between(50, 125))
    s = features.with_streak(m, "ok", ["cell_id", "campagne_calc"], ["year", "month"], "pop_consecutive")
    keys = ["cell_id", "campagne_calc", "year", "month"]
    return rain.join(s.select(*keys, "pop_consecutive"), keys, "left").select("cell_id", "decade_ord", "pop_consecutive")


@query("E6_history_join", "SELECT cell_id, decade_ord, severite_lag1, severite_lag2 FROM features_v")
def _(v: Views):
    sev = v.labels.select("cell_id", "campagne_calc", "campagne_decade", "severite")
    joined = v.cube.join(sev, ["cell_id", "campagne_calc", "campagne_decade"], "left")
    return features.with_severity_lags(joined).select("cell_id", "decade_ord", "severite_lag1", "severite_lag2")


@query("E7_training_join", "SELECT cell_id, decade_ord, severite, binaire, round(intensite, 6) AS intensite, effort_prospection, a_predire FROM training_v")
def _(v: Views):
    t = training.training_table(v.cube, v.labels)
    return t.select("cell_id", "decade_ord", "severite", "binaire", r6("intensite").alias("intensite"), "effort_prospection", "a_predire")


@query("E8_median_density_join", """
SELECT r.rn_num, r.campagne_calc, r.campagne_decade, round(m.d, 6) AS densite_imago_median, CAST(NULL AS DOUBLE) AS sans_source FROM regions_v r LEFT JOIN (
  SELECT rn_num, campagne_calc, campagne_decade, median(densite_imago) AS d FROM region_rows_v WHERE densite_imago IS NOT NULL GROUP BY 1, 2, 3) m USING (rn_num, campagne_calc, campagne_decade)""")
def _(v: Views):
    out = training.with_median_density(v.regions, training.median_density(v.region_rows))
    none = training.with_median_density(v.regions, None).select("rn_num", "campagne_calc", "campagne_decade", F.col("densite_imago_median").alias("sans_source"))
    keys = ["rn_num", "campagne_calc", "campagne_decade"]
    return out.join(none, keys).select(*keys, r6("densite_imago_median").alias("densite_imago_median"), "sans_source")


def maps(v: Views):
    """Monthly severity map of the labels with areas."""
    lab = v.labels.filter("severite is not null").join(v.cells.select("cell_id", "AIRE_CODE"), "cell_id")
    return lab.withColumn("proba_presence", F.col("severite") / 3.0)


MAP_SQL = "(SELECT l.*, c.AIRE_CODE, l.severite / 3e0 AS proba_presence FROM labels_v l JOIN cells_v c USING (cell_id) WHERE severite IS NOT NULL)"


@query("E9_map_geometry", f"SELECT m.cell_id, m.severite, c.cell_col * 1000e0 AS x_min, c.cell_row * 1000e0 AS y_min FROM (SELECT cell_id, max(severite) AS severite FROM {MAP_SQL} a GROUP BY 1) m JOIN cells_v c USING (cell_id)")
def _(v: Views):
    m = outputs.cell_map(maps(v))
    return m.join(spatial.with_corners(v.cells).drop("AIRE_CODE"), "cell_id").select("cell_id", "severite", "x_min", "y_min")


@query("E10_max_probability", f"SELECT cell_id, AIRE_CODE, max(severite) AS severite, round(max(proba_presence), 6) AS proba_presence FROM {MAP_SQL} m GROUP BY 1, 2")
def _(v: Views):
    return outputs.cell_map(maps(v)).withColumn("proba_presence", r6("proba_presence"))


PANEL_SQL = """SELECT CAST(g.rn_num AS VARCHAR) AS ID, DATE '2001-10-01' + CAST(10 * ((CAST(substr(g.campagne_calc, 1, 4) AS INTEGER) - 2001) * 30 + g.d - 1) AS INTEGER) AS ds, CAST(r.label AS DOUBLE) AS y
FROM (SELECT DISTINCT rn_num, campagne_calc, d FROM (SELECT DISTINCT rn_num FROM regions_v) a CROSS JOIN (SELECT DISTINCT campagne_calc FROM regions_v) b CROSS JOIN (SELECT unnest(range(1, 31)) AS d) k) g
LEFT JOIN regions_v r ON r.rn_num = g.rn_num AND r.campagne_calc = g.campagne_calc AND r.campagne_decade = g.d"""


@query("E11_panel_join", PANEL_SQL)
def _(v: Views):
    return panel.complete_panel(v.regions)


@query("E12_fold_reports", """
SELECT a.campagne_calc, a.n_positifs, b.n_presence, g.total FROM (SELECT campagne_calc, count(*) FILTER (WHERE label = 1) AS n_positifs FROM regions_v WHERE split = 'validation' GROUP BY 1) a
JOIN (SELECT campagne_calc, count(*) AS n_presence FROM regions_v WHERE label = 1 AND niveau_gregarite_dominant IN ('S', 'St', 'T', 'G') GROUP BY 1) b USING (campagne_calc)
LEFT JOIN (SELECT campagne_calc, count(*) AS total FROM regions_v GROUP BY 1) g USING (campagne_calc)""")
def _(v: Views):
    a = v.regions.filter("split = 'validation'").groupBy("campagne_calc").agg(F.count_if(F.col("label") == 1).alias("n_positifs"))
    b = clean.phase_rows(v.regions).groupBy("campagne_calc").agg(F.count("*").alias("n_presence"))
    g = v.regions.groupBy("campagne_calc").agg(F.count("*").alias("total"))
    return a.join(b, "campagne_calc").join(g, "campagne_calc", "left")


RISK_SQL = "(SELECT AIRE_CODE, campagne_calc, max(severite) AS niveau_risque FROM {m} m GROUP BY 1, 2)"


@query("E13_external_map", f"""
SELECT p.AIRE_CODE, p.campagne_calc, p.niveau_risque, e.niveau_externe FROM {RISK_SQL.format(m=MAP_SQL)} p JOIN (
  SELECT AIRE_CODE, campagne_calc, CAST(count(*) % 5 AS INTEGER) AS niveau_externe FROM {MAP_SQL} m GROUP BY 1, 2) e USING (AIRE_CODE, campagne_calc)""")
def _(v: Views):
    m = maps(v)
    p = m.groupBy("AIRE_CODE", "campagne_calc").agg(F.max("severite").alias("niveau_risque"))
    e = m.groupBy("AIRE_CODE", "campagne_calc").agg(F.pmod(F.count("*"), F.lit(5)).cast("int").alias("niveau_externe"))
    return outputs.compare_maps(p, e)


@query("E14_semi_join", "SELECT id, campagne_calc FROM preds_v WHERE campagne_calc IN (SELECT campagne_calc FROM regions_v WHERE split = 'validation')")
def _(v: Views):
    return v.preds.select("id", "campagne_calc").join(v.regions.filter("split = 'validation'").select("campagne_calc").distinct(), "campagne_calc", "left_semi")


@query("E15_cells_outside", "SELECT DISTINCT cell_id FROM labels_v WHERE cell_id NOT IN (SELECT cell_id FROM cells_v WHERE AIRE_CODE <> 2)")
def _(v: Views):
    return spatial.cells_outside(v.cells.filter("AIRE_CODE <> 2"), v.labels)


@query("E16_window_join", """
SELECT i.cell_id, i.image_time, d.decade_ord FROM lst_raw_v i JOIN decades_all_v d ON i.image_time >= d.date_start - 4 AND i.image_time < d.date_end + 5""")
def _(v: Views):
    return composites.with_candidate_decades(v.lst_images, "image_time", *TEMPERATURE_WINDOW).select("cell_id", "image_time", "decade_ord")


@query("E17_latest_composite", "SELECT cell_id, decade_ord, round(ndvi_mean, 6) AS ndvi_mean, round(evi_mean, 6) AS evi_mean FROM veg_v")
def _(v: Views):
    return v.vegetation.select("cell_id", "decade_ord", r6("ndvi_mean").alias("ndvi_mean"), r6("evi_mean").alias("evi_mean"))


@query("E17_best_valid", """
SELECT cell_id, decade_ord, round(arg_max(lst, image_time) FILTER (WHERE lst IS NOT NULL), 6) AS lst_mean FROM (
  SELECT i.cell_id, d.decade_ord, i.image_time, CASE WHEN (qa & 3) = 0 THEN lst_raw * 0.02e0 END AS lst FROM lst_raw_v i JOIN decades_all_v d ON i.image_time >= d.date_start - 4 AND i.image_time < d.date_end + 5) t GROUP BY 1, 2""")
def _(v: Views):
    out = composites.best_valid_composite(v.lst_images, v.lst_values(), "image_time", TEMPERATURE_WINDOW)
    return out.withColumn("lst_mean", r6("lst_mean"))


@query("E18_group_value", "SELECT rn_num, campagne_calc, campagne_decade, min(niveau_gregarite_dominant) OVER (PARTITION BY rn_num) AS premier FROM regions_v")
def _(v: Views):
    first = v.regions.select("rn_num", F.col("niveau_gregarite_dominant").alias("premier"))
    return outputs.with_group_value(v.regions.select("rn_num", "campagne_calc", "campagne_decade"), first, "rn_num", "premier")
