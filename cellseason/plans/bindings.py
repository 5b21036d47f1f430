"""Driver tables seen as domain views.

Raw views are one SELECT text rendered for both engines, so that both start from identical inputs; every
derived view is built with the library on the Spark side and written independently in SQL on the other.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TEMPERATURE_SCALE, TEMPERATURE_WINDOW, VEGETATION_SCALE, VEGETATION_WINDOW
from ..functions import calendar as cal
from ..functions import quality
from ..functions.scoring import digest_draw, draw, presence, score_records
from ..operators import clean, composites, cube, features, labels, training

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
MODELS = {f"model_{i}": i for i in range(6)}


class _Spark:
    quote = staticmethod(lambda n: f"`{n}`")
    div = staticmethod(lambda a, b: f"({a} div {b})")
    days = staticmethod(lambda d, origin: f"datediff({d}, DATE '{origin}')")
    add = staticmethod(lambda origin, n: f"date_add(DATE '{origin}', CAST({n} AS INT))")


class _Duck:
    quote = staticmethod(lambda n: f'"{n}"')
    div = staticmethod(lambda a, b: f"({a} // {b})")
    days = staticmethod(lambda d, origin: f"date_diff('day', DATE '{origin}', {d})")
    add = staticmethod(lambda origin, n: f"(DATE '{origin}' + CAST({n} AS INTEGER))")


def u(key: str, seed: int) -> str:
    """SQL text of the reproducible draw."""
    return draw_sql(key, str(seed))


def draw_sql(key: str, seed: str) -> str:
    return f"(CAST(concat('0x', substr(md5(CAST(CAST({key} AS BIGINT) AS VARCHAR) || ':' || CAST({seed} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496e0)"


def noise(key: str, seed: int) -> str:
    """Noise of the made-up predictions, in arithmetic that both engines read; operators draw by ``scoring.draw``."""
    return f"(((({key} % 1000003) + 1) * {1103515245 + 131074 * seed} + 12345) % 2147483648) / 2147483648e0"


def _cell(key: str, e) -> str:
    return f"concat({key} % 40, '_', {e.div(key, 40)})"


def _survey_raw(e) -> str:
    k, d = "o_orderkey", "CAST(o_orderdate AS DATE)"
    hole = f"{k} % 29 = 0"
    return f"""
SELECT {k} AS id, {d} AS obs_date,
  CASE WHEN {k} % 499 = 3 THEN NULL ELSE CAST({e.days(d, '1899-12-30')} AS DOUBLE) END AS Date_,
  CASE WHEN {k} % 37 = 0 THEN NULL WHEN {k} % 41 = 0 THEN -45.5e0 ELSE -25.9e0 + ({k} % 1483) / 1483e0 * 14.5e0 END AS LAT_DD,
  CASE WHEN {k} % 43 = 0 THEN NULL WHEN {k} % 53 = 0 THEN 12.25e0 ELSE 43.1e0 + ({k} % 1361) / 1361e0 * 7.8e0 END AS LNG_DD,
  CASE WHEN {hole} OR {k} % 11 = 0 THEN NULL WHEN {k} % 3 = 0 THEN CAST({k} % 7 AS DOUBLE) ELSE 0e0 END AS Sol,
  CASE WHEN {hole} OR {k} % 13 = 0 THEN NULL WHEN {k} % 5 = 0 THEN CAST({k} % 4 AS DOUBLE) ELSE 0e0 END AS Trans,
  CASE WHEN {hole} OR {k} % 17 = 0 THEN NULL WHEN {k} % 19 = 0 THEN CAST({k} % 3 AS DOUBLE) ELSE 0e0 END AS Greg,
  CASE WHEN {hole} OR {k} % 4 = 1 THEN NULL WHEN {k} % 6 = 0 THEN CAST({k} % 5 AS DOUBLE) ELSE 0e0 END AS {e.quote('Sol larve')},
  CASE WHEN {hole} OR {k} % 4 = 1 THEN NULL WHEN {k} % 23 = 0 THEN CAST({k} % 3 AS DOUBLE) ELSE 0e0 END AS {e.quote('Trans larve')},
  CASE WHEN {hole} OR {k} % 4 = 1 THEN NULL WHEN {k} % 31 = 0 THEN 1e0 ELSE 0e0 END AS {e.quote('Greg larve')},
  CASE WHEN {k} % 3 = 1 THEN NULL WHEN {k} % 9 = 0 THEN 0e0 ELSE o_totalprice / 40e0 END AS DI_dif_moy,
  CASE WHEN {k} % 4 = 2 THEN NULL WHEN {k} % 9 = 0 THEN 0e0 ELSE o_totalprice / 90e0 END AS DL_dif_moy,
  CAST((month({d}) - 1) * 3 + CASE WHEN day({d}) <= 10 THEN 1 WHEN day({d}) <= 20 THEN 2 ELSE 3 END
    + CASE WHEN {k} % 50 = 0 THEN 1 ELSE 0 END AS INT) AS Decade,
  o_orderpriority AS Campagne, CAST({k} % 5 AS DOUBLE) AS Sol_NSE,
  {e.div('o_custkey', 15)} AS cell_key, {_cell(e.div('o_custkey', 15), e)} AS cell_id, o_custkey
FROM orders"""


def _cells(e) -> str:
    return f"""
SELECT {_cell('s_suppkey', e)} AS cell_id, CAST(s_suppkey % 40 AS INT) AS cell_col, CAST({e.div('s_suppkey', 40)} AS INT) AS cell_row,
  CAST(n_regionkey % 4 + 1 AS INT) AS AIRE_CODE, n_nationkey AS SECT_NO, n_name AS AIRE_NOM
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _rain_raw(e) -> str:
    return f"SELECT {_cell('l_suppkey', e)} AS cell_id, CAST(l_shipdate AS DATE) AS day, l_quantity AS rain FROM lineitem"


def _images(e, step: int, values: str) -> str:
    d = "CAST(l_shipdate AS DATE)"
    t = e.add("1994-12-25", f"{e.div(e.days(d, '1994-12-25'), step)} * {step}")
    return f"""
SELECT cell_id, image_time, {values} FROM (
  SELECT {_cell('l_suppkey', e)} AS cell_id, {t} AS image_time, l_partkey, l_linenumber FROM lineitem) s
GROUP BY cell_id, image_time"""


def _vegetation(e) -> str:
    return _images(e, 16, "CAST(max(l_partkey) % 12000 - 2000 AS INT) AS ndvi_raw, "
                          "CAST(min(l_partkey) % 10000 - 1000 AS INT) AS evi_raw, CAST(max(l_linenumber) % 4 AS INT) AS qa")


def _temperature(e) -> str:
    return _images(e, 8, "CAST(14000 + max(l_partkey) % 2000 AS INT) AS lst_raw, CAST(max(l_partkey) % 2 AS INT) AS qa")


def _pred_raw(e) -> str:
    k = "o_orderkey"
    truth = f"CASE WHEN {k} % 7 = 0 THEN 3 WHEN {k} % 5 = 0 THEN 2 WHEN {k} % 2 = 0 THEN 1 ELSE 0 END"
    return f"""
SELECT id, obs_date, y_true, CAST(CASE WHEN {noise('id', 1)} < 0.6e0 THEN y_true
    ELSE (y_true + 1 + CAST(floor(({noise('id', 2)}) * 3e0) AS INT)) % 4 END AS INT) AS y_pred,
  floor((0.55e0 * ({noise('id', 3)}) + 0.15e0 * y_true) * 1000e0) / 1000e0 AS score
FROM (SELECT {k} AS id, CAST(o_orderdate AS DATE) AS obs_date, {truth} AS y_true FROM orders) t"""


def _areas(e, hx: str, hy: str) -> str:
    return f"""
SELECT s_suppkey AS poly_id, CAST(s_suppkey % 4 + 1 AS INT) AS AIRE_CODE, CAST(s_suppkey % 12 AS INT) AS SECT_NO, s_name AS AIRE_NOM,
  43.4e0 + (s_suppkey % 23) * 0.31e0 AS cx, -25.4e0 + (s_suppkey % 31) * 0.45e0 AS cy, {hx} AS hx, {hy} AS hy
FROM supplier"""


def _markdown(e) -> str:
    nl = "chr(10)"
    return f"""
SELECT doc_id, concat('# ', replace(replace(replace(replace(replace(text, concat({nl}, 'É'), concat({nl}, '## É')),
  concat({nl}, 'T'), concat({nl}, '# T')), concat({nl}, 'D'), concat({nl}, '### D ')), ' le ', ' [le](u/le) '), ' and ', ' and: ')) AS text
FROM documents"""


RAW = {
    "survey_raw_v": _survey_raw, "cells_v": _cells, "rain_raw_v": _rain_raw, "veg_raw_v": _vegetation,
    "lst_raw_v": _temperature, "pred_raw_v": _pred_raw,
    "areas_v": lambda e: _areas(e, "0.3e0", "0.4e0"), "plots_v": lambda e: _areas(e, "0.05e0", "0.06e0"),
    "md_v": _markdown,
}


class Views:
    """Lazy Spark views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Each table is resolved once, so its footer is read once per query."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def raw(self, name: str) -> DataFrame:
        text = RAW[name](_Spark)
        used = [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)]
        for t in used:
            text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: self.table(t) for t in used})

    # --- surveys and labels --------------------------------------------------------------------------
    @cached_property
    def survey_raw(self) -> DataFrame:
        return self.raw("survey_raw_v")

    @cached_property
    def surveys(self) -> DataFrame:
        """Scored, dated records on the cell keys of the covariates."""
        df = clean.rename_existing(self.survey_raw).withColumnRenamed("obs_date", "date")
        return score_records(clean.with_season_fields(df))

    @cached_property
    def labels(self) -> DataFrame:
        return labels.aggregate_labels(self.surveys)

    @cached_property
    def cells(self) -> DataFrame:
        return self.raw("cells_v")

    # --- covariates -------------------------------------------------------------------------------------
    @cached_property
    def rain_raw(self) -> DataFrame:
        return self.raw("rain_raw_v")

    @cached_property
    def rain(self) -> DataFrame:
        return composites.sum_composite(self.rain_raw, "rain")

    @cached_property
    def veg_images(self) -> DataFrame:
        return self.raw("veg_raw_v")

    @cached_property
    def lst_images(self) -> DataFrame:
        return self.raw("lst_raw_v")

    def veg_values(self) -> dict:
        ok = quality.vegetation_ok("qa")
        return {"ndvi_mean": quality.masked("ndvi_raw", ok, VEGETATION_SCALE), "evi_mean": quality.masked("evi_raw", ok, VEGETATION_SCALE)}

    def lst_values(self) -> dict:
        return {"lst_mean": quality.masked("lst_raw", quality.temperature_ok("qa"), TEMPERATURE_SCALE)}

    @cached_property
    def vegetation(self) -> DataFrame:
        return composites.latest_composite(self.veg_images, self.veg_values(), "image_time", VEGETATION_WINDOW)

    @cached_property
    def temperature(self) -> DataFrame:
        return composites.latest_composite(self.lst_images, self.lst_values(), "image_time", TEMPERATURE_WINDOW)

    @cached_property
    def spine(self) -> DataFrame:
        return cube.spine(self.cells, *cube.season_span(self.table("lineitem"), "l_shipdate"))

    @cached_property
    def cube(self) -> DataFrame:
        sources = [self.rain, self.vegetation, self.temperature]
        return cube.with_calendar(cube.stack_on_spine(self.spine, sources))

    @cached_property
    def training(self) -> DataFrame:
        """Cube, features, history and labels in one exchange per cell: labels are stacked like any source."""
        lab = self.labels.select("cell_id", cal.campaign_ordinal("campagne_calc", "campagne_decade").alias("decade_ord"),
                                 "severite", "intensite", "effort_prospection", "binaire")
        stacked = cube.stack_on_spine(self.spine, [self.rain, self.vegetation, self.temperature, lab])
        out = features.build_features(cube.with_calendar(stacked), keep_target=True)
        return out.withColumn("a_predire", F.col("severite").isNull())

    # --- predictions and regions --------------------------------------------------------------------------
    @cached_property
    def preds(self) -> DataFrame:
        df = self.raw("pred_raw_v")
        out = df.select("id", cal.campaign_label("obs_date").alias("campagne_calc"), cal.campaign_decade("obs_date").alias("campagne_decade"),
                        "y_true", "y_pred", "score", presence("y_true").alias("label"))
        return out.filter("campagne_calc is not null")

    @cached_property
    def model_preds(self) -> DataFrame:
        """Six pseudo-models of growing accuracy over the same rows."""
        base = self.preds.select("id", "campagne_calc", "y_true")
        m = F.explode(F.array(*[F.lit(i) for i in MODELS.values()])).alias("m")
        rows = base.select("*", m)
        hit = _draws("id", 11) < 0.35 + 0.08 * F.col("m")
        miss = F.pmod(F.col("y_true") + 1 + F.floor(_draws("id", 31) * 3.0), F.lit(4))
        return rows.select(F.concat(F.lit("model_"), F.col("m").cast("string")).alias("modele"), "campagne_calc", "y_true",
                           F.when(hit, F.col("y_true")).otherwise(miss).cast("int").alias("y_pred"))

    @cached_property
    def region_rows(self) -> DataFrame:
        s = self.surveys.filter("campagne_calc is not null")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        n = self.table("nation").select("n_nationkey", "n_name")
        j = s.join(c, s.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        return j.select("id", (F.col("n_nationkey") + 10).alias("rn_num"), F.col("n_name").alias("rn_nom"), "campagne_calc",
                        "campagne_decade", "densite_imago", "niveau_gregarite", labels.record_severity().alias("sev"))

    @cached_property
    def regions(self) -> DataFrame:
        """Region x campaign x decade table with split, label and effort."""
        g = self.region_rows.groupBy("rn_num", "rn_nom", "campagne_calc", "campagne_decade").agg(
            F.count("*").alias("effort_prospection"), (F.count_if(F.col("sev") >= 1) * 2 > F.count("*")).cast("int").alias("lab"),
            F.max("niveau_gregarite").alias("niveau_gregarite_dominant"))
        y = cal.campaign_start_year("campagne_calc")
        split = F.when(y <= 1996, "train").when(y <= 1999, "validation").otherwise("inference")
        out = g.withColumn("split", split)
        out = out.withColumn("label", F.when(F.col("split") != "inference", F.col("lab"))).drop("lab")
        return out.withColumn("chirps_sum_mean", draw(F.col("rn_num") * 997 + F.col("campagne_decade") * 31 + y, 5) * 100.0)

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def markdown(self) -> DataFrame:
        return spread(self.raw("md_v"), "doc_id")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when a small input arrives as fewer partitions than cores; text work is CPU-bound.

    A large input has more partitions than cores already and passes through without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _draws(key: str, seed: int):
    """Draw whose seed also depends on the model number ``m``."""
    return digest_draw(F.col(key), F.col("m") + seed)


# --- the same derived views in SQL -------------------------------------------------------------------------

CAMP = "CASE WHEN month({d}) >= 10 THEN concat(year({d}), '-', year({d}) + 1) WHEN month({d}) <= 7 THEN concat(year({d}) - 1, '-', year({d})) END"
PART = "(CASE WHEN day({d}) <= 10 THEN 1 WHEN day({d}) <= 20 THEN 2 ELSE 3 END)"
SEASON_DEC = "CASE WHEN month({d}) >= 10 THEN (month({d}) - 10) * 3 + " + PART + " WHEN month({d}) <= 7 THEN (month({d}) + 2) * 3 + " + PART + " END"
ORD = "(year({d}) * 36 + (month({d}) - 1) * 3 + " + PART + " - 1)"


def camp(d: str) -> str:
    return CAMP.format(d=d)


def part(d: str) -> str:
    return PART.format(d=d)


def season_decade(d: str) -> str:
    return f"CAST({SEASON_DEC.format(d=d)} AS INTEGER)"


def ordinal(d: str) -> str:
    return f"CAST({ORD.format(d=d)} AS INTEGER)"


DECADE_COLUMNS = """decade_ord, CAST(decade_ord // 36 AS INTEGER) AS year, CAST((decade_ord % 36) // 3 + 1 AS INTEGER) AS month,
  CAST(decade_ord % 3 + 1 AS INTEGER) AS decade_part"""
DECADE_DATES = """*, make_date(year, month, (decade_part - 1) * 10 + 1) AS date_start,
  CASE WHEN decade_part = 3 THEN last_day(make_date(year, month, 21)) ELSE make_date(year, month, decade_part * 10) END AS date_end,
  CASE WHEN month >= 10 THEN concat(year, '-', year + 1) WHEN month <= 7 THEN concat(year - 1, '-', year) END AS campagne_calc,
  CAST(CASE WHEN month >= 10 THEN (month - 10) * 3 + decade_part WHEN month <= 7 THEN (month + 2) * 3 + decade_part END AS INTEGER) AS campagne_decade"""


def _composite_sql(images: str, values: str, lead: int, lag: int) -> str:
    return f"""
SELECT i.cell_id, w.decade_ord, {values} FROM {images} i JOIN (
  SELECT d.decade_ord, max(t.image_time) AS image_time FROM decades_all_v d JOIN (SELECT DISTINCT image_time FROM {images}) t
    ON t.image_time >= d.date_start - {lead} AND t.image_time < d.date_end + {lag} GROUP BY d.decade_ord) w USING (image_time)"""


SQL_VIEWS = {
    **{name: make(_Duck) for name, make in RAW.items()},
    "surveys_v": f"""
SELECT id, obs_date AS date, {camp('obs_date')} AS campagne_calc, {part('obs_date')} AS decade_intra, {season_decade('obs_date')} AS campagne_decade,
  cell_id, o_custkey, Sol, Trans, Greg, "Sol larve" AS Sol_larve, "Trans larve" AS Trans_larve, "Greg larve" AS Greg_larve, DI_dif_moy, DL_dif_moy, Decade,
  CASE WHEN Sol IS NULL OR Trans IS NULL OR Greg IS NULL THEN NULL WHEN Sol + Trans + Greg = 0 THEN 'absent' WHEN Greg > 0 THEN 'G'
    WHEN Trans >= Sol AND Sol > 0 THEN 'T' WHEN Trans > 0 THEN 'St' ELSE 'S' END AS niveau_gregarite,
  CASE WHEN DI_dif_moy IS NULL AND DL_dif_moy IS NULL THEN NULL ELSE coalesce(DI_dif_moy, 0) + coalesce(DL_dif_moy, 0) / 9e0 END AS densite_imago,
  CASE WHEN coalesce(Sol, Trans, Greg, "Sol larve", "Trans larve", "Greg larve") IS NULL THEN NULL
    WHEN Greg > 0 OR "Greg larve" > 0 THEN 3 WHEN Trans > 0 OR "Trans larve" > 0 THEN 2 WHEN Sol > 0 OR "Sol larve" > 0 THEN 1 ELSE 0 END AS sev
FROM survey_raw_v""",
    "labels_v": """
SELECT cell_id, campagne_calc, campagne_decade, max(sev) AS severite, ln(1 + avg(densite_imago)) AS intensite, count(*) AS effort_prospection,
  CASE WHEN max(sev) >= 1 THEN 1 WHEN max(sev) = 0 THEN 0 END AS binaire
FROM surveys_v WHERE cell_id IS NOT NULL AND campagne_calc IS NOT NULL AND campagne_decade IS NOT NULL GROUP BY 1, 2, 3""",
    "span_v": "SELECT min(year(l_shipdate)) AS lo, max(year(l_shipdate)) AS hi FROM lineitem",
    "decades_all_v": f"""
SELECT {DECADE_DATES} FROM (SELECT {DECADE_COLUMNS} FROM (SELECT CAST(unnest(range(lo * 36 - 4, hi * 36 + 40)) AS INTEGER) AS decade_ord FROM span_v) a) b""",
    "decades_v": "SELECT d.* FROM decades_all_v d, span_v WHERE campagne_decade IS NOT NULL AND year BETWEEN lo AND hi",
    "rain_v": f"SELECT cell_id, {ordinal('day')} AS decade_ord, sum(rain) AS chirps_sum_mean FROM rain_raw_v GROUP BY 1, 2",
    "veg_v": _composite_sql("veg_raw_v", "CASE WHEN (i.qa & 3) <= 1 THEN i.ndvi_raw * 0.0001e0 END AS ndvi_mean, CASE WHEN (i.qa & 3) <= 1 THEN i.evi_raw * 0.0001e0 END AS evi_mean", *VEGETATION_WINDOW),
    "lst_v": _composite_sql("lst_raw_v", "CASE WHEN (i.qa & 3) = 0 THEN i.lst_raw * 0.02e0 END AS lst_mean", *TEMPERATURE_WINDOW),
    "cube_v": """
SELECT c.cell_id, c.AIRE_CODE, d.*, r.chirps_sum_mean, v.ndvi_mean, v.evi_mean, l.lst_mean FROM cells_v c CROSS JOIN decades_v d
LEFT JOIN rain_v r ON r.cell_id = c.cell_id AND r.decade_ord = d.decade_ord
LEFT JOIN veg_v v ON v.cell_id = c.cell_id AND v.decade_ord = d.decade_ord
LEFT JOIN lst_v l ON l.cell_id = c.cell_id AND l.decade_ord = d.decade_ord""",
    "month_v": """
SELECT *, coalesce(sum(in_pop) OVER (PARTITION BY cell_id, campagne_calc, isl ORDER BY year, month), 0) AS streak FROM (
  SELECT *, sum(1 - in_pop) OVER (PARTITION BY cell_id, campagne_calc ORDER BY year, month) AS isl FROM (
    SELECT cell_id, campagne_calc, year, month, coalesce(sum(chirps_sum_mean), 0) AS monthly,
      CASE WHEN coalesce(sum(chirps_sum_mean), 0) BETWEEN 50 AND 125 THEN 1 ELSE 0 END AS in_pop
    FROM cube_v GROUP BY 1, 2, 3, 4) a) b""",
    "features_v": """
SELECT c.*, CAST(m.streak AS INTEGER) AS pop_consecutive,
  lag(chirps_sum_mean, 1) OVER w AS chirps_sum_mean_lag1d, lag(chirps_sum_mean, 2) OVER w AS chirps_sum_mean_lag2d,
  lag(ndvi_mean, 1) OVER w AS ndvi_mean_lag1d, lag(ndvi_mean, 2) OVER w AS ndvi_mean_lag2d,
  lag(evi_mean, 1) OVER w AS evi_mean_lag1d, lag(evi_mean, 2) OVER w AS evi_mean_lag2d,
  lag(lst_mean, 1) OVER w AS lst_mean_lag1d, lag(lst_mean, 2) OVER w AS lst_mean_lag2d,
  c.chirps_sum_mean + lag(chirps_sum_mean, 1) OVER w AS chirps_cumul_2d,
  c.chirps_sum_mean + lag(chirps_sum_mean, 1) OVER w + lag(chirps_sum_mean, 2) OVER w AS chirps_cumul_3d,
  lag(s.severite, 1) OVER w AS severite_lag1, lag(s.severite, 2) OVER w AS severite_lag2
FROM cube_v c LEFT JOIN month_v m ON m.cell_id = c.cell_id AND m.campagne_calc = c.campagne_calc AND m.year = c.year AND m.month = c.month
LEFT JOIN labels_v s ON s.cell_id = c.cell_id AND s.campagne_calc = c.campagne_calc AND s.campagne_decade = c.campagne_decade
WINDOW w AS (PARTITION BY c.cell_id ORDER BY c.date_start)""",
    "training_v": """
SELECT f.*, s.severite, s.intensite, s.effort_prospection, s.binaire, s.severite IS NULL AS a_predire
FROM features_v f LEFT JOIN labels_v s ON s.cell_id = f.cell_id AND s.campagne_calc = f.campagne_calc AND s.campagne_decade = f.campagne_decade""",
    "preds_v": f"""
SELECT id, {camp('obs_date')} AS campagne_calc, {season_decade('obs_date')} AS campagne_decade, y_true, y_pred, score,
  CASE WHEN y_true >= 1 THEN 1 ELSE 0 END AS label FROM pred_raw_v WHERE {camp('obs_date')} IS NOT NULL""",
    "model_preds_v": f"""
SELECT concat('model_', m) AS modele, campagne_calc, y_true, CAST(CASE WHEN u1 < 0.35e0 + 0.08e0 * m THEN y_true
  ELSE (y_true + 1 + CAST(floor(u2 * 3e0) AS INTEGER)) % 4 END AS INTEGER) AS y_pred FROM (
  SELECT *, {draw_sql('id', '(m + 11)')} AS u1, {draw_sql('id', '(m + 31)')} AS u2
  FROM preds_v CROSS JOIN (SELECT unnest(range(6)) AS m) mm) t""",
    "detail_v": """
SELECT modele, campagne_calc,
  round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (sum(y_true * y_true) + sum(y_pred * y_pred) - 2e0 * sum(y_true) * sum(y_pred) / count(*)), 4) AS qwk,
  round(count(*) FILTER (WHERE y_true >= 2 AND y_pred >= 2) / CAST(count(*) FILTER (WHERE y_true >= 2) AS DOUBLE), 4) AS recall_23
FROM model_preds_v GROUP BY 1, 2""",
    "summary_v": """
SELECT modele, round(avg(recall_23), 4) AS recall_23, round(avg(qwk), 4) AS qwk, round(var_pop(recall_23), 4) AS variance_inter_folds,
  round(min(recall_23), 4) AS pire_campagne, count(*) AS n_folds, CAST(substr(modele, 7) AS INTEGER) AS complexite
FROM detail_v GROUP BY 1""",
    "region_rows_v": """
SELECT id, n_nationkey + 10 AS rn_num, n_name AS rn_nom, campagne_calc, campagne_decade, densite_imago, niveau_gregarite, sev
FROM surveys_v JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE campagne_calc IS NOT NULL""",
    "regions_v": f"""
SELECT * EXCLUDE (lab), CASE WHEN split <> 'inference' THEN lab END AS label, 100e0 * ({u('k', 5)}) AS chirps_sum_mean FROM (
SELECT rn_num, rn_nom, campagne_calc, campagne_decade, count(*) AS effort_prospection,
  CASE WHEN count(*) FILTER (WHERE sev >= 1) * 2 > count(*) THEN 1 ELSE 0 END AS lab, max(niveau_gregarite) AS niveau_gregarite_dominant,
  CASE WHEN CAST(substr(campagne_calc, 1, 4) AS INTEGER) <= 1996 THEN 'train' WHEN CAST(substr(campagne_calc, 1, 4) AS INTEGER) <= 1999 THEN 'validation' ELSE 'inference' END AS split,
  CAST(rn_num * 997 + campagne_decade * 31 + CAST(substr(campagne_calc, 1, 4) AS INTEGER) AS BIGINT) AS k
FROM region_rows_v GROUP BY 1, 2, 3, 4) t""",
}


def with_views(sql: str) -> str:
    """Prefixes a query with the views it uses, directly or through other views."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+_v\b", text):
            if name in SQL_VIEWS and name not in order:
                visit(SQL_VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
