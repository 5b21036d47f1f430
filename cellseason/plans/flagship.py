"""End-to-end queries: raw tables to training table, area report and evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, outputs
from .bindings import Views
from .catalog_data import REPORT_SQL, r6
from .catalog_models import auc_sql
from .registry import query

TRAINING_DOUBLES = ["ndvi_mean", "evi_mean", "lst_mean", "intensite", "ndvi_mean_lag1d", "ndvi_mean_lag2d", "evi_mean_lag1d", "evi_mean_lag2d", "lst_mean_lag1d", "lst_mean_lag2d"]
TRAINING_PLAIN = ["cell_id", "AIRE_CODE", "campagne_calc", "campagne_decade", "date_start", "date_end", "year", "month", "decade_part", "chirps_sum_mean", "pop_consecutive",
                  "chirps_sum_mean_lag1d", "chirps_sum_mean_lag2d", "chirps_cumul_2d", "chirps_cumul_3d", "severite_lag1", "severite_lag2", "severite", "binaire", "effort_prospection", "a_predire"]


@query("flagship_training_table", f"SELECT {', '.join(TRAINING_PLAIN)}, {', '.join(f'round({c}, 6) AS {c}' for c in TRAINING_DOUBLES)} FROM training_v")
def _(v: Views):
    return v.training.select(*TRAINING_PLAIN, *[r6(c).alias(c) for c in TRAINING_DOUBLES])


@query("flagship_area_month", """
SELECT AIRE_CODE, campagne_calc, mois_campagne, max(severite) AS severite_max, count(*) AS n_cellules, count(*) FILTER (WHERE severite >= 2) AS n_cellules_foyer, round(avg(streak), 6) AS serie_pluie_moyenne FROM (
  SELECT cell_id, AIRE_CODE, campagne_calc, CAST((campagne_decade - 1) // 3 + 1 AS INTEGER) AS mois_campagne, max(severite) AS severite, max(pop_consecutive) AS streak
  FROM training_v WHERE severite IS NOT NULL GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3""")
def _(v: Views):
    """Worst level, hot-spot cells and mean rain streak per area, campaign and month."""
    t = v.training.filter("severite is not null")
    keys = ["AIRE_CODE", "campagne_calc", "mois_campagne"]
    month = t.groupBy("cell_id", "AIRE_CODE", "campagne_calc", outputs.campaign_month("campagne_decade").alias("mois_campagne")).agg(
        F.max("severite").alias("severite"), F.max("pop_consecutive").alias("streak"))
    return month.groupBy(*keys).agg(F.max("severite").alias("severite_max"), F.count("*").alias("n_cellules"),
                                    F.count_if(F.col("severite") >= 2).alias("n_cellules_foyer"), r6(F.avg("streak")).alias("serie_pluie_moyenne"))


@query("flagship_report", f"SELECT r.campagne_calc, r.qwk, r.recall_23, r.n, round(a.auc, 6) AS auc_binaire FROM ({REPORT_SQL.replace('preds_v', '(SELECT unnest([campagne_calc, chr(71)]) AS campagne_calc, y_true, y_pred FROM preds_v) g')}) r JOIN ({auc_sql('campagne_calc', '(SELECT unnest([campagne_calc, chr(71)]) AS campagne_calc, label, score FROM preds_v) h')}) a USING (campagne_calc)")
def _(v: Views):
    """Per-campaign report with the pooled row ``G``."""
    both = v.preds.withColumn("campagne_calc", F.explode(F.array("campagne_calc", F.lit("G"))))
    return metrics.campaign_report(both).withColumn("auc_binaire", r6("auc_binaire"))
