"""Queries for folds, models, metrics, selection and the panel (L, M, N, P).

Model queries first write the table they train on, as a stage table: every fit then scans the few columns
and campaigns it needs instead of recomputing the features.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BASELINE_MODEL, PHASES, THRESHOLDS
from ..functions import calendar as cal
from ..functions.scoring import draw
from ..operators import clean, metrics, models, order, outputs, panel, selection, training
from ..session import scratch_dir
from ..sources import readers, sinks
from .bindings import MODELS, Views, u
from .catalog_data import PHASE_AT, PROBS_SQL, REPORT_SQL, detail, probabilities, r6
from .catalog_features import COVERAGE_SQL, FIT_SQL, FOLDS_SQL, GAIN_SQL, RANK_SQL, fitted_panel
from .catalog_space import PANEL_SQL
from .linear_sql import RIDGE, fits_sql, panel_columns
from .registry import query


def stored(v: Views, df, label: str):
    path = scratch_dir(v.spark, label)
    sinks.write_stage(df, path)
    return readers.read_stage(v.spark, path)


def row_key():
    """One integer for each cell and decade, without collisions: columns and rows below 10^6, decades below 10^6."""
    part = lambda i: F.get(F.split("cell_id", "_"), F.lit(i)).cast("bigint")
    return (part(0) * 1000000 + part(1)) * 1000000 + F.col("decade_ord")


def training_stage(v: Views):
    return stored(v, v.training.withColumn("row_id", row_key()), "training")


FEATURES = ["AIRE_CODE", "campagne_decade", "month", "decade_part", "chirps_sum_mean", "ndvi_mean", "evi_mean", "lst_mean", "pop_consecutive",
            "chirps_sum_mean_lag1d", "chirps_sum_mean_lag2d", "ndvi_mean_lag1d", "ndvi_mean_lag2d", "evi_mean_lag1d", "evi_mean_lag2d",
            "lst_mean_lag1d", "lst_mean_lag2d", "chirps_cumul_2d", "chirps_cumul_3d", "severite_lag1", "severite_lag2"]


def observed(v: Views):
    """Assembled observed rows with median-filled predictors, as a stage table."""
    t = stored(v, clean.observed(v.training).withColumn("row_id", row_key()).select("row_id", "cell_id", "campagne_calc", "severite", *FEATURES), "training")
    filled = order.with_median_fill(t, FEATURES, order.column_medians(t, FEATURES))
    return stored(v, models.assemble(filled, FEATURES).select("row_id", "cell_id", "campagne_calc", "features", "y"), "observed")


def observed_by_fold(v: Views):
    """Observed rows as they are, and what fills those of a fold: the medians of the seasons before its test season, so that no later
    season reaches a fold. All folds' medians come out of one table of counted values."""
    t = clean.observed(training_stage(v))
    starts = [int(test.split("-")[0]) for _, test in training.fold_list(training.walk_forward_folds(t))]
    found = order.stored(order.expanding_medians(order.counts_by_season(t, FEATURES, cal.campaign_start_year("campagne_calc")), starts))

    def prepare(rows, test_camp: str):
        return models.assemble(order.with_fold_fill(rows, FEATURES, found, int(test_camp.split("-")[0])), FEATURES).select("row_id", "cell_id", "campagne_calc", "features", "y")

    return t.withColumn("y", F.col("severite").cast("int")), prepare


def last_fold(df):
    """Train on all campaigns but the last, test on the last."""
    last = outputs.latest_campaign(df).first()["derniere"]
    return df.filter(F.col("campagne_calc") != last), df.filter(F.col("campagne_calc") == last)


def scored(pred):
    return pred.select("row_id", "campagne_calc", F.col("y").alias("y_true"), "y_pred", r6("score").alias("score"))


# --- L. folds and models -----------------------------------------------------------------------------------------

@query("L1_walk_forward", FOLDS_SQL.replace("SELECT fold_id, 'test' AS role, campagne FROM t UNION ALL SELECT t.fold_id, 'train', c.campagne FROM t JOIN c ON c.y < t.y",
       ", f AS (SELECT fold_id, 'test' AS role, campagne FROM t UNION ALL SELECT t.fold_id, 'train', c.campagne FROM t JOIN c ON c.y < t.y) SELECT fold_id, role, count(*) AS n FROM f JOIN preds_v ON campagne = campagne_calc GROUP BY 1, 2"))
def _(v: Views):
    folds = training.walk_forward_folds(v.preds, skip=("1997-1998",))
    return training.fold_rows(v.preds, folds).groupBy("fold_id", "role").agg(F.count("*").alias("n"))


@query("L2_split_folds", """
WITH s AS (SELECT DISTINCT campagne_calc AS campagne, split, CAST(substr(campagne_calc, 1, 4) AS INTEGER) AS y FROM regions_v WHERE split <> 'inference'),
t AS (SELECT *, CAST(row_number() OVER (ORDER BY y) AS INTEGER) AS fold_id FROM s WHERE split = 'validation')
SELECT fold_id, 'test' AS role, campagne, split FROM t UNION ALL SELECT t.fold_id, 'train', s.campagne, s.split FROM t JOIN s ON s.split = 'train' OR s.y < t.y""")
def _(v: Views):
    return training.split_folds(v.regions)


RIDGE_SQL = f"""
WITH d AS (SELECT id, campagne_calc, y_true AS y, score AS a, {u('id', 77)} AS b FROM preds_v), last AS (SELECT max(campagne_calc) AS c FROM d),
tr AS (SELECT d.*, (SELECT count(*) FROM d, last WHERE campagne_calc <> c) / (4e0 * count(*) OVER (PARTITION BY y)) AS w FROM d, last WHERE campagne_calc <> c),
m AS (SELECT sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * y) / sum(w) AS my FROM tr),
s AS (SELECT sum(w * (a - ma) * (a - ma)) + 1 AS aa, sum(w * (b - mb) * (b - mb)) + 1 AS bb, sum(w * (a - ma) * (b - mb)) AS ab,
  sum(w * (a - ma) * (y - my)) AS ay, sum(w * (b - mb) * (y - my)) AS cy FROM tr, m),
c AS (SELECT (ay * bb - ab * cy) / (aa * bb - ab * ab) AS ca, (cy * aa - ab * ay) / (aa * bb - ab * ab) AS cb FROM s),
p AS (SELECT id AS row_id, d.y AS y_true, my + ca * (a - ma) + cb * (b - mb) AS raw FROM d, last, m, c WHERE campagne_calc = last.c)
SELECT row_id, y_true, CAST(greatest(0, least(3, round_even(raw, 0))) AS INTEGER) AS y_pred, round(1 / (1 + exp(-(raw - 0.5e0))), 6) AS score FROM p"""


@query("L3_ridge", RIDGE_SQL)
def _(v: Views):
    df = v.preds.select(F.col("id").alias("row_id"), "campagne_calc", "y_true", "score", draw("id", 77).alias("b")).withColumnRenamed("score", "a")
    train, test = last_fold(df)
    fit = models.Ridge().fit(models.assemble(train, ["a", "b"], "y_true"))
    out = fit.predict(models.assemble(test, ["a", "b"], None))
    return out.select("row_id", "y_true", "y_pred", r6("score").alias("score"))


FOLD_YEARS = """(SELECT DISTINCT CAST(substr(campagne_calc, 1, 4) AS INTEGER) AS s FROM {t} WHERE campagne_calc <> '2023-2024'
  AND CAST(substr(campagne_calc, 1, 4) AS INTEGER) > (SELECT min(CAST(substr(campagne_calc, 1, 4) AS INTEGER)) FROM {t}))"""
_YEAR = "CAST(substr(campagne_calc, 1, 4) AS INTEGER)"
_LEVEL = "CAST(greatest(0, least(3, round_even({raw}, 0))) AS INTEGER)"


@query("L3_ridge_folds", f"""
WITH d AS (SELECT id, campagne_calc, {_YEAR} AS s, y_true AS y, [score, {u('id', 77)}] AS x FROM preds_v),
f AS (SELECT a.s AS g, d.* FROM {FOLD_YEARS.format(t='preds_v')} a JOIN d ON d.s < a.s),
c AS (SELECT g, y, count(*) AS n FROM f GROUP BY 1, 2), k AS (SELECT g, count(*) AS k, sum(n) AS n FROM c GROUP BY 1),
fits AS {fits_sql("SELECT f.g, k.n / CAST(k.k * c.n AS DOUBLE) AS w, x, f.y FROM f JOIN c ON c.g = f.g AND c.y = f.y JOIN k ON k.g = f.g", 2, RIDGE)},
p AS (SELECT id AS row_id, campagne_calc, d.y AS y_true, a + list_dot_product(b, x) AS raw FROM d JOIN fits ON fits.g = d.s)
SELECT row_id, campagne_calc, y_true, {_LEVEL.format(raw='raw')} AS y_pred, round(1 / (1 + exp(-(raw - 0.5e0))), 6) AS score FROM p""")
def _(v: Views):
    """Every walk-forward fold of the ridge from one scan for the sums of products and one for the predictions."""
    df = v.preds.select(F.col("id").alias("row_id"), "campagne_calc", "y_true", "score", draw("id", 77).alias("b")).withColumnRenamed("score", "a")
    return scored(models.walk_forward_ridge(models.assemble(df, ["a", "b"], "y_true"))[0])


MEDIANS_OF = ["ndvi_mean", "lst_mean", "chirps_sum_mean", "chirps_sum_mean_lag1d", "severite_lag2"]


@query("F16_expanding_medians", f"""
WITH o AS (SELECT *, {_YEAR} AS s FROM training_v WHERE severite IS NOT NULL), f AS (SELECT a.s AS start, o.* EXCLUDE (s) FROM {FOLD_YEARS.format(t='(SELECT * FROM training_v WHERE severite IS NOT NULL)')} a JOIN o ON o.s < a.s)
SELECT * FROM (""" + " UNION ALL ".join(f"SELECT start, '{c}' AS feature, round(median({c}), 6) AS median FROM f GROUP BY 1" for c in MEDIANS_OF) + ") q WHERE median IS NOT NULL")
def _(v: Views):
    """Medians of each fold's own training seasons."""
    t = clean.observed(training_stage(v))
    starts = [int(test.split("-")[0]) for _, test in training.fold_list(training.walk_forward_folds(t))]
    counts = order.counts_by_season(t, MEDIANS_OF, cal.campaign_start_year("campagne_calc"))
    return order.expanding_medians(counts, starts).withColumn("median", r6("median"))


@query("J12_fold_fill", f"""
WITH o AS (SELECT *, {_YEAR} AS s FROM training_v WHERE severite IS NOT NULL), l AS (SELECT max(s) AS s FROM {FOLD_YEARS.format(t='(SELECT * FROM training_v WHERE severite IS NOT NULL)')} a),
m AS (SELECT """ + ", ".join(f"median({c}) AS m_{c}" for c in MEDIANS_OF) + " FROM o, l WHERE o.s < l.s) SELECT campagne_calc, " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS filled_{c}, round(avg(coalesce({c}, m_{c})), 6) AS {c}" for c in MEDIANS_OF) + " FROM o, m GROUP BY 1")
def _(v: Views):
    """Rows of the last fold filled with the medians of its training seasons."""
    t = clean.observed(training_stage(v))
    last = max(int(test.split("-")[0]) for _, test in training.fold_list(training.walk_forward_folds(t)))
    found = order.expanding_medians(order.counts_by_season(t, MEDIANS_OF, cal.campaign_start_year("campagne_calc")), [last])
    raw = t.select("campagne_calc", *MEDIANS_OF, *[F.col(c).isNull().alias(f"n_{c}") for c in MEDIANS_OF])
    filled = order.with_fold_fill(raw, MEDIANS_OF, found, last)
    return filled.groupBy("campagne_calc").agg(*[e for c in MEDIANS_OF for e in (F.count_if(f"n_{c}").alias(f"filled_{c}"), F.round(F.avg(c), 6).alias(c))])


@query("L4_all_threshold")
def _(v: Views):
    train, test = last_fold(observed(v))
    return scored(models.AllThresholdLogistic().fit(train).predict(test))


def _single(v: Views, name: str, **sizes):
    train, test = last_fold(observed(v))
    return scored(models.fit_predict(models.registry(**sizes)[name], train, test))


@query("L5_random_forest")
def _(v: Views):
    return _single(v, "random_forest", trees=300)


@query("L6_boosted_trees")
def _(v: Views):
    return _single(v, "lightgbm", trees=20)


@query("L7_extra_trees")
def _(v: Views):
    return _single(v, "extra_trees", trees=20)


@query("L8_dense_net")
def _(v: Views):
    return _single(v, "mlp", max_iter=300)


@query("L9_stratified_random", f"""
WITH last AS (SELECT max(campagne_calc) AS c FROM preds_v), n AS (SELECT y_true AS y, count(*) AS n FROM preds_v, last WHERE campagne_calc <> c GROUP BY 1),
k AS (SELECT y, sum(n) OVER (ORDER BY y) / CAST(sum(n) OVER () AS DOUBLE) AS upto FROM n),
r AS (SELECT id AS row_id, y_true, {u('id', 42)} AS x FROM preds_v, last WHERE campagne_calc = c)
SELECT row_id, y_true, CAST(min(k.y) AS INTEGER) AS y_pred FROM r JOIN k ON r.x < k.upto GROUP BY 1, 2""")
def _(v: Views):
    df = v.preds.select(F.col("id").alias("row_id"), "campagne_calc", "y_true", F.col("y_true").alias("y"))
    train, test = last_fold(df)
    return models.StratifiedRandom().fit(train).predict(test).select("row_id", "y_true", "y_pred")


def _small_forest():
    return models.Classifier(lambda n, k: RandomForestClassifier(numTrees=4, maxDepth=5, seed=1))


@query("L10_hard_vote")
def _(v: Views):
    train, test = last_fold(observed(v))
    return scored(models.HardVote([models.Ridge, models.AllThresholdLogistic, _small_forest]).fit(train).predict(test))


@query("L11_stacking")
def _(v: Views):
    train, test = last_fold(observed(v))
    return scored(models.Stacking([models.Forest, lambda: models.Boosted(200, 5)]).fit(train).predict(test))


REGION_FEATURES = ["rn_num", "campagne_decade", "chirps_sum_mean", "c_sin", "c_cos"]


def region_stage(v: Views):
    """Region table with densities, a numeric feature vector and a row key, as a stage table."""
    t = training.with_median_density(v.regions, training.median_density(v.region_rows))
    a = F.col("campagne_decade") * 0.2
    t = t.withColumns({"c_sin": F.sin(a), "c_cos": F.cos(a)})
    t = t.withColumn("row_id", F.col("rn_num") * 100000 + cal.campaign_ordinal("campagne_calc", "campagne_decade"))
    t = t.withColumn("row_id", F.col("row_id").cast("bigint"))
    return stored(v, models.assemble(t, REGION_FEATURES, None), "regions")


def region_folds(df):
    return training.fold_list(training.split_folds(df).drop("split"))


@query("L12_presence_model")
def _(v: Views):
    df = region_stage(v)
    lab = clean.labeled_splits(df)
    train, test = lab.filter("split = 'train'"), lab.filter("split = 'validation'")
    out = models.PresenceModel(rounds=40, depth=5).fit(train).predict(test)
    return out.select("row_id", "campagne_calc", "label", r6("score").alias("score"))


@query("L13_density_model")
def _(v: Views):
    df = region_stage(v).filter("label = 1 and densite_imago_median is not null")
    out = models.DensityModel(rounds=40, depth=5).fit(df.filter("split = 'train'")).predict(df.filter("split = 'validation'"))
    return out.select("row_id", r6("densite_imago_median").alias("densite_imago_median"), r6("densite_pred").alias("densite_pred"))


@query("L14_phase_model")
def _(v: Views):
    df = clean.phase_rows(region_stage(v))
    out = models.PhaseModel(rounds=300, depth=5).fit(df.filter("split = 'train'")).predict(df.filter("split = 'validation'"))
    return out.select("row_id", "niveau_gregarite_dominant", *[r6(F.get("phase_p", F.lit(i))).alias(f"p_{p}") for i, p in enumerate(("S", "St", "T", "G"))])


@query("L14_phase_rounds")
def _(v: Views):
    """Rounds that each phase keeps out of the 300 allowed, when its held-out loss decides."""
    model = models.PhaseModel(rounds=300, depth=5).fit(clean.phase_rows(region_stage(v)).filter("split = 'train'"))
    kept = [(PHASES[c], n, 300) for c, n in model.inner.rounds_kept.items()]
    return v.spark.createDataFrame(kept, "phase string, rounds int, allowed int")


@query("L15_hierarchical")
def _(v: Views):
    df = region_stage(v)
    lab = clean.labeled_splits(df)
    pres = lab.filter("label = 1")
    low, low_g = models.searched_thresholds(lab.filter("split = 'train'"), lab.filter("split = 'validation'"),
                                            models.PresenceModel, models.PhaseModel)
    m1 = models.PresenceModel().fit(lab)
    m2 = models.DensityModel().fit(pres.filter("densite_imago_median is not null"))
    m3 = models.PhaseModel().fit(clean.phase_rows(lab))
    keys = ["rn_num", "rn_nom", "campagne_calc", "campagne_decade"]
    out = models.predict_hierarchical(df.filter("split = 'inference'"), m1, m2, m3, low, low_g, keys)
    return out.withColumn("densite_pred", r6("densite_pred"))


@query("L12_presence_walk_forward")
def _(v: Views):
    """Presence folds with the pooled row."""
    df = clean.labeled_splits(region_stage(v))
    report, _, _ = models.walk_forward_presence(df, region_folds(df), lambda: models.PresenceModel(rounds=3, depth=3))
    return report


@query("F22_fold_importances")
def _(v: Views):
    """Importance of each feature in the presence model, mean and deviation over the walk-forward folds."""
    df = clean.labeled_splits(region_stage(v))
    _, _, importances = models.walk_forward_presence(df, region_folds(df), lambda: models.PresenceModel(rounds=3, depth=3), REGION_FEATURES)
    return selection.importance_summary(importances)


@query("L14_two_stage_walk_forward")
def _(v: Views):
    """Density and phase metrics per validation campaign and pooled, with the size gates."""
    df = clean.labeled_splits(region_stage(v))
    table = training.split_folds(df)
    folds = training.fold_list(table.drop("split"))
    sizes = {r["fold_id"]: (r["fit_density"], r["fit_phase"]) for r in models.fold_sizes(df, table).collect()}
    gates = {test: sizes[i] for i, (_, test) in enumerate(folds, 1)}
    return models.walk_forward_two_stage(df, folds, gates, lambda: models.DensityModel(rounds=3, depth=3), lambda: models.PhaseModel(rounds=1, depth=3))


@query("L16_model_registry")
def _(v: Views):
    """Every registered model on one fold: levels predicted per model. Fits run a few at a time over the stored rows."""
    train, test = last_fold(observed(v))

    def one(name: str, spec):
        p = models.fit_predict(spec, train, test).groupBy("y_pred").agg(F.count("*").alias("n"))
        return order.stored(p.select(F.lit(name).alias("modele"), F.lit(spec.framing).alias("cadrage"), F.lit(spec.complexity).alias("complexite"), "y_pred", "n"))

    return reduce(DataFrame.unionByName, models.in_threads(v.spark, [lambda n=n, s=s: one(n, s) for n, s in models.registry().items()]))


def light_models():
    reg = models.registry(trees=4)
    return {n: reg[n] for n in ("dummy_stratified", "regression_ordinale", "mord_logistic_at", "random_forest")}


@query("L17_fit_predict")
def _(v: Views):
    """Both framings on one fold; classes are re-encoded when the training rows miss a level."""
    train, test = last_fold(observed(v))
    reg = light_models()
    a = scored(models.fit_predict(reg["regression_ordinale"], train, test)).withColumn("cadrage", F.lit("regression"))
    b = scored(models.fit_predict(reg["random_forest"], train.filter("y <> 2"), test)).withColumn("cadrage", F.lit("multiclass"))
    return a.unionByName(b)


@query("L18_benchmark")
def _(v: Views):
    specs = dict(light_models())
    specs["broken"] = models.ModelSpec("multiclass", 9, lambda: models.Classifier(lambda n, k: (_ for _ in ()).throw(RuntimeError("fails"))))
    out, _ = models.benchmark(observed(v), specs)  # observed_by_fold, with prepare, fills each fold by itself: 109 s instead of 88 s at the smallest scale
    return out


@query("L18_chosen_report")
def _(v: Views):
    """Benchmark, choice, and the walk-forward report of the chosen model with its calibration gap, per season."""
    reg = models.registry()
    specs = {n: reg[n] for n in ("dummy_stratified", "regression_ordinale", "mord_logistic_at")}
    found, preds = models.benchmark(observed(v), specs)
    summary = selection.model_summary(found, models.complexities(specs))
    path = scratch_dir(v.spark, "choice")
    sinks.write_choice(selection.rank_robust(summary, selection.baseline_value(summary, BASELINE_MODEL)), path)
    record = v.spark.read.schema("classement ARRAY<STRING>, modele_retenu STRING").json(path)
    own = preds.filter(F.col("modele") == sinks.chosen_model(record)).withColumn("label", (F.col("y_true") >= 1).cast("int"))
    bins = metrics.calibration(own, keys=["campagne_calc"])
    gap = bins.groupBy("campagne_calc").agg(F.round(F.sum(F.col("n") * F.abs(F.col("proba_moyenne") - F.col("freq_observee"))) / F.sum("n"), 4).alias("ecart_calibration"))
    names = own.groupBy("campagne_calc").agg(F.max("modele").alias("modele"))
    return names.join(metrics.campaign_report(own), "campagne_calc").join(gap, "campagne_calc")


@query("L19_fold_gates", """
WITH r AS (SELECT r.*, m.d FROM regions_v r LEFT JOIN (SELECT rn_num, campagne_calc, campagne_decade, median(densite_imago) AS d FROM region_rows_v WHERE densite_imago IS NOT NULL GROUP BY 1, 2, 3) m USING (rn_num, campagne_calc, campagne_decade)),
s AS (SELECT DISTINCT campagne_calc AS campagne, split, CAST(substr(campagne_calc, 1, 4) AS INTEGER) AS y FROM regions_v WHERE split <> 'inference'),
t AS (SELECT *, CAST(row_number() OVER (ORDER BY y) AS INTEGER) AS fold_id FROM s WHERE split = 'validation'),
f AS (SELECT fold_id, 'test' AS role, campagne FROM t UNION ALL SELECT t.fold_id, 'train', s.campagne FROM t JOIN s ON s.split = 'train' OR s.y < t.y),
g AS (SELECT fold_id, count(*) FILTER (WHERE role = 'train' AND d IS NOT NULL) AS den_train, count(*) FILTER (WHERE role = 'test' AND d IS NOT NULL) AS den_val,
  count(*) FILTER (WHERE role = 'train' AND niveau_gregarite_dominant IN ('S', 'St', 'T', 'G')) AS ph_train, count(*) FILTER (WHERE role = 'test' AND niveau_gregarite_dominant IN ('S', 'St', 'T', 'G')) AS ph_val,
  count(DISTINCT CASE WHEN role = 'train' AND niveau_gregarite_dominant IN ('S', 'St', 'T', 'G') THEN niveau_gregarite_dominant END) AS ph_classes
  FROM f LEFT JOIN r ON r.campagne_calc = f.campagne AND r.label = 1 GROUP BY 1)
SELECT *, den_train >= 10 AND den_val >= 2 AS fit_density, ph_train >= 10 AND ph_val >= 2 AND ph_classes >= 2 AS fit_phase FROM g""")
def _(v: Views):
    t = training.with_median_density(v.regions, training.median_density(v.region_rows))
    return models.fold_sizes(t, training.split_folds(t))


L20_SQL = f"""
WITH o AS (SELECT * FROM training_v WHERE severite IS NOT NULL), med AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in FEATURES)} FROM o),
x AS (SELECT t.*, [{', '.join(f'CAST(coalesce({c}, m_{c}) AS DOUBLE)' for c in FEATURES)}] AS x FROM training_v t, med),
c AS (SELECT severite, count(*) AS n FROM o GROUP BY 1), k AS (SELECT count(*) AS k, sum(n) AS n FROM c),
target AS (SELECT coalesce(max(CASE WHEN couverture >= 0.4 THEN campagne_calc END), max(campagne_calc)) AS target FROM {COVERAGE_SQL} q),
fits AS {fits_sql("SELECT 0 AS g, k.n / CAST(k.k * c.n AS DOUBLE) AS w, x, x.severite AS y FROM x JOIN c ON c.severite = x.severite, k", len(FEATURES), RIDGE)},
p AS (SELECT cell_id, AIRE_CODE, campagne_calc, campagne_decade, a + list_dot_product(b, x) AS raw FROM x, fits, target WHERE a_predire AND campagne_calc = target)
SELECT cell_id, CAST(AIRE_CODE AS DOUBLE) AS AIRE_CODE, campagne_calc, CAST(campagne_decade AS DOUBLE) AS campagne_decade, {_LEVEL.format(raw='raw')} AS severite, round(1 / (1 + exp(-(raw - 0.5e0))), 6) AS proba_presence,
  CAST({_LEVEL.format(raw='raw')} >= 1 AS INTEGER) AS presence FROM p"""


@query("L20_predict_target", L20_SQL)
def _(v: Views):
    t = training_stage(v)
    medians = order.column_medians(clean.observed(t), FEATURES)
    target = outputs.target_campaign(clean.to_predict(t), minimum=0.4).scalar()
    out = models.predict_target(t, FEATURES, medians, target, models.registry()["regression_ordinale"])
    return out.withColumn("proba_presence", r6("proba_presence"))


# --- M. metrics -----------------------------------------------------------------------------------------------------

AUC_SQL = """SELECT {k}, CASE WHEN min(label) < max(label) THEN (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2e0) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label))) END AS auc
  FROM (SELECT {k}, label, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2e0 AS r FROM {src}) a GROUP BY {k}"""


def auc_sql(k: str, src: str) -> str:
    return AUC_SQL.format(k=k, src=src)


@query("M1_auc", f"SELECT campagne_calc, round(auc, 6) AS auc_roc, (SELECT round(auc, 6) FROM ({auc_sql('one', '(SELECT *, 1 AS one FROM preds_v) z')}) g) AS auc_global FROM ({auc_sql('campagne_calc', 'preds_v')}) q")
def _(v: Views):
    pooled = metrics.auc(v.preds).select(r6("auc_roc")).scalar()
    return metrics.auc(v.preds, keys=["campagne_calc"]).select("campagne_calc", r6("auc_roc").alias("auc_roc"), pooled.alias("auc_global"))


PRF = "coalesce(round({tp} / nullif({tp} + {fp}, 0), 4), 0) AS precision, coalesce(round({tp} / nullif({tp} + {fn}, 0), 4), 0) AS recall, coalesce(round(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 4), 0) AS f1"


@query("M2_precision_recall", """
SELECT campagne_calc, """ + PRF.format(tp="tp", fp="fp", fn="fn") + """ FROM (SELECT campagne_calc, CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE score < 0.5 AND label = 1) AS DOUBLE) AS fn FROM preds_v GROUP BY 1) q""")
def _(v: Views):
    return metrics.precision_recall(v.preds, 0.5, keys=["campagne_calc"])


GRID = "(SELECT unnest(range(1, 47)) AS k, unnest([" + ", ".join(f"{t!r}e0" for t in THRESHOLDS) + "]) AS t)"


def best_sql(key: str, src: str) -> str:
    return f"""(SELECT {key}, coalesce(arg_max(t, (f1, -k)) FILTER (WHERE f1 IS NOT NULL), 0.20e0) AS threshold FROM (
  SELECT {key}, k, t, CASE WHEN tp + fp > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM (
    SELECT {key}, k, t, CAST(count(*) FILTER (WHERE score >= t AND label = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE score >= t AND label = 0) AS fp, count(*) FILTER (WHERE score < t AND label = 1) AS fn
    FROM {src} CROSS JOIN {GRID} g GROUP BY 1, 2, 3) a) b GROUP BY 1)"""


HARD = "(SELECT id, campagne_calc, label, round(score * 0.5e0, 6) AS score FROM preds_v)"


def hard(v: Views):
    """Predictions whose scores stay inside the threshold grid."""
    return v.preds.withColumn("score", r6(F.col("score") * 0.5))


@query("M3_f1_threshold", f"SELECT campagne_calc, round(threshold, 6) AS threshold FROM {best_sql('campagne_calc', HARD + ' h')} q")
def _(v: Views):
    return metrics.best_f1_threshold(hard(v), keys=["campagne_calc"]).withColumn("threshold", r6("threshold"))


@query("M4_quadratic_kappa", """
WITH o AS (SELECT campagne_calc, y_true AS i, y_pred AS j, CAST(count(*) AS DOUBLE) AS n FROM preds_v GROUP BY 1, 2, 3), r AS (SELECT campagne_calc, i, sum(n) AS n FROM o GROUP BY 1, 2), c AS (SELECT campagne_calc, j, sum(n) AS n FROM o GROUP BY 1, 2),
t AS (SELECT campagne_calc, sum(n) AS n FROM o GROUP BY 1), e AS (SELECT r.campagne_calc, sum((i - j) * (i - j) * r.n * c.n) / any_value(t.n) AS e FROM r JOIN c USING (campagne_calc) JOIN t USING (campagne_calc) GROUP BY 1)
SELECT o.campagne_calc, round(1 - sum((i - j) * (i - j) * n) / any_value(e.e), 6) AS qwk FROM o JOIN e USING (campagne_calc) GROUP BY 1""")
def _(v: Views):
    return v.preds.groupBy("campagne_calc").agg(r6(metrics.quadratic_kappa()).alias("qwk"))


@query("M5_recall_high", "SELECT campagne_calc, round(count(*) FILTER (WHERE y_true >= 2 AND y_pred >= 2) / CAST(count(*) FILTER (WHERE y_true >= 2) AS DOUBLE), 6) AS recall_23 FROM preds_v GROUP BY 1")
def _(v: Views):
    return v.preds.groupBy("campagne_calc").agg(r6(metrics.recall_high()).alias("recall_23"))


@query("M6_regression_errors", "SELECT campagne_calc, round(sqrt(avg((y_true - score) * (y_true - score))), 4) AS rmse_densite, round(avg(abs(y_true - score)), 4) AS mae_densite FROM preds_v GROUP BY 1")
def _(v: Views):
    return metrics.regression_errors(v.preds, "y_true", "score", ["campagne_calc"])


F1_SQL = """SELECT {k}, sum(coalesce(2 * tp / nullif(act + sai, 0), 0)) / 4 AS f1, coalesce(sum(CASE WHEN c = 3 THEN tp END) / nullif(sum(CASE WHEN c = 3 THEN act END), 0), 0) AS rg FROM (
  SELECT {k}, c, CAST(count(*) FILTER (WHERE y = c AND p = c) AS DOUBLE) AS tp, count(*) FILTER (WHERE y = c) AS act, count(*) FILTER (WHERE p = c) AS sai FROM {src} CROSS JOIN (SELECT unnest(range(4)) AS c) k4 GROUP BY {k}, c) z GROUP BY {k}"""


@query("M7_phase_report", "SELECT campagne_calc, round(f1, 4) AS f1_macro_phase, round(rg, 4) AS recall_G FROM (" + F1_SQL.format(k="campagne_calc", src="(SELECT campagne_calc, y_true AS y, y_pred AS p FROM preds_v) s") + ") q")
def _(v: Views):
    return metrics.phase_report(v.preds, keys=["campagne_calc"])


@query("M8_target_threshold", "SELECT campagne_calc, round(coalesce(arg_max(t, (rg, -k)) FILTER (WHERE f1 >= 0.30), 0.15e0), 6) AS threshold_G FROM (" + F1_SQL.format(
    k="campagne_calc, k, t", src=f"(SELECT campagne_calc, k, t, y_true AS y, {PHASE_AT.format(t='t')} AS p FROM {PROBS_SQL} pr CROSS JOIN {GRID} g) s") + ") q GROUP BY 1")
def _(v: Views):
    return metrics.best_target_threshold(probabilities(v), "p", keys=["campagne_calc"]).withColumn("threshold_G", r6("threshold_G"))


@query("M9_calibration", "SELECT CAST((SELECT count(*) FROM range(1, 10) e(i) WHERE i * 0.1e0 <= score) AS INTEGER) AS bin, round(avg(score), 6) AS proba_moyenne, round(avg(label), 6) AS freq_observee, count(*) AS n FROM preds_v GROUP BY 1")
def _(v: Views):
    return metrics.calibration(v.preds).withColumns({"proba_moyenne": r6("proba_moyenne"), "freq_observee": r6("freq_observee")})


@query("M10_gain_lift", GAIN_SQL.replace("10e0", "7e0").replace("q = 10", "q = 7").replace("range(1, 11)", "range(1, 8)").replace("ORDER BY score DESC", "ORDER BY floor(score * 4) DESC"))
def _(v: Views):
    """Five distinct scores only: every cut falls inside a large tie."""
    return metrics.gain_lift(v.preds.withColumn("score", F.floor(F.col("score") * 4)), "label", "score", "id", bins=7)


@query("M11_campaign_report", f"SELECT r.campagne_calc, r.qwk, r.recall_23, r.n, round(a.auc, 6) AS auc_binaire FROM ({REPORT_SQL}) r JOIN ({auc_sql('campagne_calc', 'preds_v')}) a USING (campagne_calc)")
def _(v: Views):
    return metrics.campaign_report(v.preds).withColumn("auc_binaire", r6("auc_binaire"))


def binary_sql(key: str, src: str) -> str:
    """AUC and metrics at the best threshold."""
    return f"""SELECT s.{key}, n_positifs, n_negatifs, round(a.auc, 4) AS auc_roc, {PRF.format(tp='tp', fp='fp', fn='fn')}, round(s.threshold, 4) AS threshold FROM (
  SELECT h.{key}, b.threshold, count(*) FILTER (WHERE label = 1) AS n_positifs, count(*) FILTER (WHERE label = 0) AS n_negatifs, CAST(count(*) FILTER (WHERE score >= threshold AND label = 1) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (WHERE score >= threshold AND label = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE score < threshold AND label = 1) AS DOUBLE) AS fn
  FROM {src} h JOIN {best_sql(key, src + ' h2')} b ON b.{key} = h.{key} GROUP BY 1, 2) s JOIN ({auc_sql(key, src + ' h3')}) a ON a.{key} = s.{key}"""


HORIZON_SRC = f"""(SELECT 'decadaire' AS horizon, CAST(y AS INTEGER) AS label, p AS score FROM (SELECT y, lag(yhat1, 1) OVER (PARTITION BY ID ORDER BY ds) AS p FROM {FIT_SQL} f) g WHERE y IS NOT NULL AND p IS NOT NULL)"""


@query("M12_horizon_report", f"""
SELECT k.horizon, auc_roc, precision, recall, f1, threshold FROM (SELECT unnest(['decadaire', 'mensuel', 'saisonnier']) AS horizon) k
LEFT JOIN (SELECT * FROM ({binary_sql('horizon', HORIZON_SRC)}) b WHERE n_positifs > 0 AND n_negatifs > 0) r USING (horizon)""")
def _(v: Views):
    p = panel.shift_forecast(fitted_panel(v), {"decadaire": 1})
    return metrics.horizon_report(p.withColumn("pred_3", F.lit(None).cast("double")))


@query("F26_binary_with_global", binary_sql("campagne_calc", "(SELECT label, score, unnest([campagne_calc, 'GLOBAL']) AS campagne_calc FROM preds_v)"))
def _(v: Views):
    return metrics.binary_report_with_global(v.preds)


@query("M13_agreement", """
WITH o AS (SELECT campagne_calc, y_true AS i, y_pred AS j, count(*) AS n FROM preds_v GROUP BY 1, 2, 3), t AS (SELECT campagne_calc, sum(n) AS n, sum(n) FILTER (WHERE i = j) / CAST(sum(n) AS DOUBLE) AS po, sum(n) FILTER (WHERE abs(i - j) <= 1) / CAST(sum(n) AS DOUBLE) AS p1 FROM o GROUP BY 1),
r AS (SELECT campagne_calc, i AS l, sum(n) AS n FROM o GROUP BY 1, 2), c AS (SELECT campagne_calc, j AS l, sum(n) AS n FROM o GROUP BY 1, 2), e AS (SELECT campagne_calc, sum(CAST(r.n AS DOUBLE) * c.n) AS s FROM r JOIN c USING (campagne_calc, l) GROUP BY 1)
SELECT t.campagne_calc, CAST(t.n AS BIGINT) AS n, round(po, 6) AS accord_exact, round(p1, 6) AS accord_pm1, round((po - s / (CAST(t.n AS DOUBLE) * t.n)) / (1 - s / (CAST(t.n AS DOUBLE) * t.n)), 6) AS kappa FROM t JOIN e USING (campagne_calc)""")
def _(v: Views):
    a = metrics.agreement(v.preds, "y_true", "y_pred", ["campagne_calc"])
    return a.select("campagne_calc", "n", *[r6(c).alias(c) for c in ("accord_exact", "accord_pm1", "kappa")])


@query("M14_target_status", """
SELECT metric, round(value, 4) AS value, target, CASE WHEN target IS NULL THEN '' WHEN value >= target THEN 'reached' ELSE 'missed' END AS status FROM (
  SELECT unnest(['auc_roc', 'recall', 'qwk']) AS metric, unnest([0.85e0, 0.30e0, NULL]) AS target, unnest([(SELECT auc FROM (%s) g), (SELECT avg(label) FROM preds_v), (SELECT avg(qwk) FROM detail_v)]) AS value) q""" % auc_sql("one", "(SELECT *, 1 AS one FROM preds_v) z"))
def _(v: Views):
    q = detail(v).agg(F.avg("qwk").alias("q")).scalar()
    vals = metrics.auc(v.preds).select("auc_roc", v.preds.agg(F.avg("label").alias("r")).scalar().alias("recall"), q.alias("qwk"), F.lit(None).cast("double").alias("absent"))
    return metrics.target_status(vals, {"auc_roc": 0.85, "recall": 0.30})


# --- N. selection -------------------------------------------------------------------------------------------------------

@query("N1_model_summary", "SELECT * FROM summary_v")
def _(v: Views):
    return selection.model_summary(detail(v), MODELS)


@query("N2_robust_ranking", RANK_SQL.replace("(SELECT max(qwk) FROM summary_v WHERE modele = 'model_2')", "0.2"))
def _(v: Views):
    return selection.rank_robust(selection.model_summary(detail(v), MODELS), 0.2)


ERFC = "(((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t} * exp(-{x} * {x}))".format(
    t="(1 / (1 + 0.3275911e0 * abs(z) / sqrt(2)))", x="(abs(z) / sqrt(2))")
WILCOXON_SQL = f"""
WITH d AS (SELECT a.modele AS modele_a, b.modele AS modele_b, a.recall_23 AS va, b.recall_23 AS vb, round(a.recall_23 - b.recall_23, 12) AS d FROM detail_v a JOIN detail_v b USING (campagne_calc) WHERE a.modele < b.modele AND a.recall_23 IS NOT NULL AND b.recall_23 IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY modele_a, modele_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY modele_a, modele_b, abs(d)) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY modele_a, modele_b, abs(d)) AS ties FROM d WHERE d <> 0),
s AS (SELECT modele_a, modele_b, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, count(*) AS n, max(ties) AS ties, sum(ties * ties - 1) AS tie FROM r GROUP BY 1, 2),
sub AS (SELECT n, m, list_sum(list_transform(range(n), lambda b: CASE WHEN (m >> b) & 1 = 1 THEN b + 1 ELSE 0 END)) AS tot FROM (SELECT DISTINCT n, unnest(range(CAST(pow(2, n) AS BIGINT))) AS m FROM s) x),
p AS (SELECT modele_a, modele_b, w, s.n, ties, tie, least(1, 2e0 * count(*) FILTER (WHERE sub.tot <= s.w) / pow(2, s.n)) AS p_exact FROM s JOIN sub USING (n) GROUP BY modele_a, modele_b, w, s.n, ties, tie),
m AS (SELECT modele_a, modele_b, count(*) AS n_paires, avg(va) AS ma, avg(vb) AS mb FROM d GROUP BY 1, 2),
z AS (SELECT m.*, p.n, p.w, p.ties, p.p_exact, (w - n * (n + 1) / 4e0) / sqrt((n * (n + 1) * (2 * n + 1) - tie / 2e0) / 24e0) AS z FROM m LEFT JOIN p USING (modele_a, modele_b)),
f AS (SELECT *, n_paires >= 5 AND n IS NOT NULL AS usable, CASE WHEN n_paires < 5 THEN NULL WHEN n IS NULL THEN 1 WHEN ties = 1 AND n = n_paires THEN p_exact ELSE least(1, {ERFC}) END AS p FROM z)
SELECT modele_a, modele_b, n_paires, CASE WHEN usable THEN round(ma, 4) END AS mean_a, CASE WHEN usable THEN round(mb, 4) END AS mean_b, CASE WHEN usable THEN round(ma - mb, 4) END AS diff_a_minus_b,
  CASE WHEN n_paires < 5 THEN NULL WHEN n IS NULL THEN 0 ELSE round(w, 2) END AS statistic, round(p, 4) AS p_value, coalesce(p < 0.05, false) AS significatif_05 FROM f"""


@query("N3_wilcoxon", WILCOXON_SQL)
def _(v: Views):
    return selection.wilcoxon_pairs(detail(v))


@query("N4_bootstrap", f"""
WITH i AS (SELECT modele, recall_23 AS v, row_number() OVER (PARTITION BY modele ORDER BY campagne_calc) - 1 AS i, count(*) OVER (PARTITION BY modele) AS n FROM detail_v WHERE recall_23 IS NOT NULL),
s AS (SELECT modele, any_value(n) AS n, avg(v) AS mean FROM i GROUP BY 1), k AS (SELECT s.modele, n, rep, CAST(unnest(range(n)) AS BIGINT) AS k FROM s CROSS JOIN (SELECT unnest(range(500)) AS rep) r),
dr AS (SELECT modele, rep, CAST(floor(({u('(rep * 1009 + k * 31)', 7)}) * n) AS BIGINT) AS i FROM k),
b AS (SELECT modele, rep, avg(v) AS m FROM dr JOIN i USING (modele, i) GROUP BY 1, 2), q AS (SELECT modele, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM b GROUP BY 1)
SELECT modele, round(mean, 4) AS recall_mean, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, round(hi - lo, 4) AS ci_width FROM s JOIN q USING (modele)""")
def _(v: Views):
    return selection.bootstrap_interval(detail(v))


@query("N5_campaign_drilldown", "SELECT modele, qwk, recall_23 FROM detail_v WHERE campagne_calc = '1998-1999'")
def _(v: Views):
    return selection.campaign_drilldown(detail(v), "1998-1999")


@query("N6_deployment", """
SELECT *, CASE WHEN (SELECT round(avg(recall_23), 4) FROM detail_v WHERE modele = 'model_5') > (SELECT round(avg(recall_23), 4) FROM detail_v WHERE modele = 'model_1') THEN 'deploy' ELSE 'keep_baseline' END AS decision FROM (
  SELECT 'panel' AS modele, 'decadaire' AS horizon, round(avg(recall_23), 4) AS auc_global, round(avg(qwk), 4) AS f1_global, 12.3e0 AS temps_train_min FROM detail_v WHERE modele = 'model_5' UNION ALL
  SELECT 'panel', 'mensuel', round(avg(recall_23), 4), round(avg(qwk), 4), 12.3e0 FROM detail_v WHERE modele = 'model_4' UNION ALL
  SELECT 'baseline', 'decadaire', round(avg(recall_23), 4), round(avg(qwk), 4), NULL FROM detail_v WHERE modele = 'model_1') q""")
def _(v: Views):
    d = detail(v).groupBy("modele").agg(F.avg("recall_23").alias("auc_global"), F.avg("qwk").alias("f1_global"))
    cand = d.filter("modele in ('model_5', 'model_4')").select(F.when(F.col("modele") == "model_5", "decadaire").otherwise("mensuel").alias("horizon"), "auc_global", "f1_global")
    return selection.deployment_decision(cand, d.filter("modele = 'model_1'").select("auc_global", "f1_global"), 12.3)


@query("N7_baseline_constraint", "SELECT modele, qwk, (SELECT max(qwk) FROM summary_v WHERE modele = 'model_2') AS baseline_qwk, qwk >= (SELECT max(qwk) FROM summary_v WHERE modele = 'model_2') AS eligible FROM summary_v")
def _(v: Views):
    s = selection.model_summary(detail(v), MODELS)
    base = selection.baseline_value(s, "model_2")
    return s.select("modele", "qwk", base.alias("baseline_qwk"), (F.col("qwk") >= base).alias("eligible"))


# --- P. panel -------------------------------------------------------------------------------------------------------------

@query("P1_complete_panel", PANEL_SQL)
def _(v: Views):
    return panel.complete_panel(v.regions, v.regions.select("rn_num"))


def panel_split(v: Views):
    r = stored(v, v.regions, "regions")
    ids = r.select("rn_num").distinct()
    y = cal.campaign_start_year("campagne_calc")
    return panel.complete_panel(r.filter(y < 1999), ids), panel.complete_panel(r.filter(y >= 1999), ids)


_DAY = "datediff('day', DATE '1994-10-01', ds)"
_PENALTY = "CASE WHEN var > 0 THEN 1e-3 / sqrt(var_y) * var ELSE 1e0 END"
_CUT = "DATE '2001-10-01' - 600"
PANEL_FIT = f"""grid AS MATERIALIZED (SELECT *, {panel_columns(_DAY)} AS x FROM ({PANEL_SQL}) p),
fits AS {fits_sql(f"SELECT 0 AS g, 1e0 AS w, x, y FROM grid WHERE y IS NOT NULL AND ds < {_CUT}", 11, _PENALTY)},
hat AS (SELECT ID, ds, y, a + list_dot_product(b, x) AS yhat1 FROM grid, fits)"""


@query("P2_panel_model", f"WITH {PANEL_FIT} SELECT ID, ds, y, round(yhat1, 6) AS yhat1 FROM hat WHERE ds >= {_CUT}")
def _(v: Views):
    train, val = panel_split(v)
    return panel.PanelModel(origin="1994-10-01").fit(train).predict(val).select("ID", "ds", "y", r6("yhat1").alias("yhat1"))


@query("P3_rolling_forecast", f"""WITH {PANEL_FIT}, l AS (SELECT ID, ds, y, round(lag(yhat1, 1) OVER (PARTITION BY ID ORDER BY ds), 6) AS p FROM hat)
SELECT ID, ds, y, p AS pred_1, p AS pred_3, p AS pred_10 FROM l WHERE ds >= {_CUT}""")
def _(v: Views):
    train, val = panel_split(v)
    p = panel.rolling_forecast(panel.PanelModel(origin="1994-10-01").fit(train), train, val)
    return p.select("ID", "ds", "y", *[r6(c).alias(c) for c in ("pred_1", "pred_3", "pred_10")])


P4_SQL = f"""
WITH grid AS MATERIALIZED (SELECT *, {panel_columns(_DAY)} AS x, CAST(floor((ds - DATE '2001-10-01') / 300e0) AS INTEGER) + 2001 AS s FROM ({PANEL_SQL}) p),
f AS (SELECT DISTINCT campagne_calc, {_YEAR} AS g FROM regions_v WHERE split = 'validation'),
fits AS {fits_sql("SELECT f.g, 1e0 AS w, x, y FROM grid JOIN f ON grid.s < f.g WHERE y IS NOT NULL", 11, _PENALTY)},
hat AS (SELECT f.campagne_calc, ID, ds, y, s = fits.g AS own, lag(a + list_dot_product(b, x), 1) OVER (PARTITION BY fits.g, ID ORDER BY ds) AS score FROM grid JOIN fits ON s <= fits.g JOIN f ON f.g = fits.g),
pooled AS MATERIALIZED (SELECT unnest([c || '|decadaire', c || '|mensuel', c || '|saisonnier']) AS g, label, score FROM (
  SELECT unnest([campagne_calc, 'GLOBAL']) AS c, CAST(y AS INTEGER) AS label, score FROM hat WHERE own AND y IS NOT NULL AND score IS NOT NULL) q)
SELECT split_part(g, '|', 1) AS campagne_calc, split_part(g, '|', 2) AS horizon, n_positifs, n_negatifs,
  {", ".join(f"CASE WHEN n_positifs > 0 AND n_negatifs > 0 THEN {m} END AS {m}" for m in ("auc_roc", "precision", "recall", "f1", "threshold"))} FROM ({binary_sql('g', 'pooled')}) r"""


@query("P4_panel_walk_forward", P4_SQL)
def _(v: Views):
    r = stored(v, v.regions, "regions")
    folds = [test for _, test in region_folds(r)]
    return panel.walk_forward_panel(r, folds, model=lambda: panel.PanelModel(origin="1994-10-01"))[0]
