"""Model selection, robustness and significance. Inputs are one row per (model, campaign)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import draw


def importance_summary(importances: DataFrame) -> DataFrame:
    """Mean and sample deviation of each feature's importance over folds."""
    return importances.groupBy("feature").agg(
        F.round(F.avg("importance"), 2).alias("importance_mean"),
        F.round(F.stddev_samp("importance"), 2).alias("importance_std"))


def robustness(report: DataFrame, metrics=("qwk", "recall_23", "auc_binaire")) -> DataFrame:
    """Mean, population variance and worst campaign of each metric, NULLs ignored, in one row."""
    cols = []
    for m in metrics:
        cols += [F.round(F.avg(m), 4).alias(f"{m}_moyen"), F.round(F.var_pop(m), 4).alias(f"{m}_variance_inter_folds"),
                 F.round(F.min(m), 4).alias(f"{m}_pire_campagne")]
    return report.agg(*cols)


def model_summary(detail: DataFrame, complexity: dict[str, int]) -> DataFrame:
    """One row per model in the schema the ranking reads."""
    rank = F.create_map(*[x for k, v in complexity.items() for x in (F.lit(k), F.lit(v))])
    return detail.groupBy("modele").agg(
        F.round(F.avg("recall_23"), 4).alias("recall_23"), F.round(F.avg("qwk"), 4).alias("qwk"),
        F.round(F.var_pop("recall_23"), 4).alias("variance_inter_folds"),
        F.round(F.min("recall_23"), 4).alias("pire_campagne"),
        F.count("*").alias("n_folds")).withColumn("complexite", F.try_element_at(rank, F.col("modele")))


def baseline_value(summary: DataFrame, model: str, metric: str = "qwk") -> Column:
    """Metric of a named model as a scalar, 0 when the model is absent."""
    return F.coalesce(summary.filter(F.col("modele") == model).agg(F.max(metric).alias("v")).scalar(), F.lit(0.0))


def rank_robust(summary: DataFrame, baseline_qwk: Column | float) -> DataFrame:
    """Models at or above the baseline kappa: best recall, then low variance, best worst campaign, simplicity.

    NULL metrics never pass the filter; the last tie-break is the model name."""
    w = Window.partitionBy(F.lit(0)).orderBy(  # one row per registered model
        F.desc_nulls_last("recall_23"), F.asc_nulls_last("variance_inter_folds"),
        F.desc_nulls_last("pire_campagne"), "complexite", "modele")
    keep = summary.filter((F.col("qwk") >= baseline_qwk) & ~F.isnan("qwk"))
    return keep.withColumn("rang", F.row_number().over(w))


def metric_pivot(detail: DataFrame, models: list[str], metric: str = "recall_23") -> DataFrame:
    return detail.groupBy("campagne_calc").pivot("modele", models).agg(F.avg(metric))


def _normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation (absolute error below 2e-7)."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    # fixed values: coefficients of the classical five-term error function approximation
    coef = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    poly = F.lit(0.0)
    for a in reversed(coef):
        poly = (poly + F.lit(a)) * t
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def _exact_two_sided(w: Column, n: Column) -> Column:
    """Exact two-sided p of a signed-rank statistic: count the subsets of 1..n with sum at most w."""
    size = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), size), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def add(acc, k):
        return F.transform(acc, lambda v, s: v + F.when(s >= k, F.get(acc, (s - k).cast("int"))).otherwise(F.lit(0.0)))

    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add)
    below = F.aggregate(F.slice(counts, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, v: a + v)
    return F.least(F.lit(1.0), F.lit(2.0) * below / F.pow(F.lit(2.0), n))


def wilcoxon_pairs(detail: DataFrame, metric: str = "recall_23", exact_up_to: int = 50) -> DataFrame:
    """Signed-rank test of every pair of models over their common campaigns.

    The input has one row per model and campaign, so pairs are bounded by the registry. Zero differences
    are discarded; the exact null is used without zeros and ties, the tie-corrected normal otherwise.
    Fewer than five pairs give NULL, all-zero differences give p = 1."""
    d = detail.groupBy("campagne_calc", "modele").agg(F.avg(metric).alias("v")).filter("v is not null")
    a = d.select("campagne_calc", F.col("modele").alias("modele_a"), F.col("v").alias("va"))
    b = d.select("campagne_calc", F.col("modele").alias("modele_b"), F.col("v").alias("vb"))
    diff = F.round(F.col("va") - F.col("vb"), 12)
    pairs = a.join(b, "campagne_calc").filter("modele_a < modele_b").withColumn("d", diff)
    nonzero = pairs.filter("d <> 0").withColumn("m", F.abs("d"))
    w = Window.partitionBy("modele_a", "modele_b")
    ranked = nonzero.withColumns({
        "lo": F.rank().over(w.orderBy("m")), "t": F.count("*").over(Window.partitionBy("modele_a", "modele_b", "m"))})
    ranked = ranked.withColumn("r", F.col("lo") + (F.col("t") - 1) / 2)
    sums = ranked.groupBy("modele_a", "modele_b").agg(
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.count("*").cast("double").alias("n"), F.max("t").alias("max_tie"),
        F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("tie"))
    base = pairs.groupBy("modele_a", "modele_b").agg(
        F.count("*").alias("n_paires"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"))
    j = base.join(sums, ["modele_a", "modele_b"], "left")
    n, stat = F.col("n"), F.least("w_plus", "w_minus")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie") / 2) / 24)
    z = F.try_divide(stat - n * (n + 1) / 4, se)
    clean = (F.col("max_tie") == 1) & (n == F.col("n_paires")) & (n <= exact_up_to)
    p = F.when(clean, _exact_two_sided(stat, n)).otherwise(_normal_two_sided(z))
    enough, flat = F.col("n_paires") >= 5, n.isNull()
    usable = enough & ~flat
    p = F.when(enough, F.when(flat, F.lit(1.0)).otherwise(p))
    return j.select("modele_a", "modele_b", "n_paires",
                    F.when(usable, F.round("ma", 4)).alias("mean_a"), F.when(usable, F.round("mb", 4)).alias("mean_b"),
                    F.when(usable, F.round(F.col("ma") - F.col("mb"), 4)).alias("diff_a_minus_b"),
                    F.when(enough, F.when(flat, F.lit(0.0)).otherwise(F.round(stat, 2))).alias("statistic"),
                    F.round(p, 4).alias("p_value"), F.coalesce(p < 0.05, F.lit(False)).alias("significatif_05"))


def bootstrap_interval(detail: DataFrame, metric: str = "recall_23", replicates: int = 500, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean by resampling campaigns, with reproducible integer draws.

    Work is models x replicates x campaigns of small rows; fewer than three campaigns give NULL."""
    rows = detail.filter(F.col(metric).isNotNull()).select("modele", "campagne_calc", F.col(metric).alias("v"))
    w = Window.partitionBy("modele").orderBy("campagne_calc")
    idx = rows.withColumn("i", F.row_number().over(w) - 1)
    sizes = rows.groupBy("modele").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    draws = (sizes.select("modele", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
             .select("modele", "n", "rep", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
             .withColumn("i", F.floor(draw(F.col("rep") * 1009 + F.col("k") * 31, seed) * F.col("n")).cast("int")))
    means = draws.join(idx, ["modele", "i"]).groupBy("modele", "rep").agg(F.avg("v").alias("m"))
    q = means.groupBy("modele").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    ok = F.col("n") >= 3
    return sizes.join(q, "modele").select(
        "modele", F.when(ok, F.round("mean", 4)).alias("recall_mean"), F.when(ok, F.round("lo", 4)).alias("ci_low"),
        F.when(ok, F.round("hi", 4)).alias("ci_high"), F.when(ok, F.round(F.col("hi") - F.col("lo"), 4)).alias("ci_width"))


def campaign_drilldown(detail: DataFrame, campaign: str) -> DataFrame:
    return (detail.filter(F.col("campagne_calc") == campaign).select("modele", "qwk", "recall_23")
            .orderBy(F.desc_nulls_last("recall_23"), "modele"))


def deployment_decision(candidate: DataFrame, baseline: DataFrame | None, minutes: float, budget: float = 30.0) -> DataFrame:
    """Deploy the candidate when its decade AUC beats the baseline within the time budget.

    ``candidate`` has ``(horizon, auc_global, f1_global)``, ``baseline`` one row ``(auc_global, f1_global)``."""
    rows = candidate.select(F.lit("panel").alias("modele"), "horizon", F.round("auc_global", 4).alias("auc_global"),
                            F.round("f1_global", 4).alias("f1_global"), F.lit(round(minutes, 1)).alias("temps_train_min"))
    if baseline is None:
        return rows.withColumn("decision", F.lit("indeterminate"))
    base = baseline.select(F.lit("baseline").alias("modele"), F.lit("decadaire").alias("horizon"),
                           F.round("auc_global", 4).alias("auc_global"), F.round("f1_global", 4).alias("f1_global"),
                           F.lit(None).cast("double").alias("temps_train_min"))
    all_rows = rows.unionByName(base)
    auc_of = lambda m: all_rows.filter((F.col("modele") == m) & (F.col("horizon") == "decadaire")).agg(
        F.max("auc_global").alias("a")).scalar()
    n_base = base.agg(F.count("*").alias("c")).scalar()
    better = F.coalesce(auc_of("panel") > auc_of("baseline"), F.lit(False)) & F.lit(minutes < budget)
    return all_rows.withColumn("decision", F.when(n_base == 0, "indeterminate").when(better, "deploy").otherwise("keep_baseline"))
