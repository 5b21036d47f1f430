"""Evaluation tables. Row-level predictions are reduced to counts (confusion cells, distinct scores,
grid buckets) by one aggregate; the metrics are arithmetic over those counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HORIZONS, PHASES, SEVERITY_LEVELS, THRESHOLDS
from ..functions.scoring import argmax_without
from .order import running_before, stored


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- confusion based ----------------------------------------------------------------------------------

def confusion(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", keys=(), levels=SEVERITY_LEVELS) -> DataFrame:
    """Counts over the complete levels x levels square, per key."""
    cells = F.array(*[F.struct(F.lit(a).alias(truth), F.lit(b).alias(pred)) for a in levels for b in levels])
    got = df.groupBy(*keys, truth, pred).agg(F.count("*").alias("n"))
    base = got.select(*keys).distinct() if keys else got.limit(1).select(F.lit(1).alias("__one"))
    full = base.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return (full.join(got, [*keys, truth, pred], "left")
            .select(*keys, truth, pred, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def quadratic_kappa(truth: str = "y_true", pred: str = "y_pred") -> Column:
    """Quadratic weighted kappa as one aggregate expression; NULL when the expected disagreement is 0.

    With weights (i - j)^2 the expected disagreement only needs first and second moments:
    n * sum E = n * (sum i^2 + sum j^2) - 2 * sum i * sum j."""
    i, j = _c(truth).cast("double"), _c(pred).cast("double")
    seen = F.sum((i - j) * (i - j))
    expected = F.sum(i * i) + F.sum(j * j) - F.lit(2.0) * F.sum(i) * F.sum(j) / F.count("*")
    return F.lit(1.0) - F.try_divide(seen, F.when(F.abs(expected) > 1e-12, expected))


def recall_high(truth: str = "y_true", pred: str = "y_pred") -> Column:
    """Share of true levels 2-3 predicted 2-3; NULL when there is none."""
    t, p = _c(truth).isin(2, 3), _c(pred).isin(2, 3)
    return F.try_divide(F.count_if(t & p).cast("double"), F.count_if(t).cast("double"))


def ordinal_report(df: DataFrame, keys=("campagne_calc",), digits: int = 4) -> DataFrame:
    """Kappa, high-level recall and size per key."""
    return df.groupBy(*keys).agg(
        F.round(quadratic_kappa(), digits).alias("qwk"), F.round(recall_high(), digits).alias("recall_23"),
        F.count("*").alias("n"))


def campaign_report(df: DataFrame, keys=("campagne_calc",)) -> DataFrame:
    """Ordinal report plus presence AUC per campaign."""
    binary = df.withColumn("__pos", (F.col("y_true") >= 1).cast("int"))
    return (ordinal_report(df, keys).join(auc(binary, "__pos", "score", keys), list(keys), "left")
            .withColumnRenamed("auc_roc", "auc_binaire"))


def agreement(df: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    """Exact and +-1 agreement and unweighted kappa between two level columns."""
    counts = df.filter(_c(a).isNotNull() & _c(b).isNotNull()).groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*(list(keys) or [F.lit(0)]))  # at most levels x levels rows per key
    tagged = counts.withColumns({
        "__ra": F.sum("n").over(Window.partitionBy(*keys, a)), "__cb": F.sum("n").over(Window.partitionBy(*keys, b)),
        "__n": F.sum("n").over(part)})
    # expected agreement: sum over levels present on both sides of row total x column total
    rows = tagged.groupBy(*keys, _c(a).alias("__lv")).agg(F.max("__ra").alias("__r"), F.max("__n").alias("__tot"))
    cols = tagged.groupBy(*keys, _c(b).alias("__lv")).agg(F.max("__cb").alias("__k"))
    exp = (rows.join(cols, [*keys, "__lv"]).groupBy(*keys)
           .agg((F.sum(F.col("__r").cast("double") * F.col("__k")) / F.max(F.col("__tot").cast("double") * F.col("__tot"))).alias("__pe")))
    n = F.sum("n").cast("double")
    obs = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(_c(a) == _c(b), F.col("n")).otherwise(0)) / n).alias("accord_exact"),
        (F.sum(F.when(F.abs(_c(a) - _c(b)) <= 1, F.col("n")).otherwise(0)) / n).alias("accord_pm1"))
    if keys:
        both = obs.join(exp, list(keys))
        pe = F.col("__pe")
    else:
        both, pe = obs, F.coalesce(exp.scalar(), F.lit(0.0))
    return both.select(*keys, "n", "accord_exact", "accord_pm1",
                       F.try_divide(F.col("accord_exact") - pe, F.lit(1.0) - pe).alias("kappa"))


# --- score based --------------------------------------------------------------------------------------

def auc(df: DataFrame, label: str = "label", score: str = "score", keys=(), digits: int | None = None) -> DataFrame:
    """Area under the ROC curve with half credit for ties; NULL when a class is missing.

    Rows collapse to distinct scores; negatives below each score come from bucketed running sums."""
    keys = list(keys)
    return _auc_of_counts(score_counts(df, label, score, keys), score, keys, digits)


def score_counts(df: DataFrame, label: str, score: str, keys) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(*keys, score).agg(F.count_if(_c(label) == 1).alias("pos"), F.count_if(_c(label) == 0).alias("neg"))


def _auc_of_counts(by_score: DataFrame, score: str, keys: list[str], digits: int | None) -> DataFrame:
    ranked = running_before(by_score, score, ["neg"], keys)
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    value = F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double"))
    return ranked.groupBy(*keys).agg((F.round(value, digits) if digits else value).alias("auc_roc"))


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {"precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
            "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero)}


def precision_recall(df: DataFrame, threshold: Column | float, label: str = "label", score: str = "score",
                     keys=(), digits: int = 4) -> DataFrame:
    """Precision, recall and F1 at a threshold; an empty denominator gives 0."""
    hit = _c(score) >= threshold
    d = lambda c: F.count_if(c).cast("double")
    tp, fp, fn = d(hit & (_c(label) == 1)), d(hit & (_c(label) == 0)), d(~hit & (_c(label) == 1))
    return df.groupBy(*keys).agg(*[F.round(c, digits).alias(n) for n, c in _prf(tp, fp, fn).items()])


def _grid_bucket(score) -> Column:
    """Number of grid thresholds at or below the score (0..46)."""
    return sum((F.when(_c(score) >= t, 1).otherwise(0) for t in THRESHOLDS), F.lit(0))


def _threshold_at(k: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in THRESHOLDS]), k - 1)


def _best(metric: str, eligible: Column) -> Column:
    """Lowest grid position ``k`` with the largest metric among the eligible ones, NULL when there is none."""
    return -F.max(F.when(eligible, F.struct(F.col(metric), (-F.col("k")).alias("nk"))))["nk"]


def best_f1_threshold(df: DataFrame, label: str = "label", score: str = "score", keys=()) -> DataFrame:
    """Grid threshold with the best F1, the lowest one on ties, 0.20 when nothing is predicted.

    Scores collapse to 47 grid buckets; the 46 thresholds are then evaluated on those counts."""
    keys = list(keys)
    return _best_f1_of_counts(df.groupBy(*keys, _grid_bucket(score).alias("b")).agg(
        F.count_if(_c(label) == 1).alias("p"), F.count_if(_c(label) == 0).alias("q")), keys)


def _best_f1_of_counts(b: DataFrame, keys: list[str]) -> DataFrame:
    # bucket b is selected by thresholds 1..b; bucket 0 by none, but its positives are missed ones
    used = b.select(*keys, "p", "q", "b", F.explode(F.sequence(F.lit(1), F.lit(len(THRESHOLDS)))).alias("k"))
    on = F.col("b") >= F.col("k")
    at = used.groupBy(*keys, "k").agg(F.sum(F.when(on, F.col("p")).otherwise(0)).cast("double").alias("tp"),
                                      F.sum(F.when(on, F.col("q")).otherwise(0)).cast("double").alias("fp"),
                                      F.sum("p").cast("double").alias("pos"))
    f1 = F.when(F.col("tp") + F.col("fp") > 0, _prf(F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp"))["f1"])
    best = at.withColumn("f1", f1).groupBy(*keys).agg(_best("f1", F.col("f1").isNotNull()).alias("k"))
    return best.select(*keys, F.coalesce(_threshold_at(F.col("k")), F.lit(0.20)).alias("threshold"))


def binary_report(df: DataFrame, label: str = "label", score: str = "score", keys=("campagne_calc",)) -> DataFrame:
    """AUC and the metrics at the F1-optimal threshold, per key."""
    return _binary_report_of_counts(score_counts(df, label, score, keys), score, list(keys))


def _binary_report_of_counts(counts: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """The counts of distinct scores are all that is needed; they are stored once."""
    counts = stored(counts)
    t = _best_f1_of_counts(counts.groupBy(*keys, _grid_bucket(score).alias("b")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")), keys)
    hit = _c(score) >= F.col("threshold")
    total = lambda m, c: F.coalesce(F.sum(F.when(c, F.col(m))), F.lit(0)).cast("double")
    at = counts.join(t, keys).groupBy(*keys).agg(*[F.round(c, 4).alias(n) for n, c in _prf(total("pos", hit), total("neg", hit), total("pos", ~hit)).items()])
    sizes = counts.groupBy(*keys).agg(F.sum("pos").alias("n_positifs"), F.sum("neg").alias("n_negatifs"))
    return (sizes.join(_auc_of_counts(counts, score, keys, 4), keys).join(at, keys)
            .join(t.withColumn("threshold", F.round("threshold", 4)), keys))


def with_global(df: DataFrame, campaign: str = "campagne_calc") -> DataFrame:
    """Doubles the rows under the pooled key ``GLOBAL`` so one grouped pass yields folds and total."""
    both = F.explode(F.array(F.col(campaign), F.lit("GLOBAL")))
    return df.withColumn(campaign, both)


def binary_report_with_global(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Per-campaign rows plus the pooled row, with AUC and threshold recomputed on the pool.

    Rows become counts of distinct scores before they are doubled, so the pooled key is as long as its scores."""
    counts = with_global(score_counts(df, label, score, ["campagne_calc"]))
    counts = counts.groupBy("campagne_calc", score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _binary_report_of_counts(counts, score, ["campagne_calc"])


def pooled_counts(df: DataFrame, campaign: str = "campagne_calc") -> DataFrame:
    """Additive counts per campaign and pooled, in one pass with grouping sets."""
    return (df.groupingSets([[F.col(campaign)], []], F.col(campaign))
            .agg(F.count("*").alias("n"), F.count_if(F.col("y_true") >= 1).alias("n_positifs"),
                 F.count_if(F.col("y_true") == F.col("y_pred")).alias("n_exact"),
                 F.round(quadratic_kappa(), 4).alias("qwk"), F.round(recall_high(), 4).alias("recall_23"))
            .withColumn(campaign, F.coalesce(F.col(campaign), F.lit("GLOBAL"))))


def regression_errors(df: DataFrame, truth: str, pred: str, keys=(), digits: int = 4) -> DataFrame:
    e = _c(truth) - _c(pred)
    return df.groupBy(*keys).agg(F.round(F.sqrt(F.avg(e * e)), digits).alias("rmse_densite"),
                                 F.round(F.avg(F.abs(e)), digits).alias("mae_densite"))


# --- phase metrics -------------------------------------------------------------------------------------

def _f1_by_class(counts: DataFrame, keys: list[str], n_classes: int | None) -> DataFrame:
    """Macro F1 and recall of the last class from confusion counts ``(y, p, n)``.

    With ``n_classes`` the mean runs over that many fixed labels, else over the labels met."""
    sides = counts.select(*keys, "n", F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.lit(1).alias("t")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t")))).alias("s"),
        (F.col("y") == F.col("p")).alias("ok"))
    per = sides.groupBy(*keys, F.col("s.c").alias("c")).agg(
        F.sum(F.when(F.col("ok") & (F.col("s.t") == 1), F.col("n")).otherwise(0)).cast("double").alias("tp"),
        F.sum(F.when(F.col("s.t") == 1, F.col("n")).otherwise(0)).cast("double").alias("actual"),
        F.sum(F.when(F.col("s.t") == 0, F.col("n")).otherwise(0)).cast("double").alias("said"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("said")), F.lit(0.0))
    g = len(PHASES) - 1
    denom = F.lit(float(n_classes)) if n_classes else F.count("*").cast("double")
    recall = F.coalesce(F.try_divide(F.sum(F.when(F.col("c") == g, F.col("tp"))),
                                     F.sum(F.when(F.col("c") == g, F.col("actual")))), F.lit(0.0))
    said_any = F.sum(F.when(F.col("c") > 0, F.col("said")).otherwise(0.0))
    return per.groupBy(*keys).agg((F.sum(f1) / denom).alias("f1_macro"), recall.alias("recall_G"), said_any.alias("nonzero"))


def phase_report(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", keys=(), digits: int = 4) -> DataFrame:
    """Macro F1 over the four fixed phases and recall of the gregarious one."""
    counts = df.groupBy(*keys, _c(truth).alias("y"), _c(pred).alias("p")).agg(F.count("*").alias("n"))
    return _f1_by_class(counts, list(keys), len(PHASES)).select(
        *keys, F.round("f1_macro", digits).alias("f1_macro_phase"), F.round("recall_G", digits).alias("recall_G"))


def best_target_threshold(df: DataFrame, probabilities: str, truth: str = "y_true", keys=(), min_f1: float = 0.30) -> DataFrame:
    """Grid threshold on P(G) with the best recall of G among those with macro F1 >= ``min_f1``
    (labels met only), lowest on ties, default 0.15. Thresholds predicting only class 0 are skipped.

    Each row is reduced to (grid bucket of P(G), best other class, truth): at most 47 x 3 x 4 counts."""
    keys, g = list(keys), len(PHASES) - 1
    p = F.col(probabilities)
    base = df.groupBy(*keys, _grid_bucket(F.get(p, F.lit(g))).alias("b"), argmax_without(p, g, len(PHASES)).alias("o"),
                      _c(truth).alias("y")).agg(F.count("*").alias("n"))
    grid = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(THRESHOLDS)))).alias("k"))
    counts = (grid.withColumn("p", F.when(F.col("b") >= F.col("k"), g).otherwise(F.col("o")))
              .groupBy(*keys, "k", "y", "p").agg(F.sum("n").alias("n")))
    scored = _f1_by_class(counts, keys + ["k"], None)
    ok = (F.col("nonzero") > 0) & (F.col("f1_macro") >= min_f1)
    best = scored.groupBy(*keys).agg(_best("recall_G", ok).alias("k"))
    return best.select(*keys, F.coalesce(_threshold_at(F.col("k")), F.lit(0.15)).alias("threshold_G"))


# --- reliability and gain -------------------------------------------------------------------------------

def calibration(df: DataFrame, label: str = "label", score: str = "score", bins: int = 10, keys=()) -> DataFrame:
    """Mean score against observed frequency in equal-width bins on [0, 1]; empty bins are absent.

    Inner edges are the doubles ``i * (1 / bins)``: 0.3 stays below the edge 0.30000000000000004."""
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)]
    b = sum((F.when(_c(score) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.groupBy(*keys, b.alias("bin")).agg(
        F.avg(score).alias("proba_moyenne"), F.avg(label).alias("freq_observee"), F.count("*").alias("n"))


def gain_lift(df: DataFrame, label: str, score: str, key: str, bins: int = 10, digits: int = 4) -> DataFrame:
    """Cumulative gain and lift when rows are taken by falling score (ties by rising key).

    Counts per distinct score give the positives above any score; only the scores that a cut splits go
    back to rows, ranked by key with bucketed running sums."""
    pos = F.count_if(_c(label) == 1)
    by_score = stored(df.groupBy((-_c(score)).alias("s")).agg(F.count("*").alias("c"), pos.alias("p")))
    ranked = running_before(by_score, "s", ["c", "p"])
    totals = by_score.agg(F.sum("c").alias("n"), F.sum("p").alias("pos"))
    n, total_pos = totals.select("n").scalar(), totals.select("pos").scalar()
    cut = F.when(F.col("q") == bins, F.col("n")).otherwise(F.floor(F.col("q") * (F.col("n") / F.lit(float(bins)))))
    q = F.explode(F.sequence(F.lit(1), F.lit(bins)))
    # the score group that holds the last row of each cut
    cuts = (ranked.withColumn("n", n).select("*", q.alias("q")).withColumn("cut", cut)
            .filter((F.col("cut") > F.col("c_before")) & (F.col("cut") <= F.col("c_before") + F.col("c"))))
    tied = df.select((-_c(score)).alias("s"), F.col(key).alias("k"), (_c(label) == 1).cast("bigint").alias("p1"),
                     F.lit(1).cast("bigint").alias("one"))
    split = cuts.filter(F.col("cut") < F.col("c_before") + F.col("c")).select("s").distinct()
    inside = running_before(tied.join(split, "s", "left_semi"), "k", ["one"], ["s"])
    need = cuts.select("s", "q", (F.col("cut") - F.col("c_before")).alias("need"))
    part = (inside.join(need, "s").filter(F.col("one_before") < F.col("need"))
            .groupBy("q").agg(F.sum("p1").alias("part")))
    whole = F.col("cut") == F.col("c_before") + F.col("c")
    got = cuts.join(part, "q", "left").withColumn(
        "got", F.col("p_before") + F.when(whole, F.col("p")).otherwise(F.coalesce("part", F.lit(0))))
    pop = F.col("cut") / F.col("n")
    gain = F.try_divide(F.col("got").cast("double"), total_pos.cast("double"))
    return got.select(F.col("q").alias("quantile"), F.round(pop, digits).alias("pop_cumulee"),
                      F.round(gain, digits).alias("gain_cumule"), F.round(gain / pop, digits).alias("lift"))


# --- horizons and targets --------------------------------------------------------------------------------

def horizon_report(preds: DataFrame, horizons=HORIZONS, truth: str = "y") -> DataFrame:
    """Binary metrics per horizon column ``pred_<k>``; NULL metrics for a missing column or a single class."""
    names = ["auc_roc", "precision", "recall", "f1", "threshold"]
    have = {h: k for h, k in horizons.items() if f"pred_{k}" in preds.columns}
    spark = preds.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    if not have:
        return wanted.select("horizon", *[F.lit(None).cast("double").alias(m) for m in names])
    long = preds.select(F.col(truth).cast("int").alias("label"), F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"pred_{k}").alias("score")) for h, k in have.items()])).alias("s"))
    long = long.select("label", "s.*").filter("label is not null and score is not null")
    rep = binary_report(long, "label", "score", ["horizon"])
    both = (F.col("n_positifs") > 0) & (F.col("n_negatifs") > 0)
    rep = rep.select("horizon", *[F.when(both, F.col(m)).alias(m) for m in names])
    return wanted.join(rep, "horizon", "left")


def target_status(values: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row per metric column: value rounded, target and whether it is reached; NULL metrics drop out."""
    cols = values.columns
    t = F.try_element_at(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))]), F.col("metric"))
    return (values.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "metric", "value")
            .filter("value is not null").withColumn("target", t)
            .withColumn("status", F.when(t.isNull(), "").when(F.col("value") >= t, "reached").otherwise("missed"))
            .withColumn("value", F.round("value", 4)))
