"""Panel forecasting: complete entity x campaign x decade series and a pooled trend + season model."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HORIZONS
from ..functions.calendar import campaign_start_year, panel_date
from . import linear
from .metrics import binary_report, horizon_report

PERIOD_DAYS = 300.0  # thirty gap-free decades


def complete_panel(df: DataFrame, entities: DataFrame | None = None, entity: str = "rn_num", label: str = "label") -> DataFrame:
    """Series ``(ID, ds, y)`` on the full grid; missing observations and unlabeled rows have NULL y.

    Campaigns are a list of seasons, so the grid grows from each entity by exploding that short array
    and the 30 decades: no join builds it."""
    ids = (entities if entities is not None else df).select(F.col(entity).cast("bigint").alias("e")).filter("e is not null").distinct()
    seasons = df.filter(F.col("campagne_calc").isNotNull()).agg(F.collect_set("campagne_calc").alias("s")).scalar()
    grid = (ids.select("e", F.explode(seasons).alias("campagne_calc"))
            .select("e", "campagne_calc", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("campagne_decade")))
    data = df.select(F.col(entity).cast("bigint").alias("e"), "campagne_calc",
                     F.col("campagne_decade").cast("int").alias("campagne_decade"), F.col(label).cast("double").alias("y"))
    return (grid.join(data, ["e", "campagne_calc", "campagne_decade"], "left")
            .select(F.col("e").cast("string").alias("ID"), panel_date("campagne_calc", "campagne_decade").alias("ds"), "y"))


def seasonal_columns(ds: Column, origin: str, knots: list[float], order: int = 4) -> dict[str, Column]:
    """Piecewise-linear trend and Fourier terms of the season."""
    day = F.datediff(ds, F.lit(origin).cast("date")).cast("double")
    cols = {"t": day / PERIOD_DAYS}
    for i, k in enumerate(knots):
        cols[f"t_{i}"] = F.greatest(F.lit(0.0), day / PERIOD_DAYS - F.lit(float(k)))
    for h in range(1, order + 1):
        a = F.lit(2 * math.pi * h / PERIOD_DAYS) * day
        cols[f"sin_{h}"], cols[f"cos_{h}"] = F.sin(a), F.cos(a)
    return cols


class PanelModel:
    """One linear model shared by all series; missing observations do not train.

    The penalty of a slope is ``reg`` times the variance of its column over the deviation of the target, so it does not depend on units."""

    def __init__(self, origin: str = "2001-10-01", knots: tuple[float, ...] = (2.0, 4.0), order: int = 4, reg: float = 1e-3):
        self.origin, self.knots, self.order, self.reg = origin, list(knots), order, reg

    @property
    def width(self) -> int:
        return 1 + len(self.knots) + 2 * self.order

    def design(self, ds: Column) -> Column:
        return F.array(*seasonal_columns(ds, self.origin, self.knots, self.order).values())

    def moments(self, panel: DataFrame, keys: list[str] = ()) -> DataFrame:
        return linear.moments(panel.filter("y is not null"), self.design(F.col("ds")), self.width, F.col("y"), list(keys))

    def solve(self, sums) -> "PanelModel":
        """The model of these sums of products (a matrix). Constant targets and columns get no slope."""
        def penalty(var, var_y, n):
            return [self.reg / max(var_y, 1e-300) ** 0.5 * v if v > 0 else 1.0 for v in var]

        self.fitted = linear.solve(sums, penalty)
        return self

    def fit(self, panel: DataFrame) -> "PanelModel":
        sums = linear.matrices(self.moments(panel), [], self.width)
        return self.solve(sums.get((), np.zeros((self.width + 2, self.width + 2))))

    def predict(self, panel: DataFrame) -> DataFrame:
        return panel.withColumn("yhat1", self.fitted.of(self.design(F.col("ds"))))


def shift_forecast(preds: DataFrame, horizons=HORIZONS, unshifted: bool = False) -> DataFrame:
    """``pred_<k>`` per horizon: ``yhat<k>`` shifted k places, or ``yhat1`` shifted once when the model has
    no further steps; ``unshifted`` keeps the fitted value of the date itself."""
    w = Window.partitionBy("ID").orderBy("ds")
    cols = {}
    for k in horizons.values():
        if unshifted:
            cols[f"pred_{k}"] = F.col("yhat1")
        elif k > 1 and f"yhat{k}" in preds.columns:
            cols[f"pred_{k}"] = F.lag(f"yhat{k}", k).over(w)
        else:
            cols[f"pred_{k}"] = F.lag("yhat1", 1).over(w)
    return preds.withColumns(cols)


def rolling_forecast(model: PanelModel, train: DataFrame, val: DataFrame, horizons=HORIZONS, unshifted: bool = False) -> DataFrame:
    """Predicts train and validation dates together, shifts per horizon, returns validation dates with true y."""
    combined = train.unionByName(val)
    shifted = shift_forecast(model.predict(combined), horizons, unshifted)
    dates = val.select("ds").distinct()
    return shifted.join(dates, "ds", "left_semi").select("ID", "ds", "y", *[f"pred_{k}" for k in horizons.values()])


def walk_forward_panel(df: DataFrame, folds: list[str], horizons=HORIZONS, entity: str = "rn_num", model=PanelModel) -> tuple[DataFrame, DataFrame]:
    """Per validation campaign: fit on everything earlier (inference rows included), forecast, evaluate per
    horizon; then the pooled row ``GLOBAL``. Returns the report and the pooled predictions.

    ``folds`` lists the validation campaigns: a short list of seasons drives the loop. One aggregation gives the sums of products of
    every season; a fold adds up the seasons before it and solves one small system. No folds give an empty report; the metrics of a
    single class are NULL."""
    entities, names = df.select(entity).distinct(), [f"pred_{k}" for k in horizons.values()]
    blank = model()
    rows = df.filter(F.col(entity).isNotNull() & F.col("campagne_calc").isNotNull() & F.col("campagne_decade").between(1, 30))
    rows = rows.select("campagne_calc", panel_date("campagne_calc", "campagne_decade").alias("ds"), F.col("label").cast("double").alias("y"))
    sums = linear.by_season(blank.moments(rows, ["campagne_calc"]), "campagne_calc", None, blank.width)
    seasons = sorted(sums, key=lambda c: int(c.split("-")[0]))
    plan = sorted(((([c for c in seasons if int(c.split("-")[0]) < int(camp.split("-")[0])]), camp) for camp in folds), key=lambda f: len(f[0]))
    pooled = df.sparkSession.createDataFrame([], "ID string, ds date, y double, " + ", ".join(f"{n} double" for n in names) + ", campagne_calc string")
    for camp, total in linear.expanding(sums, plan):
        if not total:
            continue  # nothing earlier was observed
        start = int(camp.split("-")[0])
        train = complete_panel(df.filter(campaign_start_year("campagne_calc") < start), entities, entity)
        val = complete_panel(df.filter((F.col("campagne_calc") == camp) & F.col("split").isin("train", "validation")), entities, entity)
        preds = rolling_forecast(model().solve(total[0]), train, val, horizons)
        pooled = pooled.unionByName(preds.withColumn("campagne_calc", F.lit(camp)))
    stacked = pooled.select("campagne_calc", F.col("y").cast("int").alias("label"), F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"pred_{k}").alias("score")) for h, k in horizons.items()])).alias("s"))
    stacked = (stacked.select(F.explode(F.array("campagne_calc", F.lit("GLOBAL"))).alias("campagne_calc"), "label", "s.*")
               .filter("label is not null and score is not null"))
    rep = binary_report(stacked, "label", "score", ["campagne_calc", "horizon"])
    both = (F.col("n_positifs") > 0) & (F.col("n_negatifs") > 0)
    metrics = ["auc_roc", "precision", "recall", "f1", "threshold"]
    return rep.select("campagne_calc", "horizon", "n_positifs", "n_negatifs", *[F.when(both, F.col(m)).alias(m) for m in metrics]), pooled


__all__ = ["complete_panel", "PanelModel", "shift_forecast", "rolling_forecast", "walk_forward_panel", "horizon_report"]
