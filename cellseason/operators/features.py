"""Windowed features per cell. Every window is partitioned by the cell (or finer), so one hash
partitioning by ``cell_id`` serves them all; a cell holds one row per decade of the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LAGGED, RAIN_BAND


def with_streak(df: DataFrame, flag: str, keys: list[str], order: list[str], name: str = "streak") -> DataFrame:
    """Consecutive-true counter; false or NULL restarts it at zero (gaps and islands)."""
    yes = F.coalesce(F.col(flag), F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = df.withColumn("__isl", F.sum(F.when(yes, 0).otherwise(1)).over(w))
    wi = Window.partitionBy(*keys, "__isl").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(name, F.when(yes, F.sum(F.when(yes, 1).otherwise(0)).over(wi)).otherwise(0).cast("int")).drop("__isl")


def monthly_rain(df: DataFrame, rain: str = "chirps_sum_mean") -> DataFrame:
    """Monthly sums per cell and campaign; a month without any value is 0."""
    return (df.filter(F.col("campagne_calc").isNotNull())
            .groupBy("cell_id", "campagne_calc", "year", "month")
            .agg(F.coalesce(F.sum(rain), F.lit(0.0)).alias("chirps_monthly_sum")))


def with_rain_streak(df: DataFrame, rain: str = "chirps_sum_mean", band=RAIN_BAND, name: str = "pop_consecutive") -> DataFrame:
    """Consecutive months inside the rain band per (cell, campaign), the same value on each decade of a month.

    Everything is read off one ordering, (cell, date): a month is at most the two rows before and after, so
    its sum is five shifted terms; the streak is the running count of in-band months minus the count at the
    last break (an out-of-band month or a new campaign). No exchange and no further sort is added to the
    lag features. ``(cell_id, year, month, decade_part)`` must be unique."""
    w = _by_cell()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    month = F.col("year") * 12 + F.col("month")
    out = df.withColumn("__m", month)
    at = lambda k: F.when(F.lag("__m", k).over(w) == F.col("__m"), F.lag(rain, k).over(w))
    total = sum((F.coalesce(at(k), F.lit(0.0)) for k in (2, 1, -1, -2)), F.coalesce(F.col(rain), F.lit(0.0)))
    before = F.lag("campagne_calc", 1).over(w)
    out = out.withColumns({
        "__in": total.between(*band) & F.col("campagne_calc").isNotNull(),
        "__head": ~F.lag("__m", 1).over(w).eqNullSafe(F.col("__m")),
        "__new": ~before.eqNullSafe(F.col("campagne_calc"))})
    hit = (F.col("__in") & F.col("__head")).cast("int")
    out = out.withColumn("__n", F.sum(hit).over(run))
    base = F.when(F.col("__new"), F.col("__n") - hit).when(~F.col("__in"), F.col("__n"))
    out = out.withColumn("__base", F.max(base).over(run))
    streak = F.when(F.col("__in"), F.col("__n") - F.col("__base")).otherwise(0)
    return (out.withColumn(name, F.when(F.col("campagne_calc").isNotNull(), streak).cast("int"))
            .drop("__m", "__in", "__head", "__new", "__n", "__base"))


def _by_cell():
    return Window.partitionBy("cell_id").orderBy("date_start")


def with_lags(df: DataFrame, columns=LAGGED, depths=(1, 2)) -> DataFrame:
    """Previous values per cell, only for the columns the table has."""
    w = _by_cell()
    return df.withColumns({f"{c}_lag{k}d": F.lag(c, k).over(w) for c in columns if c in df.columns for k in depths})


def with_rolling_rain(df: DataFrame, rain: str = "chirps_sum_mean", widths=(2, 3)) -> DataFrame:
    """Rolling sums over the last n rows, NULL unless all n values are present."""
    if rain not in df.columns:
        return df
    cols = {}
    for n in widths:
        w = _by_cell().rowsBetween(-n + 1, 0)
        cols[f"chirps_cumul_{n}d"] = F.when(F.count(rain).over(w) == n, F.sum(rain).over(w))
    return df.withColumns(cols)


def with_severity_lags(df: DataFrame, target: str = "severite", depths=(1, 2), keep_target: bool = False) -> DataFrame:
    """History of the target per cell; the current value is dropped unless it is kept as the label."""
    out = df.withColumns({f"{target}_lag{k}": F.lag(target, k).over(_by_cell()) for k in depths})
    return out if keep_target else out.drop(target)


def with_adjacency(df: DataFrame, ordinal: str = "decade_ord", depth: int = 1) -> DataFrame:
    """True where the row ``depth`` places back is exactly ``depth`` decades earlier: the lags above are
    positional and step over missing decades and over the August-September gap."""
    return df.withColumn(f"adjacent_{depth}", F.col(ordinal) - F.lag(ordinal, depth).over(_by_cell()) == depth)


def build_features(cube: DataFrame, keep_target: bool = False) -> DataFrame:
    """Streak, lags, rolling rain and target history, all on the cell partitioning of ``cube``."""
    out = with_rolling_rain(with_lags(with_rain_streak(cube)))
    return with_severity_lags(out, keep_target=keep_target) if "severite" in cube.columns else out
