"""Decade composites of gridded series, climatology and anomaly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLIMATOLOGY_YEARS, RAIN_WINDOW
from ..functions import calendar as cal


def with_candidate_decades(images: DataFrame, time: str, lead: int, lag: int) -> DataFrame:
    """One row per (image row, decade whose window holds the image day)."""
    return images.withColumn("decade_ord", F.explode(cal.window_ordinals(F.col(time).cast("date"), lead, lag)))


def sum_composite(daily: DataFrame, value: str, time: str = "day", window=RAIN_WINDOW, name: str = "chirps_sum_mean") -> DataFrame:
    """Sum of the days of each decade per cell; partial sums run before the shuffle."""
    rows = (daily.withColumn("decade_ord", cal.decade_ordinal(F.col(time).cast("date"))) if tuple(window) == (0, 1)
            else with_candidate_decades(daily, time, *window))
    return rows.groupBy("cell_id", "decade_ord").agg(F.sum(value).alias(name))


def latest_image(images: DataFrame, time: str, lead: int, lag: int) -> DataFrame:
    """Newest image time per decade over the whole collection (a few hundred rows)."""
    return (images.select(time).distinct().transform(with_candidate_decades, time, lead, lag)
            .groupBy("decade_ord").agg(F.max(time).alias(time)))


def latest_composite(images: DataFrame, values: dict[str, object], time: str, window) -> DataFrame:
    """Pixel values of the newest image of each decade window; a masked pixel stays NULL.

    ``values`` maps output names to masked column expressions. The image is chosen per decade first, so
    the pixel rows meet a tiny table and are not regrouped."""
    newest = latest_image(images, time, *window)
    rows = images.select("cell_id", time, *[c.alias(n) for n, c in values.items()])
    return rows.join(newest, time).select("cell_id", "decade_ord", *values)


def best_valid_composite(images: DataFrame, values: dict[str, object], time: str, window) -> DataFrame:
    """Variant that takes, per cell and value, the newest unmasked image of the window."""
    rows = images.select("cell_id", time, *[c.alias(n) for n, c in values.items()])
    rows = with_candidate_decades(rows, time, *window)
    return rows.groupBy("cell_id", "decade_ord").agg(*[
        F.max_by(n, F.when(F.col(n).isNotNull(), F.col(time))).alias(n) for n in values])


def climatology(decade_sums: DataFrame, value: str = "chirps_sum_mean", years=CLIMATOLOGY_YEARS,
                name: str = "chirps_baseline_mean") -> DataFrame:
    """Mean over the years of the decade sums, per cell and decade of the year (36 of them).

    A year without any day in a decade has no image and does not enter the mean."""
    f = cal.decade_fields("decade_ord")
    return (decade_sums.select("cell_id", f["year"].alias("year"), f["month"].alias("month"),
                               f["decade_part"].alias("decade_part"), value)
            .filter(F.col("year").between(*years))
            .groupBy("cell_id", "month", "decade_part").agg(F.avg(value).alias(name)))


def climatology_state(decade_sums: DataFrame, value: str = "chirps_sum_mean") -> DataFrame:
    """Sum and count of the decade sums per cell and decade of the year; states of different years are merged by adding."""
    f = cal.decade_fields("decade_ord")
    return (decade_sums.select("cell_id", f["month"].alias("month"), f["decade_part"].alias("decade_part"), value).groupBy("cell_id", "month", "decade_part")
            .agg(F.sum(value).alias("total"), F.count(value).alias("n")))


def merge_climatology(*states: DataFrame) -> DataFrame:
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("cell_id", "month", "decade_part").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def climatology_of(state: DataFrame, name: str = "chirps_baseline_mean") -> DataFrame:
    return state.select("cell_id", "month", "decade_part", F.try_divide("total", "n").alias(name))


def with_anomaly(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds value minus climatology; NULL when either is missing."""
    keys = ["cell_id", "month", "decade_part"]
    joined = df.join(baseline.select(*keys, "chirps_baseline_mean"), keys, "left")
    return joined.select(*df.columns, (F.col("chirps_sum_mean") - F.col("chirps_baseline_mean")).alias("chirps_anomaly_mean"))
