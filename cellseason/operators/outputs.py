"""Operational outputs: severity maps, area roll-ups, target campaign and export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CELL_SIZE_M
from ..functions import geo
from ..functions.calendar import campaign_month, campaign_start_year
from .order import exact_quantiles


def monthly_map(df: DataFrame) -> DataFrame:
    """Decade severities to campaign months: the month takes its worst level."""
    keys = [c for c in ("cell_id", "AIRE_CODE", "campagne_calc") if c in df.columns]
    return df.groupBy(*keys, campaign_month("campagne_decade").alias("mois_campagne")).agg(F.max("severite").alias("severite"))


def area_month(monthly: DataFrame) -> DataFrame:
    """Worst level, cells and hot-spot cells (level >= 2) per area, campaign and month."""
    keys = [c for c in ("AIRE_CODE", "campagne_calc") if c in monthly.columns]
    return monthly.groupBy(*keys, "mois_campagne").agg(
        F.max("severite").alias("severite_max"), F.count("*").alias("n_cellules"),
        F.count_if(F.col("severite") >= 2).alias("n_cellules_foyer"))


def cell_map(df: DataFrame) -> DataFrame:
    """One worst-case row per cell; level and probability come from the same aggregate."""
    aggs = [F.max("severite").alias("severite")]
    if "proba_presence" in df.columns:
        aggs.append(F.max("proba_presence").alias("proba_presence"))
    return df.groupBy("cell_id", "AIRE_CODE").agg(*aggs)


def coverage(df: DataFrame, witness: str = "ndvi_mean") -> DataFrame:
    """Share of rows with a witness feature, per campaign."""
    return (df.filter(F.col("campagne_calc").isNotNull()).groupBy("campagne_calc")
            .agg(F.avg(F.col(witness).isNotNull().cast("double")).alias("couverture")))


def target_campaign(df: DataFrame, witness: str = "ndvi_mean", minimum: float = 0.5, forced: str | None = None) -> DataFrame:
    """Campaign to map: the forced one, else the latest with enough coverage, else the latest."""
    cov = coverage(df, witness)
    latest = cov.agg(F.max(F.when(F.col("couverture") >= minimum, F.col("campagne_calc"))).alias("ok"),
                     F.max("campagne_calc").alias("any"))
    return latest.select(F.coalesce(F.lit(forced or None), "ok", "any").alias("campagne_cible"))


def varied_decades(df: DataFrame, levels: int = 3) -> DataFrame:
    return (df.groupBy("campagne_decade").agg(F.count_distinct("severite").alias("n_niveaux"))
            .filter(F.col("n_niveaux") >= levels))


def latest_campaign(df: DataFrame, campaign: str = "campagne_calc") -> DataFrame:
    c = F.col(campaign)
    return df.filter(c.isNotNull()).agg(F.max_by(c, campaign_start_year(c)).alias("derniere"),
                                        F.min_by(c, campaign_start_year(c)).alias("premiere"))


def decade_map(df: DataFrame, decade: int | None = None) -> DataFrame:
    """Rows of one decade: the one asked for when the table has it, else the last one."""
    has = df.agg(F.max(F.when(F.col("campagne_decade") == F.lit(decade), F.lit(decade))).alias("d")).scalar()
    last = df.agg(F.max("campagne_decade").alias("d")).scalar()
    return df.filter(F.col("campagne_decade") == F.coalesce(has, last))


# --- exports -------------------------------------------------------------------------------------------

def geojson_features(cells: DataFrame, grid: DataFrame, properties: list[str], size: float = CELL_SIZE_M) -> DataFrame:
    """One GeoJSON feature text per mapped cell (inner join with the grid geometry)."""
    shaped = grid.select("cell_id", geo.cell_polygon("cell_col", "cell_row", size).alias("geometry"))
    props = F.to_json(F.struct("cell_id", *[p for p in properties if p != "cell_id"]), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.col("geometry"), F.lit("}"))
    return cells.join(shaped, "cell_id").select("cell_id", text.alias("feature"))


def raster_pixels(cells: DataFrame, grid: DataFrame, value: str = "severite", nodata: int = 255, size: float = CELL_SIZE_M) -> DataFrame:
    """Complete pixel matrix ``(px_row, px_col, value)`` over the bounds of the mapped cells, row 0 at the top."""
    placed = cells.join(grid.select("cell_id", "cell_col", "cell_row"), "cell_id")
    # a single pass over the mapped cells finds the frame; rows are then completed one by one
    frame = placed.agg(F.min("cell_col").alias("c0"), F.max("cell_col").alias("c1"),
                       F.min("cell_row").alias("r0"), F.max("cell_row").alias("r1"))
    full = (frame.select("c0", "c1", "r1", F.explode(F.sequence("r0", "r1")).alias("cell_row"))
            .repartition("cell_row")
            .select("c0", "r1", "cell_row", F.explode(F.sequence("c0", "c1")).alias("cell_col")))
    return (full.join(placed.select("cell_col", "cell_row", F.col(value).alias("v")), ["cell_col", "cell_row"], "left")
            .select((F.col("r1") - F.col("cell_row")).alias("px_row"), (F.col("cell_col") - F.col("c0")).alias("px_col"),
                    F.coalesce(F.col("v").cast("int"), F.lit(nodata)).alias("value")))


# --- detection bias --------------------------------------------------------------------------------------

def effort_by_region(df: DataFrame, region: str = "rn_nom") -> DataFrame:
    return df.groupBy(region, "campagne_calc").agg(
        F.avg("effort_prospection").alias("effort_mean"), F.avg("label").alias("taux_presence"),
        F.count("campagne_decade").alias("n_decades"))


def effort_trend(by_region: DataFrame) -> DataFrame:
    """Least-squares line and correlation of presence rate against mean effort.

    NaN where rows leave them open: the slope when all efforts are equal, the correlation when all efforts or all rates are equal."""
    y, x = "taux_presence", "effort_mean"
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    undefined = F.when(F.count_if(both) > 0, F.lit(float("nan")))
    # corr itself divides by the spread, and a spread of 0 is an error
    return by_region.agg(F.coalesce(F.regr_slope(y, x), undefined).alias("pente"), F.regr_intercept(y, x).alias("origine"),
                         F.coalesce(F.try_divide(F.covar_pop(y, x), spread), undefined).alias("r"))


def effort_quartiles(df: DataFrame, effort: str = "effort_prospection", label: str = "label") -> DataFrame:
    """Presence rate per quartile of effort; equal quartile edges merge."""
    probs = {f"q{i}": i / 4 for i in range(5)}
    edges = exact_quantiles(df, effort, probs).select(F.array_distinct(F.array(*probs)).alias("e")).scalar()
    e = F.col(effort).cast("double")
    # right-closed intervals, the lowest value belongs to the first
    nth = F.greatest(F.lit(1), F.size(F.filter(F.col("__edges"), lambda x: x < e)))
    return (df.filter(e.isNotNull()).withColumn("__edges", edges).withColumn("quartile", nth)
            .groupBy("quartile").agg(F.avg(label).alias("taux_presence"), F.count(label).alias("n_obs")))


def with_group_value(df: DataFrame, groups: DataFrame, key: str, value: str) -> DataFrame:
    """Looks a per-key value up; the lookup holds one row per key."""
    return df.join(groups.groupBy(key).agg(F.min(value).alias(value)), key, "left")


def compare_maps(predicted: DataFrame, external: DataFrame, keys=None) -> DataFrame:
    """Joins two risk maps on the area code when both have it, else on the region number."""
    if keys is None:
        first = "AIRE_CODE" if "AIRE_CODE" in external.columns else "rn_num"
        keys = [first, "campagne_calc"]
    return predicted.join(external, list(keys))
