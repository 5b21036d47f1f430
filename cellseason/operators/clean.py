"""Cleaning, projection and audit operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CUBE_META, LABEL_KEYS, LAT_BOUNDS, LON_BOUNDS, PHASES
from ..functions import calendar as cal

SURVEY_RENAMES = {
    "Campagne": "campagne_xls", "Sol larve": "Sol_larve", "Trans larve": "Trans_larve", "Greg larve": "Greg_larve",
}


def drop_matching(df: DataFrame, pattern: str = r"_NSE|^NSE\.Sup_inf$") -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def rename_existing(df: DataFrame, names: dict[str, str] = SURVEY_RENAMES) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def _in_bounds(lat: str, lon: str):
    return F.col(lat).between(*LAT_BOUNDS) & F.col(lon).between(*LON_BOUNDS)


def valid_positions(df: DataFrame, lat: str = "LAT_DD", lon: str = "LNG_DD") -> DataFrame:
    return df.filter(_in_bounds(lat, lon))


def position_audit(df: DataFrame, lat: str = "LAT_DD", lon: str = "LNG_DD") -> DataFrame:
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(missing).alias("n_missing"),
        F.count_if(~missing & ~_in_bounds(lat, lon)).alias("n_out_of_bounds"),
        F.count_if(_in_bounds(lat, lon)).alias("n_valid"))


def with_season_fields(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({
        "campagne_calc": cal.campaign_label(date), "decade_intra": cal.decade_intra(date),
        "campagne_decade": cal.campaign_decade(date)})


def decade_mismatch(df: DataFrame, recorded: str = "Decade") -> DataFrame:
    """Recorded yearly decade against the third of the month derived from the date."""
    derived = F.pmod(F.col(recorded).cast("int") - 1, F.lit(3)) + 1
    both = F.col(recorded).isNotNull() & F.col("decade_intra").isNotNull()
    return df.agg(F.count_if(both).alias("n_checked"),
                  F.count_if(both & (derived != F.col("decade_intra"))).alias("n_mismatch"))


def clean_surveys(df: DataFrame) -> DataFrame:
    """Raw survey sheet to dated, positioned records."""
    out = drop_matching(df)
    out = valid_positions(out.withColumn("date", cal.survey_date(out, "Date_")))
    return with_season_fields(rename_existing(out))


def cube_columns(df: DataFrame) -> DataFrame:
    """Calendar vocabulary to label vocabulary, metadata first, technical columns removed."""
    out = df.withColumnsRenamed({"campaign": "campagne_calc", "decade_num": "campagne_decade"})
    technical = {"decade_id", "midpoint", "decade_ord", "cal_decade", "legacy_decade_id"}
    rest = [c for c in out.columns if c not in CUBE_META and c not in technical]
    return out.select(*CUBE_META, *rest)


def keep_columns(df: DataFrame | None, names: dict[str, str], keep: list[str], schema: T.StructType | None = None,
                 spark: SparkSession | None = None) -> DataFrame:
    """Renames and keeps, in the order asked; no input gives an empty table of the given schema."""
    if df is None:
        return spark.createDataFrame([], schema)
    out = rename_existing(df, names)
    return out.select(*[c for c in keep if c in out.columns])


def observed(df: DataFrame, target: str = "severite") -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def to_predict(df: DataFrame) -> DataFrame:
    return df.filter("a_predire")


def labeled_splits(df: DataFrame, splits=("train", "validation")) -> DataFrame:
    return df.filter(F.col("split").isin(*splits))


def phase_rows(df: DataFrame, phase: str = "niveau_gregarite_dominant", label: str = "label") -> DataFrame:
    return df.filter((F.col(label) == 1) & F.col(phase).isin(*PHASES))


# --- checks: every check is a table of violations --------------------------------------------------

def range_violations(df: DataFrame, keys=("cell_id", "AIRE_CODE", "campagne_calc", "campagne_decade", "date_start")) -> DataFrame:
    """Rows ``(rule, n_violations)``: null keys and values outside their physical range, in one pass."""
    ranges = {"ndvi_mean": (-1.0, 1.0), "lst_mean": (200.0, 400.0), "chirps_sum_mean": (0.0, None)}
    checks = {f"null_{k}": F.col(k).isNull() for k in keys if k in df.columns}
    for c, (lo, hi) in ranges.items():
        if c in df.columns:
            v = F.col(c)
            checks[f"range_{c}"] = (v < lo) if hi is None else ((v < lo) | (v > hi))
    return (df.agg(*[F.count_if(cond).alias(n) for n, cond in checks.items()])
            .unpivot([], list(checks), "rule", "n_violations"))


def completeness_violations(df: DataFrame, cells: DataFrame, decade: str = "campagne_decade") -> DataFrame:
    """Decades that do not cover the number of cells of the grid.

    Cells are reduced to distinct (year, decade, cell) rows first, so the distinct count never builds a
    set per decade."""
    n = cells.select("cell_id").distinct().agg(F.count("*").alias("n")).scalar()
    return (df.select("year", decade, "cell_id").distinct()
            .groupBy("year", decade).agg(F.count("cell_id").alias("n_cells"))
            .withColumn("n_expected", n).filter("n_cells <> n_expected"))


def duplicate_keys(df: DataFrame, keys=("cell_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_empty(violations: DataFrame, message: str) -> None:
    """Raises when a violations table has rows, naming a few of them."""
    if "n_violations" in violations.columns:
        violations = violations.filter("n_violations > 0")
    bad = violations.take(3)
    if bad:
        raise AssertionError(f"{message}: {[r.asDict() for r in bad]}")


# --- profiles -------------------------------------------------------------------------------------

def null_rates(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    return (df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), digits).alias(c) for c in columns])
            .unpivot([], columns, "feature", "null_rate"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, NULL included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def drop_keyless(df: DataFrame, keys=LABEL_KEYS) -> DataFrame:
    return df.dropna(subset=list(keys))
