"""Sinks: stage tables, reports, exports, chosen-model record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BASELINE_MODEL, CLIMATOLOGY_YEARS
from ..functions.calendar import decade_fields
from ..operators.clean import duplicate_keys, range_violations, require_empty
from ..operators.composites import climatology_of, climatology_state, merge_climatology
from ..operators.cube import upsert
from .readers import path_exists


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_cube(df: DataFrame, path: str, partition: str = "campagne_calc", spread: str = "cell_id") -> None:
    """Partitioned dataset; ``overwrite`` purges earlier parts.

    Range partitioning on (campaign, cell) balances the tasks by size: a large campaign becomes several
    files, small ones share a task, and the file count stays near tasks + campaigns."""
    df.repartitionByRange(partition, spread).write.mode("overwrite").partitionBy(partition).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str = "campagne_calc") -> None:
    """Overwrites only the partitions present in ``df``."""
    (df.repartitionByRange(partition, "cell_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def upsert_cube(spark: SparkSession, incoming: DataFrame, path: str, staging: str,
                keys=("cell_id", "date_start"), partition: str = "campagne_calc", per_date: int | None = None, version: str | None = None) -> None:
    """Merges new decades into a partitioned cube, rewriting only the campaigns they touch.

    The merge is written to ``staging`` first: a partition is never read and overwritten in one job, and
    either half can be rerun after a lost executor or driver. The first batch makes the cube. What was merged is
    checked before it replaces anything: keys once, covariates in their ranges, and with ``per_date`` (number of cells) as
    many rows for each date of the batch; a failed check raises and leaves the cube as it was. ``version`` is that of ``upsert``: with it,
    rows of one key inside a batch and batches that come late are decided by the column."""
    merged = upsert(incoming.limit(0), incoming, keys, version) if version else incoming
    if path_exists(spark, path):
        touched = incoming.select(partition).distinct()
        merged = upsert(spark.read.parquet(path).join(touched, partition, "left_semi"), incoming, keys, version)
    merged.write.mode("overwrite").parquet(staging)
    merged = spark.read.parquet(staging)
    require_empty(duplicate_keys(merged, keys), "duplicate keys after the merge")
    require_empty(range_violations(merged, keys), "values out of range after the merge")
    if per_date is not None:
        dates = merged.join(incoming.select(keys[-1]).distinct(), keys[-1], "left_semi").groupBy(keys[-1]).agg(F.count("*").alias("n"))
        require_empty(dates.filter(F.col("n") != per_date), "dates without all cells after the merge")
    replace_partitions(merged, path, partition)


def update_climatology(spark: SparkSession, decade_sums: DataFrame, path: str, value: str = "chirps_sum_mean", years=CLIMATOLOGY_YEARS) -> DataFrame:
    """Adds the years of ``decade_sums`` to the stored climatology and returns it.

    The state holds sum and count of each cell and decade of the year, so a new year is counted alone and merged; no earlier year is read
    again. A ledger beside it names the state in force and the years in it: a year that is already in does not count twice, and a
    merge that broke off is not in the ledger, so it is made anew."""
    ledger, kinds = f"{path}/ledger", "number int, years array<int>"
    spark.createDataFrame([], kinds).write.mode("append").parquet(ledger)
    last = spark.read.schema(kinds).parquet(ledger).agg(F.max(F.struct("number", "years")).alias("r")).first()["r"]
    number, known = (last["number"], list(last["years"])) if last else (0, [])
    year = decade_fields("decade_ord")["year"]
    fresh = decade_sums.filter(year.between(*years) & ~year.isin(known or [-1]))
    new = sorted(r[0] for r in fresh.select(year.cast("int")).distinct().collect())
    if new:
        state = climatology_state(fresh, value)
        if known:
            state = merge_climatology(spark.read.parquet(f"{path}/state-{number}"), state)
        state.write.mode("overwrite").parquet(f"{path}/state-{number + 1}")
        spark.createDataFrame([(number + 1, sorted(known + new))], kinds).coalesce(1).write.mode("append").parquet(ledger)
        number += 1
    if not number:
        return climatology_of(climatology_state(fresh, value))
    return climatology_of(spark.read.parquet(f"{path}/state-{number}"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def write_choice(ranking: DataFrame, path: str) -> None:
    """One-row record: the ranked names, the kept model and the kappa it had to reach."""
    (ranking.agg(F.transform(F.sort_array(F.collect_list(F.struct("rang", "modele"))), lambda s: s["modele"]).alias("classement"),
                 F.min_by("modele", "rang").alias("modele_retenu"))
     .write.mode("overwrite").json(path))


def chosen_model(record: DataFrame | None, baseline: str = BASELINE_MODEL) -> Column | str:
    """Kept model of a record, the baseline when there is no record or no eligible model."""
    if record is None or "modele_retenu" not in record.columns:
        return baseline
    return F.coalesce(record.agg(F.max("modele_retenu").alias("m")).scalar(), F.lit(baseline))
