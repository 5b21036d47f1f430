"""Training tables, class balance, folds and hold-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (LABEL_KEYS, NON_PREDICTORS, REGION_KEYS, REGION_META, REGION_TARGETS, SKIPPED_CAMPAIGNS)
from ..functions.calendar import campaign_start_year
from ..functions.scoring import draw
from .order import exact_median, running_before


def training_table(features: DataFrame, labels: DataFrame, keys=LABEL_KEYS) -> DataFrame:
    """Feature rows with their labels; rows without an observed severity form the prediction surface."""
    return (features.join(labels, list(keys), "left")
            .withColumn("a_predire", F.col("severite").isNull()))


def shift_target(table: DataFrame, horizon: int = 0, target: str = "severite") -> DataFrame:
    """Target ``horizon`` rows ahead per cell; 0 keeps the same-decade target."""
    if horizon == 0:
        return table
    w = Window.partitionBy("cell_id").orderBy("date_start")
    ahead = F.lead(target, horizon).over(w)
    return table.withColumn(target, ahead).withColumn("a_predire", F.col(target).isNull())


def predictors(df: DataFrame, exclude=NON_PREDICTORS) -> list[str]:
    """Everything not excluded, in table order."""
    return [c for c in df.columns if c not in set(exclude)]


def region_predictors(df: DataFrame, with_targets: bool = False) -> list[str]:
    """Predictors of the region tables; the two-stage models also exclude their own targets."""
    return predictors(df, REGION_KEYS + REGION_META + (REGION_TARGETS if with_targets else ()))


def numeric_predictors(df: DataFrame, exclude=NON_PREDICTORS) -> list[str]:
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    ok = ("integer", "long", "short", "byte", "float", "double", "decimal", "boolean")
    return [c for c in predictors(df, exclude) if kinds[c] in ok]


def median_density(records: DataFrame, keys=("rn_num", "campagne_calc", "campagne_decade"),
                   density: str = "densite_imago", buckets: int = 8) -> DataFrame:
    """Exact median density per key, rows with a null key or density left out."""
    rows = records.dropna(subset=[*keys, density])
    return exact_median(rows, density, list(keys), "densite_imago_median", buckets)


def with_median_density(table: DataFrame, density: DataFrame | None,
                        keys=("rn_num", "campagne_calc", "campagne_decade")) -> DataFrame:
    """Attaches the density table; without one the column exists and is NULL."""
    if density is None:
        return table.withColumn("densite_imago_median", F.lit(None).cast("double"))
    return table.join(density, list(keys), "left")


# --- balance ----------------------------------------------------------------------------------------

def class_weights(df: DataFrame, label: str = "severite") -> DataFrame:
    """``n / (k * count)`` per class present."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    k = counts.agg(F.count("*").alias("k")).scalar()
    return counts.withColumn("weight", total / (k * F.col("n")))


def with_class_weight(df: DataFrame, label: str = "severite", name: str = "class_weight") -> DataFrame:
    """Row weight of its class; the handful of class weights travels as a map."""
    w = class_weights(df, label)
    lookup = w.agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("string").alias("k"), "weight")))).scalar()
    return df.withColumn(name, F.try_element_at(lookup, F.col(label).cast("string")))


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives over positives, 1.0 when there is no positive."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(F.when(pos == 0, F.lit(1.0)).otherwise(F.try_divide(neg.cast("double"), pos.cast("double")))
                  .alias("scale_pos_weight"))


# --- folds --------------------------------------------------------------------------------------------

def campaigns(df: DataFrame, campaign: str = "campagne_calc", skip=SKIPPED_CAMPAIGNS) -> DataFrame:
    """Distinct campaigns with their start year (one row per season)."""
    rows = df.select(F.col(campaign).alias("campagne")).filter("campagne is not null").distinct()
    if skip:
        rows = rows.filter(~F.col("campagne").isin(*skip))
    return rows.withColumn("start_year", campaign_start_year("campagne"))


def _season_runs(seasons: DataFrame, *fields: str) -> DataFrame:
    """Sorted seasons as one short array ``ss``: fold building is array arithmetic, not a join."""
    return seasons.agg(F.sort_array(F.collect_set(F.struct("start_year", *fields))).alias("ss"))


def walk_forward_folds(df: DataFrame, campaign: str = "campagne_calc", skip=SKIPPED_CAMPAIGNS) -> DataFrame:
    """``(fold_id, role, campagne)``: every campaign after the first is tested on all earlier ones."""
    runs = _season_runs(campaigns(df, campaign, skip), "campagne")
    tests = runs.select("ss", F.posexplode("ss").alias("fold_id", "s")).filter("fold_id > 0")
    rows = F.concat(F.array(F.struct(F.lit("test").alias("role"), F.col("s.campagne").alias("campagne"))),
                    F.transform(F.slice("ss", F.lit(1), F.col("fold_id")),
                                lambda t: F.struct(F.lit("train").alias("role"), t["campagne"].alias("campagne"))))
    return tests.select("fold_id", F.inline(rows))


def split_folds(df: DataFrame, campaign: str = "campagne_calc", split: str = "split") -> DataFrame:
    """Folds of a table with a split column: one per validation campaign, trained on the train split
    and the earlier validation campaigns."""
    seasons = (df.filter(F.col(split).isin("train", "validation"))
               .select(F.col(campaign).alias("campagne"), F.col(split).alias("split")).distinct()
               .withColumn("start_year", campaign_start_year("campagne")))
    runs = _season_runs(seasons, "campagne", "split")
    val = F.filter("ss", lambda t: t["split"] == "validation")
    tests = runs.select("ss", F.posexplode(val).alias("i", "s"))
    named = lambda role, t: F.struct(F.lit(role).alias("role"), t["campagne"].alias("campagne"), t["split"].alias("split"))
    train = F.filter("ss", lambda t: (t["split"] == "train") | (t["start_year"] < F.col("s.start_year")))
    rows = F.concat(F.array(named("test", F.col("s"))), F.transform(train, lambda t: named("train", t)))
    return tests.select((F.col("i") + 1).alias("fold_id"), F.inline(rows))


def fold_list(folds: DataFrame) -> list[tuple[list[str], str]]:
    """Fold table as Python lists for the fitting loops (one entry per season)."""
    rows = folds.groupBy("fold_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("role") == "train", F.col("campagne")))).alias("train"),
        F.max(F.when(F.col("role") == "test", F.col("campagne"))).alias("test")).orderBy("fold_id").collect()
    return [(list(r["train"]), r["test"]) for r in rows]


def fold_rows(df: DataFrame, folds: DataFrame, campaign: str = "campagne_calc") -> DataFrame:
    """Rows of every fold with ``(fold_id, role)``; the season table is small and broadcast by its size."""
    return df.join(folds.withColumnRenamed("campagne", campaign), campaign)


def stratified_holdout(df: DataFrame, key: str, label: str, share: float = 0.20, seed: int = 42) -> DataFrame:
    """Marks ``share`` of each class as hold-out: the rows whose draw ranks lowest in the class.

    Distributed running counts give one cut value per class; rows then only compare their own draw."""
    drawn = df.withColumn("__u", draw(key, seed))
    tally = drawn.groupBy(label, "__u").agg(F.count("*").alias("__c"))
    size = tally.groupBy(label).agg(F.sum("__c").alias("__n"))
    cut = (running_before(tally, "__u", ["__c"], [label]).join(size, label)
           .filter(F.col("__c_before") < F.rint(F.col("__n") * F.lit(share)))
           .groupBy(label).agg(F.max("__u").alias("__cut")))
    return (drawn.join(cut, label, "left")
            .withColumn("is_holdout", F.coalesce(F.col("__u") <= F.col("__cut"), F.lit(False))).drop("__u", "__cut"))
