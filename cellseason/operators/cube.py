"""Space-time cube: cells x decades with covariates, and its incremental upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal


def spine(cells: DataFrame, lo: Column, hi: Column, season_only: bool = True, keep=("cell_id", "AIRE_CODE")) -> DataFrame:
    """Cells x decades by exploding the run of ordinals inside each cell row: no join at all."""
    rows = cells.select(*[c for c in keep if c in cells.columns], F.explode(cal.ordinals(lo, hi)).alias("decade_ord"))
    if season_only:
        rows = rows.filter(cal.decade_fields("decade_ord")["decade_num"].isNotNull())
    return rows


def season_span(df: DataFrame, date: str) -> tuple[Column, Column]:
    """First and last decade ordinal of the civil years met in ``date``, as scalar subqueries."""
    years = df.agg(F.min(F.year(date)).alias("lo"), F.max(F.year(date)).alias("hi"))
    return years.select(F.col("lo") * 36).scalar(), years.select(F.col("hi") * 36 + 35).scalar()


def left_join_sources(base: DataFrame, sources: list[DataFrame | None]) -> DataFrame:
    """Left-joins each source on (cell, decade); sources that are absent are skipped."""
    usable = [s for s in sources if s is not None and "cell_id" in s.columns]
    return reduce(lambda acc, s: acc.join(s, ["cell_id", "decade_ord"], "left"), usable, base)


def stack_on_spine(base: DataFrame, sources: list[DataFrame | None], partition: str = "cell_id") -> DataFrame:
    """Same result as :func:`left_join_sources` for sources unique on (cell, decade), in one exchange.

    Spine and sources are stacked, hashed once by cell and folded by (cell, decade). Windows per cell
    that follow reuse the partitioning, so cube, lags, streaks and labels share a single shuffle. Each
    source is already one row per key, so a cell holds at most (1 + sources) x decades rows."""
    usable = [s for s in sources if s is not None and "cell_id" in s.columns]
    names = [c for s in usable for c in s.columns if c not in ("cell_id", "decade_ord")]
    carried = [c for c in base.columns if c not in ("cell_id", "decade_ord")]
    parts = [base.withColumn("__spine", F.lit(True))] + usable
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    folded = (stacked.repartition(partition).groupBy("cell_id", "decade_ord")
              .agg(F.max("__spine").alias("__spine"), *[F.max(c).alias(c) for c in carried + names]))
    return folded.filter("__spine").drop("__spine")


def with_calendar(df: DataFrame) -> DataFrame:
    """Calendar attributes under the names the label tables use."""
    f = cal.decade_fields("decade_ord")
    renames = {"campaign": "campagne_calc", "decade_num": "campagne_decade"}
    return df.select("*", *[c.alias(renames.get(n, n)) for n, c in f.items()])


def keep_latest(rows: DataFrame, keys=("cell_id", "date_start"), version: str = "batch_no") -> DataFrame:
    """Newest version of each key; of equal versions the greatest row (columns compared from left to right, NULL least), whatever the
    order of arrival. An aggregate, not a window: versions are reduced before the shuffle."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys and c != version]
    best = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def keep_first(rows: DataFrame, keys, order: str) -> DataFrame:
    """First row of each key in an explicit order."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(existing: DataFrame, incoming: DataFrame, keys=("cell_id", "date_start"), version: str | None = None) -> DataFrame:
    """Existing rows overlaid by incoming ones with the same key.

    ``version`` names a column that says how new a row is (NULL is oldest): a key keeps its newest row, so a batch that comes late does
    not undo a newer one. Of equal versions the incoming row wins, and of several incoming ones the greatest."""
    both = (existing.withColumn("batch_no", F.lit(0))
            .unionByName(incoming.withColumn("batch_no", F.lit(1)), allowMissingColumns=True))
    if version is None:
        return keep_latest(both, keys)
    newest = keep_latest(both.withColumn("batch_no", F.struct(F.col(version).alias("v"), "batch_no")), keys)
    return newest.select(*[c for c in both.columns if c != "batch_no"])
