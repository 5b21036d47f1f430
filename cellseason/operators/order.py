"""Order statistics without a single-task sort.

A running sum over one ordered group would put the whole group in one task. Here the order key is cut
into buckets of roughly equal size; buckets are summed in parallel, the short list of bucket totals is
accumulated, and each bucket is finished on its own. The approximate cut points only balance the work:
the result is exact for any cut, as long as all steps use the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

_BUCKET = "__bucket"
#: Rows of a bucket, about; a bucket is ordered by one task.
BUCKET_ROWS = 500_000


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder: what follows scans it instead of deriving it anew."""
    path = scratch_dir(df.sparkSession, "order")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _below(cuts: Column, n: int, value: Column) -> Column:
    """How many of at most ``n`` ascending ``cuts`` are below ``value``, by bisection."""
    def step(pos: Column, width: Column) -> Column:
        return F.when(F.get(cuts, pos + width - 1) < value, pos + width).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))]), F.lit(0), step)


def _with_bucket(df: DataFrame, keys: list[str], order: str, buckets: int) -> DataFrame:
    """``df`` is stored. Approximate cuts per key; rows of NULL keys meet no cut and fall into the first bucket.

    The cuts are stored: an approximate percentile depends on the order in which its parts are merged, and a second evaluation may
    give others, so that rows and totals would be dealt into different buckets."""
    cuts = stored(df.groupBy(*keys).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("__cuts")))
    cut = df.join(cuts, keys, "left") if keys else df.withColumn("__cuts", cuts.scalar())
    return cut.withColumn(_BUCKET, F.coalesce(_below(F.col("__cuts"), buckets - 1, F.col(order)), F.lit(0))).drop("__cuts")


def running_before(df: DataFrame, order: str, measures: list[str], keys: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Adds ``<m>_before``: the sum of ``m`` over rows of the same keys with a smaller ``order``.

    ``(keys, order)`` must be unique; aggregate to distinct order values first. The number of buckets follows the
    number of rows. NULL keys are dropped by the keyed form (they never match a group)."""
    keys, df = list(keys), stored(df)
    buckets = buckets or 1 + df.count() // BUCKET_ROWS
    if buckets == 1:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return (df.dropna(subset=keys) if keys else df).select("*", *[F.coalesce(F.sum(m).over(whole), F.lit(0)).alias(f"{m}_before") for m in measures])
    cut = _with_bucket(df, keys, order, buckets)
    by_bucket = cut.groupBy(*keys, _BUCKET).agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    w = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(*keys, _BUCKET, *[
        F.coalesce(F.sum(f"__t_{m}").over(w), F.lit(0)).alias(f"__o_{m}") for m in measures])
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"__l_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    return local.join(offsets, keys + [_BUCKET]).select(
        *df.columns, *[(F.col(f"__l_{m}") + F.col(f"__o_{m}")).alias(f"{m}_before") for m in measures])


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key; one column per entry of ``probs``.

    Equal values collapse to one counted row before anything is ordered."""
    keys = list(keys)
    counts = stored(df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
                    .groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n")))
    ranked = running_before(counts, "__v", ["__n"], keys, buckets)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    if keys:
        ranked = ranked.join(totals, keys)
    else:
        ranked = ranked.withColumn("__total", totals.scalar())
    aggs = []
    for name, p in probs.items():
        h = (F.col("__total") - 1) * F.lit(float(p))
        at = lambda r: F.max(F.when((F.col("__n_before") <= r) & (r < F.col("__n_before") + F.col("__n")), F.col("__v")))
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        frac = F.max(h - F.floor(h))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def exact_median(df: DataFrame, value: str, keys: list[str] = (), name: str = "median", buckets: int | None = None) -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, keys, buckets)


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median of each column as rows ``(feature, median)``.

    Approximate percentiles bracket the middle of each column: their error in rank is at most a 2000th of the rows, the bracket is twice as
    wide. Values outside are moved to its ends, which leaves the median as it is, so that the values that are exchanged are few."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    df = stored(df.select(*[known(c) for c in columns]))
    ends = df.agg(*[F.percentile_approx(c, [0.499, 0.501], 2000).alias(c) for c in columns]).first()
    inside = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(ends[c][0]), F.least(F.lit(ends[c][1]), F.col(c)))).alias(c)
    long = df.select(*[inside(c) if ends[c] else c for c in columns]).unpivot([], columns, "feature", "value")
    return exact_median(long, "value", ["feature"], "median")


def with_median_fill(df: DataFrame, columns: list[str], medians: DataFrame) -> DataFrame:
    """Fills NULLs of ``columns`` with ``medians`` (one row per column, so it travels as a small map)."""
    lookup = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.try_element_at(lookup, F.lit(c)))
                           for c in columns})


def counts_by_season(df: DataFrame, columns: list[str], season: Column) -> DataFrame:
    """``(feature, value, season, n)``: how often each value of each column comes in each season, missing ones left out.

    The tables of two seasons are merged by a union: a new season is counted alone."""
    long = df.select(season.alias("season"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["season"], columns, "feature", "value")
    return long.filter(F.col("season").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature", "value", "season").agg(F.count("*").alias("n"))


def expanding_medians(counts: DataFrame, starts: list[int], buckets: int | None = None) -> DataFrame:
    """``(start, feature, median)``: exact medians of each feature over the seasons before each of ``starts``.

    ``counts`` is as ``counts_by_season`` gives it (or several of them together). Every different value is one row with one count for
    each start, so all windows come out of one pass of running sums; no value is ordered twice. A window without values has no row."""
    names = {s: f"c{i}" for i, s in enumerate(sorted(set(starts)))}
    if not names:
        return counts.select(F.col("n").cast("int").alias("start"), "feature", F.col("value").alias("median")).limit(0)
    wide = stored(counts.groupBy("feature", "value").agg(*[F.coalesce(F.sum(F.when(F.col("season") < s, F.col("n"))), F.lit(0)).alias(c) for s, c in names.items()])
                  .filter(F.col(list(names.values())[-1]) > 0))
    totals = wide.groupBy("feature").agg(*[F.sum(c).alias(f"t_{c}") for c in names.values()])
    ranked = running_before(wide, "value", list(names.values()), ["feature"], buckets).join(totals, "feature")

    def median(c: str) -> Column:
        at = lambda r: F.max(F.when((F.col(f"{c}_before") <= r) & (r < F.col(f"{c}_before") + F.col(c)), F.col("value")))
        h = (F.col(f"t_{c}") - 1) / F.lit(2.0)
        low, high = at(F.floor(h)), at(F.ceil(h))
        return low + (high - low) * F.max(h - F.floor(h))

    medians = ranked.groupBy("feature").agg(F.array(*[F.struct(F.lit(s).alias("start"), median(c).alias("median")) for s, c in names.items()]).alias("m"))
    return medians.select("feature", F.inline("m")).filter("median is not null").select("start", "feature", "median")


def with_fold_fill(df: DataFrame, columns: list[str], medians: DataFrame, start: int) -> DataFrame:
    """Fills NULLs of ``columns`` with the medians of the seasons before ``start``."""
    return with_median_fill(df, columns, medians.filter(F.col("start") == start).select("feature", "median"))
