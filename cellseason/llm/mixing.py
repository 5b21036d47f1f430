"""Mixing sources to target weights by capped water-filling, with whole and fractional repetitions of documents.

Every source gets its share of all words by weight. Sources whose share is above ``max_epochs`` times their own words are clamped there,
and what they leave is shared by weight among the rest, round by round, until no source is above. A source is then repeated as a whole as
often as its target allows, and the rest of its target is taken from its documents in a seeded random order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, placed, stored

#: Bits of a draw; it is the first hexadecimal digits of an MD5.
DRAW_BITS = 60


def words(text: Column) -> Column:
    """Number of runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int, *of: Column) -> Column:
    """A number below 2^60 out of the seed and the values (null counts as empty)."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in of]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, DRAW_BITS // 4), 16, 10).cast("long")


def cycle_weights(sources: DataFrame, length: int = 3) -> DataFrame:
    """source, weight: 1 to ``length``, repeating, for the different sources by code point, null last."""
    own = sources.select("source").distinct().withColumn("all", F.lit(0))
    return placed(own, "all", F.col("source").asc_nulls_last()).select("source", (F.col("idx") % length + 1).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source, source_size, weight with target. ``weight`` is a whole number of at least 0.

    Clamping compares whole numbers, so reruns agree. Each round is one aggregation over the sources; only its sums reach the driver.
    The targets add up to all words unless every source of positive weight is clamped.
    """
    cap = F.col("source_size") * max_epochs
    first = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total, share, weight, clamped = first.words or 0, first.words or 0, first.weight or 0, 0
    while True:
        # above: weight / all free weight * free words > cap
        above = F.col("weight").cast("decimal(20,0)") * F.lit(Decimal(share)) > cap.cast("decimal(20,0)") * F.lit(Decimal(weight)) if weight else F.col("weight") > 0
        found = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if found.n == clamped:
            break
        clamped, share, weight = found.n, total - found.capped, found.weight or 0
    filled = F.col("weight") * F.lit(float(share)) / F.lit(float(weight)) if weight else F.lit(0.0)
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(filled))


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by source, null equal to null."""
    right = right.withColumnRenamed("source", "own_source")
    return left.join(right, left["source"].eqNullSafe(right["own_source"]), how).drop("own_source")


def _cuts(rows: DataFrame, mixed: DataFrame, bits: int) -> DataFrame:
    """source, cut (draw, sub, k): extra repetitions go to the documents drawn before (draw, sub) and to k of those at it.

    A document gets one if its middle word lies below the rest of the target, counted in the order of draws; so the words taken differ
    from the target by half a document at most. Words are summed in buckets of draws first; only the bucket that the rest
    falls into is ordered, so a source may hold most documents.
    """
    before = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, -1)
    bucket = F.shiftright("draw", DRAW_BITS - bits)
    buckets = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(before.orderBy("bucket")), F.lit(0)))
    edges = (_same(buckets, mixed.filter("rest > 0").select("source", "rest")).filter("before <= rest and rest < before + words")
             .select(F.col("source").alias("own_source"), F.col("bucket").alias("own_bucket"), "before", "rest"))
    at_edge = rows.join(edges, F.col("source").eqNullSafe(F.col("own_source")) & (bucket == F.col("own_bucket")))
    groups = (at_edge.groupBy("source", "draw", "sub").agg(F.sum("size").alias("words"), F.count("*").alias("g"), F.min("before").alias("before"), F.min("rest").alias("rest"),
                                                           F.min("own_bucket").alias("bucket"))
              .withColumn("c", F.col("before") + F.coalesce(F.sum("words").over(before.orderBy("draw", "sub")), F.lit(0))))
    each = F.col("words") / F.col("g")
    k = F.when(F.col("words") == 0, F.col("g")).otherwise(F.least(F.col("g"), F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("c") - each / 2) / each) + 1)))
    end = F.struct(F.shiftleft(F.max("bucket") + 1, DRAW_BITS - bits).alias("draw"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("k"))
    return groups.withColumn("k", k).groupBy("source").agg(F.coalesce(F.min(F.when(F.col("k") < F.col("g"), F.struct("draw", "sub", "k"))), end).alias("cut"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 12, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: ``id_col``, size (words), source_size, target (words of its source), repeats, taken (repeats * size).

    ``weights`` has source and weight (whole numbers; sources without one get nothing); by default ``cycle_weights``. A null source is
    a source of its own, null and empty texts have no words, sources without words have target 0. The order of drawing follows the seed,
    the id and the text, not the layout of the table; rows equal in all three are drawn one by one, and it does not matter which of them is taken.
    No rows give no rows; other columns are ignored. Texts are read once; what is stored is a few numbers a document.
    """
    n = partitions(docs)
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
                              draw(seed, F.col(id_col), F.col(text_col)).alias("draw"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias("sub")), "mix")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = _same(totals, weights.select("source", "weight") if weights is not None else cycle_weights(totals), "left").fillna(0, ["weight"])
    whole = F.least(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(max_epochs))
    mixed = water_fill(stored(totals, "sources"), max_epochs).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    edge = F.struct(F.when(F.col("rest") > 0, F.lit(1 << DRAW_BITS)).otherwise(F.lit(-1)).cast("long").alias("draw"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("k"))
    cuts = _same(mixed, _cuts(rows, mixed, min(24, (8 * n).bit_length())), "left").withColumn("cut", F.coalesce("cut", edge))
    cuts = stored(cuts.select("source", "source_size", "target", "whole", "cut"), "cuts")  # of known size, so documents of a large source need not meet in one task
    met = _same(rows, cuts)
    at_cut = (F.col("draw") == F.col("cut.draw")) & (F.col("sub") == F.col("cut.sub"))
    before_cut = F.struct("draw", "sub") < F.struct("cut.draw", "cut.sub")
    few = met.filter(at_cut).withColumn("extra", (F.row_number().over(Window.partitionBy("source", "draw", "sub").orderBy("id")) <= F.col("cut.k")).cast("int"))
    repeats = F.col("whole") + F.col("extra")
    return met.filter(~at_cut).withColumn("extra", before_cut.cast("int")).unionByName(few).select(
        F.col("id").alias(id_col), "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))
