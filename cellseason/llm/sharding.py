"""Sharding: a uniform shuffle with exact shard sizes by a communication matrix.

The numbers of rows that go from each source to each block are drawn first, from the law that a uniform permutation gives them
(multivariate hypergeometric). Sources permute their rows and deal them out by the matrix; blocks permute what they get. A shard
is a row of blocks of known sizes, so no task ever holds a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, rank_in, stored

#: Cells of the matrix at most: it is drawn on the driver, and its side does not depend on the rows.
MATRIX_CELLS = 1 << 24


def split_evenly(total: int, parts: int) -> list[int]:
    """Whole numbers at most one apart."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without return are good ones; beyond the generator's range by inversion from the mode."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    up = down = mode
    p_up = p_down = p
    left = rng.random() - p
    while left > 0:  # the mode first, then outwards, in turn
        before = left
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if left == before:
            break
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, as a uniform permutation deals them."""
    rng = np.random.default_rng(seed)
    room = list(columns)
    out = []
    for size in rows:
        line, rest, need = [], sum(room), size
        for j, free in enumerate(room):
            rest -= free
            got = need if not rest else hypergeometric(rng, free, rest, need) if need and free else 0
            line.append(got)
            need -= got
            room[j] = free - got
        out.append(line)
    return out


def shuffle_into_shards(df: DataFrame, shards: int = 8, keep: tuple[str, ...] = ("doc_id",), seed: int = 20) -> DataFrame:
    """The columns of ``keep`` with shard (0 to shards - 1) and slot (0, 1, ... within the shard), in uniformly random order.

    Shard sizes are at most one row apart, the first shards are the larger ones. Every row is dealt by itself: repeated and equal
    rows spread over all shards, nulls do not matter, no rows give no rows, fewer rows than shards leave shards empty. ``keep``
    names what travels; other columns are ignored. A source is a partition of ``df`` (at most as many as there are shuffle partitions): it
    permutes its rows where they are and is written once to the shared folder, so a repeated task deals as before. Rows, texts
    included, are then exchanged once, by block. Blocks follow the number of shuffle partitions; the matrix of counts is bounded by MATRIX_CELLS.
    """
    n = partitions(df)
    blocks = shards * -(-n // shards)
    if n * blocks > MATRIX_CELLS:
        raise ValueError(f"{n} sources by {blocks} blocks exceed {MATRIX_CELLS} cells")
    own = F.monotonically_increasing_id()
    local = df.select(F.struct(*keep).alias("row")).coalesce(n).withColumn("at", own).withColumn("source", F.spark_partition_id())
    local = local.sortWithinPartitions(F.xxhash64(F.lit(seed + 1), "at"), "at").withColumn("n", own.bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stored(local, "sharding")
    counts = sorted((r.source, r["count"]) for r in rows.groupBy("source").count().collect())
    sizes = [split_evenly(size, blocks // shards) for size in split_evenly(sum(c for _, c in counts), shards)]
    matrix = communication_matrix([c for _, c in counts], [b for own_blocks in sizes for b in own_blocks], seed)
    spark = df.sparkSession
    dealt = spark.createDataFrame([(s, [int(x) for x in np.cumsum(line)]) for (s, _), line in zip(counts, matrix)], "source int, upto array<long>")
    first = [sum(own_blocks[:i]) for own_blocks in sizes for i in range(len(own_blocks))]
    starts = spark.createDataFrame([(b, b // (blocks // shards), x) for b, x in enumerate(first)], "block int, shard int, first long")

    turn = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 2), "at"), "at")
    # both tables are bounded by MATRIX_CELLS and go to all tasks, so rows are exchanged by block only
    placed = rows.join(F.broadcast(dealt), "source").select("row", "at", rank_in(F.col("upto"), blocks, F.col("n")).alias("block"))
    return (placed.withColumn("n", F.row_number().over(turn)).join(F.broadcast(starts), "block")
            .select("row.*", "shard", (F.col("first") + F.col("n") - 1).alias("slot")))
