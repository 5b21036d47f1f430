"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors see. Where that is unset, a session in one process takes a
    temporary folder and a cluster gets an error."""
    return scratch_dir(spark, label)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``; see ``shared_folder`` where that is unset."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoints"))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps start from the files, whatever executors are lost."""
    folder = f"{shared_folder(df.sparkSession, label)}/table"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def partitions(df: DataFrame) -> int:
    """The number of shuffle partitions that the cluster is set to: the fan-out of blocks follows it."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def placed(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """``df`` with idx (the place of a row in its group, from 0, by ``order``) and n (rows of the group); ``group`` has no nulls.

    Rows are cut into ranges of (group, order), so that one group may hold most rows; a range numbers its rows and learns how many
    rows of the group lie before it. Rows of equal order are numbered in any order.
    """
    keys = [F.col(group), *order, F.col("tie")]
    ranges = stored(df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys)
                    .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("tie"), "placed")
    whole = Window.partitionBy(group)
    starts = (ranges.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
              .select(group, "part", "first", F.sum("rows").over(whole).alias("n"),
                      F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    return ranges.join(starts, [group, "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = 256) -> DataFrame:
    """``make()`` runs once in a task; its result maps lists by column name to lists by column name, ``rows`` rows at a time."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even where ``body`` uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_in(cuts: Column, n: int, value: Column) -> Column:
    """How many of the ``n`` ascending ``cuts`` are at most ``value``: a binary search inside the row."""
    steps = [1 << i for i in reversed(range(max(1, n.bit_length())))]

    def step(pos: Column, width: Column) -> Column:
        return F.when((pos + width <= n) & (F.get(cuts, pos + width - 1) <= value), pos + width).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
