"""Incremental upkeep of the cube from a stream of decade tables: the batch upsert per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.readers import path_exists
from ..sources.sinks import upsert_cube


def cube_upserter(path: str, staging_root: str, keys=("cell_id", "date_start"), partition: str = "campagne_calc", per_date: int | None = None,
                  version: str | None = None):
    """Function for ``writeStream.foreachBatch``. A batch overwrites its own staging folder, so one that broke off is simply done again;
    a batch that was committed is entered in the ledger ``staging_root/done`` and a replay of it is left out. ``per_date`` and
    ``version`` are those of ``upsert_cube``: dates must be complete, and newer rows win over late ones."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, entry = batch.sparkSession, f"{staging_root}/done/batch-{batch_id}"
        if path_exists(spark, f"{entry}/_SUCCESS"):
            return
        upsert_cube(spark, batch, path, f"{staging_root}/batch-{batch_id}", keys, partition, per_date, version)
        spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("overwrite").parquet(entry)

    return merge


def start(stream: DataFrame, path: str, staging_root: str, checkpoint: str, per_date: int | None = None, version: str | None = None):
    """Runs the upsert over everything available, then stops."""
    return (stream.writeStream.foreachBatch(cube_upserter(path, staging_root, per_date=per_date, version=version))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
