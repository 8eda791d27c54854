"""Profiles from a stream of operations: an append-only log, and profiles folded from the last ones and each batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from looseleaf.operators.change_feed import deliver_once, profile_state


def fold_batch(batch: DataFrame, state: DataFrame) -> DataFrame:
    """The state after a batch of operations, for foreachBatch; deliveries in any order and split give the same state.

    Users without an operation in the batch are taken over as they are.
    """
    users = deliver_once(batch).select("user_id").distinct()
    folded = profile_state(batch, state.join(users, "user_id", "left_semi"))
    return state.join(users, "user_id", "left_anti").unionByName(folded)


def write_profiles(ops: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends the operations of a stream to folder/log and writes profiles to folder/state.

    Each batch writes a version of its own number, of the log and of the state, so a batch that runs again after a failure
    replaces its own rows only. read_profiles gives the last version. A version goes two batches later.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        state = profile_state(batch.limit(0)) if number == 0 else batch.sparkSession.read.parquet(f"{folder}/state/version={number - 1}")
        fold_batch(batch, state).write.mode("overwrite").parquet(f"{folder}/state/version={number}")
        if number > 1:
            fs_path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/version={number - 2}")
            fs_path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(fs_path, True)
        batch.unpersist()

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_profiles(spark, folder: str) -> DataFrame | None:
    """The last version of the profiles, None before the first."""
    try:
        versions = spark.read.parquet(f"{folder}/state")
    except AnalysisException:
        return None
    return versions.where(versions["version"] == versions.agg({"version": "max"}).first()[0]).drop("version")
