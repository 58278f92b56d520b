"""The change log as a stream, and closures kept up by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..store_quads import CHANGES_DDL, QuadStore


def publish(store: QuadStore, path: str) -> None:
    """Appends every change of a store to a folder of Parquet files."""
    store.listeners.append(lambda rows: rows.write.mode("append").parquet(path))


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The change log of a folder as a stream, in commit order of its files."""
    return spark.readStream.schema(CHANGES_DDL).parquet(path)


def on_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``apply`` with each batch of changes that is there, then ends; goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replicate(target: QuadStore) -> Callable[[DataFrame, int], None]:
    """A batch function that makes another store follow a change log."""

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        target._commit(batch.where("action = 'added'").select("s", "p", "o", "g"), batch.where("action = 'removed'").select("s", "p", "o", "g"))  # noqa: SLF001
        batch.unpersist()

    return apply
