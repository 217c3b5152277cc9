"""Inserts as a stream: a file source of keys, appended to a store micro-batch by micro-batch.

The query keeps no state.  A batch's number is committed in the manifest that commits its keys,
so a batch that is run again after a failure at any point is stored once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pathloom.plans.store import Store


def insert_stream(source: DataFrame, store: Store, checkpoint: str, to_keys: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Start appending ``to_keys(batch)`` of a streaming source to the store; stops when all available input is stored."""

    def append(batch: DataFrame, number: int) -> None:
        store.insert(to_keys(batch), batch=f"{checkpoint}#{number}")

    return source.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


def file_source(spark: SparkSession, folder: str, schema, files_each: int = 1) -> DataFrame:
    """A stream of the Parquet files that a folder holds or gets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)
