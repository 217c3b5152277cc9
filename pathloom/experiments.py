"""Sweeps over the store's parameters: buffer sizes and bulk-loaded fractions, timed."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.plans.scratch import file_system, materialize, new_folder
from pathloom.plans.store import Store


def load(store: Store, keys: DataFrame, fraction: float = 1.0, batches: int = 4) -> None:
    """Bulk-load about ``fraction`` of the keys (by a hash of their references) and insert the rest in ``batches``."""
    place = F.pmod(F.xxhash64("ref", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    placed = materialize(keys.withColumn("_place", place), "load")
    store.bulk_load(placed.where(F.col("_place") < fraction).drop("_place"))
    if fraction < 1:
        width = (1 - fraction) / batches
        for i in range(batches):
            low, high = fraction + i * width, fraction + (i + 1) * width if i < batches - 1 else 1.0
            store.insert(placed.where((F.col("_place") >= low) & (F.col("_place") < high)).drop("_place"))


def stored_bytes(store: Store) -> int:
    """Bytes of a store's folder, with what older manifests keep."""
    system, folder = file_system(store.spark, store.root)
    return system.getContentSummary(folder).getLength()


def sweep(keys: DataFrame, buffers: list[int], fractions: list[float], batches: int = 4) -> DataFrame:
    """(max_buffer_keys, fraction, n_keys, levels, bytes, seconds) of a store built with each buffer size and fraction."""
    spark = keys.sparkSession
    keys = materialize(keys, "sweep")
    rows = []
    for buffer in buffers:
        for fraction in fractions:
            store = Store(spark, new_folder(spark, "store"), buffer)
            began = time.perf_counter()
            load(store, keys, fraction, batches)
            took = time.perf_counter() - began
            facts = store.facts().collect()
            rows.append((buffer, float(fraction), sum(r.n_keys for r in facts), ",".join(sorted(r.place for r in facts if r.place != "buffer")), stored_bytes(store), took))
            store.clear()
    return spark.createDataFrame(rows, "max_buffer_keys long, fraction double, n_keys long, levels string, bytes long, seconds double")
