"""Statistics of key sets, histograms, and the I/O cost model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.paths import depth
from pathloom.operators.structure import discriminative_bytes
from pathloom.plans.scratch import materialize

PAGE_BYTES = 16384
KEY_HEADER = 24


def histogram(df: DataFrame, value: str | Column) -> DataFrame:
    """(v, n) of the values that occur."""
    value = F.col(value) if isinstance(value, str) else value
    return df.groupBy(value.cast("long").alias("v")).agg(F.count("*").alias("n"))


def hist_stats(hist: DataFrame) -> DataFrame:
    """(n, average, most) of a histogram (v, n)."""
    return hist.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 9).alias("average"), F.max("v").alias("most"))


def running_sums(df: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """df with a running sum (name=column) for each entry, in a total order, without a single-task window.

    Ranges are summed up in parallel; a range's start is the sum of the ranges before it.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    # As many rows as ranges.
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select("_part", *(F.coalesce(F.sum(f"_{k}").over(upto), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(before), "_part")
    return joined.select(*df.columns, *((F.col(f"_{k}") + F.sum(c).over(inside)).alias(k) for k, c in sums.items()))


def hist_cumulative(hist: DataFrame) -> DataFrame:
    """(v, n, percent, cumulative, cumulative_percent) of a histogram of any number of values."""
    hist = materialize(hist, "histogram")
    total = hist.agg(F.sum("n")).first()[0] or 1
    part = lambda c: F.round(F.col(c) / F.lit(total) * 100, 9)
    return running_sums(hist, ["v"], cumulative="n").select("v", "n", part("n").alias("percent"), "cumulative", part("cumulative").alias("cumulative_percent"))


def hist_bins(hist: DataFrame, bins: int, upper: int | None = None) -> DataFrame:
    """(bin, low, high, value_percent, n, percent, cumulative, cumulative_percent).

    Bins are ``ceil(upper / bins)`` wide and half open, the last one wider; ``upper`` is the
    greatest value unless given.  Values beyond the last bin count in the total only.  No
    bins give no rows.
    """
    ends = hist.agg(F.sum("n").alias("total"), (F.max("v") if upper is None else F.lit(upper)).alias("upper")).where("total > 0")
    grid = ends.withColumn("width", F.ceil(F.col("upper") / F.lit(max(bins, 1)))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)) if bins > 0 else F.array().cast("array<int>")))
    grid = grid.select("bin", "total", "upper", (F.col("bin") * F.col("width")).alias("low"), ((F.col("bin") + 1) * F.col("width") + (F.col("bin") == bins - 1).cast("int")).alias("high"))
    size = F.broadcast(ends.select(F.ceil(F.col("upper") / F.lit(max(bins, 1))).alias("width")))
    placed = hist.crossJoin(size).select(F.when(F.col("v") == F.col("width") * bins, bins - 1).otherwise(F.floor(F.col("v") / F.greatest("width", F.lit(1)))).cast("int").alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))
    both = grid.join(placed, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    running = F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return both.select(
        "bin", "low", "high", F.floor(F.col("high") / F.col("upper") * 100).alias("value_percent"), "n",
        F.round(F.col("n") / F.col("total") * 100, 9).alias("percent"), running.alias("cumulative"), F.round(running / F.col("total") * 100, 9).alias("cumulative_percent"),
    )


def sum_and_average(counts: DataFrame, *columns: str) -> DataFrame:
    """(runs, c_sum, c_avg) of counters; the average is a whole number, and zero without runs."""
    n = F.count("*")
    made = [x for c in columns for x in (F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum"), F.coalesce(F.floor(F.sum(c) / n), F.lit(0)).cast("long").alias(f"{c}_avg"))]
    return counts.agg(n.alias("runs"), *made)


def distinct_paths(keys: DataFrame) -> DataFrame:
    return keys.agg(F.count("*").alias("n_keys"), F.count_distinct("path").alias("n_paths"))


def distinct_keys(keys: DataFrame) -> DataFrame:
    """Distinct (path, value) pairs and values; each count is a two-step aggregate, so no task holds them all."""
    return keys.agg(F.count_distinct("path", "value").alias("n_pairs"), F.count_distinct("value").alias("n_values"))


def path_depths(keys: DataFrame) -> DataFrame:
    return keys.agg(F.max(depth("path")).cast("long").alias("max_labels"), F.round(F.avg(depth("path")), 9).alias("avg_labels"))


def ingest_summary(keys: DataFrame) -> DataFrame:
    """(nr_keys, nr_pages, dsc_p, dsc_v); pages as if keys filled them evenly."""
    size = keys.agg(F.sum(F.octet_length("path") + KEY_HEADER + 9).alias("bytes"))
    found = discriminative_bytes(keys).crossJoin(F.broadcast(size))
    return found.select(F.col("n_keys").alias("nr_keys"), F.ceil(F.col("bytes") / (PAGE_BYTES - 2)).alias("nr_pages"), F.col("dsc_p").cast("long").alias("dsc_p"), F.col("dsc_v").cast("long").alias("dsc_v"))


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with ``row_number`` (from 1) in a total order, without a single-task window.

    Ranges are sorted in parallel; a range's first number is the sum of the sizes before it.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.select(*df.columns, (F.col("_before") + F.expr("_at & 8589934591") + 1).alias("row_number"))


def pages_until(keys: DataFrame, wanted: int) -> DataFrame:
    """(nr_keys, nr_pages, input_size): whole pages, filled in order of ref, until they hold ``wanted`` keys."""
    sized = keys.select("ref", (F.octet_length("path") + KEY_HEADER + 9).cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    placed = materialize(running_sums(sized, ["ref", "size"], bytes="size", nr="one").select("nr", F.floor((F.col("bytes") - 1) / (PAGE_BYTES - 2)).alias("page")), "pages")
    last = placed.where(F.col("nr") <= wanted).agg(F.max("page")).first()[0]
    last = F.lit(-1 if last is None else last).cast("long")
    return placed.where(F.col("page") <= last).agg(F.count("*").alias("nr_keys"), (last + 1).alias("nr_pages"), ((last + 1) * PAGE_BYTES).alias("input_size"))


#: The cost model's parameters, data set sizes and memory sizes.
PAGE, KEY, FANOUT = 16384, 80, 10
GRID = tuple((d, 50_000_000_000) for d in (100_000_000_000, 200_000_000_000, 300_000_000_000, 400_000_000_000, 550_263_603_200)) + tuple(
    (550_263_603_200, m) for m in (16_000_000_000, 32_000_000_000, 64_000_000_000, 128_000_000_000, 256_000_000_000)
)


def cost_model(spark: SparkSession, grid: tuple[tuple[int, int], ...] = GRID, page: int = PAGE, key: int = KEY, fanout: int = FANOUT) -> DataFrame:
    """(dataset, memory, all_or_nothing, best_case, worst_case): bytes of partition I/O predicted by three formulas.

    ``height`` rounds of partitioning until pieces fit; front-loading keeps the memory's
    worth of pages out of each round's reads and writes.  The worst case is the closed sum
    over keys of the pages still to move, taken at its first round's height.
    """
    rows = spark.createDataFrame(list(grid), "dataset long, memory long").distinct()
    n, m, b = f"(dataset div {key})", f"(memory div {key})", page // key
    rows = rows.selectExpr("dataset", "memory", f"ceil({n} / {b}) AS nb", f"ceil({m} / {b}) AS mb", f"cast(ceil(round(ln(ceil({n} / {m})) / ln({fanout}), 12)) AS int) AS height", f"{n} AS n", f"{m} AS m")
    moved = f"CASE WHEN height < 1 THEN 0 ELSE aggregate(sequence(1, height), 0L, (s, i) -> s + nb - cast(pow({fanout}, i - 1) AS bigint) * mb) END"
    # Sum over i = 1 .. n - m + b of ceil((n - i) / b): whole runs of b equal terms and a rest.
    upto = f"(n - m + {b})"
    tri = lambda x: f"(({x} div {b}) * ({x} div {b} + 1) div 2 * {b} + ({x} % {b}) * ({x} div {b} + 1))"  # noqa: E731  sum of ceil(k / b), k = 1 .. x
    every = f"(CASE WHEN n - 1 > 0 THEN {tri('(n - 1)')} ELSE 0 END - CASE WHEN n - {upto} - 1 > 0 THEN {tri(f'(n - {upto} - 1)')} ELSE 0 END)"
    return rows.selectExpr(
        "dataset",
        "memory",
        f"(nb + 2 * nb * height) * {page} AS all_or_nothing",
        f"((nb - mb) + 2 * {moved}) * {page} AS best_case",
        f"cast((cast(nb - mb AS decimal(38,0)) + 2 * (cast({every} AS decimal(38,0)) - cast({upto} AS decimal(38,0)) * (mb - 1))) * {page} AS double) AS worst_case",
    )
