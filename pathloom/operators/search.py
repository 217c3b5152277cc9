"""The query Q(pattern, low, high), batches of it, and selectivity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.glob import Pattern
from pathloom.functions.paths import depth

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Query:
    pattern: str
    low: int = LOWEST
    high: int = HIGHEST

    def condition(self) -> Column:
        """The predicate on (path, value); a side without a bound is left out."""
        if self.low > self.high:
            return F.lit(False)
        return Pattern(self.pattern).condition() & value_range(self.low, self.high)

    def duckdb(self) -> str:
        if self.low > self.high:
            return "false"
        return f"{Pattern(self.pattern).duckdb()} AND value BETWEEN {self.low} AND {self.high}"


def value_range(low: int, high: int) -> Column:
    if low > high:
        return F.lit(False)
    if low == high:
        return F.col("value") == low
    bounds = [F.col("value") >= low] * (low > LOWEST) + [F.col("value") <= high] * (high < HIGHEST)
    return bounds[0] & bounds[1] if len(bounds) == 2 else bounds[0] if bounds else F.col("value").isNotNull()


def search(keys: DataFrame, pattern: str, low: int = LOWEST, high: int = HIGHEST) -> DataFrame:
    """Keys whose path matches the pattern and whose value lies in [low, high]; a bag."""
    return keys.where(Query(pattern, low, high).condition())


def search_levels(levels: list[DataFrame], pattern: str, low: int = LOWEST, high: int = HIGHEST) -> DataFrame:
    """The same over several key tables; duplicates stay."""
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return search(whole, pattern, low, high)


def answers(keys: DataFrame, queries: list[Query]) -> DataFrame:
    """(qid, path, value, ref): every key once for each query that it answers, in one scan.

    The queries are few and live on the driver, so a key meets each compiled predicate in
    its row and no join is planned; literal prefixes are shared by short-circuit.
    """
    hits = F.array_compact(F.array(*[F.when(q.condition(), F.lit(i)) for i, q in enumerate(queries)]))
    some = None
    for q in queries:
        some = q.condition() if some is None else some | q.condition()
    return keys.where(some).select(F.explode(hits).alias("qid"), *keys.columns)


def batch_counts(keys: DataFrame, queries: list[Query]) -> DataFrame:
    """(qid, pattern, low, high, matches) of every query, also of those without a match."""
    counts = keys.agg(*[F.count_if(q.condition()).alias(f"q{i}") for i, q in enumerate(queries)])
    rows = [F.struct(F.lit(i).alias("qid"), F.lit(q.pattern).alias("pattern"), F.lit(q.low).cast("long").alias("low"), F.lit(q.high).cast("long").alias("high"), F.col(f"q{i}").alias("matches")) for i, q in enumerate(queries)]
    return counts.select(F.inline(F.array(*rows)))


#: Queries of a table of at most this many rows (about 50 MB) are broadcast for their labels; more meet keys by a shuffle.
BROADCAST_QUERIES = 200_000
#: Labels of a prefix that queries and keys are matched on, and tasks that one such beginning is dealt to.
DEPTHS, SALTS = 4, 16


def _beginning(text: str, n: str) -> str:
    """SQL: the first n labels of a path, with their separators."""
    return f"substring_index({text}, '/', {n} + 1)"


def join_queries(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, path, value, ref) for a query *table* (qid, regex, prefix, low, high) of any size.

    A query is known by the whole labels of its prefix, up to DEPTHS of them; a prefix without a
    whole label (a pattern that begins with a wildcard) has none.  A key meets the queries of each
    of its own beginnings by an equality.  Queries are grouped by beginning; few groups are
    broadcast, many are joined by a shuffle in which each beginning is dealt to SALTS tasks, so
    one beginning of most keys is no hot key.  A query without a label is compared with every
    key, as it must be; no pair is planned that differs in a whole label.
    """
    whole = F.expr("size(split(prefix, '/', -1)) - 2")
    known = queries.withColumn("_n", F.greatest(F.lit(0), F.least(F.lit(DEPTHS), whole))).withColumn("_start", F.expr(f"if(_n = 0, '', {_beginning('prefix', '_n')})"))
    groups = known.groupBy("_n", "_start").agg(F.collect_list(F.struct("qid", "regex", "low", "high")).alias("_asked"))
    depths = [r._n for r in known.select("_n").distinct().orderBy("_n").collect()]
    if not depths:
        return keys.where("false").select(F.lit(None).cast("int").alias("qid"), *keys.columns)
    starts = F.array(*[F.struct(F.lit(n).alias("_n"), F.expr("''" if n == 0 else _beginning("path", str(n))).alias("_start")) for n in depths])
    rows = keys.select(F.explode(starts).alias("_own"), *keys.columns).select("_own._n", "_own._start", *keys.columns)
    if queries.count() <= BROADCAST_QUERIES:
        met = rows.join(F.broadcast(groups), ["_n", "_start"])
    else:
        every = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("path", "value", "ref"), F.lit(SALTS)).cast("int")).join(groups.withColumn("_salt", every), ["_n", "_start", "_salt"])
    asked = met.select(F.explode("_asked").alias("_q"), *keys.columns)
    return asked.where(F.col("value").between(F.col("_q.low"), F.col("_q.high")) & F.rlike("path", F.col("_q.regex"))).select(F.col("_q.qid").alias("qid"), *keys.columns)


def query_table(spark, queries: list[Query]) -> DataFrame:
    rows = [(i, q.pattern, Pattern(q.pattern).regex, Pattern(q.pattern).prefix, q.low, q.high) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "qid int, pattern string, regex string, prefix string, low long, high long")


def selectivity(keys: DataFrame, queries: list[Query]) -> DataFrame:
    """(qid, full, values_only, paths_only): the part of all keys that the query, its range alone and its pattern alone answer, in one pass."""
    wanted = []
    for i, q in enumerate(queries):
        forms = {"full": q, "values": Query("/**", q.low, q.high), "paths": Query(q.pattern)}
        wanted += [F.count_if(form.condition()).alias(f"{name}{i}") for name, form in forms.items()]
    counts = keys.agg(F.count("*").alias("n"), *wanted)
    part = lambda c: F.round(F.col(c) / F.greatest("n", F.lit(1)), 9)
    rows = [F.struct(F.lit(i).alias("qid"), part(f"full{i}").alias("full"), part(f"values{i}").alias("values_only"), part(f"paths{i}").alias("paths_only")) for i in range(len(queries))]
    return counts.select(F.inline(F.array(*rows)))


def match_stats(keys: DataFrame, queries: list[Query]) -> DataFrame:
    """(qid, matches, sum_depth, avg_depth) of every query: depths in labels, their average a whole number, zero without a match."""
    found = [(F.count_if(q.condition()).alias(f"n{i}"), F.coalesce(F.sum(F.when(q.condition(), depth("path"))), F.lit(0)).alias(f"d{i}")) for i, q in enumerate(queries)]
    sums = keys.agg(*[c for pair in found for c in pair])
    average = lambda i: F.when(F.col(f"n{i}") > 0, F.expr(f"d{i} div n{i}")).otherwise(F.lit(0)).cast("long").alias("avg_depth")
    rows = [F.struct(F.lit(i).alias("qid"), F.col(f"n{i}").alias("matches"), F.col(f"d{i}").alias("sum_depth"), average(i)) for i in range(len(queries))]
    return sums.select(F.inline(F.array(*rows)))


def scan_report(found: DataFrame) -> dict[str, int]:
    """Runs a query's plan and tells what its scans read: rows (after row groups were skipped), files and bytes, and the matches."""
    run = found._jdf.queryExecution()
    matches = run.toRdd().count()
    out = {"matches": matches, "rows_read": 0, "files_read": 0, "bytes_read": 0}
    leaves = run.executedPlan().collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        for name, metric in (("rows_read", "numOutputRows"), ("files_read", "numFiles"), ("bytes_read", "filesSize")):
            if metrics.contains(metric):
                out[name] += metrics.apply(metric).value()
    return out


def for_each(found: DataFrame, call: Callable[[str, int, str], None]) -> None:
    """Call ``call(path, value, ref)`` once for every match, on the executors."""

    def run(rows) -> None:
        for row in rows:
            call(row["path"], row["value"], row["ref"])

    found.select("path", "value", "ref").foreachPartition(run)


def print_matches(found: DataFrame, most: int = 1000) -> int:
    """Print up to ``most`` matches as lines ``path;value;ref`` on the driver; returns how many."""
    shown = found.limit(most).collect()
    for row in shown:
        print(f"{row['path']};{row['value']};{row['ref']}")
    return len(shown)
