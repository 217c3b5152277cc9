"""Command line: ``python -m pathloom COMMAND ...``, or through spark-submit.

create FOLDER INPUT     load key lines into a store, ``--fraction`` of them at once and the rest in batches
query FOLDER PATTERN    matches of one query; or ``--queries FILE``: a line for each query of a file
selectivity FOLDER FILE parts of all keys that the queries of a file, their ranges and their patterns answer
keys INPUT OUTPUT       clean key lines and write them as a table of keys
lines INPUT OUTPUT      write a table of keys as lines
pages INPUT N           whole pages until they hold N keys
sweep INPUT             build stores with several buffer sizes and fractions and time them
costs                   the I/O cost model
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from pathloom import experiments
from pathloom.operators import search, statistics
from pathloom.operators.search import HIGHEST, LOWEST, Query
from pathloom.plans.store import BUFFER_KEYS, Store
from pathloom.sources import lines


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pathloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        for place in places:
            made.add_argument(place)
        return made

    for made in (command("create", "folder", "input"), command("sweep", "input")):
        made.add_argument("--delimiter", default=";")
    commands.choices["create"].add_argument("--max-buffer-keys", type=int, default=BUFFER_KEYS)
    commands.choices["create"].add_argument("--fraction", type=float, default=1.0)
    commands.choices["create"].add_argument("--batches", type=int, default=4)
    commands.choices["create"].add_argument("--reverse", action="store_true")
    commands.choices["sweep"].add_argument("--buffers", type=int, nargs="+", default=[100_000, 1_000_000])
    commands.choices["sweep"].add_argument("--fractions", type=float, nargs="+", default=[0.0, 0.5, 1.0])
    query = command("query", "folder")
    query.add_argument("pattern", nargs="?")
    query.add_argument("--low", type=int, default=LOWEST)
    query.add_argument("--high", type=int, default=HIGHEST)
    query.add_argument("--direction", choices=("0", "1", "auto"), default="auto")
    query.add_argument("--queries")
    query.add_argument("--repetitions", type=int, default=1)
    query.add_argument("--warmup", action="store_true")
    query.add_argument("--most", type=int, default=1000)
    command("selectivity", "folder", "queries")
    for name in ("keys", "lines"):
        command(name, "input", "output").add_argument("--delimiter", default=";")
    command("pages", "input").add_argument("n", type=int)
    command("costs")
    return out


def _keys(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    return lines.clean(lines.parse(lines.read_lines(spark, path), delimiter))


def _show(df: DataFrame) -> None:
    """Rows of a small result as lines."""
    print(";".join(df.columns))
    for row in df.collect():
        print(";".join("" if x is None else str(x) for x in row))


def _run_queries(store: Store, asked: list[Query], repetitions: int, warmup: bool) -> None:
    """A line ``Qi;matches;rows read;milliseconds`` for each query, then sums and averages."""
    if warmup:
        for q in asked:
            store.query(q.pattern, q.low, q.high).count()
    totals = [0, 0, 0.0]
    for i, q in enumerate(asked):
        for _ in range(repetitions):
            began = time.perf_counter()
            told = search.scan_report(store.query(q.pattern, q.low, q.high))
            took = (time.perf_counter() - began) * 1000
            print(f"Q{i};{told['matches']};{told['rows_read']};{took:.1f}")
            totals = [a + b for a, b in zip(totals, (told["matches"], told["rows_read"], took), strict=True)]
    runs = max(1, len(asked) * repetitions)
    print("sum;" + ";".join(f"{x:.1f}" if isinstance(x, float) else str(x) for x in totals))
    print("average;" + ";".join(f"{x / runs:.1f}" if isinstance(x, float) else str(x // runs) for x in totals))


def main(args: list[str] | None = None) -> int:
    asked = parser().parse_args(args)
    spark = SparkSession.builder.appName("pathloom").getOrCreate()
    if asked.command == "create":
        store = Store(spark, asked.folder, asked.max_buffer_keys, asked.reverse)
        experiments.load(store, _keys(spark, asked.input, asked.delimiter), asked.fraction, asked.batches)
        _show(store.facts())
    elif asked.command == "query":
        store = Store(spark, asked.folder)
        if asked.queries:
            _run_queries(store, [Query(*q) for q in lines.read_queries(spark, asked.queries)], asked.repetitions, asked.warmup)
        elif asked.pattern is None:
            parser().error("a pattern or --queries is needed")
        else:
            search.print_matches(store.query(asked.pattern, asked.low, asked.high, asked.direction), asked.most)
    elif asked.command == "selectivity":
        _show(search.selectivity(Store(spark, asked.folder).read(), [Query(*q) for q in lines.read_queries(spark, asked.queries)]))
    elif asked.command == "keys":
        _keys(spark, asked.input, asked.delimiter).write.parquet(asked.output)
    elif asked.command == "lines":
        lines.write_lines(spark.read.parquet(asked.input), asked.output)
    elif asked.command == "pages":
        _show(statistics.pages_until(spark.read.parquet(asked.input), asked.n))
    elif asked.command == "sweep":
        _show(experiments.sweep(_keys(spark, asked.input, asked.delimiter), asked.buffers, asked.fractions))
    else:
        _show(statistics.cost_model(spark))
    return 0


if __name__ == "__main__":
    sys.exit(main())
