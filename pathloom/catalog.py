"""All queries by name over the provided tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.fixtures import truth_table
from pathloom.functions import glob, paths
from pathloom.functions.glob import Pattern, quote
from pathloom.operators import search, statistics, structure
from pathloom.operators.search import Query
from pathloom.plans.scratch import materialize, new_folder
from pathloom.plans.store import Store, level_number
from pathloom.sources import keys, lines
from pathloom.streaming.inserts import file_source, insert_stream

Call = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Call] = {}
ORACLES: dict[str, str] = {}

FLAGSHIP = Query("/ASIA/**", 800000000, 900000000)
EVER = 1 << 62
BATCH = (
    FLAGSHIP,
    Query("/*/NATION_1*/AUTOMOBILE/**", 0, EVER),
    Query("/**/1-URGENT", 850000000, 900000000),
    Query("/EUROPE/*/BUILDING/*/5-LOW", 0, EVER),
    Query("/AFRICA/NATION_0/nothing", 0, EVER),
    Query("/AMERICA/**", 900000000, 800000000),
)
PATTERNS = ("/a/**", "/**/x", "/a*/b/**", "/*", "/a/b", "", "ab/c", "/a/", "//a", "/a/***", "/a**", "/**b", r"/a\*b/c", "/a/**/**", "/a/*b*/c", "a/b", "/", "/**")


#: Predicates of the patterns in DuckDB's SQL, written by hand over labels; ``s`` is the path's labels, the first one empty.
_L = "string_split(path, '/')"
BY_HAND = {
    "/ASIA/**": "(path = '/ASIA' OR (starts_with(path, '/ASIA/') AND NOT ends_with(path, '/')))",
    "/*/NATION_1*/AUTOMOBILE/**": f"(len({_L}) >= 4 AND {_L}[1] = '' AND starts_with({_L}[3], 'NATION_1') AND {_L}[4] = 'AUTOMOBILE' AND NOT ends_with(path, '/'))",
    "/**/1-URGENT": "ends_with(path, '/1-URGENT') AND starts_with(path, '/')",
    "/EUROPE/*/BUILDING/*/5-LOW": f"(len({_L}) = 6 AND {_L}[1] = '' AND {_L}[2] = 'EUROPE' AND {_L}[4] = 'BUILDING' AND {_L}[6] = '5-LOW')",
    "/AFRICA/NATION_0/nothing": "path = '/AFRICA/NATION_0/nothing'",
    "/AMERICA/**": "(path = '/AMERICA' OR (starts_with(path, '/AMERICA/') AND NOT ends_with(path, '/')))",
    "/**": "(path = '' OR (starts_with(path, '/') AND NOT ends_with(path, '/')))",
    "/events/error/user3/13": "path = '/events/error/user3/13'",
    "/Brand#*/ECONOMY*/**": f"({_L}[1] = '' AND starts_with({_L}[2], 'Brand#') AND starts_with({_L}[3], 'ECONOMY') AND NOT ends_with(path, '/') AND (len({_L}) > 3 OR length({_L}[3]) > 7))",
    "/events/error/**": "(path = '/events/error' OR (path LIKE '/events/error/%' AND path NOT LIKE '%/'))",
    "/**/fr/**": f"(list_contains({_L}[2:], 'fr') AND starts_with(path, '/') AND NOT ends_with(path, '/'))",
}


def by_hand(q: Query) -> str:
    """DuckDB predicate of a query, from BY_HAND."""
    return f"({BY_HAND[q.pattern]} AND value BETWEEN {q.low} AND {q.high})" if q.low <= q.high else "false"


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` may use {orders}, {events}, {parts}, {pages} for the key views."""

    def put(f: Call) -> Call:
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql is not None:
            text = sql
            for view in keys.VIEWS:
                text = text.replace("{" + view + "}", keys.duckdb(view) + " AS k")
            ORACLES[name] = text
        return f

    return put


def _values(rows: list[tuple], names: str) -> str:
    show = lambda x: "NULL" if x is None else quote(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS BIGINT)" if isinstance(x, int) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS t({names})"


# Predicates.


@query(f"SELECT path, value, ref FROM {{orders}} WHERE {by_hand(FLAGSHIP)}")
def cas_query(spark, sf):
    return search.search(keys.orders(spark, sf), FLAGSHIP.pattern, FLAGSHIP.low, FLAGSHIP.high)


@query(f"SELECT path, value, ref FROM {{orders}} WHERE {by_hand(FLAGSHIP)}")
def path_prefix_pruned(spark, sf):
    """The same rows from a clustered store, where the prefix reaches the scan."""
    store = Store(spark, new_folder(spark, "store"))
    store.bulk_load(keys.orders(spark, sf))
    return store.query(FLAGSHIP.pattern, FLAGSHIP.low, FLAGSHIP.high)


def _path_query(name: str, view: str, pattern: str) -> None:
    def run(spark, sf):
        return search.search(keys.VIEWS[view](spark, sf), pattern)

    run.__name__ = name
    query(f"SELECT path, value, ref FROM {{{view}}} WHERE {BY_HAND[pattern]}")(run)


_path_query("path_exact", "events", "/events/error/user3/13")
_path_query("path_star", "parts", "/Brand#*/ECONOMY*/**")
_path_query("path_descendant", "events", "/events/error/**")
_path_query("path_mixed", "orders", "/EUROPE/*/BUILDING/*/5-LOW")
_path_query("path_suffix", "orders", "/**/1-URGENT")
_path_query("path_deep", "pages", "/**/fr/**")
_path_query("paths_only", "orders", "/ASIA/**")


@query(f"SELECT path, pattern, expected, expected AS matches FROM {_values(truth_table(), 'path, pattern, expected')}")
def path_truth_table(spark, sf):
    rows = [(p, q, e, Pattern(q).regex) for p, q, e in truth_table()]
    table = spark.createDataFrame(rows, "path string, pattern string, expected boolean, regex string")
    return table.select("path", "pattern", "expected", F.rlike("path", F.col("regex")).alias("matches"))


_CLASSIFIED = "/events/*/user3/**"
_S = "string_split(part, '/')"


@query(
    f"""SELECT part, count(*) AS n, CASE WHEN len({_S}) >= 4 AND starts_with(part, '/events/') AND {_S}[4] = 'user3' AND NOT ends_with(part, '/') THEN 'MATCH'
    WHEN starts_with('/events/', part) OR (starts_with(part, '/events/') AND (len({_S}) = 3 OR (len({_S}) = 4 AND starts_with('user3', {_S}[4])) OR {_S}[4] = 'user3')) THEN 'INCOMPLETE' ELSE 'MISMATCH' END AS kind
    FROM (SELECT unnest(['', '/events', '/events/', substr(path, 1, 12), substr(path, 1, 18), path]) AS part FROM {{events}}) GROUP BY part"""
)
def path_prefix_classify(spark, sf):
    parts = F.array(F.lit(""), F.lit("/events"), F.lit("/events/"), F.substring("path", 1, 12), F.substring("path", 1, 18), F.col("path"))
    cut = keys.events(spark, sf).select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return cut.select("part", "n", glob.could_match(_CLASSIFIED, "part").alias("kind"))


@query("SELECT path, value, ref FROM {orders} WHERE value BETWEEN 800000000 AND 850000000")
def value_range(spark, sf):
    return keys.orders(spark, sf).where(search.value_range(800000000, 850000000))


@query("SELECT path, value, ref FROM {parts} WHERE value = 7")
def value_point(spark, sf):
    return keys.parts(spark, sf).where(search.value_range(7, 7))


@query("SELECT path, value, ref FROM {pages} WHERE value BETWEEN 500 AND 2500 AND NOT ends_with(path, '/')")
def values_only(spark, sf):
    return search.search(keys.pages(spark, sf), "/**", 500, 2500)


# A pattern without its escapes: every label is there, and two stars only alone.
_BARE = "regexp_replace(pattern, '\\\\[^/]', 'x', 'g')"


@query(
    f"""SELECT pattern, starts_with(bare, '/') AND NOT list_contains(l, '') AND NOT contains(bare, chr(92)) AND len(list_filter(l, lambda x: x <> '**' AND contains(x, '**'))) = 0 AS ok
    FROM (SELECT *, string_split(substr(bare, 2), '/') AS l FROM (SELECT pattern, {_BARE} AS bare FROM {_values([(p,) for p in PATTERNS], 'pattern')}))"""
)
def pattern_validate(spark, sf):
    return spark.createDataFrame([(p,) for p in PATTERNS], "pattern string").select("pattern", glob.valid("pattern").alias("ok"))


# Sources and sinks.

_LONG = lines.MOST_PATH_BYTES


@query(
    f"""SELECT path, value, ref FROM (SELECT unnest([{{{{'path': path, 'value': value}}}}, {{{{'path': '', 'value': value}}}}, {{{{'path': path || repeat('x', {_LONG}), 'value': value}}}},
    {{{{'path': path, 'value': {lines.LOWEST_TIME - 1}}}}}, {{{{'path': path, 'value': {lines.HIGHEST_TIME + 1}}}}}, {{{{'path': path, 'value': 12}}}}], recursive := true), ref FROM {{pages}})
    WHERE path <> '' AND strlen(path) <= {_LONG} AND value BETWEEN {lines.LOWEST_TIME} AND {lines.HIGHEST_TIME}""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")
)
def ingest_csv_clean(spark, sf):
    """Every page as a clean line and as five odd ones, parsed and cleaned."""
    own = F.col("value").cast("string")
    odd = [("path", own), (None, own), ("long", own), ("path", F.lit(str(lines.LOWEST_TIME - 1))), ("path", F.lit(str(lines.HIGHEST_TIME + 1))), ("path", F.lit(" 12abc"))]
    shown = {"path": F.col("path"), None: F.lit(""), "long": F.concat("path", F.repeat(F.lit("x"), F.lit(_LONG)))}
    made = F.array(*[F.concat_ws(";", shown[p], v, "ref") for p, v in odd])
    return lines.clean(lines.parse(keys.pages(spark, sf).select(F.explode(made).alias("line"))))


@query(
    """SELECT count(*) AS nr_keys, CAST(ceil(sum(strlen(path) + 33) / 16382) AS BIGINT) AS nr_pages,
    (SELECT min(i) - 1 FROM range(1, 400) r(i) WHERE substr(lo, i, 1) <> substr(hi, i, 1) OR i > length(lo)) AS dsc_p, (SELECT CASE WHEN vlo = vhi THEN 8 ELSE min(i - 1) END FROM range(1, 9) r(i) WHERE vlo = vhi OR substr(vlo, 2 * i - 1, 2) <> substr(vhi, 2 * i - 1, 2)) AS dsc_v
    FROM {parts}, (SELECT min(path) AS lo, max(path) AS hi, lpad(upper(hex(xor(min(value), CAST(-9223372036854775808 AS BIGINT)))), 16, '0') AS vlo, lpad(upper(hex(xor(max(value), CAST(-9223372036854775808 AS BIGINT)))), 16, '0') AS vhi FROM {parts}) GROUP BY lo, hi, vlo, vhi"""
)
def ingest_summary(spark, sf):
    return statistics.ingest_summary(keys.parts(spark, sf))


@query("SELECT count(DISTINCT substr(path, 1, 1)) AS first_bytes, count(DISTINCT substr(path, 1, 1)) <= 1 AS one_first_byte FROM {pages}")
def ingest_first_byte_check(spark, sf):
    return lines.first_byte_check(keys.pages(spark, sf))


@query("SELECT concat_ws(';', path, CAST(value AS VARCHAR), ref) AS line FROM {parts}")
def export_csv_rows(spark, sf):
    """Written as lines and read back."""
    folder = new_folder(spark, "lines")
    lines.write_lines(keys.parts(spark, sf), folder)
    return lines.read_lines(spark, folder)


@query("SELECT path, value, ref FROM {parts}")
def scan_all(spark, sf):
    return search.search(keys.parts(spark, sf), "/**")


@query("SELECT path, value, ref FROM {parts} ORDER BY ref LIMIT 500")
def scan_fraction(spark, sf):
    return keys.parts(spark, sf).orderBy("ref").limit(500)


# Projections.


@query(f"SELECT ref FROM {{orders}} WHERE {by_hand(FLAGSHIP)}")
def project_ref(spark, sf):
    return cas_query(spark, sf).select("ref")


@query("SELECT path, value FROM {orders}")
def project_columns(spark, sf):
    return keys.orders(spark, sf).select("path", "value")


@query("SELECT left(ref, 20) AS short_ref FROM {orders}")
def shorten_ref(spark, sf):
    return keys.orders(spark, sf).select(F.substring("ref", 1, 20).alias("short_ref"))


@query("SELECT ref, substr(path, 9) AS suffix FROM {events}")
def suffix_projection(spark, sf):
    return structure.suffixes(keys.events(spark, sf))


# Counts and batches.


@query(f"SELECT count(*) AS matches FROM {{orders}} WHERE {by_hand(FLAGSHIP)}")
def count_matches(spark, sf):
    return cas_query(spark, sf).agg(F.count("*").alias("matches"))


_COUNTS = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS qid, {quote(q.pattern)} AS pattern, CAST({q.low} AS BIGINT) AS low, CAST({q.high} AS BIGINT) AS high, (SELECT count(*) FROM {{orders}} WHERE {by_hand(q)}) AS matches" for i, q in enumerate(BATCH))


@query(_COUNTS)
def query_batch(spark, sf):
    return search.batch_counts(keys.orders(spark, sf), list(BATCH)).withColumn("qid", F.col("qid").cast("long"))


_ROWS = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS qid, path, value, ref FROM {{orders}} WHERE {by_hand(q)}" for i, q in enumerate(BATCH))


@query(_ROWS)
def query_batch_rows(spark, sf):
    return search.answers(keys.orders(spark, sf), list(BATCH)).withColumn("qid", F.col("qid").cast("long"))


@query(_ROWS)
def query_batch_join(spark, sf):
    """The same rows with the queries as a table."""
    return search.join_queries(keys.orders(spark, sf), search.query_table(spark, list(BATCH))).withColumn("qid", F.col("qid").cast("long"))


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS qid, round(count(*) FILTER ({by_hand(q)}) / count(*), 9) AS \"full\", round(count(*) FILTER ({by_hand(Query('/**', q.low, q.high))}) / count(*), 9) AS values_only, round(count(*) FILTER ({by_hand(Query(q.pattern))}) / count(*), 9) AS paths_only FROM {{orders}}"
        for i, q in enumerate(BATCH)
    )
    + ")"
)
def selectivity(spark, sf):
    return search.selectivity(keys.orders(spark, sf), list(BATCH)).withColumn("qid", F.col("qid").cast("long"))


@query(f"SELECT count(*) AS runs, CAST(sum(matches) AS BIGINT) AS matches_sum, CAST(sum(matches) // count(*) AS BIGINT) AS matches_avg FROM ({_COUNTS})")
def stats_sum_avg(spark, sf):
    return statistics.sum_and_average(query_batch(spark, sf), "matches")


_DEPTH_OF = "len(list_filter(string_split(substr(path, 2), '/'), lambda x: x <> ''))"


@query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS qid, count(*) AS matches, CAST(coalesce(sum({_DEPTH_OF}), 0) AS BIGINT) AS sum_depth, CAST(coalesce(sum({_DEPTH_OF}) // count(*), 0) AS BIGINT) AS avg_depth FROM {{orders}} WHERE {by_hand(q)}"
        for i, q in enumerate(BATCH)
    )
)
def match_stats(spark, sf):
    return search.match_stats(keys.orders(spark, sf), list(BATCH)).selectExpr("cast(qid as bigint) AS qid", "matches", "cast(sum_depth as bigint) AS sum_depth", "avg_depth")


# Levels and inserts.


# A batch is known by the first digit of the reference.
_DEALT = "ascii(substr(ref, 1, 1)) % {}"


def _batches(rows: DataFrame, n: int) -> list[DataFrame]:
    rows = materialize(rows.withColumn("part", F.expr(_DEALT.format(n))), "batches")
    return [rows.where(F.col("part") == i).drop("part") for i in range(n)]


@query(f"SELECT path, value, ref FROM {{orders}} WHERE {by_hand(FLAGSHIP)}")
def query_multi_level(spark, sf):
    """Two levels and a buffer that isn't full, queried as one."""
    store = Store(spark, new_folder(spark, "store"), 1)
    *merged, last = _batches(keys.orders(spark, sf), 4)
    for batch in merged:
        store.insert(batch)
    store.max_buffer_keys = 1 << 40
    store.insert(last)
    return store.query(FLAGSHIP.pattern, FLAGSHIP.low, FLAGSHIP.high)


@query(f"SELECT path, value, ref FROM {{orders}} WHERE {by_hand(Query('/**/1-URGENT'))}")
def path_suffix_pruned(spark, sf):
    """A pattern that begins with a wildcard, answered from the copy that is clustered by reversed path."""
    store = Store(spark, new_folder(spark, "store"), reverse=True)
    store.bulk_load(keys.orders(spark, sf))
    return store.query("/**/1-URGENT")


def _with_facts(store: Store) -> DataFrame:
    """All keys of a store, each with the store's levels and buffer as text."""
    told = ",".join(f"{r.place}={r.n_keys}" for r in sorted(store.facts().collect()))
    return store.read().withColumn("store", F.lit(told))


def _facts_sql(**places: str) -> str:
    """The keys of events, each with the number of keys in each place (by SQL condition)."""
    told = " || ',' || ".join(f"'{name.strip('_')}=' || (SELECT count(*) FROM {{events}} WHERE {condition})" for name, condition in sorted(places.items()))
    return f"SELECT path, value, ref, {told} AS store FROM {{events}}"


@query(_facts_sql(buffer="true"))
def insert_batches(spark, sf):
    """Four batches in a store whose buffer never fills."""
    store = Store(spark, new_folder(spark, "store"), 1 << 40)
    for batch in _batches(keys.events(spark, sf), 4):
        store.insert(batch)
    return _with_facts(store)


@query(_facts_sql(_0=f"{_DEALT.format(5)} = 4", _2=f"{_DEALT.format(5)} < 4", buffer="false"))
def merge_levels(spark, sf):
    """Five batches, each of which fills the buffer: levels 0 and 2 are left."""
    store = Store(spark, new_folder(spark, "store"), 1)
    for batch in _batches(keys.events(spark, sf), 5):
        store.insert(batch)
    store.flush()
    return _with_facts(store)


@query(_facts_sql(_1=f"{_DEALT.format(2)} = 0", buffer=f"{_DEALT.format(2)} = 1").replace("'1='", f"(SELECT ceil(log2(count(*) / {float(1 << 40)}))::BIGINT FROM {{events}} WHERE {_DEALT.format(2)} = 0) || '='"))
def bulk_then_insert(spark, sf):
    """A bulk load, whose level follows from its size, and a batch in the buffer."""
    store = Store(spark, new_folder(spark, "store"), 1 << 40)
    first, second = _batches(keys.events(spark, sf), 2)
    store.bulk_load(first)
    store.insert(second)
    return _with_facts(store)


@query(_facts_sql(buffer="true"))
def insert_stream_(spark, sf):
    """The events as a stream of files, appended batch by batch."""
    folder = new_folder(spark, "files")
    keys.events(spark, sf).repartition(3, "ref").write.parquet(folder)
    store = Store(spark, new_folder(spark, "store"), 1 << 40)
    insert_stream(file_source(spark, folder, keys.SCHEMA), store, new_folder(spark, "stream")).awaitTermination()
    return _with_facts(store)


@query(_COUNTS)
def query_file(spark, sf):
    """The batch from a query file, over a store."""
    folder = new_folder(spark, "queries")
    spark.createDataFrame([(f"{q.pattern};{q.low};{q.high}",) for q in BATCH], "line string").coalesce(1).write.text(folder)
    store = Store(spark, new_folder(spark, "store"))
    store.bulk_load(keys.orders(spark, sf))
    return store.query_file(folder).withColumn("qid", F.col("qid").cast("long"))


_SIZES = [(n, m) for n in (100, 1000, 99_887_918, 6_891_972_832) for m in (1000, 1_000_000, 100_000_000)]


@query(f"SELECT n, m, CAST(ceil(log2(n / m)) AS BIGINT) AS level FROM {_values(_SIZES, 'n, m')}")
def level_number_(spark, sf):
    return spark.createDataFrame([(n, m, level_number(n, m)) for n, m in _SIZES], "n long, m long, level long")


# Order.


@query("SELECT path, value, ref, row_number() OVER (ORDER BY value, path, ref) AS row_number FROM {orders}")
def order_vp(spark, sf):
    return statistics.numbered(keys.orders(spark, sf), "value", "path", "ref")


@query("SELECT path, value, ref, row_number() OVER (ORDER BY path, value, ref) AS row_number FROM {orders}")
def order_pv(spark, sf):
    return statistics.numbered(keys.orders(spark, sf), "path", "value", "ref")


@query("SELECT path, value, ref, row_number() OVER (ORDER BY path, value, ref) AS row_number FROM (SELECT * FROM {events} ORDER BY ref LIMIT 1000)")
def sort_first_n(spark, sf):
    return statistics.numbered(keys.events(spark, sf).orderBy("ref").limit(1000), "path", "value", "ref")


# Structure.

_CODE = "lpad(upper(hex(xor({}, CAST(-9223372036854775808 AS BIGINT)))), 16, '0')"
_LCP = "coalesce((SELECT min(i) - 1 FROM range(1, 200) r(i) WHERE i <= least(length({a}), length({b})) // {w} AND substr({a}, {w} * (i - 1) + 1, {w}) <> substr({b}, {w} * (i - 1) + 1, {w})), least(length({a}), length({b})) // {w})"
_PLACES = f"""SELECT region, n_keys, {_LCP.format(a='lo', b='hi', w=1)} + CASE WHEN lo = hi THEN 1 ELSE 0 END AS dsc_p, {_LCP.format(a='vlo', b='vhi', w=2)} AS dsc_v
FROM (SELECT split_part(path, '/', 2) AS region, count(*) AS n_keys, min(path) AS lo, max(path) AS hi, {_CODE.format('min(value)')} AS vlo, {_CODE.format('max(value)')} AS vhi FROM {{orders}} GROUP BY 1)"""


def _regions(spark, sf):
    return keys.orders(spark, sf).withColumn("region", F.split_part("path", F.lit("/"), F.lit(2)))


@query(f"SELECT region, n_keys, CAST(dsc_p AS BIGINT) AS dsc_p, CAST(dsc_v AS BIGINT) AS dsc_v FROM ({_PLACES})")
def discriminative_bytes(spark, sf):
    return structure.discriminative_bytes(_regions(spark, sf), "region").withColumns({c: F.col(c).cast("long") for c in ("dsc_p", "dsc_v")})


@query(f"SELECT region, upper(hex(substr(path, CAST(dsc_p AS BIGINT) + 1, 1))) AS byte, count(*) AS n_keys FROM (SELECT *, split_part(path, '/', 2) AS region FROM {{orders}}) JOIN ({_PLACES}) p USING (region) GROUP BY ALL")
def psi_partition_path(spark, sf):
    return structure.psi_partition(_regions(spark, sf), "PATH", "region")


@query(f"SELECT region, substr({_CODE.format('value')}, 2 * CAST(dsc_v AS BIGINT) + 1, 2) AS byte, count(*) AS n_keys FROM (SELECT *, split_part(path, '/', 2) AS region FROM {{orders}}) JOIN ({_PLACES}) p USING (region) GROUP BY ALL")
def psi_partition_value(spark, sf):
    return structure.psi_partition(_regions(spark, sf), "VALUE", "region")


_ALL_EVENTS = f"""SELECT {_LCP.format(a='lo', b='hi', w=1)} AS dsc_p, {_LCP.format(a='vlo', b='vhi', w=2)} AS dsc_v
FROM (SELECT min(path) AS lo, max(path) AS hi, {_CODE.format('min(value)')} AS vlo, {_CODE.format('max(value)')} AS vhi FROM {{events}})"""


@query(f"""SELECT 'PATH' AS dimension, count(DISTINCT substr(path, CAST(dsc_p AS BIGINT) + 1, 1)) AS fanout FROM {{events}}, ({_ALL_EVENTS})
UNION ALL SELECT 'VALUE', count(DISTINCT substr({_CODE.format('value')}, 2 * CAST(dsc_v AS BIGINT) + 1, 2)) FROM {{events}}, ({_ALL_EVENTS})""")
def psi_fanout(spark, sf):
    return structure.psi_fanout(keys.events(spark, sf))


def _lcp(a: str, b: str) -> str:
    """SQL: common leading bytes of two hex texts."""
    n = f"least(length({a}), length({b})) // 2"
    return f"coalesce(list_position(list_transform(range(1, {n} + 1), lambda i: substr({a}, 2 * i - 1, 2) = substr({b}, 2 * i - 1, 2)), false) - 1, {n})"


# Every key with its node, a level in each round; a window over the node's keys says how it is split.
_TRIE = f"""(WITH RECURSIVE t AS (
  SELECT 0 AS depth, '' AS node, hex(encode(path)) || '00' AS p, {_CODE.format('value')} AS v, 'VALUE' AS dim FROM {{parts}}
  UNION ALL
  SELECT depth + 1, node || substr(CASE WHEN used = 'PATH' THEN p ELSE v END, 2 * CASE WHEN used = 'PATH' THEN lp ELSE lv END + 1, 2),
    substr(p, 2 * (lp + CASE WHEN used = 'PATH' THEN 1 ELSE 0 END) + 1), substr(v, 2 * (lv + CASE WHEN used = 'VALUE' THEN 1 ELSE 0 END) + 1), CASE WHEN used = 'PATH' THEN 'VALUE' ELSE 'PATH' END
  FROM (SELECT *, {_lcp('pa', 'pz')} AS lp, {_lcp('va', 'vz')} AS lv, CASE WHEN (pa = pz AND va = vz) OR (depth > 0 AND c <= {structure.LEAF_KEYS}) THEN 'LEAF' WHEN dim = 'PATH' AND pa = pz THEN 'VALUE' WHEN dim = 'VALUE' AND va = vz THEN 'PATH' ELSE dim END AS used
    FROM (SELECT *, min(p) OVER w AS pa, max(p) OVER w AS pz, min(v) OVER w AS va, max(v) OVER w AS vz, count(*) OVER w AS c FROM t WINDOW w AS (PARTITION BY node)))
  WHERE used <> 'LEAF'),
g AS (SELECT node, depth, dim, count(*) AS n_keys, min(p) AS pa, max(p) AS pz, min(v) AS va, max(v) AS vz, sum((length(p) + length(v)) // 2) AS bytes FROM t GROUP BY ALL),
n AS (SELECT node, depth, n_keys, bytes, {_lcp('pa', 'pz')} AS len_p, {_lcp('va', 'vz')} AS len_v, CASE WHEN (pa = pz AND va = vz) OR (depth > 0 AND n_keys <= {structure.LEAF_KEYS}) THEN 'LEAF' WHEN dim = 'PATH' AND pa = pz THEN 'VALUE' WHEN dim = 'VALUE' AND va = vz THEN 'PATH' ELSE dim END AS dim FROM g),
f AS (SELECT substr(node, 1, length(node) - 2) AS parent, count(*) AS children FROM n WHERE depth > 0 GROUP BY 1)
SELECT node, CAST(depth AS BIGINT) AS depth, dim, n_keys, CAST(len_p AS BIGINT) AS len_p, CAST(len_v AS BIGINT) AS len_v, CAST(coalesce(children, 0) AS BIGINT) AS fanout,
  CAST(4 + len_p + len_v + CASE WHEN dim = 'LEAF' THEN bytes - n_keys * (len_p + len_v) + 22 * n_keys ELSE 7 * coalesce(children, 0) END AS BIGINT) AS byte_size
FROM n LEFT JOIN f ON node = parent AND dim <> 'LEAF')"""


def _cumulative(hist: str) -> str:
    return f"SELECT v, n, round(n / sum(n) OVER () * 100, 9) AS percent, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS cumulative, round(sum(n) OVER (ORDER BY v) / sum(n) OVER () * 100, 9) AS cumulative_percent FROM ({hist})"


@query(f"SELECT * FROM {_TRIE}")
def trie_nodes(spark, sf):
    return structure.trie_nodes(keys.parts(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("depth", "len_p", "len_v", "fanout")})


@query(f"SELECT dim, count(*) AS n FROM {_TRIE} GROUP BY dim")
def trie_node_counts(spark, sf):
    return trie_nodes(spark, sf).groupBy("dim").agg(F.count("*").alias("n"))


@query(_cumulative(f"SELECT depth AS v, count(*) AS n FROM {_TRIE} GROUP BY 1"))
def trie_depth_hist(spark, sf):
    return statistics.hist_cumulative(statistics.histogram(trie_nodes(spark, sf), "depth"))


@query(_cumulative(f"SELECT fanout AS v, count(*) AS n FROM {_TRIE} WHERE dim <> 'LEAF' GROUP BY 1"))
def trie_fanout_hist(spark, sf):
    return statistics.hist_cumulative(statistics.histogram(trie_nodes(spark, sf).where("dim <> 'LEAF'"), "fanout"))


@query(f"SELECT dim = 'LEAF' AS leaf, byte_size AS v, count(*) AS n FROM {_TRIE} GROUP BY ALL")
def trie_width_hist(spark, sf):
    """Byte sizes of inner nodes and of leaves."""
    sizes = trie_nodes(spark, sf).select((F.col("dim") == "LEAF").alias("leaf"), F.col("byte_size").alias("v"))
    return sizes.groupBy("leaf", "v").agg(F.count("*").alias("n"))


# Statistics.

_DEPTH = "CASE WHEN rtrim(substr(path, 2), '/') = '' THEN 0 ELSE length(rtrim(substr(path, 2), '/')) - length(replace(rtrim(substr(path, 2), '/'), '/', '')) + 1 END"
_HIST = f"(SELECT CAST({_DEPTH} AS BIGINT) AS v, count(*) AS n FROM {{pages}} GROUP BY 1)"


def _depths(spark, sf):
    return statistics.histogram(keys.pages(spark, sf), paths.depth("path"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(v * n) / sum(n), 9) AS average, max(v) AS most FROM {_HIST}")
def hist_stats(spark, sf):
    return statistics.hist_stats(_depths(spark, sf))


@query(
    f"""SELECT v, n, round(n / sum(n) OVER () * 100, 9) AS percent, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS cumulative, round(sum(n) OVER (ORDER BY v) / sum(n) OVER () * 100, 9) AS cumulative_percent FROM {_HIST}"""
)
def hist_cumulative(spark, sf):
    return statistics.hist_cumulative(_depths(spark, sf))


@query(
    """WITH h AS (SELECT value AS v, count(*) AS n FROM {pages} GROUP BY 1), e AS (SELECT sum(n) AS total, max(v) AS upper, CAST(ceil(max(v) / 10) AS BIGINT) AS width FROM h),
g AS (SELECT i AS bin, i * width AS low, (i + 1) * width + CASE WHEN i = 9 THEN 1 ELSE 0 END AS high, total, upper FROM e, range(0, 10) r(i)),
c AS (SELECT g.*, coalesce((SELECT sum(n) FROM h WHERE v >= low AND v < high), 0) AS n FROM g)
SELECT bin, low, high, CAST(floor(high / upper * 100) AS BIGINT) AS value_percent, CAST(n AS BIGINT) AS n, round(n / total * 100, 9) AS percent, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cumulative, round(sum(n) OVER (ORDER BY bin) / total * 100, 9) AS cumulative_percent FROM c"""
)
def hist_bins(spark, sf):
    return statistics.hist_bins(statistics.histogram(keys.pages(spark, sf), "value"), 10).withColumn("bin", F.col("bin").cast("long"))


@query("SELECT count(*) AS n_keys, count(DISTINCT path) AS n_paths FROM {events}")
def count_distinct_paths(spark, sf):
    return statistics.distinct_paths(keys.events(spark, sf))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT path, value FROM {events})) AS n_pairs, count(DISTINCT value) AS n_values FROM {events}")
def count_distinct_keys(spark, sf):
    return statistics.distinct_keys(keys.events(spark, sf))


@query(f"SELECT CAST(max({_DEPTH}) AS BIGINT) AS max_labels, round(avg({_DEPTH}), 9) AS avg_labels FROM {{pages}}")
def path_depth_stats(spark, sf):
    return statistics.path_depths(keys.pages(spark, sf))


@query(
    """WITH o AS (SELECT row_number() OVER (ORDER BY ref) AS nr, (sum(strlen(path) + 33) OVER (ORDER BY ref ROWS UNBOUNDED PRECEDING) - 1) // 16382 AS page FROM {parts}),
l AS (SELECT max(page) AS last FROM o WHERE nr <= 1000)
SELECT count(*) AS nr_keys, CAST(max(last) + 1 AS BIGINT) AS nr_pages, CAST((max(last) + 1) * 16384 AS BIGINT) AS input_size FROM o, l WHERE page <= last"""
)
def count_pages(spark, sf):
    return statistics.pages_until(keys.parts(spark, sf), 1000)


_I = "CAST({} AS HUGEINT)"


@query(
    f"""WITH g AS (SELECT DISTINCT dataset, memory, dataset // 80 AS n, memory // 80 AS m FROM {_values(list(statistics.GRID), 'dataset, memory')}),
p AS (SELECT *, CAST(ceil(n / 204) AS HUGEINT) AS nb, CAST(ceil(m / 204) AS HUGEINT) AS mb, CAST(ceil(round(ln(ceil(n / m)) / ln(10), 12)) AS BIGINT) AS height, CAST(n - m + 204 AS HUGEINT) AS h FROM g),
q AS (SELECT *, CAST(n - 1 AS HUGEINT) AS a, CAST(m - 205 AS HUGEINT) AS b FROM p)
SELECT dataset, memory, CAST((nb + 2 * nb * height) * 16384 AS BIGINT) AS all_or_nothing,
  CAST(((nb - mb) + 2 * coalesce((SELECT sum(nb - CAST(pow(10, i - 1) AS BIGINT) * mb) FROM range(1, 20) r(i) WHERE i <= height), 0)) * 16384 AS BIGINT) AS best_case,
  CAST((nb - mb + 2 * ((a // 204) * (a // 204 + 1) // 2 * 204 + (a % 204) * (a // 204 + 1) - ((b // 204) * (b // 204 + 1) // 2 * 204 + (b % 204) * (b // 204 + 1)) - h * (mb - 1))) * 16384 AS DOUBLE) AS worst_case FROM q"""
)
def cost_model(spark, sf):
    return statistics.cost_model(spark)


# Scalar functions.


@query(f"SELECT ref, {_CODE.format('value')} AS code FROM {{orders}}")
def encode_value(spark, sf):
    return keys.orders(spark, sf).select("ref", paths.encode_value("value").alias("code"))


@query("SELECT ref, value AS decoded, -value - 1 AS negative FROM {orders}")
def decode_value(spark, sf):
    rows = keys.orders(spark, sf)
    return rows.select("ref", paths.decode_value(paths.encode_value("value")).alias("decoded"), paths.decode_value(paths.encode_value(-F.col("value") - 1)).alias("negative"))


@query("SELECT ref, CAST(strlen(path) + 1 AS BIGINT) AS path_bytes, CAST(strlen(path) + 2 AS BIGINT) AS pattern_bytes, CAST(8 AS BIGINT) AS value_bytes FROM {orders}")
def encoded_sizes(spark, sf):
    pattern = F.concat("path", F.lit("\\*"))
    return keys.orders(spark, sf).select("ref", paths.path_size("path").cast("long").alias("path_bytes"), paths.pattern_size(pattern).cast("long").alias("pattern_bytes"), F.lit(8).cast("long").alias("value_bytes"))


@query("SELECT ref, CAST(strlen(path) + 28 AS BIGINT) AS bytes FROM {orders}")
def key_size(spark, sf):
    return keys.orders(spark, sf).select("ref", paths.key_size("path").cast("long").alias("bytes"))


@query("SELECT ref, CAST(strlen(path) * 16 + 8 AS BIGINT) AS packed, CAST(strlen(path) AS BIGINT) AS path_length, CAST(8 AS BIGINT) AS value_length FROM {orders}")
def pack_sizes(spark, sf):
    packed = keys.orders(spark, sf).select("ref", paths.pack_sizes(F.octet_length("path"), F.lit(8)).alias("packed"))
    path_length, value_length = paths.unpack_sizes("packed")
    return packed.select("ref", F.col("packed").cast("long").alias("packed"), path_length.cast("long").alias("path_length"), value_length.cast("long").alias("value_length"))


_REVERSED = "concat(array_to_string(list_reverse(string_split(substr(path, 2), '/')), '/'), '/')"


@query(f"SELECT ref, {_REVERSED} AS reversed FROM {{orders}}")
def reverse_path(spark, sf):
    return keys.orders(spark, sf).select("ref", paths.reverse_path("path").alias("reversed"))


@query("SELECT ref, path FROM {orders}")
def decode_reverse_path(spark, sf):
    return keys.orders(spark, sf).select("ref", paths.unreverse_path(paths.reverse_path("path")).alias("path"))


_DIRECTIONS = [("/a/**", "1"), ("/**/x", "0"), ("/a/b", "0"), ("/*", "1"), ("/a/*/b/c", "0"), ("/a/b/*/c", "1"), ("/*/*", "0")]


@query(f"""SELECT p AS pattern, CASE WHEN CASE WHEN strpos(r, '*') = 0 THEN 1000000 ELSE strpos(r, '*') END > CASE WHEN strpos(p, '*') = 0 THEN 1000000 ELSE strpos(p, '*') END THEN '1' ELSE '0' END AS direction
FROM (SELECT p, concat(array_to_string(list_reverse(string_split(substr(p, 2), '/')), '/'), '/') AS r FROM {_values([(p,) for p, _ in _DIRECTIONS], 'p')})""")
def index_direction(spark, sf):
    return spark.createDataFrame([(p,) for p, _ in _DIRECTIONS], "pattern string").select("pattern", glob.index_direction("pattern").alias("direction"))


def _event_times(spark, sf):
    return keys.events(spark, sf).select("ref", "value", F.date_format(F.timestamp_seconds("value"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


_ISO = "strftime(make_timestamp(value * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


@query("SELECT ref, value AS seconds FROM {events}")
def iso_to_unix(spark, sf):
    return _event_times(spark, sf).select("ref", paths.iso_to_unix("iso").alias("seconds"))


@query(f"SELECT ref, {_ISO} AS iso FROM {{events}}")
def unix_to_iso(spark, sf):
    return keys.events(spark, sf).select("ref", paths.unix_to_iso(F.col("value").cast("string")).alias("iso"))


_TEXTS = ["2013-04-14T12:05:32Z", "1969-12-31T23:59:59Z", "2013-13-01T00:00:00Z", "2013-04-14 12:05:32", "", "2099-12-31T23:59:59Z", "1365941132", "4102444800", "4102444799", "-1", "12x", "99999999999999999999"]


_FIELD = "coalesce(try_cast(substr(text, {}, {}) AS INTEGER) BETWEEN {} AND {}, false)"
_IS_ISO = "translate(text, '0123456789', '') = '--T::Z' AND length(text) = 20 AND substr(text, 5, 1) = '-' AND substr(text, 8, 1) = '-' AND substr(text, 11, 1) = 'T' AND substr(text, 14, 1) = ':' AND substr(text, 17, 1) = ':' AND ends_with(text, 'Z') AND " + " AND ".join(
    _FIELD.format(*x) for x in ((1, 4, 1970, 2099), (6, 2, 1, 12), (9, 2, 0, 31), (12, 2, 0, 23), (15, 2, 0, 59), (18, 2, 0, 59))
)


@query(f"SELECT text, {_IS_ISO} AS ok FROM (SELECT text FROM {_values([(t,) for t in _TEXTS], 'text')} UNION ALL SELECT {_ISO} FROM {{events}})")
def iso_validate(spark, sf):
    texts = spark.createDataFrame([(t,) for t in _TEXTS], "text string").union(_event_times(spark, sf).select("iso"))
    return texts.select("text", paths.is_iso("text").alias("ok"))


@query(f"SELECT text, regexp_matches(text, '^[0-9]+$') AND coalesce(try_cast(text AS BIGINT) < 4102444800, false) AS ok FROM (SELECT text FROM {_values([(t,) for t in _TEXTS], 'text')} UNION ALL SELECT CAST(value AS VARCHAR) FROM {{events}})")
def unix_validate(spark, sf):
    texts = spark.createDataFrame([(t,) for t in _TEXTS], "text string").union(keys.events(spark, sf).select(F.col("value").cast("string")))
    return texts.select("text", paths.is_unix("text").alias("ok"))


@query("SELECT text, text IN ('0', '1', 'auto') AS ok FROM " + _values([("0",), ("1",), ("auto",), ("2",), ("",)], "text"))
def direction_validate(spark, sf):
    return spark.createDataFrame([(t,) for t in ("0", "1", "auto", "2", "")], "text string").select("text", paths.is_direction("text").alias("ok"))


@query(f"SELECT replace({quote(paths.LINK)}, 'REF', ref) AS link FROM {{parts}}")
def create_link(spark, sf):
    return keys.parts(spark, sf).select(paths.create_link("ref").alias("link"))


@query("SELECT ref, replace(path, 'Brand#', 'B-') AS replaced FROM {parts}")
def replace_string(spark, sf):
    return keys.parts(spark, sf).select("ref", paths.replace_string("path", "Brand#", "B-").alias("replaced"))


@query("SELECT ref FROM {parts}")
def ref_roundtrip(spark, sf):
    return keys.parts(spark, sf).select(paths.ref_text(paths.ref_bytes(F.upper("ref"))).alias("ref"))


_KEY_PATH = "array_to_string(list_transform(string_split(path, '/'), lambda x: hex(encode(x))), 'FF') || '00'"


@query(f"SELECT ref AS id, {_KEY_PATH} AS path, {_CODE.format('value')} AS value, upper(ref) AS ref FROM {{orders}}")
def encode_key(spark, sf):
    """Keys as bytes, shown in hex."""
    made = keys.orders(spark, sf).select(F.col("ref").alias("id"), paths.encode_key().alias("k"))
    return made.select("id", *(F.hex(f"k.{c}").alias(c) for c in ("path", "value", "ref")))


@query("SELECT ref, path AS forward, concat(array_to_string(list_reverse(string_split(substr(path, 2), '/')), '/'), '/') AS stored, path AS backward FROM {events}")
def decode_key_path(spark, sf):
    """Paths read back from keys' bytes, stored forward and reversed."""
    back = paths.key_path(paths.reverse_path("path"))
    return keys.events(spark, sf).select("ref", paths.decode_key_path(paths.key_path("path")).alias("forward"), paths.decode_path(back).alias("stored"), paths.decode_key_path(back, True).alias("backward"))


_SEARCHED = [("/a/**", "FF61FFFDFD", "FDFDFF61FF"), ("/b*/x", "FF62FDFF78", "78FF62FDFF"), ("/c\\*", "FF632A", "632AFF"), ("/*", "FFFD", "FDFF")]


@query(f"SELECT pattern, forward, reversed, '8000000000000001' AS low, '7FFFFFFFFFFFFFFE' AS high FROM {_values(_SEARCHED, 'pattern, forward, reversed')}")
def encode_search_key(spark, sf):
    """Queries as bytes, forward and with the labels turned around; the wanted bytes are written by hand."""
    rows = spark.createDataFrame([(p, 1, -2) for p, _, _ in _SEARCHED], "pattern string, lo long, hi long")
    made = rows.select("pattern", *(paths.encode_search_key("pattern", "lo", "hi", r).alias(n) for n, r in (("f", False), ("r", True))))
    return made.select("pattern", F.hex("f.path").alias("forward"), F.hex("r.path").alias("reversed"), F.hex("f.low").alias("low"), F.hex("f.high").alias("high"))


@query(
    """SELECT n, CASE WHEN n >= 1000000000000 THEN (n // 1000000000000) || ' TB' WHEN n >= 1000000000 THEN (n // 1000000000) || ' GB' WHEN n >= 1000000 THEN (n // 1000000) || ' MB' ELSE n || ' B' END AS shown
    FROM (SELECT CAST(pow(7, i) AS BIGINT) AS n FROM range(0, 20) r(i))"""
)
def byte_units(spark, sf):
    return spark.range(20).select(F.expr("cast(pow(7, id) as bigint)").alias("n")).select("n", paths.byte_text("n").alias("shown"))


@query("SELECT dim, CASE dim WHEN 'PATH' THEN 'VALUE' WHEN 'VALUE' THEN 'PATH' END AS other FROM (VALUES ('PATH'), ('VALUE'), ('LEAF')) t(dim)")
def alternate_dimension(spark, sf):
    return spark.createDataFrame([("PATH",), ("VALUE",), ("LEAF",)], "dim string").select("dim", paths.alternate("dim").alias("other"))
