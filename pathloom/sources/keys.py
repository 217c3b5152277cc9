"""Keys: rows (path, value, ref), and the four key views over the provided tables.

A key table is a bag: equal rows stay.  ``ref`` is shown as 40 hex digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.LongType()), T.StructField("ref", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/region/nation/segment/customer/priority, order date, order key."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    path = F.concat(F.lit("/"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name", "o_orderpriority"))
    return joined.select(path.alias("path"), _seconds("o_orderdate").alias("value"), F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("ref"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/events/type/user group/user, time, event id; many equal paths."""
    user = F.col("user_id").cast("string")
    path = F.concat(F.lit("/events/"), "event_type", F.lit("/user"), (F.col("user_id") % 10).cast("string"), F.lit("/"), user)
    return table(spark, sf_dir, "events").select(path.alias("path"), _seconds("ts").alias("value"), F.sha1(F.col("event_id").cast("string").cast("binary")).alias("ref"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/brand/type/name, size, part key."""
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_size").cast("long").alias("value"), F.sha1(F.col("p_partkey").cast("string").cast("binary")).alias("ref"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/host/path of a url, length of the page, page id."""
    path = F.concat(F.lit("/"), F.regexp_replace("url", r"^[a-z]+://|[?].*$", ""))
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.char_length("html").cast("long").alias("value"), F.sha1(F.col("page_id").cast("string").cast("binary")).alias("ref"))


VIEWS = {"orders": orders, "events": events, "parts": parts, "pages": pages}

#: The same views in DuckDB's SQL.
DUCKDB = {
    "orders": """SELECT concat('/', r_name, '/', n_name, '/', c_mktsegment, '/', c_name, '/', o_orderpriority) AS path,
  CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS value, sha1(CAST(o_orderkey AS VARCHAR)) AS ref
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "events": """SELECT concat('/events/', event_type, '/user', CAST(user_id % 10 AS VARCHAR), '/', CAST(user_id AS VARCHAR)) AS path,
  CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS value, sha1(CAST(event_id AS VARCHAR)) AS ref FROM events""",
    "parts": """SELECT concat('/', p_brand, '/', p_type, '/', replace(p_name, ' ', '_')) AS path, CAST(p_size AS BIGINT) AS value,
  sha1(CAST(p_partkey AS VARCHAR)) AS ref FROM part""",
    "pages": """SELECT concat('/', regexp_replace(url, '^[a-z]+://|[?].*$', '', 'g')) AS path, CAST(length(html) AS BIGINT) AS value,
  sha1(CAST(page_id AS VARCHAR)) AS ref FROM pages""",
}


def duckdb(view: str) -> str:
    return f"({DUCKDB[view]})"
