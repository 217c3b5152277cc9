"""Text lines ``path;value;ref`` and query lines ``pattern;low;high``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.paths import ref_bytes

#: Bytes that a path may have, and the times from 1949 to 2024 that values may lie between.
MOST_PATH_BYTES = 16324
LOWEST_TIME, HIGHEST_TIME = -633916800, 1732924800


def leading_number(text: str | Column) -> Column:
    """The number that a text begins with, after blanks; what follows is ignored. Null where there is none or it doesn't fit 64 bits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(text, r"^[\s]*([+-]?[0-9]+)", 1).try_cast("bigint")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files; a quote or a line's length has no meaning."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse(lines: DataFrame, delimiter: str = ";", line: str = "line") -> DataFrame:
    """Keys (path, value, ref as lower-case hex) of lines; a line without a number or with a bad reference raises."""
    fields = F.split(F.col(line), "[" + ("\\" if delimiter in "\\]^" else "") + delimiter + "]", -1)
    number = leading_number(F.get(fields, F.lit(1)))
    value = F.when(number.isNull(), F.raise_error(F.concat(F.lit("no number: "), F.col(line))).cast("bigint")).otherwise(number)
    return lines.select(F.get(fields, F.lit(0)).alias("path"), value.alias("value"), F.lower(F.hex(ref_bytes(F.get(fields, F.lit(2))))).alias("ref"))


def clean(keys: DataFrame) -> DataFrame:
    """Keys that may be stored: a path that isn't empty or too long, and a value in range; nulls go."""
    return keys.where(
        (F.col("path") != "") & (F.octet_length("path") <= MOST_PATH_BYTES) & F.col("value").between(LOWEST_TIME, HIGHEST_TIME) & F.col("ref").isNotNull()
    )


def render(keys: DataFrame) -> DataFrame:
    """(line) of keys."""
    return keys.select(F.concat_ws(";", "path", F.col("value").cast("string"), "ref").alias("line"))


def write_lines(keys: DataFrame, path: str) -> None:
    render(keys).write.mode("overwrite").text(path)


def read_queries(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(pattern, low, high) of a query file; a query file is small and read on the driver."""
    out = []
    for (text,) in read_lines(spark, path).collect():
        pattern, low, high = text.split(";")[:3]
        out.append((pattern, int(low), int(high)))
    return out


def first_byte_check(keys: DataFrame) -> DataFrame:
    """(first_bytes, one_first_byte): paths are expected to share their first byte."""
    first = F.hex(F.substring(F.encode("path", "UTF-8"), 1, 1))
    return keys.agg(F.count_distinct(first).alias("first_bytes"), (F.count_distinct(first) <= 1).alias("one_first_byte"))
