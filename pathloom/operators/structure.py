"""Structure of a key set: common prefixes, discriminative bytes, partitions, and the nodes of an interleaved trie.

Positions count bytes of the encoded path (with its closing zero) and of the eight value
bytes.  All of it is group-bys over hex text; no node gathers its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import encode_path, encode_value
from pathloom.plans.scratch import drop_table, materialize, new_folder

LEAF_KEYS = 100
#: Groups or nodes of at most this many rows are broadcast to their keys; more are joined by a shuffle, each dealt to SALTS tasks.
BROADCAST_ROWS = 200_000
SALTS = 16


def common_bytes(a: str, b: str) -> Column:
    """Number of leading bytes that two hex texts share."""
    n = f"least(length({a}), length({b})) div 2"
    return F.expr(
        f"CASE WHEN {n} = 0 THEN 0 ELSE coalesce(nullif(cast(array_position(transform(sequence(1, {n}), i -> substring({a}, 2 * i - 1, 2) = substring({b}, 2 * i - 1, 2)), false) AS int), 0) - 1, {n}) END"
    )


def encoded(keys: DataFrame) -> DataFrame:
    """keys with p_hex and v_hex."""
    return keys.withColumn("p_hex", F.hex(encode_path("path"))).withColumn("v_hex", encode_value("value"))


def discriminative_bytes(keys: DataFrame, *by: str) -> DataFrame:
    """(..., n_keys, dsc_p, dsc_v) of each group: the first byte at which its paths, and its values, differ.

    The common prefix of a set is that of its least and greatest member, so two aggregates suffice.
    """
    ends = encoded(keys).groupBy(*by).agg(F.count("*").alias("n_keys"), *(f(c).alias(f"{n}_{c}") for c in ("p_hex", "v_hex") for n, f in (("lo", F.min), ("hi", F.max))))
    return ends.select(*by, "n_keys", common_bytes("lo_p_hex", "hi_p_hex").alias("dsc_p"), common_bytes("lo_v_hex", "hi_v_hex").alias("dsc_v"))


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with what groups, a row for each value of ``by``, says; a group of most rows is no hot key."""
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), by)
    salted = groups.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("p_hex", "v_hex"), F.lit(SALTS)).cast("int")).join(salted, [*by, "_salt"]).drop("_salt")


def psi_partition(keys: DataFrame, dimension: str, *by: str) -> DataFrame:
    """(..., byte, n_keys): keys split by the byte at the discriminative position of a dimension, as two hex digits."""
    code, place = ("p_hex", "dsc_p") if dimension == "PATH" else ("v_hex", "dsc_v")
    found = discriminative_bytes(keys, *by).select(*by, place)
    rows = encoded(keys)
    # Without groups there is one row to broadcast.
    joined = _beside(rows, materialize(found, "places"), list(by)) if by else rows.crossJoin(F.broadcast(found))
    return joined.groupBy(*by, F.expr(f"substring({code}, 2 * {place} + 1, 2)").alias("byte")).agg(F.count("*").alias("n_keys"))


def psi_fanout(keys: DataFrame) -> DataFrame:
    """(dimension, fanout) for both dimensions."""
    rows = [psi_partition(keys, d).agg(F.count("*").alias("fanout")).select(F.lit(d).alias("dimension"), "fanout") for d in ("PATH", "VALUE")]
    return rows[0].union(rows[1])


def suffixes(keys: DataFrame) -> DataFrame:
    """(ref, suffix): paths without the prefix that all share."""
    place = discriminative_bytes(keys).select("dsc_p")
    rest = F.expr("decode(substring(encode(path, 'UTF-8'), dsc_p + 1), 'UTF-8')")
    return keys.crossJoin(F.broadcast(place)).select("ref", rest.alias("suffix"))


def trie_nodes(keys: DataFrame, leaf_keys: int = LEAF_KEYS) -> DataFrame:
    """One row for each node: node (bytes chosen on the way down), depth, dim, n_keys, len_p, len_v, fanout, byte_size.

    A level at a time: a group-by finds each node's size and common prefixes, the inner nodes
    come back to their keys, and what is left of these goes on; keys of leaves go.  Each level
    is appended to one table, and the level before it is deleted.  The number of rounds is the
    trie's depth.
    """
    spark = keys.sparkSession
    folder = new_folder(spark, "nodes")
    state = materialize(encoded(keys).select(F.lit("").alias("node"), "p_hex", "v_hex", F.lit("VALUE").alias("dim")), "trie")
    depth = 0
    while True:
        group = state.groupBy("node", "dim").agg(
            F.count("*").alias("n_keys"),
            *(f(c).alias(f"{n}_{c}") for c in ("p_hex", "v_hex") for n, f in (("lo", F.min), ("hi", F.max))),
            F.sum(F.length("p_hex") / 2 + F.length("v_hex") / 2).cast("long").alias("bytes"),
        )
        no_path, no_value = F.col("lo_p_hex") == F.col("hi_p_hex"), F.col("lo_v_hex") == F.col("hi_v_hex")
        leaf = (no_path & no_value) | (F.col("n_keys") <= leaf_keys) if depth else no_path & no_value
        used = F.when(leaf, "LEAF").when((F.col("dim") == "PATH") & no_path, "VALUE").when((F.col("dim") == "VALUE") & no_value, "PATH").otherwise(F.col("dim"))
        places = (common_bytes("lo_p_hex", "hi_p_hex").alias("len_p"), common_bytes("lo_v_hex", "hi_v_hex").alias("len_v"))
        node = materialize(group.select("node", "n_keys", "bytes", *places, used.alias("used")), "level")
        inner = node.where("used <> 'LEAF'").select("node", "used", "len_p", "len_v")
        moved = _beside(state.drop("dim"), inner, ["node"])
        byte = F.expr("substring(if(used = 'PATH', p_hex, v_hex), 2 * if(used = 'PATH', len_p, len_v) + 1, 2)")
        down = materialize(
            moved.select(
                F.concat("node", byte).alias("node"),
                F.expr("substring(p_hex, 2 * (len_p + if(used = 'PATH', 1, 0)) + 1)").alias("p_hex"),
                F.expr("substring(v_hex, 2 * (len_v + if(used = 'VALUE', 1, 0)) + 1)").alias("v_hex"),
                F.when(F.col("used") == "PATH", "VALUE").otherwise("PATH").alias("dim"),
            ),
            "trie",
        )
        # A child's name is its parent's and one more byte.
        fan = down.select("node").distinct().groupBy(F.expr("substring(node, 1, length(node) - 2)").alias("parent")).agg(F.count("*").alias("fanout"))
        level = node.join(fan, node["node"] == fan["parent"], "left").select(
            "node",
            F.lit(depth).alias("depth"),
            F.col("used").alias("dim"),
            "n_keys",
            "len_p",
            "len_v",
            F.coalesce("fanout", F.lit(0)).alias("fanout"),
            # Header, prefixes, and a pointer for each child or a suffix and reference for each key.
            F.expr("cast(4 + len_p + len_v + if(used = 'LEAF', bytes - n_keys * (len_p + len_v) + 22 * n_keys, 7 * coalesce(fanout, 0)) AS bigint)").alias("byte_size"),
        )
        level.write.mode("append").parquet(folder)
        schema = level.schema
        for used_up in (node, state):
            drop_table(used_up)
        if down.isEmpty():
            drop_table(down)
            return spark.read.schema(schema).parquet(folder)
        state = down
        depth += 1
