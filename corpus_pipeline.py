"""A corpus pipeline: five filters and transformations of ``documents`` in a fixed order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
to the shared folder and reads it back for the next.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, decontam, jaccard, pii, toxicity
from pathloom.llm.kernel import materialize

#: Ids of at most this many rows (16 MB) are broadcast to an anti join; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, once; rows without id stay."""
    found = materialize(jaccard.assign(docs), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    gone = materialize(gone, "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    repeated = materialize(repeated.join(gone, "doc_id", "left_anti"), "repeated")
    if (n := repeated.count()) == 0:
        return kept.select(*docs.columns)
    repeated = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return once.union(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; ``n_chars`` is that of the new text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(docs.select("doc_id", "text"), ranks)
    return both.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("PII", mask_private),
    ("byte-level BPE", to_tokens),
]

#: SQL can't express the models of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
