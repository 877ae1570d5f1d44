"""Exact duplicates by progressive refinement: length, then the hash of a prefix, then the hash of the whole text.

Only columns of the fixed width of a length and a hash are shuffled for the first two steps. Whole texts are hashed only
for documents that share their length and their prefix with another one. All steps are DataFrame functions.

Defined cases: a null text is an empty one. Empty texts are equal to each other. Rows with the same id and equal texts are
one document and come out once; rows with the same id and different texts are two documents. A null id is smaller than any
other. An empty table gives an empty result. Further columns of the input are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.store import stored

PREFIX_CHARS = 256


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def measures(prefix_chars: int) -> list[Column]:
    """``n_bytes, prefix``: what can be known of a text without its whole content."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(lower_ascii(F.substring(text, 1, prefix_chars))).alias("prefix"),
    ]


def text_digest(text: Column) -> Column:
    return F.sha2(lower_ascii(text).cast("binary"), 256)


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``doc_id, n_bytes, prefix, digest, keep_id, group_size, kept`` per document.

    ``digest`` is null where a text is unique by length or prefix. The largest id of equal texts stays.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = whole.select("doc_id", *measures(prefix_chars))
    # What is counted by a key is written before it is joined by that key: only then can the join's hot keys be split.
    lengths = sized.groupBy("n_bytes").count().where("count > 1").select("n_bytes", F.lit(True).alias("same_length"))
    sized = stored(spark, "exact-sized", sized.join(stored(spark, "exact-lengths", lengths), "n_bytes", "left"))
    prefixes = (
        sized.where("same_length")
        .groupBy("n_bytes", "prefix")
        .count()
        .where("count > 1")
        .select("n_bytes", "prefix", F.lit(True).alias("same_prefix"))
    )
    prefixes = stored(spark, "exact-prefixes", prefixes)
    refined = stored(
        spark,
        "exact-refined",
        sized.join(prefixes, ["n_bytes", "prefix"], "left").select("doc_id", "n_bytes", "prefix", "same_prefix"),
    )
    wanted = refined.where("same_prefix").select(F.col("doc_id").alias("wanted_id"), "n_bytes", "prefix").distinct()
    whole = whole.select("doc_id", *measures(prefix_chars), "text")
    same = (
        whole["doc_id"].eqNullSafe(wanted["wanted_id"])
        & (whole["n_bytes"] == wanted["n_bytes"])
        & (whole["prefix"] == wanted["prefix"])
    )
    hashed = whole.join(wanted, same, "left_semi").withColumn("digest", text_digest(F.col("text"))).drop("text")
    hashed = stored(spark, "exact-hashed", hashed.distinct())
    groups = hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    repeated = hashed.join(stored(spark, "exact-groups", groups), "digest")
    return (
        refined.where("same_prefix is null")
        .select(
            "doc_id",
            "n_bytes",
            "prefix",
            F.lit(None).cast("string").alias("digest"),
            F.col("doc_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
        )
        .unionByName(repeated)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )
