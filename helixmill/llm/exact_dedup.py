"""Exact dedup by skew-safe combining: local, then salted, then global, on full content.

Three combining steps, each grouping by digest *and* text, so a digest collision
never merges different texts:

1. local: the salt is the input partition, so the map side of the first
   aggregation removes every copy inside a partition before anything moves;
2. salted: rows meet by (salt, digest, text); a group that holds a third of all
   rows is spread over `salts` tasks;
3. global: at most `salts` winners a text meet by digest.

Rows learn of their winner by digest and salt: the winner of a text with a thousandth of
all rows or more is there once a salt, and its rows are spread over the salts.

Edge cases: null text counts as ''; the row with the largest doc_id stays; rows
that repeat the winner's id and text all say kept; a null id never wins against a
number; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._shared import HOT_SHARE, materialise

SALTS = 16


def _sha256(text):
    return F.unhex(F.sha2(text, 256))


def _winners(docs: DataFrame, id_col: str, text_col: str, salts: int, digest, carry: list[str]) -> DataFrame:
    """One row per distinct text: digest, text, largest id, size, and the winner's other columns."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        text.alias("_text"),
        digest(text).alias("_digest"),
        (F.spark_partition_id() % salts).alias("_salt"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_rest")] if carry else []),
    )
    rest = [F.max_by("_rest", F.coalesce("_id", F.lit(-(2**63)))).alias("_rest")] if carry else []
    salted = rows.groupBy("_salt", "_digest", "_text").agg(F.max("_id").alias("_id"), F.count("*").alias("_n"), *rest)
    # Each text has one row per salt by now, so nothing is left to combine before this exchange.
    return (
        salted.repartition("_digest").groupBy("_digest", "_text").agg(F.max("_id").alias("_id"), F.sum("_n").alias("_n"), *rest)
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=_sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    winners = _winners(docs, id_col, text_col, salts, digest, [])
    found = materialise(
        winners.groupBy("_digest").agg(F.count("*").alias("_texts"), F.max("_id").alias("_keep"), F.max("_n").alias("_size")),
        "exact-dedup",
    )
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), digest(text).alias("_digest"), F.sha2(text, 256).alias("_sha"), text.alias("_text"))
    if found.filter("_texts > 1").isEmpty():
        hot = F.col("_size") * HOT_SHARE >= (found.agg(F.sum("_size")).first()[0] or 0)
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        winners = found.withColumn("_salt", F.explode(F.when(hot, every).otherwise(F.array(F.lit(0)))))
        few = found.filter(hot).select("_digest", F.lit(True).alias("_hot"))  # at most HOT_SHARE rows
        salt = F.when(F.col("_hot"), F.spark_partition_id() % salts).otherwise(0)
        joined = rows.drop("_text").join(F.broadcast(few), "_digest", "left").withColumn("_salt", salt).join(winners, ["_digest", "_salt"])
    else:  # texts that share a digest: meet by content
        joined = rows.join(winners.select("_digest", "_text", F.col("_id").alias("_keep"), F.col("_n").alias("_size")), ["_digest", "_text"])
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("_keep"), F.col("_keep").isNull()).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text, with all columns of docs, in their order; null text comes out as ''."""
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    won = _winners(docs, id_col, text_col, salts, _sha256, carry)
    at = {id_col: F.col("_id"), text_col: F.col("_text")}
    return won.select(*[at.get(c, F.col("_rest").getField(c) if c in carry else None).alias(c) for c in docs.columns])
