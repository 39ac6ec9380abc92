"""Rows to model inputs: ragged arrays stay ragged until a writer pads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import sequence


def coordinates(points: DataFrame, keys=("entry",), length: int | None = None, confidence: str | None = None) -> DataFrame:
    """One row per structure: coords (array of [x, y, z] in order), finite mask, confidence; padded with null coordinates to length."""
    conf = F.col(confidence) if confidence else F.lit(1.0)
    ok = ~(F.isnan("x") | F.isnan("y") | F.isnan("z") | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull())
    rows = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", F.when(ok, F.array("x", "y", "z")).alias("p"), conf.alias("c"), ok.alias("ok")))).alias("r"))
    out = rows.select(*keys, F.transform("r", lambda s: s["p"]).alias("coords"), F.transform("r", lambda s: s["ok"]).alias("mask"), F.transform("r", lambda s: s["c"]).alias("confidence"))
    if length is None:
        return out
    more = F.greatest(F.lit(length) - F.size("mask"), F.lit(0))
    return out.select(*keys, F.concat("coords", F.array_repeat(F.lit(None).cast("array<double>"), more)).alias("coords"), F.concat("mask", F.array_repeat(F.lit(False), more)).alias("mask"), F.concat("confidence", F.array_repeat(F.lit(-1.0), more)).alias("confidence"))


def chain_offsets(chains: DataFrame, keys, chain: str, length: str, target: str, spacer: int = 10) -> DataFrame:
    """Places of the chains of a complex laid end to end, the target first, with spacers between: adds offset."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.col(target), 0).otherwise(1), chain).rowsBetween(Window.unboundedPreceding, -1)
    return chains.withColumn("offset", F.coalesce(F.sum(F.col(length) + spacer).over(w), F.lit(0)))


def pair_ids(seq, codes, offset: int = sequence.MODALITY_OFFSET):
    """Ids of both modalities of one row, each in its own markers: struct(aa, structure)."""
    return F.struct(sequence.wrapped(sequence.esm_ids(seq)).alias("aa"), sequence.wrapped(F.transform(codes, lambda c: c + offset + 4), offset, offset + 1).alias("structure"))
