"""Model inputs from structures and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import collate
from helixmill.operators import geometry as G
from helixmill.plans.registry import POINTS, R, models, points, query, r6, table


@query("COL04", f"WITH {POINTS} SELECT entry, CAST(24 AS INTEGER) AS n, CAST(21 AS INTEGER) AS finite, {R('sum(x)')} AS x, {R('max(CASE WHEN idx = 5 THEN y END)')} AS y5 FROM points GROUP BY entry")
def coordinate_batch(spark, d):
    rows = collate.coordinates(points(spark, d), length=24)
    x = F.aggregate(F.filter("coords", lambda p: p.isNotNull()), F.lit(0.0), lambda a, p: a + F.get(p, F.lit(0)))
    return rows.select("entry", F.size("coords").alias("n"), F.size(F.filter("mask", lambda m: m)).alias("finite"), r6(x).alias("x"), r6(F.get(F.get("coords", F.lit(5)), F.lit(1))).alias("y5"))


@query("COL06", "WITH c AS (SELECT conv_id, turn, role, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) AS rn FROM conversations) SELECT conv_id, turn, CAST(coalesce(sum(len + 10) OVER (PARTITION BY conv_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")
def chain_concatenation(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("len"), (F.col("role") == "assistant").alias("target"))
    return collate.chain_offsets(rows, ["conv_id"], "turn", "len", "target").select("conv_id", "turn", "offset")


@query("COL03 FN10", "SELECT vec_id, CAST(vec_id % 5 + 3 AS INTEGER) AS aa, CAST(vec_id % 7 + 2 AS INTEGER) AS structure, CAST(33 + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 4 + vec_id % 100 END AS INTEGER) AS first FROM embeddings")
def modality_pairs(spark, d):
    v = F.col("vec_id")
    seq = F.repeat(F.lit("A"), (v % 5 + 1).cast("int"))
    codes = F.array_repeat((v % 100).cast("int"), (v % 7).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", collate.pair_ids(seq, codes).alias("p")).select("vec_id", F.size("p.aa").alias("aa"), F.size("p.structure").alias("structure"), F.get("p.structure", F.lit(1)).alias("first"))


@query("MET18 MET03")
def pocket_aligned_rmsd(spark, d):
    m = models(spark, d).withColumn("pocket", F.col("idx") < 12).withColumn("ligand", F.col("idx") >= 12)
    return G.pocket_rmsd(m, "pocket", "ligand").select("entry", r6("pocket_rmsd").alias("pocket_rmsd"))
