"""Named queries with their SQL equivalents, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Operators of the survey's inventory that a query exercises.
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = tuple(covers.split())
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col):
    """Six decimals, as both engines are compared."""
    return F.round(col, 6)


def R(sql: str) -> str:
    return f"(round({sql}, 6) + 0.0)"


def U(seed: str, key: str) -> str:
    """SQL of hashing.uniform."""
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def exact_sum(col):
    """A sum that does not depend on the order of addition."""
    return F.sum(col.cast("decimal(24,6)")).cast("double")


def S(sql: str) -> str:
    return f"CAST(sum(CAST({sql} AS DECIMAL(24,6))) AS DOUBLE)"


CORPUS = "corpus AS (SELECT d.doc_id, d.text AS seq, d.n_chars AS length, d.lang AS split, d.source AS cluster, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def corpus(spark, d) -> DataFrame:
    """Documents as sequences: split is the language, cluster the source; quality where labelled."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("text").alias("seq"), F.col("n_chars").alias("length"), F.col("lang").alias("split"), F.col("source").alias("cluster"), "quality", "toxic")


POINTS = "points AS (SELECT vec_id AS entry, label, CAST(i AS INTEGER) AS idx, CAST(embedding[3*i+1] AS DOUBLE)*10 AS x, CAST(embedding[3*i+2] AS DOUBLE)*10 AS y, CAST(embedding[3*i+3] AS DOUBLE)*10 AS z FROM embeddings, range(21) r(i))"


def points(spark, d) -> DataFrame:
    """Embeddings as chains of 21 points."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("entry"), "label", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("idx"))
    return v.select("entry", "label", "idx", *[(F.get("e", F.col("idx") * 3 + i) * 10).alias(c) for i, c in enumerate("xyz")])


MODELS = POINTS + ", models AS (SELECT a.*, b.x AS px, b.y AS py, b.z AS pz FROM points a JOIN points b ON b.entry = a.entry + 1 AND b.idx = a.idx)"


def models(spark, d) -> DataFrame:
    """Each chain with the next one's coordinates as a second model."""
    p = points(spark, d)
    other = p.select((F.col("entry") - 1).alias("entry"), "idx", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    return p.join(other, ["entry", "idx"])


META = "meta AS (SELECT p_partkey AS k, p_size AS modeled_seq_len, p_brand AS oligomeric_detail, p_type AS split, p_retailprice AS radius_gyration, CAST(p_partkey % 100 AS DOUBLE) / 100 AS helix_percent, CAST(p_partkey % 37 AS DOUBLE) / 37 AS coil_percent, CAST(p_partkey % 23 AS DOUBLE) / 23 AS strand_percent, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 90 AS DOUBLE) / 90 END AS lddt_ca FROM part)"


def meta(spark, d) -> DataFrame:
    """Parts as structure metadata."""
    k = F.col("p_partkey")
    share = lambda n: (k % n).cast("double") / n
    return table(spark, d, "part").select(k.alias("k"), F.col("p_size").alias("modeled_seq_len"), F.col("p_brand").alias("oligomeric_detail"), F.col("p_type").alias("split"), F.col("p_retailprice").alias("radius_gyration"), share(100).alias("helix_percent"), share(37).alias("coil_percent"), share(23).alias("strand_percent"), F.when(k % 11 != 0, share(90)).alias("lddt_ca"))
