"""Length buckets, batches and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import batching as B
from helixmill.plans.registry import R, query, r6, table  # noqa: F401

DOCS = "SELECT doc_id, lang, source, CAST(n_chars AS INTEGER) AS len FROM documents"
CLIPPED = DOCS.replace("CAST(n_chars", "CAST(least(n_chars, 4000)")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("int").alias("len"))


@query(
    "SRT03 SRT01",
    f"""WITH d AS ({DOCS}), r AS (SELECT doc_id, len, CAST((row_number() OVER (ORDER BY len, doc_id) - 1) // 50 AS INTEGER) AS bucket FROM d),
    p AS (SELECT *, row_number() OVER (ORDER BY md5('4-bucket:' || CAST(bucket AS VARCHAR)), bucket, md5('4-row:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place, count(*) OVER () AS n FROM r),
    w AS (SELECT * FROM p UNION ALL SELECT doc_id, len, bucket, place + n, n FROM p WHERE place < CAST(ceil(n / 4) AS BIGINT) * 4 - n)
    SELECT doc_id, bucket, CAST(place AS INTEGER) AS place, CAST(floor(place / ceil(n / 4)) AS INTEGER) AS replica FROM w""",
)
def sortish_order(spark, d):
    return B.sortish(_docs(spark, d).select("doc_id", "len"), "doc_id", "len", 50, 4, 4).select("doc_id", "bucket", F.col("place").cast("int").alias("place"), "replica")


FOLD = """WITH RECURSIVE d0 AS ({docs}), d AS (SELECT *, CAST((row_number() OVER (PARTITION BY {by} ORDER BY len, doc_id) - 1) // 100 AS INTEGER) AS bucket FROM d0),
    o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY len, doc_id) AS rn FROM d WHERE {fits}),
    f AS (SELECT {key}, doc_id, rn, len, {first}, 0 AS batch FROM o WHERE rn = 1
      UNION ALL SELECT {okey}, o.doc_id, o.rn, o.len, {step}, CASE WHEN {ok} THEN f.batch ELSE f.batch + 1 END FROM f JOIN o ON {same} AND o.rn = f.rn + 1)
    SELECT d.doc_id, d.bucket, CAST(f.batch AS INTEGER) AS batch FROM d LEFT JOIN f ON d.doc_id = f.doc_id"""

_BUCKET = {"by": "1", "key": "bucket", "okey": "o.bucket", "same": "o.bucket = f.bucket"}
_SOURCE = {"by": "source", "key": "source, bucket", "okey": "o.source, o.bucket", "same": "o.source = f.source AND o.bucket = f.bucket"}
_OK = "(f.n + 1) * greatest(f.top, o.len) <= 20000 AND CAST(f.n + 1 AS BIGINT) * greatest(f.top, o.len) * greatest(f.top, o.len) < 40000000"


@query(
    "BAT01",
    FOLD.format(docs=CLIPPED, **_BUCKET, fits="len <= 20000 AND CAST(len AS BIGINT) * len < 40000000", first="1 AS n, len AS top", ok=f"{_OK} AND f.n < 16", step=f"CASE WHEN {_OK} AND f.n < 16 THEN f.n + 1 ELSE 1 END, CASE WHEN {_OK} AND f.n < 16 THEN greatest(f.top, o.len) ELSE o.len END"),
)
def token_budget_batches(spark, d):
    docs = B.length_buckets(_docs(spark, d).withColumn("len", F.least("len", F.lit(4000))), "doc_id", "len", 100)  # lengths are clipped here, as the operator's own rule
    return B.token_batches(docs, ["bucket"], ["len", "doc_id"], "len", budget=20000, square=40_000_000, most=16).select("doc_id", "bucket", "batch")


@query(
    "BAT03 BAT06",
    FOLD.format(docs=DOCS, **_SOURCE, fits="len <= 8192", first="len AS total", ok="f.total + o.len <= 8192", step="CASE WHEN f.total + o.len <= 8192 THEN f.total + o.len ELSE o.len END"),
)
def running_sum_batches(spark, d):
    docs = B.length_buckets(_docs(spark, d), "doc_id", "len", 100, ["source"])
    return B.token_batches(docs, ["source", "bucket"], ["len", "doc_id"], "len", budget=8192, by="sum").select("doc_id", "bucket", "batch")


@query(
    "BAT05",
    FOLD.format(docs=DOCS, **_BUCKET, fits="len <= 16384", first="1 AS n, len AS top", ok="(f.n + 1) * greatest(f.top, o.len) <= 16384", step="CASE WHEN (f.n + 1) * greatest(f.top, o.len) <= 16384 THEN f.n + 1 ELSE 1 END, CASE WHEN (f.n + 1) * greatest(f.top, o.len) <= 16384 THEN greatest(f.top, o.len) ELSE o.len END"),
)
def fasta_batches(spark, d):
    return B.token_batches(B.length_buckets(_docs(spark, d), "doc_id", "len", 100), ["bucket"], ["len", "doc_id"], "len", budget=16384).select("doc_id", "bucket", "batch")


@query(
    "BAT02",
    "WITH b AS (SELECT DISTINCT CAST(n_nationkey % 4 AS INTEGER) AS replica, CAST(n_nationkey // 4 AS INTEGER) AS batch FROM nation), c AS (SELECT replica, max(batch) + 1 AS own FROM b GROUP BY 1), s AS (SELECT replica, own, unnest(range((SELECT max(own) FROM c))) AS step FROM c) SELECT s.replica, CAST(s.step AS INTEGER) AS step, CAST(s.step % s.own AS INTEGER) AS batch FROM s",
)
def rank_equalize(spark, d):
    rows = table(spark, d, "nation").select((F.col("n_nationkey") % 4).alias("replica"), F.expr("CAST(n_nationkey div 4 AS INT)").alias("batch")).distinct()
    return B.equalised(rows, "replica", "batch").select("replica", "step", "batch")


@query(
    "BAT04",
    "SELECT p_partkey, p_size, CAST((row_number() OVER (PARTITION BY p_size ORDER BY md5('6:' || CAST(p_partkey AS VARCHAR)), p_partkey) - 1) // least(8, 4000 // (p_size * p_size) + 1) AS INTEGER) AS batch FROM part",
)
def equal_length_batches(spark, d):
    return B.same_length_batches(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", 8, 4000, 6)


@query("BAT07", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 32 AS INTEGER) AS chunk FROM documents")
def fixed_chunks(spark, d):
    return B.chunks(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 32, F.expr("doc_id div 10000")).select("doc_id", "chunk")


@query(
    "BAT08",
    "WITH s AS (SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at0 FROM documents) SELECT doc_id, at0 // 8192 AS first_block, (at0 + n_chars) // 8192 AS last_block, at0 % 8192 AS \"offset\" FROM s",
)
def sequence_packing(spark, d):
    return B.packed_blocks(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 8192, F.expr("doc_id div 10000")).select("doc_id", "first_block", "last_block", "offset")


@query("BAT03 BAT02")
def buffered_batches(spark, d):
    """Documents through bounded heaps, four replicas with equally many steps."""
    return B.buffered_batches(_docs(spark, d), "doc_id", "len", 16384, 4, buffer=4)


_CLIP = "least(o.len, 512)"
_FITS = f"(f.n + 1) * greatest(f.top, {_CLIP}) <= 6000 AND (f.n + 1) * greatest(f.top, {_CLIP}) * greatest(f.top, {_CLIP}) < 1000000 AND f.n < 800"


@query(
    "BAT09",
    FOLD.format(docs=DOCS, **_BUCKET, fits="least(len, 512) <= 6000", first="1 AS n, least(len, 512) AS top", ok=_FITS, step=f"CASE WHEN {_FITS} THEN f.n + 1 ELSE 1 END, CASE WHEN {_FITS} THEN greatest(f.top, {_CLIP}) ELSE {_CLIP} END").replace("// 100 AS", "// 1000 AS"),
)
def default_batches(spark, d):
    return B.assembled(_docs(spark, d), "doc_id", "len").select("doc_id", "bucket", "batch")
