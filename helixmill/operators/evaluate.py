"""Evaluation summaries as aggregate specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import numeric
from helixmill.operators.sampling import global_sum


def means(df: DataFrame, columns: dict[str, str], by=()) -> DataFrame:
    """Averages under new names."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(name) for name, c in columns.items()])


def success(df: DataFrame, passes, columns: dict[str, str], by=()) -> DataFrame:
    """Number and share of passing rows, row count, and averages."""
    ok = F.when(passes, 1).otherwise(0)
    return df.groupBy(*by).agg(F.sum(ok).cast("long").alias("n_pass"), F.avg(ok).alias("pass_rate"), F.count("*").alias("n"), *[F.avg(c).alias(name) for name, c in columns.items()])


def zero_filled(all_keys: DataFrame, hits: DataFrame, keys, count: str = "n") -> DataFrame:
    """Every key with its count; 0 where there was none."""
    return all_keys.select(*keys).distinct().join(hits, list(keys), "left").withColumn(count, F.coalesce(count, F.lit(0)))


def two_level(df: DataFrame, inner, outer, inner_agg, name: str) -> DataFrame:
    """Mean over groups of an aggregate within groups."""
    return df.groupBy(*inner).agg(inner_agg.alias("_v")).groupBy(*outer).agg(F.avg("_v").alias(name))


def average_ranks(df: DataFrame, column: str, name: str, by=()) -> DataFrame:
    """Ranks of numbers with ties at their mean, null first.

    Values are counted first, and distinct ones put in order bucket by bucket (`numeric.coarse`), so no task sorts a whole group.
    """
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_c"))
    ranks = global_sum(counts, numeric.coarse(F.col(column)), [column], F.col("_c"), "_before", by)
    ranks = ranks.withColumn(name, F.col("_before") + (F.col("_c") + 1) / 2).drop("_c", "_before")
    ranks = ranks.select(F.col(column).alias("_x"), name, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)])
    same = F.col(column).eqNullSafe(F.col("_x"))
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, same).drop("_x", *[f"_k{i}" for i in range(len(by))])


def spearman(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    return average_ranks(average_ranks(df, x, "_rx", by), y, "_ry", by).groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def stratified(df: DataFrame, t: str, loss: str, bins: int = 4, top: float = 1.001) -> DataFrame:
    """Mean loss per linear bin of t on [0, top]."""
    return df.groupBy(F.floor(F.col(t) / (top / bins)).cast("int").alias("bin")).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))


def scatter(df: DataFrame, index: str, value: str) -> DataFrame:
    """Sum, mean, product, minimum, maximum by index."""
    return df.groupBy(index).agg(
        F.sum(value).alias("sum"), (F.sum(value) / F.greatest(F.count("*"), F.lit(1))).alias("mean"), F.product(F.col(value)).alias("product"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def codebook_usage(df: DataFrame, code: str, size: int, by=()) -> DataFrame:
    """Perplexity of code use, and the share of codes used."""
    counts = df.groupBy(*by, code).agg(F.count("*").alias("_c"))
    if by:
        p = counts.join(counts.groupBy(*by).agg(F.sum("_c").alias("_t")), list(by))
    else:
        p = counts.crossJoin(F.broadcast(counts.agg(F.sum("_c").alias("_t"))))  # one row
    q = F.col("_c") / F.col("_t")
    return p.groupBy(*by).agg(F.exp(-F.sum(q * F.log(q + 1e-10))).alias("perplexity"), (F.count("*") / size).alias("usage"))


def ngram_counts(df: DataFrame, by: str, text: str, n: int = 1) -> DataFrame:
    """(by, gram, n): how often each run of n code points stands in the texts of a group.

    A batch's texts are read as numbers and counted together; only counts are shuffled.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            groups, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in dict.fromkeys(groups):
                held = [t for g, t in zip(groups, texts) if g == group and t is not None and len(t) >= n]
                if not held:
                    continue
                points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                ends = np.cumsum([len(t) for t in held])
                starts = np.ones(len(points), dtype=bool)
                for k in range(1, n):  # a run does not begin in the last n - 1 places of a text
                    starts[ends - k] = False
                letters, code = np.unique(points, return_inverse=True)
                at = np.flatnonzero(starts)
                gram = code[at].astype(np.int64)
                names = letters[None, :].T
                for k in range(1, n):
                    # Runs so far by number, so that numbers never grow beyond letters times runs.
                    pair, gram = np.unique(gram * len(letters) + code[at + k], return_inverse=True)
                    names = np.concatenate([names[pair // len(letters)], letters[pair % len(letters)][:, None]], axis=1)
                count = np.bincount(gram, minlength=len(names))
                strings = [row.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for row in names]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(strings), batch.schema.field(0).type), pa.array(strings), pa.array(count, pa.int64())], names=[by, "gram", "n"])

    return df.select(by, text).mapInArrow(run, f"`{by}` {dict(df.dtypes)[by]}, gram string, n long").groupBy(by, "gram").agg(F.sum("n").alias("n"))


def distribution(df: DataFrame, item: str, by=(), weight: str | None = None) -> DataFrame:
    """Shares of items in each group; weight: a column of counts, where rows are counted already."""
    counts = df.groupBy(*by, item).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(total, list(by)) if by else counts.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("p", F.col("n") / F.col("total")).drop("total")


def hellinger(p: DataFrame, q: DataFrame, item: str, by=()) -> DataFrame:
    """Distance of each group's distribution p to one reference q; items missing on a side count as 0."""
    # sum (sqrt p - sqrt q)^2 = 2 - 2 sum sqrt(pq) when both add up to 1
    both = p.join(q.select(item, F.col("p").alias("_q")), item, "left").withColumn("_q", F.coalesce("_q", F.lit(0.0)))
    inner = both.groupBy(*by).agg(F.sum(F.sqrt(F.col("p") * F.col("_q"))).alias("_b"))
    return inner.select(*by, F.sqrt(F.greatest(2 - 2 * F.col("_b"), F.lit(0.0))).alias("hellinger"))


def kl_divergence(p: DataFrame, q: DataFrame, item: str, by=(), floor: float = 1e-5) -> DataFrame:
    """sum p ln(p / q) with a floor for items that the reference lacks."""
    both = p.join(q.select(item, F.col("p").alias("_q")), item, "left").withColumn("_q", F.coalesce("_q", F.lit(floor)))
    return both.groupBy(*by).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("_q"))).alias("kl"))


def merged(frames, keys) -> DataFrame:
    """Frames with different metrics in one, by name: per key, each metric's values in ascending order; none where a frame lacks it."""
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.groupBy(*keys).agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in rows.columns if c not in keys])


def quantised(vectors: DataFrame, key: str, vector: str, books) -> DataFrame:
    """Residual quantisation: key, a code per book in order, and the squared length of what is left.

    books: frames (code, centre) of a few codewords each, the next applied to what the one before left.
    A codebook belongs to a model, not to the data, so it is broadcast. Ties go to the smaller code.
    """
    rows = vectors.select(key, F.col(vector).alias("_r"), F.array().cast("array<bigint>").alias("codes"))
    for book in books:
        tried = rows.crossJoin(F.broadcast(book)).withColumn("_left", F.zip_with("_r", "centre", lambda x, y: x - y))
        tried = tried.withColumn("_d", F.round(F.aggregate("_left", F.lit(0.0), lambda a, x: a + x * x), 9))
        best = tried.groupBy(key).agg(F.min_by(F.struct("_left", "codes", "code"), F.struct("_d", "code")).alias("_b"))
        rows = best.select(key, F.col("_b._left").alias("_r"), F.concat("_b.codes", F.array(F.col("_b.code").cast("long"))).alias("codes"))
    return rows.select(key, "codes", F.aggregate("_r", F.lit(0.0), lambda a, x: a + x * x).alias("left"))


def masked_mean(df: DataFrame, value: str, mask, by=()) -> DataFrame:
    m = F.when(mask, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg((F.sum(F.col(value) * m) / F.nullif(F.sum(m), F.lit(0.0))).alias("masked_mean"))
