"""Filters, trims and projections over sequence corpora."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import numeric


@dataclass(frozen=True)
class MetadataFilter:
    """Optional predicates of the metadata scan; None leaves one out."""

    splits: tuple[str, ...] | None = None
    min_len: int | None = None
    max_len: int | None = None
    oligomeric: tuple[str, ...] | None = None
    max_helix: float | None = None
    max_coil: float | None = None
    min_strand: float | None = None
    min_lddt: float | None = None
    rog_quantile: float | None = None
    subset: int | None = None
    eval_max_len: int | None = None
    crop: int | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def col(self, name: str) -> Column:
        return F.col(self.columns.get(name, name))


#: The two published parameter sets.
MONOMER_128 = MetadataFilter(max_len=128, oligomeric=("monomeric",), rog_quantile=0.96, eval_max_len=256)
PDB_SWISSPROT_512 = MetadataFilter(splits=("pdb", "afdb_swissprot"), min_len=60, max_len=1024, crop=512)


def all_of(predicates) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def evaluation_scan(df: DataFrame, f: MetadataFilter, key: str) -> DataFrame:
    """The rows of a set's own scan that are short enough to be evaluated on, whatever the length that it trains on."""
    return metadata_scan(df, replace(f, max_len=f.eval_max_len), key)


def metadata_scan(df: DataFrame, f: MetadataFilter, key: str) -> DataFrame:
    """All predicates in one conjunction, so they reach the scan; then the length-dependent radius cut-off."""
    tests = []
    if f.splits:
        tests.append(f.col("split").isin(*f.splits))
    if f.min_len is not None:
        tests.append(f.col("modeled_seq_len") >= f.min_len)
    if f.max_len is not None:
        tests.append(f.col("modeled_seq_len") <= f.max_len)
    if f.oligomeric:
        tests.append(f.col("oligomeric_detail").isin(*f.oligomeric))
    for name, most in (("helix_percent", f.max_helix), ("coil_percent", f.max_coil)):
        if most is not None:
            tests.append(f.col(name) < most)
    if f.min_strand is not None:
        tests.append(f.col("strand_percent") > f.min_strand)
    if f.min_lddt is not None:
        tests.append(f.col("lddt_ca").isNotNull() & (f.col("lddt_ca") > f.min_lddt))
    out = df.filter(all_of(tests))
    if f.rog_quantile is not None:
        out = below_quantile_curve(out, f.columns.get("modeled_seq_len", "modeled_seq_len"), f.columns.get("radius_gyration", "radius_gyration"), f.rog_quantile)
    return out.orderBy(key).limit(f.subset) if f.subset else out


def quantile_curve(df: DataFrame, x: str, y: str, quantile: float, degree: int = 2, lift: float = 0.1) -> DataFrame:
    """(x, cutoff): the y-quantile at each x, smoothed by a polynomial fit through the normal equations, plus lift.

    One row per distinct x goes to the fit; its sums are added up distributed, and only
    (degree + 1) ** 2 numbers meet in one row.
    """
    q = df.groupBy(F.col(x).alias("x")).agg(F.percentile(F.col(y), F.lit(quantile)).alias("q"))
    scale = q.agg(F.max("x").alias("s"), F.count("*").alias("n"))
    u = q.crossJoin(scale).withColumn("u", F.col("x") / F.col("s"))  # one row
    sums = u.agg(*[F.sum(F.pow("u", F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.col("q") * F.pow("u", F.lit(k))).alias(f"t{k}") for k in range(degree + 1)])
    solved = sums.select(*[c.alias(f"c{i}") for i, c in enumerate(_solve([[F.col(f"s{i + j}") for j in range(degree + 1)] for i in range(degree + 1)], [F.col(f"t{i}") for i in range(degree + 1)]))])
    value = sum((F.col(f"c{i}") * F.pow("u", F.lit(i)) for i in range(1, degree + 1)), F.col("c0"))
    return u.crossJoin(solved).select("x", (value + lift).alias("cutoff"))  # one row again


def _solve(a, b):
    """Gaussian elimination on column expressions, for small symmetric positive systems."""
    n = len(b)
    a, b = [list(r) for r in a], list(b)
    for i in range(n):
        for r in range(i + 1, n):
            k = a[r][i] / a[i][i]
            a[r] = [a[r][j] - k * a[i][j] for j in range(n)]
            b[r] = b[r] - k * b[i]
    out = [None] * n
    for i in reversed(range(n)):
        out[i] = (b[i] - sum((a[i][j] * out[j] for j in range(i + 1, n)), F.lit(0.0))) / a[i][i]
    return out


def below_quantile_curve(df: DataFrame, x: str, y: str, quantile: float, degree: int = 2, lift: float = 0.1) -> DataFrame:
    """Rows whose y lies strictly below the cut-off at their x."""
    curve = quantile_curve(df, x, y, quantile, degree, lift).withColumnRenamed("x", x)
    return df.join(curve, x).filter(F.col(y) < F.col("cutoff")).drop("cutoff")


def trim_to(values, keep):
    """First and last place (from 1) of an array where keep holds, as struct(first, last); null if nowhere."""
    flags = F.transform(values, lambda v: F.coalesce(keep(v), F.lit(False)))
    first = F.nullif(F.array_position(flags, True), F.lit(0))
    last = F.size(flags) - F.array_position(F.reverse(flags), True) + 1
    return F.when(first.isNotNull(), F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))


def trimmed(array, span):
    """The part of a parallel array that a span of trim_to covers; empty where the span is null."""
    return F.coalesce(F.slice(array, span["first"], span["last"] - span["first"] + 1), F.slice(array, 1, 0))


def mask_below(values, confidence, least: float):
    """values with null where the parallel confidence is not above least."""
    return F.zip_with(values, confidence, lambda v, c: F.when(c > least, v))


def reject_reason(rules) -> Column:
    """First rule that fails, by name; null if none does. rules: (name, failing condition)."""
    out = None
    for name, fails in rules:
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def alphabet_ok(seq, letters: str) -> Column:
    return ~seq.rlike(f"[^{letters}]")


def repetitive(tokens, ratio: float) -> Column:
    """Whether one token makes up more than `ratio` of an array."""
    n = F.size(tokens)
    most = F.array_max(F.transform(F.array_distinct(tokens), lambda t: F.size(F.filter(tokens, lambda x: x == t))))
    return F.coalesce(most > n * ratio, F.lit(False))


def corpus_quality(df: DataFrame, seq: str, length: str, plddt: str, avg: str, source_is_predicted, max_len: int = 1024, min_avg: float = 85.0, min_spread: float = 15.0) -> DataFrame:
    """Drop null sequences; predicted structures need an even confidence and a high mean; length is bounded."""
    even = numeric.stddev_pop(F.col(plddt)) < min_spread
    return df.filter(F.col(seq).isNotNull() & (F.col(length) <= max_len) & (~source_is_predicted | (even & (F.col(avg) > min_avg))))


def best_per(df: DataFrame, keys, order, n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def renumbered(df: DataFrame, keys, index: str, name: str = "residue") -> DataFrame:
    """index counted from 1 within each chain."""
    return df.withColumn(name, F.col(index) - F.min(index).over(Window.partitionBy(*keys)) + 1)


def centred(df: DataFrame, keys, xyz=("x", "y", "z"), scale: float = 1.0, eps: float = 1e-5) -> DataFrame:
    """Coordinates moved to the centroid of their group and scaled."""
    w = Window.partitionBy(*keys)
    for c in xyz:
        df = df.withColumn(f"{c}_c", (F.col(c) - F.sum(c).over(w) / (F.count(c).over(w) + eps)) * scale)
    return df


def islands(df: DataFrame, keys, index: str) -> DataFrame:
    """Contiguous runs of an integer index: keys, start, end, n. Repeated indices count once."""
    w = Window.partitionBy(*keys).orderBy(index)
    runs = df.select(*keys, index).distinct().withColumn("_run", F.col(index) - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(index).alias("start"), F.max(index).alias("end"), F.count("*").alias("n")).drop("_run")


def fill_range(df: DataFrame, keys, index: str) -> DataFrame:
    """A row for every index between the least and the largest of each group; missing ones have nulls."""
    span = df.groupBy(*keys).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"))
    every = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(index))
    return every.join(df, [*keys, index], "left")
