"""Mixing sources to target weights.

Words are added up per source; a source's weight and the budget give its target,
held below a multiple of its size (water filling: what a full source cannot take
goes to the others by weight). target / size is the source's repetition rate. A
document is emitted floor(rate) times, and once more if a number drawn from the
hash of seed and id is below the fraction, so reruns agree.

Edge cases: null source is a source of its own, after all others; null or empty
text has size 0 and is emitted like any other; rows that repeat an id share its
draw; an empty table gives an empty table; other columns, whatever their names, come
out as they went in. Sources are few: one row of each meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._shared import materialise, small, uniform

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
SEED = "mix"


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, target). One row per source meets in one task."""
    by_name, whole = Window.orderBy(F.col("source").isNull(), "source"), Window.partitionBy()
    fill = Window.orderBy(F.col("_full") / F.col("_w"), "_rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sources.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_w", w)
        .withColumn("_full", F.col("source_size") * cap)
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(budget)))
        .withColumn("_at", F.row_number().over(fill))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_full").over(before), F.lit(0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    )
    open_ = F.when(F.col("_level") * F.col("_w") <= F.col("_full"), F.struct("_at", "_level"))
    return ranked.withColumn("_open", F.min(open_).over(whole)).select(
        "source",
        "source_size",
        F.least(F.col("_full").cast("double"), F.coalesce(F.col("_open._level") * F.col("_w"), F.col("_full").cast("double"))).alias("target"),
    )


def copies(rate, id_col, seed: str = SEED):
    """floor(rate), plus one with the fraction's probability."""
    whole = F.floor(rate)
    return whole + F.when(uniform(id_col, seed) < rate - whole, F.lit(1)).otherwise(F.lit(0))


def _rates(sizes: DataFrame, **kw) -> DataFrame:
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return small(materialise(targets(by_source, **kw), "mix-targets"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **kw) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, copies, taken."""
    sizes = materialise(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), size_of(F.col(f"`{text_col}`")).alias("size"), F.col(f"`{source_col}`").cast("string").alias("source")), "mix-sizes"
    )
    rates = _rates(sizes, **kw).withColumnRenamed("source", "_source")
    n = F.when(F.col("source_size") > 0, copies(F.col("target") / F.col("source_size"), F.col("doc_id"), seed)).otherwise(F.lit(1))
    return (
        sizes.join(rates, sizes.source.eqNullSafe(rates._source))
        .withColumn("copies", n.cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **kw) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with the columns of docs."""
    source = F.col(f"`{source_col}`").cast("string")
    rates = _rates(docs.select(size_of(F.col(f"`{text_col}`")).alias("size"), source.alias("source")), **kw).withColumnRenamed("source", "of")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), source.alias("source"))
    n = F.when(F.col("source_size") > 0, copies(F.col("target") / F.col("source_size"), F.col("id"), seed)).otherwise(F.lit(1)).cast("int")
    taken = rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).select("row", F.explode(F.array_repeat(F.lit(1), n)))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
