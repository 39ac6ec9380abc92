"""Filter interaction audit: what each of five filters removes in each of their 120 orders.

A document fails some of the filters, a mask of five bits; FIRST[mask, order] says at
which step an order removes it (STEPS: never). Tasks count their documents by part, mask
and label with np.bincount, look the counts up in FIRST and accumulate removals by part,
order, step and label; whatever a row of the result says is a sum over documents, so the
tasks' arrays are simply added up. A task holds at most PARTS parts at a time.

A text's copies are found by SHA-256: the smallest doc_id of each repeated text, by
aggregation that combines on the map side; texts with a thousandth of all rows or more,
at most a thousand of them, are joined by broadcast, so no group of copies meets in a task.

Edge cases: null text is empty, and equal to other empty texts; null lang is the part '';
a null doc_id is neither smaller nor larger than another, so such rows never fail E and
have no labels; rows that repeat a doc_id are counted one by one, and a copy under the
same doc_id is no smaller one; a document with several label rows is good or toxic if one
says so; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._shared import join_skewed, materialise

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10
BREAK, ODD = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
#: Parts that a task counts before it gives its counts on.
PARTS = 1024
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def first_failures():
    """(32, 120): the step, from 0, at which an order removes a document of that mask; STEPS if none does."""
    import numpy as np

    fails = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    at = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    in_order = fails[:, at]
    return np.where(in_order.any(axis=2), in_order.argmax(axis=2), STEPS)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, digest): bits of A to D; E needs the other rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    words = F.array_remove(F.split(text, BREAK), "")
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), F.size(words).alias("w"), F.size(F.array_distinct(words)).alias("u"), F.length(F.regexp_replace(text, "[^A-Z]", "")).alias("upper"), F.length(text).alias("points"), text.rlike(ODD).alias("odd"))
    wide = {c: F.col(c).cast("long") for c in ("w", "u", "upper", "points")}
    bits = [wide["w"] < LEAST_WORDS, 100 * wide["u"] < LEAST_DISTINCT * wide["w"], 100 * wide["upper"] > MOST_UPPER * wide["points"], F.col("odd")]
    return rows.select("doc_id", "part", sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0)).alias("mask"), "digest")


def _count(most: int):
    """Batches of (part, mask, good, toxic) -> partial rows of the result; at most so many parts at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        first = first_failures()
        cells = (np.arange(len(ORDERS)) * (STEPS + 1) + first)[:, :, None] * 4 + np.arange(4)
        at = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
        fails = ((np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1).astype(bool)
        held: dict = {}

        def rows():
            for part, n in held.items():
                weight = np.broadcast_to(n[:, None, :], cells.shape)
                lost = np.rint(np.bincount(cells.ravel(), weight.ravel(), len(ORDERS) * (STEPS + 1) * 4)).astype(np.int64).reshape(len(ORDERS), STEPS + 1, 4)
                removed = lost.sum(axis=2)[:, :STEPS]
                of_mask = n.sum(axis=1)
                failing = np.array([of_mask[fails[:, f]].sum() for f in range(STEPS)])
                alone = np.array([of_mask[1 << f] for f in range(STEPS)])
                over_orders = np.bincount(at.ravel(), removed.ravel(), STEPS).astype(np.int64)
                values = (of_mask.sum() - removed.cumsum(axis=1), removed, failing[at] - removed, alone[at], lost[:, :STEPS, 2:].sum(axis=2), lost[:, :STEPS, 1::2].sum(axis=2), over_orders[at])
                size = len(ORDERS) * STEPS
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * size), pa.array(np.repeat(ORDERS, STEPS).tolist()), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))), *[pa.array(v.ravel()) for v in values]],
                    names=["part", "filter_order", "step", *COUNTS],
                )
            held.clear()

        for batch in batches:
            parts = pc.dictionary_encode(batch.column(0))
            names = parts.dictionary.to_pylist()
            mask, good, toxic = (np.asarray(batch.column(i)).astype(np.int64) for i in (1, 2, 3))
            code = (np.asarray(parts.indices).astype(np.int64) << (STEPS + 2)) + (mask << 2) + (good << 1) + toxic
            found = np.bincount(code, minlength=len(names) << (STEPS + 2)).reshape(len(names), 1 << STEPS, 4)
            for name, n in zip(names, found):
                held[name] = held[name] + n if name in held else n
                if len(held) >= most:
                    yield from rows()
        yield from rows()

    return run


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", parts: int = PARTS) -> DataFrame:
    """600 rows per part: see RESULT."""
    rows = materialise(masks(docs, id_col, text_col, part_col), "audit-masks")
    copies = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "audit-copies")
    whole = join_skewed(rows, copies, "digest", "n", rows.count(), "left")
    whole = whole.select("doc_id", "part", F.when(F.col("doc_id") > F.col("least"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    counted = whole.join(said, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return counted.mapInArrow(_count(parts), RESULT).groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
