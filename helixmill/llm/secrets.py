"""Secret scans: patterns, and character Markov models of random strings and identifiers.

Base spans come from three patterns. The method adds further spans: every run of
20 or more token characters is scored by two first-order character Markov models,
one of random strings and one of ordinary identifiers; a run whose log-likelihood
ratio exceeds a threshold is taken for a secret.

The models are trained from labelled samples, natively: character pairs are counted
by label, with add-one smoothing, into a table as large as the alphabet squared,
which then is a constant of the scoring expression. Documents are not shuffled.

Edge cases: null text is ''; texts of any length are read whole, and one with many
thousand spans costs in proportion; positions are code
points, end exclusive; rows that repeat an id are separate rows; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs of at least so many characters are what the plain `+` patterns leave after short matches are dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
THRESHOLD = 8.0
#: Bound of the labelled rows that give ordinary identifiers, and number of random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 500, 3000


def samples(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, random): labelled strings.

    Random ones encode digests of a counter in hex, base64, and letters with digits.
    Ordinary ones are words of at most SAMPLE_DOCS documents labelled as good, alone
    and joined to identifiers the usual ways.
    """
    n = F.col("id").cast("string")
    hexed, based = F.sha2(F.concat(F.lit("sample:"), n), 256), F.base64(F.unhex(F.sha2(F.concat(F.lit("b64:"), n), 256)))
    random = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(F.substring(hexed, 1, 40), F.translate(based, "=", ""), F.translate(based, "+/=", ""), F.upper(F.translate(based, "+/=", "")))).alias("text"))
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy("doc_id").limit(SAMPLE_DOCS)
    words = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id").select(F.regexp_extract_all("text", F.lit(r"(?:\b[A-Za-z]{2,}\b[^A-Za-z]*){1,3}"), F.lit(0)).alias("runs"))
    w = words.select(F.explode("runs").alias("run")).select(F.regexp_extract_all("run", F.lit(r"[A-Za-z]+"), F.lit(0)).alias("w"))
    low = F.transform("w", lambda x: F.lower(x))
    plain = w.select(
        F.explode(
            F.array(F.array_join(low, "_"), F.array_join(low, "-"), F.array_join(F.transform("w", lambda x: F.initcap(x)), ""), F.array_join("w", "/"), F.upper(F.array_join("w", "_")))
        ).alias("text")
    )
    return random.withColumn("random", F.lit(True)).unionByName(plain.withColumn("random", F.lit(False))).filter("length(text) > 1")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each pair of ALPHABET characters, row by row."""
    pairs = samples.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair"))
    count = {(r.random, r.pair): r.n for r in pairs.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_-]{2}$")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    size, out = len(ALPHABET), []
    for a in ALPHABET:
        totals = {k: sum(count.get((k, a + b), 0) for b in ALPHABET) + size for k in (True, False)}
        out += [math.log((count.get((True, a + b), 0) + 1) / totals[True]) - math.log((count.get((False, a + b), 0) + 1) / totals[False]) for b in ALPHABET]
    return out


def ratio(run, model: list[float]):
    """Log-likelihood ratio of a string column; pairs outside the alphabet add nothing."""
    table, size = F.expr(f"cast(split('{','.join(map(repr, model))}', ',') as array<double>)"), len(ALPHABET)  # a constant
    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(
        F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))),
        F.struct(F.get(at, F.lit(0)).alias("before"), F.lit(0.0).alias("sum")),
        lambda acc, x: F.struct(x.alias("before"), (acc["sum"] + F.coalesce(F.when((acc["before"] >= 0) & (x >= 0), F.get(table, acc["before"] * size + x)), F.lit(0.0))).alias("sum")),
        lambda acc: acc["sum"],
    )


SPAN = "array<struct<start:int,kind:int,end:int>>"
NONE = "array()"
#: Elements of an array that a running value is carried through at a time: an array grows by copying.
STRIDE = 256


def _bound(value, then):
    """then(value), with value computed once a row: Spark computes an expression anew for each element of a lambda that names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values, zero: int, add):
    """For each of an int array's values, zero and all values before it under `add`, an associative function.

    Strides are summed, their sums are carried on, and then the values of each stride: work
    grows with the length, but for a square of the number of strides.
    """
    none = F.expr(f"cast({NONE} as array<int>)")

    def before(xs):
        return F.aggregate(
            xs,
            F.struct(F.lit(zero).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def of(v):
        strides = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / STRIDE).cast("int") - 1, F.lit(0))), lambda k: F.slice(v, k * STRIDE + 1, F.lit(STRIDE)))
        return _bound(strides, lambda c: F.flatten(F.zip_with(c, before(F.transform(c, lambda x: F.aggregate(x, F.lit(zero), add))), lambda x, at: F.transform(before(x), lambda b: add(at, b)))))

    return _bound(values, of)


def _spans(text, pattern: str, kind: int, keep=None):
    """Matches in order: what lies between them, split(text, pattern), gives their places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep == "value" else found
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    steps = F.filter(steps, lambda x: x["m"].isNotNull())  # there is a gap more than matches

    def placed(x):
        starts = F.zip_with(x, _running(F.transform(x, lambda s: s["g"] + s["m"]), 0, lambda a, b: a + b), lambda s, at: F.struct((at + s["g"]).alias("start"), (at + s["g"] + s["m"]).alias("end")))
        return F.zip_with(starts, value, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("v")))

    ends = _bound(steps, placed)
    ends = F.filter(ends, lambda s: F.length(s["v"]) >= 6) if keep == "value" else ends if keep is None else F.filter(ends, lambda s: keep(s["v"]))
    spans = F.transform(ends, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast({NONE} as {SPAN})"))


def _apart(base, more):
    """base and those of `more` that touch none of it, in order: one pass over both, sorted, from either side."""

    def of(spans):
        is_base = lambda s: s["kind"] < KINDS.index("markov")
        ended = _running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(-1))), -1, lambda a, b: F.greatest(a, b))
        begun = _running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(F.lit(2**31 - 1)))), 2**31 - 1, lambda a, b: F.least(a, b))
        told = F.arrays_zip(spans.alias("s"), ended.alias("before"), F.reverse(begun).alias("after"))
        return F.transform(F.filter(told, lambda x: is_base(x["s"]) | ((x["before"] <= x["s"]["start"]) & (x["after"] >= x["s"]["end"]))), lambda x: x["s"])

    return F.when(F.size(more) == 0, base).when(F.size(base) == 0, more).otherwise(_bound(F.array_sort(F.concat(base, more)), of))


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, found (array of start, kind, end), n_assign, n_access, n_hex, base_sha256, spans."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    t = F.col("_t")
    rows = rows.select("doc_id", _spans(t, ASSIGN, 0, "value").alias("_a"), _spans(t, ACCESS, 1).alias("_k"), _spans(t, HEX, 2).alias("_h"), _spans(t, RUN, 3, lambda v: ratio(v, model) > threshold).alias("_m"))
    rows = rows.withColumn("_base", F.array_sort(F.concat("_a", "_k", "_h")))
    # A run that touches a base span adds nothing to it.
    rows = rows.withColumn("found", _apart(F.col("_base"), F.col("_m")))
    return rows.select(
        "doc_id",
        F.size("_a").cast("long").alias("n_assign"),
        F.size("_k").cast("long").alias("n_access"),
        F.size("_h").cast("long").alias("n_hex"),
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        "found",
    )
