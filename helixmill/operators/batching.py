"""Length bucketing and batches under token budgets.

Folds that depend on order run per bucket of a bounded number of rows of about one
length (`length_buckets`), each inside one task, so the whole is parallel. Batches that follow from
a row's place in an order go through `sampling.global_rank`: no task sorts more than one
coarse bucket of the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import hashing
from helixmill.operators.sampling import global_rank, global_sum


def length_buckets(df: DataFrame, key: str, length: str, rows: int, by=()) -> DataFrame:
    """Adds bucket: rows in order of length and key, so many to a bucket."""
    return global_rank(df, F.col(length), [key], "_place", by).withColumn("bucket", F.floor((F.col("_place") - 1) / rows).cast("int")).drop("_place")


def sortish(df: DataFrame, key: str, length: str, bucket: int, replicas: int, seed) -> DataFrame:
    """Rows by length in buckets of `bucket`; rows shuffled in buckets, buckets shuffled; then sliced to replicas.

    Adds bucket, place (from 0) and replica. The order is padded by wrapping round, so
    every replica gets equally many rows.
    """
    ranked = length_buckets(df, key, length, bucket)
    dealt = ranked.withColumn("_bh", hashing.digest(f"{seed}-bucket", F.col("bucket"))).withColumn("_rh", hashing.digest(f"{seed}-row", F.col(key)))
    placed = global_rank(dealt, F.substring("_bh", 1, 4), ["_bh", "bucket", "_rh", key], "place").withColumn("place", F.col("place") - 1)
    placed = placed.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    each = F.ceil(F.col("_n") / replicas)
    extra = each * replicas - F.col("_n")
    again = placed.filter(F.col("place") < extra).withColumn("place", F.col("place") + F.col("_n"))
    return placed.unionByName(again).withColumn("replica", F.floor(F.col("place") / F.ceil(F.col("_n") / replicas)).cast("int")).drop("_bh", "_rh", "_n")


def fold(lengths, budget: int, square: int | None = None, most: int | None = None, clip: int | None = None, by: str = "max", compat: bool = False):
    """Lengths in order -> (batch number of each, or None for an item over the budget alone).

    by max: (n + 1) * longest <= budget and (n + 1) * longest ** 2 < square.
    by sum: total <= budget. compat: the squared maximum outlives a full batch.
    """
    out, batch, n, longest, longest_sq, total = [], 0, 0, 0, 0, 0
    for raw in lengths:
        size = min(raw, clip) if clip else raw

        def fits(n, longest, longest_sq, total, size=size):
            if by == "sum":
                return total + size <= budget
            top, top_sq = max(longest, size), max(longest_sq, size * size)
            return (n + 1) * top <= budget and (square is None or (n + 1) * top_sq < square)

        if not fits(0, 0, 0, 0):
            out.append(None)
            continue
        if n and (not fits(n, longest, longest_sq, total) or (most and n >= most)):
            batch, n, longest, total = batch + 1, 0, 0, 0
            longest_sq = longest_sq if compat else 0
            if compat and not fits(0, 0, longest_sq, 0):
                longest_sq = 0
        n, longest, longest_sq, total = n + 1, max(longest, size), max(longest_sq, size * size), total + size
        out.append(batch)
    return out


def token_batches(df: DataFrame, keys, order, length: str, **budget) -> DataFrame:
    """Adds batch (per group of keys) by a greedy fold in the given order; null batch: a reject."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, batch int"
    names = [o for o in order]

    def run(group):
        g = group.sort_values(names, kind="stable").reset_index(drop=True)
        return g.assign(batch=__import__("pandas").array(fold(g[length].tolist(), **budget), dtype="Int32"))

    return df.groupBy(*keys).applyInPandas(run, schema)


def equalised(df: DataFrame, replica: str, batch: str) -> DataFrame:
    """Every replica gets the largest number of batches, by cycling through its own. Adds step."""
    counts = df.groupBy(replica).agg((F.max(batch) + 1).alias("_own"))
    most = counts.agg(F.max("_own").alias("_most"))
    steps = counts.crossJoin(F.broadcast(most)).select(replica, "_own", F.explode(F.sequence(F.lit(0), F.col("_most") - 1)).alias("step"))  # most is one row
    return steps.withColumn(batch, (F.col("step") % F.col("_own")).cast("int")).drop("_own").join(df, [replica, batch])


def same_length_batches(df: DataFrame, key: str, length: str, most: int, square: int, seed) -> DataFrame:
    """Batches of one length each, of min(most, square // L ** 2 + 1) rows; order within a length by hash."""
    cap = F.least(F.lit(most), F.floor(F.lit(square) / (F.col(length) * F.col(length))) + 1)
    w = Window.partitionBy(length).orderBy(hashing.digest(seed, F.col(key)), key)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / cap).cast("int"))


def chunks(df: DataFrame, keys, order, n: int, bucket) -> DataFrame:
    """Fixed-size chunks in order. bucket: a coarse key whose order agrees with `order`."""
    return global_rank(df, bucket, order, "_place", keys).withColumn("chunk", F.floor((F.col("_place") - 1) / n).cast("int")).drop("_place")


def packed_blocks(df: DataFrame, keys, order, length: str, block: int, bucket) -> DataFrame:
    """Documents laid end to end, each with a separator; adds first and last block of each and its offset there."""
    out = global_sum(df, bucket, order, F.col(length) + 1, "_start", keys)
    return (
        out.withColumn("first_block", F.floor(F.col("_start") / block).cast("long"))
        .withColumn("last_block", F.floor((F.col("_start") + F.col(length)) / block).cast("long"))
        .withColumn("offset", (F.col("_start") % block).cast("long"))
        .drop("_start")
    )


def buffered_batches(df: DataFrame, key: str, length: str, most: int, replicas: int = 1, buffer: int = 100, seed: int = 42, epoch: int = 0, shuffle: bool = True, drop_last: bool = False) -> DataFrame:
    """Batches of at most `most` tokens, from each replica's rows in a seeded order, through a bounded heap.

    A replica's rows pass a heap that holds `buffer` times `most` tokens; once it is over that,
    its shortest row goes to the open batch, and so do all that are left at the end. A batch is
    closed by a row that does not fit; a row over `most` alone has a batch to itself. drop_last:
    the last batch of a replica goes. Batches are put in the order of a hash (shuffle), and every replica
    gets as many steps as the longest one has, by repeating its first batches.

    Adds replica, batch, place in the batch and step; a row has one result row per step that uses it. A task streams a replica's rows
    and holds its heap and open batch only. Ties go to the smaller place in the seeded order. Lengths are not null.
    """
    names, kinds = [key, length], dict(df.dtypes)
    order = hashing.digest(f"{seed}-order", F.col(key)) if shuffle else F.lit("")
    drawn = df.select(*names).withColumn("_h", order)
    dealt = global_rank(drawn, F.substring("_h", 1, 3), ["_h", key], "_place").withColumn("replica", ((F.col("_place") - 1) % replicas).cast("int"))

    def run(batches):
        import heapq

        import pandas as pd

        heap, held, batch, size, at, done, replica = [], 0, 0, 0, 0, [], None
        last: list = []

        def take():
            nonlocal held, batch, size, at, last
            n, place, k = heapq.heappop(heap)
            held -= n
            if at and size + n > most:
                done.extend(last)
                batch, size, at, last = batch + 1, 0, 0, []
            last.append((k, n, replica, batch, at))
            size, at = size + n, at + 1

        def finish():
            nonlocal heap, held, batch, size, at, last
            while heap:
                take()
            if not drop_last:
                done.extend(last)
            heap, held, batch, size, at, last = [], 0, 0, 0, 0, []

        def out():
            made = pd.DataFrame(done, columns=[key, length, "replica", "batch", "place"])
            done.clear()
            return made

        for part in batches:
            for r in part.itertuples(index=False):
                if r.replica != replica:
                    finish()
                    replica = r.replica
                heapq.heappush(heap, (int(r.size), int(r.spot), r.row))
                held += int(r.size)
                if held > most * buffer:
                    take()
            if done:
                yield out()
        finish()
        if done:
            yield out()

    rows = dealt.select(F.col(key).alias("row"), F.col(length).alias("size"), F.col("_place").alias("spot"), "replica")
    made = rows.repartition(replicas, "replica").sortWithinPartitions("replica", "spot").mapInPandas(run, f"`{key}` {kinds[key]}, `{length}` {kinds[length]}, replica int, batch int, place int")
    numbers = made.groupBy("replica").agg((F.max("batch") + 1).alias("_own"))
    steps = numbers.select("replica", "_own", F.explode(F.sequence(F.lit(0), F.col("_own") - 1)).alias("batch"))
    turn = hashing.digest(f"{seed}-{epoch}-batch", F.concat_ws("-", "replica", "batch")) if shuffle else F.lpad(F.col("batch").cast("string"), 12, "0")
    steps = steps.withColumn("_h", turn)
    steps = global_rank(steps, F.substring("_h", 1, 2) if shuffle else F.substring("_h", 1, 6), ["_h", "batch"], "step", ["replica"]).withColumn("step", F.col("step") - 1)
    steps = steps.crossJoin(F.broadcast(numbers.agg(F.max("_own").alias("_most"))))  # one row
    again = steps.filter(F.col("step") < F.col("_most") - F.col("_own")).withColumn("step", F.col("step") + F.col("_own"))
    return made.join(steps.unionByName(again).select("replica", "batch", F.col("step").cast("int").alias("step")), ["replica", "batch"])


@dataclass(frozen=True)
class LoaderDefaults:
    """What batches are assembled with if nothing else is said."""

    max_tokens: int = 6000
    max_square_tokens: int = 1_000_000
    bucket_size: int = 1000
    max_batch_size: int = 800
    max_len: int = 512


def assembled(df: DataFrame, key: str, length: str, defaults: LoaderDefaults = LoaderDefaults()) -> DataFrame:
    """Adds bucket and batch: rows of about one length, batches under both budgets, lengths counted up to max_len."""
    buckets = length_buckets(df, key, length, defaults.bucket_size)
    return token_batches(buckets, ["bucket"], [length, key], length, budget=defaults.max_tokens, square=defaults.max_square_tokens, most=defaults.max_batch_size, clip=defaults.max_len)
