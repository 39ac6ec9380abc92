"""Seeded samples and splits. Every draw is a function of seed and key, so reruns and retries agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import hashing
from helixmill.operators.corpus import best_per


def one_per_cluster(df: DataFrame, cluster: str, key: str, epoch: int) -> DataFrame:
    return best_per(df, [cluster], [hashing.digest(epoch, F.col(key)), F.col(key)])


def crop_length(length, key, seed, least: int = 60):
    """Half of the rows keep their length; the others get a uniform one in [least, length)."""
    drawn = least + F.floor(hashing.uniform(f"{seed}-len", key) * (length - least))
    return F.when((hashing.uniform(f"{seed}-keep", key) < 0.5) | (length <= least), length).otherwise(drawn).cast("int")


def window_start(length, key, seed, width: int):
    """Start (from 0) of a window of at most width; the same for every parallel array of a row."""
    return F.coalesce(hashing.below(seed, key, length - width + 1), F.lit(0))


def hash_split(key, seed, share: float, names=("train", "test")):
    return F.when(hashing.uniform(seed, key) < share, names[0]).otherwise(names[1])


def sample_rows(df: DataFrame, keys, key: str, seed, n, top: bool = False) -> DataFrame:
    """n rows of each group without replacement, by hash order or from the top."""
    order = [F.col(key)] if top else [hashing.digest(seed, F.col(key)), F.col(key)]
    return best_per(df, keys, order, n)


def task_mix(df: DataFrame, key: str, seed, ratios: dict[str, float]) -> DataFrame:
    """Rows dealt to tasks in hash order: floor(n * ratio) each, the remainder to the last task.

    The place in the order comes from counts per hash prefix, so no task holds all rows.
    """
    h = hashing.digest(seed, F.col(key))
    placed = global_rank(df.withColumn("_h", h), F.substring("_h", 1, 2), ["_h", key], "_place")
    n = df.agg(F.count("*").alias("_n"))
    out, low, names = None, F.lit(0).cast("double"), list(ratios)
    for name in names[:-1]:
        high = low + F.floor(F.col("_n") * ratios[name])
        test = F.col("_place") <= high
        out = F.when(test, name) if out is None else out.when(test, name)
        low = high
    task = F.lit(names[-1]) if out is None else out.otherwise(names[-1])
    return placed.crossJoin(F.broadcast(n)).withColumn("task", task).drop("_h", "_place", "_n")  # n is one row


def global_rank(df: DataFrame, bucket, order, name: str, by=()) -> DataFrame:
    """Place (from 1) of each row in a global order, or in that of its group `by`, without one task sorting all rows.

    bucket: a coarse key whose order agrees with `order`. Buckets are counted, their
    running totals are made over that small table, and rows are ranked inside buckets.
    """
    return global_sum(df, bucket, order, F.lit(1), name, by).withColumn(name, F.col(name) + 1)


def global_sum(df: DataFrame, bucket, order, value, name: str, by=()) -> DataFrame:
    """Sum of value over the rows before each row in a global order; see global_rank."""
    keyed = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = keyed.groupBy(*by, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_r", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = F.col("_b").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(totals, same).withColumn(name, F.col("_earlier") + F.col("_r")).drop("_b", "_v", "_r", "_earlier", "_kb", *[f"_k{i}" for i in range(len(by))])


#: Bytes of a group, as a matrix of code points, up to which one task chooses from it alone; and bytes of chosen texts that a scan may carry.
GROUP_BYTES, CARRIED_BYTES = 64 << 20, 64 << 20


def diverse_rows(df: DataFrame, keys, key: str, seq: str, n: int, most: bool = True, group_bytes: int = GROUP_BYTES, carried_bytes: int = CARRIED_BYTES) -> DataFrame:
    """Greedy choice of n aligned rows per group, each the most (or least) distant on average from those chosen: keys, key, step.

    Starts from the row with the smallest key; ties go to the smaller key. Key is unique in its
    group and not null; rows shorter than the longest count as filled up with gaps; null text is empty.
    Distances are whole numbers of places, so no order of addition matters.

    Groups of up to `group_bytes` are chosen from whole, each in one task. Larger ones are scanned
    once a step: a task offers its best row of each group, and the best of these is chosen. Such groups go in lots, so that the
    texts chosen from a lot, which go to every task, stay within `carried_bytes` (one group at least).
    """
    from helixmill.operators.graph import written

    rows = df.select(*keys, key, F.coalesce(F.col(seq), F.lit("")).alias("_seq"))
    wide = F.max(F.length("_seq")).cast("long")
    sizes = rows.groupBy(*keys).agg((F.count("*") * (wide + 16) * 4).alias("_bytes"), (wide * 4 * n).alias("_held"))
    large = sizes.filter(F.col("_bytes") > group_bytes)
    before = F.sum("_held").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))  # a row per large group
    large = written(large.withColumn("_lot", F.floor(F.coalesce(before, F.lit(0)) / carried_bytes)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lot"))
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{key}` {kinds[key]}", "step int"])
    lots = sorted(r["_lot"] for r in large.select("_lot").distinct().collect())

    def of(part, how):
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & rows[k].eqNullSafe(part[f"_k{i}"])
        return rows.join(part, same, how)

    out = (of(large, "left_anti") if lots else rows).groupBy(*keys).applyInPandas(_chosen(list(keys), key, n, most), schema)
    for lot in lots:
        out = out.unionByName(_scanned(written(of(large.filter(F.col("_lot") == lot), "left_semi")), keys, key, n, most, schema))
    return out


def _chosen(keys, key: str, n: int, most: bool):
    """The greedy choice from one group."""

    def run(group):
        import numpy as np

        group = group.sort_values(key).reset_index(drop=True)
        codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in group["_seq"]]
        m = np.full((len(codes), max(map(len, codes))), ord("-"), np.uint32)
        for i, x in enumerate(codes):
            m[i, : len(x)] = x
        far, free, steps = np.zeros(len(m), np.int64), np.ones(len(m), bool), [0]
        free[0] = False
        while len(steps) < min(n, len(m)):
            for i in range(len(m)):  # a row at a time: no second matrix
                far[i] += np.count_nonzero(m[i] != m[steps[-1]])
            left = np.flatnonzero(free)
            best = int(left[far[left].argmax() if most else far[left].argmin()])
            free[best] = False
            steps.append(best)
        taken = group.loc[steps[:n], [*keys, key]].copy()
        taken["step"] = np.arange(len(taken), dtype=np.int32)
        return taken

    return run


def _scanned(rows: DataFrame, keys, key: str, n: int, most: bool, schema: str) -> DataFrame:
    """The greedy choice from groups of any size, by a scan a step."""
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    offer = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{key}` {kinds[key]}", "_seq string", "_far long"])
    order = F.struct((-F.col("_far") if most else F.col("_far")).alias("d"), F.col(key).alias("k"))
    taken: dict[tuple, list] = {}
    for _ in range(n):
        sent = spark.sparkContext.broadcast(taken)
        best = rows.mapInPandas(_offers(sent, most), offer).groupBy(*keys).agg(F.min_by(F.struct(key, "_seq"), order).alias("_best")).collect()
        for r in best:
            taken.setdefault(tuple(r[k] for k in keys), []).append((r["_best"][key], r["_best"]["_seq"]))
        sent.destroy()
        if not best:
            break
    return spark.createDataFrame([(*g, k, i) for g, them in taken.items() for i, (k, _) in enumerate(them)], schema)


def _offers(sent, most: bool):
    """The best row of each group among a task's rows, given those taken: {group: [(key, sequence)]}."""

    def run(batches):
        import numpy as np
        import pandas as pd

        gap = ord("-")
        codes = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        groups, best = {}, {}
        for group, them in sent.value.items():
            a = [codes(s) for _, s in them]
            m = np.full((len(a), max(map(len, a))), gap, np.uint32)
            for i, x in enumerate(a):
                m[i, : len(x)] = x
            solid = np.append(np.cumsum((m != gap).sum(0)[::-1])[::-1], 0)  # letters of those taken from a place on
            groups[group] = {k for k, _ in them}, m, solid
        for batch in batches:
            for *group, key, seq in batch.itertuples(index=False, name=None):
                group = tuple(group)
                far = 0
                if group in groups:
                    keys, m, solid = groups[group]
                    if key in keys:
                        continue
                    x = codes(seq)
                    w = min(len(x), m.shape[1])
                    far = int(np.count_nonzero(m[:, :w] != x[:w]) + solid[w] + len(m) * np.count_nonzero(x[w:] != gap))
                rank = (-far if most else far, key)
                if group not in best or rank < best[group][0]:
                    best[group] = rank, seq, far
        if best:
            yield pd.DataFrame([(*g, rank[1], seq, far) for g, (rank, seq, far) in best.items()])

    return run


def masked_811(ids, key, seed, mask_id: int, vocabulary: int, special, p: float = 0.15):
    """Masked-language-model noise: a share p of ordinary ids is chosen; of these 80 % become mask, 10 % random, 10 % stay.

    Returns struct(input, label); label is IGNORE where nothing was chosen.
    """
    from helixmill.functions.sequence import IGNORE

    def draw(kind, i):
        return hashing.uniform(f"{seed}-{kind}", F.concat(key.cast("string"), F.lit("-"), i.cast("string")))

    def one(t, i):
        chosen = (draw("pick", i) < p) & ~t.isin(*special)
        how = draw("how", i)
        new = F.when(how < 0.8, F.lit(mask_id)).when(how < 0.9, F.floor(draw("id", i) * vocabulary).cast("int")).otherwise(t)
        return F.struct(F.when(chosen, new).otherwise(t).alias("input"), F.when(chosen, t).otherwise(F.lit(IGNORE)).alias("label"))

    return F.transform(ids, one)


def absorbed(ids, key, seed, t, mask_id: int, special):
    """Absorbing noise: each ordinary id becomes mask with probability t."""
    return F.transform(
        ids, lambda x, i: F.when((hashing.uniform(seed, F.concat(key.cast("string"), F.lit("-"), i.cast("string"))) < t) & ~x.isin(*special), F.lit(mask_id)).otherwise(x)
    )


def length_ladder(df: DataFrame, top: str, step: int, copies: int, letter: str = "A") -> DataFrame:
    """df's rows, each with chains of one letter: step (from 1), length, copy (from 1) and seq, up to the greatest multiple of `step` in top (at least one step)."""
    steps = F.greatest(F.floor(F.col(top) / step), F.lit(1)).cast("int")
    rows = df.withColumn("step", F.explode(F.sequence(F.lit(1), steps))).withColumn("length", F.col("step") * step)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("seq", F.expr(f"repeat('{letter}', length)")).drop(top)


def length_grid(df: DataFrame, low: str, high: str, every: int, samples: int) -> DataFrame:
    """df's rows, each with jobs of (length, sample): lengths from low to high in steps, samples from 0."""
    lengths = df.withColumn("length", F.explode(F.sequence(F.col(low).cast("int"), F.col(high).cast("int"), F.lit(every)))).drop(low, high)
    return lengths.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
