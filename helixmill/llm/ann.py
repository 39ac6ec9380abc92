"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a neighbour graph; the graph is split into parts
of equal size with few edges between them; a softmax classifier learns to tell from a
vector in which parts its neighbours lie. Every row is indexed under the classifier's
first choice. A query goes to its most probable parts; how many of them, is measured
on the sample, so that RECALL of the true neighbours is found there. Each part is
cut into blocks of bounded size, and so are the queries, so a part that a third of
all vectors fall into is shared by many tasks. Scores are computed anew from
the original vectors in double precision.

Copies of one vector inside a block are scored once: of equal vectors only the k + 1
smallest ids can be among k nearest with ties to the smaller id.

Edge cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows with a null id, or of a length other than the most common one;
rows that repeat an id are one row, that with the least vector, so no neighbour comes twice;
a query with fewer than k candidates gets all; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._shared import materialise

K, EVERY = 20, 20
#: Vectors that the partition is learned from, at most; neighbours in its graph; rows per part, aimed at; parts at most.
SAMPLE, GRAPH_K, PART_ROWS, PARTS = 8192, 10, 4000, 256
RECALL = 0.95
#: Rows of a block of a part, and of the queries that meet it. What is moved for a score falls with it.
BLOCK = 32768
SCHEMA = "query_id long, vec_id long, score double"


def graph(x, k: int):
    """Nearest neighbours by inner product, without the row itself, as an index array (n, k)."""
    import numpy as np

    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def split_graph(x, near, parts: int, sweeps: int = 12, slack: float = 1.05, seed: int = 7):
    """A part for each node: parts of about equal size with many edges inside.

    Starts from balanced median cuts along principal directions; then nodes move to
    the part where most of their neighbours are, as far as there is room.
    """
    import numpy as np

    n, rng = len(x), np.random.default_rng(seed)
    part = np.zeros(n, dtype=np.int64)
    cells = [np.arange(n)]
    while len(cells) < parts:
        cells.sort(key=len)
        big = cells.pop()
        axis = np.linalg.svd(x[big] - x[big].mean(0), full_matrices=False)[2][0]
        order = big[np.argsort(x[big] @ axis, kind="stable")]
        cells += [order[: len(order) // 2], order[len(order) // 2 :]]
    for p, cell in enumerate(cells):
        part[cell] = p
    room, sizes = int(np.ceil(n / parts * slack)), np.bincount(part, minlength=parts)
    back = [[] for _ in range(n)]
    for i, row in enumerate(near):
        for j in row:
            back[j].append(i)
    links = [np.concatenate([near[i], np.array(back[i], dtype=np.int64)]) for i in range(n)]
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[links[i]], minlength=parts)
            own = part[i]
            votes[(sizes >= room) & (np.arange(parts) != own)] = -1
            best = int(votes.argmax())
            if votes[best] > votes[own]:
                part[i], moved = best, moved + 1
                sizes[own] -= 1
                sizes[best] += 1
        if moved < n // 200:
            break
    return part


def classifier(x, near, part, parts: int, steps: int = 300, rate: float = 0.05):
    """Weights of a softmax regression on the share of each part among a row's neighbours and itself."""
    import numpy as np

    y = np.zeros((len(x), parts))
    np.add.at(y, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    y[np.arange(len(x)), part] += 1.0
    y /= y.sum(1, keepdims=True)
    z = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = (np.zeros((z.shape[1], parts)) for _ in range(3))
    for t in range(1, steps + 1):
        logits = z @ w
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ (p - y) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _logits(w, x):
    return x @ w[:-1] + w[-1]


def probes_for(x, w, k: int, recall: float):
    """Fewest parts to look at so that `recall` of the sample's true neighbours is found."""
    import numpy as np

    logits = _logits(w, x)
    home, rank = logits.argmax(1), np.argsort(np.argsort(-logits, axis=1, kind="stable"), axis=1)
    probe = np.arange(0, len(x), max(1, len(x) // 1000))
    s = x[probe] @ x.T
    s[np.arange(len(probe)), probe] = -np.inf
    top = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    need = np.sort(np.take_along_axis(rank[probe], home[top], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1


def fit(sample, rows: int, k: int = K, recall: float = RECALL):
    """Sample (n, d) of a table of so many rows -> (weights, number of parts to look at)."""
    import numpy as np

    parts = int(min(PARTS, max(8, rows // PART_ROWS), max(1, len(sample) // 50)))
    if parts == 1:
        return np.zeros((sample.shape[1] + 1, 1)), 1
    near = graph(sample, min(GRAPH_K, len(sample) - 1))
    w = classifier(sample, near, split_graph(sample, near, parts), parts)
    return w, probes_for(sample, w, k, recall)


def _matrix(column):
    import numpy as np

    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _assign(w):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_logits(w, _matrix(b.column(1))).argmax(1).astype("int32"))], names=["vec_id", "v", "part"])

    return run


def _route(w, probes: int, sizes: dict, least: int):
    """Query -> its most probable parts, `probes` of them or as many as hold `least` rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        count = np.array([sizes.get(p, 0) for p in range(w.shape[1])])
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-_logits(w, _matrix(b.column(1))), axis=1, kind="stable")
            enough = 1 + (np.cumsum(count[order], axis=1) < least).sum(1)
            n = np.minimum(np.maximum(probes, enough), w.shape[1])
            row = np.repeat(np.arange(len(n)), n)
            to = np.concatenate([order[i, :c] for i, c in enumerate(n)]).astype("int32")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(to)], names=["query_id", "q", "part"])

    return run


def _rerank(k: int):
    def run(vectors, queries):
        import numpy as np
        import pyarrow as pa

        out = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            ids, x = np.asarray(vectors["vec_id"]), _matrix(vectors["v"].combine_chunks())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            _, same = np.unique(x, axis=0, return_inverse=True)
            by = np.argsort(same.ravel(), kind="stable")
            s = same.ravel()[by]
            place = np.arange(len(s)) - np.searchsorted(s, s)
            keep = np.sort(by[place <= k])
            ids, x = ids[keep], x[keep]
            asked, q = np.asarray(queries["query_id"]), _matrix(queries["q"].combine_chunks())
            for a in range(0, len(q), 128):
                rough = q[a : a + 128] @ x.T
                cut = np.partition(rough, max(0, rough.shape[1] - k - 1), axis=1)[:, max(0, rough.shape[1] - k - 1)] if rough.shape[1] > k + 1 else np.full(len(rough), -np.inf)
                slack = 1e-9 * (1 + np.abs(cut))
                for i in range(len(rough)):
                    at = np.flatnonzero(rough[i] >= cut[i] - slack[i]) if np.isfinite(cut[i]) else np.arange(rough.shape[1])
                    at = at[ids[at] != asked[a + i]]
                    score = (x[at] * q[a + i]).sum(axis=1)  # row by row in the same order: equal vectors score equal
                    best = np.lexsort((ids[at], -score))[:k]
                    out[0].append(np.full(len(best), asked[a + i]))
                    out[1].append(ids[at][best])
                    out[2].append(score[best])
        cols = [np.concatenate(c) if c else np.array([], dtype=np.int64 if j < 2 else np.float64) for j, c in enumerate(out)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(good)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == F.lit(lengths.n if lengths else 0))


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_filter=None, k: int = K, recall: float = RECALL) -> DataFrame:
    """Nearest k of each query, a row that query_filter (default: id divisible by EVERY) takes: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    if not rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        rows = materialise(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The rows with the smallest digests: the same sample at any partitioning, bounded by SAMPLE.
    sample = rows.withColumn("_h", F.md5(F.col("vec_id").cast("string"))).orderBy("_h", "vec_id").limit(SAMPLE).select("v").toArrow()
    w, probes = fit(_matrix(sample["v"].combine_chunks()), n, k, recall)
    index = materialise(rows.mapInArrow(_assign(w), "vec_id long, v array<double>, part int"), "ann-index")
    sizes = {r.part: r.n for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per part
    blocks = F.expr("array(" + ",".join(str(-(-sizes.get(p, 0) // BLOCK)) for p in range(w.shape[1])) + ")")
    asked = rows.filter(query_filter if query_filter is not None else F.col("vec_id") % EVERY == 0)
    many = asked.count()
    routed = asked.mapInArrow(_route(w, probes, sizes, k + 1), "query_id long, q array<double>, part int")
    groups = max(1, -(-many * probes // w.shape[1] // BLOCK))
    queries = routed.withColumn("qb", F.pmod(F.hash("query_id"), F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("part")) - 1)))
    stored = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.greatest(F.get(blocks, F.col("part")), F.lit(1))).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = queries.filter(F.get(blocks, F.col("part")) > 0)
    near = stored.groupBy("part", "block", "qb").cogroup(queries.groupBy("part", "block", "qb")).applyInArrow(_rerank(k), SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
