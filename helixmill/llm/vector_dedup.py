"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

1. Vectors are scaled to length one; those that become equal are one class, so a hot
   vector costs one row.
2. Spherical k-means on a bounded sample (the classes with the smallest digests) gives
   centroids, one for about CELL classes. Every class lives in the cell of its nearest
   centroid, and visits each cell of a smaller number in which a vector close enough may
   live: one on the other side of the plane between two centroids, and not beyond the
   cell's farthest member. Both bounds are exact, so no link is lost at a border.
3. A cell is cut into blocks of BLOCK_BYTES; a task multiplies two blocks, strip by
   strip, and gives back each vector's number of links and a spanning forest of the
   links, never the pairs themselves.
4. Components of the forests' edges; the smallest vec_id of each represents it.

Where vectors form clusters, few cells are visited. Where they point everywhere alike,
all cells are, and the work is that of comparing all classes, in blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, and neither do vectors of different lengths; each row is a vector of its own,
also where vec_ids repeat (all rows with the representative's id are kept); a row without
a vec_id links with nothing and is kept; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._shared import join_skewed, materialise, release, small, trim
from helixmill.llm.minhash import components

COSINE = 0.9
#: Bounds of the sample that cells are fitted on: rows, bytes, lengths of vectors that get cells of their own.
SAMPLE, SAMPLE_BYTES, LENGTHS = 8192, 32 << 20, 4
#: Classes that a cell should hold, and the most cells of a sample's rows.
CELL, ROWS_A_CELL = 4096, 16
#: Bytes of vectors in a block, and rows of a strip of its product.
BLOCK_BYTES, STRIP = 2 << 20, 256
ROUNDS = 12
#: What rounding may move a bound by.
SLACK = 1e-9
RESULT = "vec_id long, n_links long, component_id long, kept boolean"


def _units(batches):
    """(vec_id, vector) -> (vec_id, unit, key); unit is null where the vector takes no part."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    for batch in batches:
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        there = ~np.asarray(lists.is_null())
        sizes = np.where(there, np.diff(offsets), 0)
        units, keys = [None] * len(lists), [None] * len(lists)
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            for lo in range(0, len(rows), max(1, BLOCK_BYTES // (8 * int(size)))):
                some = rows[lo : lo + max(1, BLOCK_BYTES // (8 * int(size)))]
                x = values[offsets[some][:, None] + np.arange(size)]
                top = np.abs(x).max(axis=1)
                fine = np.isfinite(top) & (top > 0)
                x = x[fine] / top[fine][:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0
                for i, u in zip(some[fine], x):
                    units[i] = u.tobytes()
                    keys[i] = xxhash.xxh3_128_digest(units[i])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "unit", "key"])
    trim()


def _matrix(units):
    """Binary column of equally long units -> matrix."""
    import numpy as np

    rows = units.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def fit(sample, cells: int, rounds: int = ROUNDS):
    """Centroids, unit rows, of spherical k-means."""
    import numpy as np

    at = np.random.default_rng(len(sample)).choice(len(sample), cells, replace=False)
    centres = sample[np.sort(at)].copy()
    for _ in range(rounds):
        near = sample @ centres.T
        of, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        empty = length < 1e-12
        sums[empty], length[empty] = sample[np.argsort(best)[: empty.sum()]], 1.0  # an empty cell goes to a vector far from its own
        centres = sums / length[:, None]
    return centres


def _by_length(batch):
    """(length, its rows' positions, matrix) of a batch with a unit column."""
    import numpy as np
    import pyarrow.compute as pc

    units = batch.column("unit")
    sizes = np.asarray(pc.binary_length(units)) // 8
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, _matrix(units.take(rows))


def _home(x, centres):
    if centres is None:
        import numpy as np

        return np.zeros(len(x), dtype=np.int64), np.ones(len(x)), None
    near = x @ centres.T
    return near.argmax(axis=1), near.max(axis=1), near


def _farthest(centres: dict):
    """(size, cell, n, least cosine to the centroid), a row per batch and cell."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for size, _, x in _by_length(batch):
                if size in centres:
                    home, best, _ = _home(x, centres[size])
                    for c in np.unique(home):
                        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([c], pa.int32()), pa.array([best[home == c].min()])], names=["size", "cell", "least"])

    return run


def _placed(centres: dict, least: dict, cosine: float):
    """(node, m, unit) -> (node, m, unit, size, cell, home): a row for each cell that a class lives in or visits."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for size, rows, x in _by_length(batch):
                c = centres.get(size)
                home, _, near = _home(x, c)
                at, cell, own = [np.arange(len(x))], [home], [np.ones(len(x), dtype=bool)]
                if c is not None and len(c) > 1:
                    apart = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 0))
                    reach = np.cos(np.minimum(np.arccos(np.clip(least[size], -1, 1)) + math.acos(cosine), math.pi))
                    lead = near[np.arange(len(x)), home][:, None] - near
                    visits = (lead <= math.sqrt(1 - cosine * cosine) * apart[home] + SLACK) & (near >= reach - SLACK) & (np.arange(len(c)) < home[:, None])
                    i, j = np.nonzero(visits)
                    at, cell, own = [*at, i], [*cell, j], [*own, np.zeros(len(i), dtype=bool)]
                at, cell, own = (np.concatenate(v) for v in (at, cell, own))
                whole = pa.Table.from_batches([batch]).select(["node", "m", "unit"])
                for lo in range(0, len(at), 8192):
                    part = whole.take(rows[at[lo : lo + 8192]])
                    part = part.append_column("size", pa.array(np.full(len(part), size, dtype=np.int32))).append_column("cell", pa.array(cell[lo : lo + 8192].astype(np.int32))).append_column("home", pa.array(own[lo : lo + 8192]))
                    yield from part.combine_chunks().to_batches()
        trim()

    return run


def _multiply(cosine: float):
    """Two blocks -> (a, null, links) of vectors with links, and (a, b, 0) edges of a spanning forest."""

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        first = table.slice(0, 1).to_pylist()[0]
        alone = not first["visit"] and first["rb"] == first["ob"]
        table = table.combine_chunks()
        left = table.filter(pc.equal(table["side"], 0))
        right = left if alone else table.filter(pc.equal(table["side"], 1))
        edges_a, edges_b, nodes, links = [], [], [], []
        if len(left) and len(right):
            x, y = _matrix(left["unit"]), _matrix(right["unit"])
            a, b = np.asarray(left["node"]), np.asarray(right["node"])
            m, n = np.asarray(left["m"]), np.asarray(right["m"])
            of_left, of_right = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            group = np.arange(len(b))
            for lo in range(0, len(a), STRIP):
                near = x[lo : lo + STRIP] @ y.T >= cosine
                if alone:
                    near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
                for i in np.flatnonzero(near.any(axis=1)):
                    js = np.flatnonzero(near[i])
                    of_left[lo + i] = n[js].sum()
                    of_right[js] += m[lo + i]
                    if alone:  # its own group, too; one group already is joined
                        js = np.append(js, lo + i)
                    found, at = np.unique(group[js], return_index=True)
                    if alone and len(found) == 1:
                        continue
                    edges_a += [a[lo + i]] * len(found)
                    edges_b += b[js[at]].tolist()
                    if len(found) > 1:
                        group[np.isin(group, found)] = found[0]
            nodes, links = (a, of_left) if alone else (np.concatenate([a, b]), np.concatenate([of_left, of_right]))
            nodes, links = nodes[links > 0], links[links > 0]
        k, e = len(nodes), len(edges_a)
        return pa.table(
            {"a": pa.array([*nodes, *edges_a], pa.int64()), "b": pa.array([None] * k + edges_b, pa.int64()), "links": pa.array([*links, *[0] * e], pa.int64())}
        )

    return run


def _blocked(members: DataFrame) -> DataFrame:
    """members copied to the tasks that need them: (size, cell, visit, rb, ob, side, node, m, unit).

    Task (rb, ob): residents of block rb against residents of a later block ob, or (visit)
    against visitors of block ob.
    """
    blocks = lambda n: F.ceil(F.col(n) * 8 * F.col("size") / BLOCK_BYTES).cast("int")
    cells = members.groupBy("size", "cell").agg(F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_visit"))
    cells = materialise(cells.filter("n_home > 0").select("size", "cell", blocks("n_home").alias("homes"), blocks("n_visit").alias("visits")), "vectors-cells")
    rows = members.join(small(cells), ["size", "cell"])
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int")
    rows = rows.withColumn("mine", mine)

    def upto(lo, hi, task):
        return F.when(hi > lo, F.transform(F.sequence(lo, F.greatest(hi - 1, lo)), task)).otherwise(F.array().cast("array<struct<visit:boolean,rb:int,ob:int,side:int>>"))

    def task(visit, rb, ob, side):
        return F.struct(F.lit(visit).alias("visit"), rb.alias("rb"), ob.alias("ob"), F.lit(side).alias("side"))

    zero, at = F.lit(0), F.col("mine")
    resident = F.concat(upto(at, F.col("homes"), lambda i: task(False, at, i, 0)), upto(zero, at, lambda i: task(False, i, at, 1)), upto(zero, F.col("visits"), lambda i: task(True, at, i, 0)))
    visitor = upto(zero, F.col("homes"), lambda i: task(True, i, at, 1))
    return rows.withColumn("t", F.explode(F.when(F.col("home"), resident).otherwise(visitor))).select("size", "cell", "t.*", "node", "m", "unit")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """One row per row of vectors: see RESULT. cosine: over 0, up to 1."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    units = materialise(rows.mapInArrow(_units, "vec_id long, unit binary, key binary"), "vectors-units")
    linked = units.filter("unit IS NOT NULL AND vec_id IS NOT NULL")
    classes = linked.groupBy("key", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "vectors-classes")

    size = (F.length("unit") / 8).cast("int").alias("size")
    centres, least = {}, {}
    for r in classes.groupBy(size).count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect():
        most = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * r["size"])))
        cells = min(-(-r["count"] // cell), max(1, min(most, r["count"]) // ROWS_A_CELL))
        if cells > 1:
            sample = classes.filter(F.length("unit") == 8 * r["size"]).orderBy("key").select("unit").limit(most).toArrow()
            centres[r["size"]] = fit(_matrix(sample["unit"]), cells)
            least[r["size"]] = [1.0] * cells
    if centres:
        for r in classes.select("unit").mapInArrow(_farthest(centres), "size int, cell int, least double").groupBy("size", "cell").agg(F.min("least").alias("least")).collect():  # a row a cell
            least[r["size"]][r["cell"]] = r["least"]

    members = materialise(classes.select("node", "m", "unit").mapInArrow(_placed(centres, least, cosine), "node long, m long, unit binary, size int, cell int, home boolean"), "vectors-members")
    tasks = _blocked(members).groupBy("size", "cell", "visit", "rb", "ob")
    found = materialise(tasks.applyInArrow(_multiply(cosine), "a long, b long, links long"), "vectors-found")
    release(members)
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("b IS NOT NULL").select("a", "b"))
    placed = classes.select("key", "least", "m", "node").join(links, "node", "left").join(joined, F.col("node") == F.col("id"), "left")
    placed = materialise(placed.select("key", "least", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vectors-linked")
    groups = materialise(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "vectors-groups")
    done = materialise(join_skewed(placed, groups, "component", "n", placed.count()).select("key", "m", "n_links", "component_id"), "vectors-done")
    out = join_skewed(linked.select("vec_id", "key"), done, "key", "m", linked.count()).select("vec_id", "n_links", "component_id")
    apart = units.filter("unit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vectors without those that another represents."""
    gone = materialise(near_duplicates(vectors, id_col, vector_col, cosine).filter("NOT kept").select(F.col("vec_id").alias("_gone")).distinct(), "vectors-gone")
    return vectors.join(small(gone), vectors[id_col] == gone["_gone"], "left_anti")
