"""Structure comparison on long-form points: (entry, idx, x, y, z).

Pairs are made inside an entry by an equi-join and aggregated at once; searches over
all points go through a grid of cells, so they are equi-joins too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import numeric

LDDT_THRESHOLDS = (0.5, 1.0, 2.0, 4.0)


def distance(a: str = "a", b: str = "b"):
    return F.sqrt(sum((F.pow(F.col(f"{a}_{c}") - F.col(f"{b}_{c}"), 2) for c in "xyz"), F.lit(0.0)))


def side(points: DataFrame, name: str, keys, extra=()) -> DataFrame:
    return points.select(*keys, F.col("idx").alias(f"{name}_idx"), *[F.col(c).alias(f"{name}_{c}") for c in (*"xyz", *extra)])


def pairs(points: DataFrame, keys=("entry",), least_gap: int = 1) -> DataFrame:
    """Each unordered pair of an entry's points once: keys, a_idx < b_idx, d."""
    return side(points, "a", keys).join(side(points, "b", keys), list(keys)).filter(F.col("b_idx") - F.col("a_idx") >= least_gap).withColumn("d", distance())


def two_model_pairs(points: DataFrame, keys=("entry",)) -> DataFrame:
    """Points with coordinates of two models (x, y, z and px, py, pz) -> pairs with d (first) and p (second model)."""
    extra = ("px", "py", "pz")
    p = F.sqrt(sum((F.pow(F.col(f"a_p{c}") - F.col(f"b_p{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return side(points, "a", keys, extra).join(side(points, "b", keys, extra), list(keys)).filter("a_idx < b_idx").withColumn("d", distance()).withColumn("p", p)


def drmsd(model_pairs: DataFrame, keys=("entry",)) -> DataFrame:
    """Root mean squared difference of the two distance matrices."""
    return model_pairs.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("d") - F.col("p"), 2))).alias("drmsd"))


def lddt(model_pairs: DataFrame, keys=("entry",), cutoff: float = 15.0, thresholds=LDDT_THRESHOLDS, eps: float = 1e-10) -> DataFrame:
    """Share of true distances under the cut-off kept within each threshold, averaged over thresholds. d is the truth."""
    near = F.col("d") < cutoff
    hit = sum((F.when(F.abs(F.col("d") - F.col("p")) < t, 1.0).otherwise(0.0) for t in thresholds), F.lit(0.0)) / len(thresholds)
    return model_pairs.groupBy(*keys).agg(((F.sum(F.when(near, hit).otherwise(0.0)) + eps) / (F.sum(F.when(near, 1.0).otherwise(0.0)) + eps)).alias("lddt"))


def lddt_per_point(model_pairs: DataFrame, keys=("entry",), cutoff: float = 15.0, thresholds=LDDT_THRESHOLDS, eps: float = 1e-10) -> DataFrame:
    both = model_pairs.select(*keys, F.col("a_idx").alias("idx"), "d", "p").unionByName(model_pairs.select(*keys, F.col("b_idx").alias("idx"), "d", "p"))
    return lddt(both, (*keys, "idx"), cutoff, thresholds, eps)


def rmsd(points: DataFrame, keys=("entry",)) -> DataFrame:
    """Root mean squared deviation of two models as they lie."""
    d2 = sum((F.pow(F.col(c) - F.col(f"p{c}"), 2) for c in "xyz"), F.lit(0.0))
    return points.groupBy(*keys).agg(F.sqrt(F.avg(d2)).alias("rmsd"), F.avg(F.sqrt(d2)).alias("mean_dist"))


def fixed_scores(points: DataFrame, keys=("entry",)) -> DataFrame:
    """TM-score and GDT of two models as they lie."""
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"p{c}"), 2) for c in "xyz"), F.lit(0.0)))
    rows = points.withColumn("_d", d).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    d0 = F.greatest(numeric.tm_d0(F.greatest(F.col("_n"), F.lit(19))), F.lit(0.5))
    share = lambda cuts: sum((F.avg(F.when(F.col("_d") <= t, 1.0).otherwise(0.0)) for t in cuts), F.lit(0.0)) / len(cuts)
    return rows.groupBy(*keys).agg(F.avg(1 / (1 + F.pow(F.col("_d") / d0, 2))).alias("tm"), share((1.0, 2.0, 4.0, 8.0)).alias("gdt_ts"), share((0.5, 1.0, 2.0, 4.0)).alias("gdt_ha"))


def aligned(points: DataFrame, keys=("entry",), weight: str | None = None, reflect: bool = False) -> DataFrame:
    """Best rigid superposition of the second model on the first: keys, n, rmsd_aligned.

    Centroids, the 3 x 3 covariance and the spread are sums; only one row of sums per
    entry reaches the singular value decomposition, never its points.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    p, q = ("x", "y", "z"), ("px", "py", "pz")
    sums = [F.sum(w).alias("w"), F.count("*").alias("n")]
    sums += [F.sum(w * F.col(c)).alias(f"s_{c}") for c in (*p, *q)] + [F.sum(w * F.col(c) * F.col(c)).alias(f"e_{c}") for c in (*p, *q)]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a in p for b in q]
    names = ["w", *[f"s_{c}" for c in (*p, *q)], *[f"e_{c}" for c in (*p, *q)], *[f"c_{a}_{b}" for a in p for b in q]]

    @F.pandas_udf("double")
    def fit(*cols):
        import numpy as np
        import pandas as pd

        v = {k: c.to_numpy() for k, c in zip(names, cols)}
        w = v["w"]
        h = np.stack([np.stack([v[f"c_{a}_{b}"] - v[f"s_{a}"] * v[f"s_{b}"] / w for b in q], -1) for a in p], -2)
        spread = sum(v[f"e_{c}"] - v[f"s_{c}"] ** 2 / w for c in (*p, *q))
        sigma = np.linalg.svd(h, compute_uv=False)
        if not reflect:
            sigma[:, 2] *= np.sign(np.linalg.det(h)) + (np.linalg.det(h) == 0)
        return pd.Series(np.sqrt(np.maximum(spread - 2 * sigma.sum(1), 0) / w))

    return points.groupBy(*keys).agg(*sums).withColumn("rmsd_aligned", fit(*names)).select(*keys, "n", "rmsd_aligned")


def steps(points: DataFrame, keys=("entry",)) -> DataFrame:
    """Distance of each point to the next in order (null at the end), and whether their indices are adjacent."""
    w = Window.partitionBy(*keys).orderBy("idx")
    d = F.sqrt(sum((F.pow(F.lead(c).over(w) - F.col(c), 2) for c in "xyz"), F.lit(0.0)))
    return points.withColumn("step", d).withColumn("adjacent", F.lead("idx").over(w) - F.col("idx") == 1)


def ring_steps(points: DataFrame, keys=("entry",)) -> DataFrame:
    """Distance of each point to the one before; the first wraps round to the last."""
    w = Window.partitionBy(*keys).orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    return points.withColumn("step", F.sqrt(sum((F.pow(F.col(c) - before(c), 2) for c in "xyz"), F.lit(0.0))))


def chain_geometry(points: DataFrame, keys=("entry",), bond: float = 3.80, tolerance: float = 0.1, clash: float = 1.0) -> DataFrame:
    """Bond deviation, share of valid bonds, and clashes of unordered pairs."""
    s = steps(points, keys).filter("step IS NOT NULL").groupBy(*keys).agg(F.avg(F.abs(F.col("step") - bond)).alias("bond_deviation"), F.avg(F.when(F.col("step") < bond + tolerance, 1.0).otherwise(0.0)).alias("bond_valid"))
    c = pairs(points, keys).groupBy(*keys).agg(F.sum(F.when(F.col("d") < clash, 1).otherwise(0)).alias("clashes"))
    return s.join(c, list(keys))


def radius_of_gyration(points: DataFrame, keys=("entry",)) -> DataFrame:
    r2 = sum((F.avg(F.col(c) * F.col(c)) - F.pow(F.avg(c), 2) for c in "xyz"), F.lit(0.0))
    return points.groupBy(*keys).agg(F.sqrt(r2).alias("rog"))


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All (l_id, r_id, d) within a radius, as an equi-join on grid cells.

    left: l_id, x, y, z; right: r_id, x, y, z. Each left point looks into the 27 cells
    round its own.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.sequence(F.lit(-1), F.lit(1))
    a = left.select("l_id", *[F.col(c).alias(f"a_{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    for c in "xyz":
        a = a.withColumn("_o", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_o")).drop("_o")
    b = right.select("r_id", *[F.col(c).alias(f"b_{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    return a.join(b, ["cx", "cy", "cz"]).withColumn("d", distance()).filter(F.col("d") <= radius).select("l_id", "r_id", "d")


def virtual_beta(n, ca, c):
    """Beta carbon from backbone points given as arrays [x, y, z]. The three constants are fixed values."""
    v = lambda a, b: F.array(*[F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(3)])
    b, d = v(ca, n), v(c, ca)
    cross = F.array(*[F.get(b, F.lit((i + 1) % 3)) * F.get(d, F.lit((i + 2) % 3)) - F.get(b, F.lit((i + 2) % 3)) * F.get(d, F.lit((i + 1) % 3)) for i in range(3)])
    return F.array(*[-0.58273431 * F.get(cross, F.lit(i)) + 0.56802827 * F.get(b, F.lit(i)) - 0.54067466 * F.get(d, F.lit(i)) + F.get(ca, F.lit(i)) for i in range(3)])


def _sub(a, b):
    return [x - y for x, y in zip(a, b)]


def _dot(a, b):
    return sum((x * y for x, y in zip(a, b)), F.lit(0.0))


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def angle(a, b, c):
    """Planar angle at b; points are lists of three columns."""
    u, v = _sub(a, b), _sub(c, b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(u, v) / F.sqrt(_dot(u, u) * _dot(v, v)))))


def dihedral(a, b, c, d):
    """Torsion about the bond b-c: the angle between the planes (a, b, c) and (b, c, d), signed by the triple product of the three bonds."""
    first, middle, last = _sub(b, a), _sub(c, b), _sub(d, c)
    plane, next_plane = _cross(first, middle), _cross(middle, last)
    return F.atan2(F.sqrt(_dot(middle, middle)) * _dot(first, next_plane), _dot(plane, next_plane))


def direction(v, floor: float = 0.0):
    """A vector over its length; `floor` is added to the squared length, so that a vector without one stays 0."""
    size = F.sqrt(_dot(v, v) + floor)
    return [x / size for x in v]


def frame(n, ca, c):
    """Rows of the local frame of a residue: x along ca-c, z normal to the plane of n, ca and c, and y = z cross x."""
    x = direction(_sub(c, ca), FRAME_FLOOR)
    z = direction(_cross(x, _sub(n, ca)), FRAME_FLOOR)
    return [x, _cross(z, x), z]


#: Fixed value: what a squared length gets added in a frame.
FRAME_FLOOR = 1e-8


def placed_atom(a, b, c, length: float, bond_angle: float, torsion: float):
    """An atom bound to c: `length` away, at `bond_angle` to the bond c-b, turned about that bond by `torsion` from a's side."""
    import math

    axis, toward = direction(_sub(b, c)), _sub(a, b)
    along = _dot(toward, axis)
    side = direction([t - along * x for t, x in zip(toward, axis)])
    turned = [math.cos(torsion) * s + math.sin(torsion) * q for s, q in zip(side, _cross(side, axis))]
    return [start + length * (math.cos(bond_angle) * x + math.sin(bond_angle) * t) for start, x, t in zip(c, axis, turned)]


def coordinates_6d(residues: DataFrame, most: float, keys=("entry",)) -> DataFrame:
    """Ordered pairs of residues whose beta carbons lie within `most`: keys, i, j, d, omega, theta, phi.

    residues: keys, idx, and n, ca, c as arrays [x, y, z]. Pairs are made inside an entry by an equi-join.
    """
    beta = residues.select(*keys, "idx", "n", "ca", virtual_beta(F.col("n"), F.col("ca"), F.col("c")).alias("cb"))
    one = beta.select(*keys, F.col("idx").alias("i"), *[F.col(x).alias(f"i_{x}") for x in ("n", "ca", "cb")])
    two = beta.select(*keys, F.col("idx").alias("j"), *[F.col(x).alias(f"j_{x}") for x in ("ca", "cb")])
    at = lambda x: [F.get(F.col(x), F.lit(k)) for k in range(3)]
    apart = _sub(at("i_cb"), at("j_cb"))
    near = one.join(two, list(keys)).filter("i <> j").withColumn("d", F.sqrt(_dot(apart, apart))).filter(F.col("d") <= most)
    omega = dihedral(at("i_ca"), at("i_cb"), at("j_cb"), at("j_ca"))
    theta = dihedral(at("i_n"), at("i_ca"), at("i_cb"), at("j_cb"))
    return near.select(*keys, "i", "j", "d", omega.alias("omega"), theta.alias("theta"), angle(at("i_ca"), at("i_cb"), at("j_cb")).alias("phi"))


def chain_means(points: DataFrame, chain: str = "chain", keys=("entry",)) -> DataFrame:
    """Mean over an entry's chains of TM-score and deviation as they lie, and deviation after each chain is superposed."""
    by = [*keys, chain]
    scores = fixed_scores(points, by).join(rmsd(points, by), by).join(aligned(points, by), by)
    return scores.groupBy(*keys).agg(F.count("*").alias("chains"), F.avg("tm").alias("tm"), F.avg("rmsd").alias("rmsd"), F.avg("rmsd_aligned").alias("rmsd_aligned"))


def contact_precision(scored: DataFrame, keys, score: str, hit: str, length: str, gap: str, bands=None) -> DataFrame:
    """Precision of the best L, L/2, L/5 scored pairs of each entry and separation band, and the mean over ten cut points."""
    bands = bands or {"local": (3, 6), "short": (6, 12), "medium": (12, 24), "long": (24, None)}
    band = None
    for name, (lo, hi) in bands.items():
        inside = (F.col(gap) >= lo) & ((F.col(gap) < hi) if hi else F.lit(True))
        band = F.when(inside, name) if band is None else band.when(inside, name)
    w = Window.partitionBy(*keys, "band").orderBy(F.desc(score), "a_idx", "b_idx")
    ranked = scored.withColumn("band", band).filter("band IS NOT NULL").withColumn("_r", F.row_number().over(w))
    at = lambda share: F.avg(F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col(length) * share)), F.col(hit).cast("double")))
    auc = sum((at(i / 10) for i in range(1, 11)), F.lit(0.0)) / 10
    return ranked.groupBy(*keys, "band").agg(at(1.0).alias("p_l"), at(0.5).alias("p_l2"), at(0.2).alias("p_l5"), auc.alias("auc"))


def best_permutation(candidates: DataFrame, keys, perm: str, deviation: str) -> DataFrame:
    """The permutation of least deviation per group; ties go to the smaller number, which is the identity."""
    return candidates.groupBy(*keys).agg(F.min_by(perm, F.struct(deviation, perm)).alias(perm), F.min(deviation).alias(deviation))


def valid_permutation(df: DataFrame, keys, place: str) -> DataFrame:
    """Whether each group's places are 0 .. n-1, each once."""
    return df.groupBy(*keys).agg(((F.countDistinct(place) == F.count("*")) & (F.max(place) == F.count("*") - 1) & (F.min(place) == 0)).alias("valid"))


def greedy_chain_match(pred: DataFrame, true: DataFrame, keys=("entry",)) -> DataFrame:
    """Predicted to true chains of one complex: (keys, pred, length, p) and (keys, true, t) -> keys, pred, true; longest first, nearest first, each once.

    p and t are arrays of equal size, compared by squared distance. A group is one complex;
    its task holds the chains but not their pairs: each predicted chain queues with its
    nearest free true chain, and queues again if that one is taken before its turn.
    """
    schema = ", ".join([*(f"{k} {dict(pred.dtypes)[k]}" for k in keys), f"pred {dict(pred.dtypes)['pred']}", f"true {dict(true.dtypes)['true']}"])

    def match(g, h):
        import heapq

        import numpy as np

        if g.empty or h.empty:
            return g.assign(true=None).iloc[:0][[*keys, "pred", "true"]]
        g, h = g.sort_values("pred").reset_index(drop=True), h.sort_values("true").reset_index(drop=True)
        p, t = np.stack(g["p"].to_list()), np.stack(h["t"].to_list())
        free, rows = np.ones(len(h), bool), []

        def nearest(i):
            at = np.flatnonzero(free)
            d = np.zeros(len(at))
            for k in range(p.shape[1]):  # in order, as a fold adds
                d += (p[i, k] - t[at, k]) ** 2
            d[np.isnan(d)] = np.inf
            j = int(d.argmin())
            return -g["length"][i], float(d[j]), i, int(at[j])

        queue = [nearest(i) for i in range(len(g))]
        heapq.heapify(queue)
        while queue and len(rows) < len(h):
            _, _, i, j = heapq.heappop(queue)
            if free[j]:
                free[j] = False
                rows.append((i, j))
            else:
                heapq.heappush(queue, nearest(i))
        out = g.iloc[[i for i, _ in rows]].reset_index(drop=True)
        return out.assign(true=h["true"].iloc[[j for _, j in rows]].to_numpy())[[*keys, "pred", "true"]]

    return pred.groupBy(*keys).cogroup(true.groupBy(*keys)).applyInPandas(match, schema)


def transforms(points: DataFrame, keys=("entry",), mask: str | None = None) -> DataFrame:
    """Rotation (row by row) and translation that lay the second model on the first, fitted where mask holds: keys, m (12 numbers)."""
    w = F.when(F.col(mask), 1.0).otherwise(0.0) if mask else F.lit(1.0)
    p, q = ("x", "y", "z"), ("px", "py", "pz")
    sums = [F.sum(w).alias("w")] + [F.sum(w * F.col(c)).alias(f"s_{c}") for c in (*p, *q)] + [F.sum(w * F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a in p for b in q]
    names = ["w", *[f"s_{c}" for c in (*p, *q)], *[f"c_{a}_{b}" for a in p for b in q]]

    @F.pandas_udf("array<double>")
    def fit(*cols):
        import numpy as np
        import pandas as pd

        v = {k: c.to_numpy() for k, c in zip(names, cols)}
        n = np.maximum(v["w"], 1)
        mp, mq = (np.stack([v[f"s_{c}"] / n for c in side], -1) for side in (p, q))
        h = np.stack([np.stack([v[f"c_{a}_{b}"] - v[f"s_{a}"] * v[f"s_{b}"] / n for b in q], -1) for a in p], -2)
        u, _, vt = np.linalg.svd(h)
        u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
        rot = u @ vt
        shift = mp - np.einsum("nij,nj->ni", rot, mq)
        return pd.Series(list(np.concatenate([rot.reshape(-1, 9), shift], axis=1)))

    return points.groupBy(*keys).agg(*sums).select(*keys, fit(*names).alias("m"))


def pocket_rmsd(points: DataFrame, pocket: str, ligand: str, keys=("entry",)) -> DataFrame:
    """Deviation of the ligand after the models are superposed on the pocket."""
    moved = points.join(transforms(points, keys, pocket), list(keys))
    at = lambda r: sum((F.get("m", F.lit(3 * r + i)) * F.col(c) for i, c in enumerate(("px", "py", "pz"))), F.get("m", F.lit(9 + r)))
    d2 = sum((F.pow(F.col(c) - at(r), 2) for r, c in enumerate("xyz")), F.lit(0.0))
    return moved.filter(F.col(ligand)).groupBy(*keys).agg(F.sqrt(F.avg(d2)).alias("pocket_rmsd"))


def patches(points: DataFrame, size: int, keys=("entry",), scale: float = 1.0) -> DataFrame:
    """Matrix of difference vectors of an entry's points over `scale`, in patches of size x size: keys, i, j, cells.

    cells: [dx, dy, dz] row by row; points are numbered by idx from 0, and places up to the next multiple of `size` hold zeros.
    Pairs are made inside an entry and go straight into their patch.
    """
    apart = F.array(*[(F.col(f"a_{c}") - F.col(f"b_{c}")) / scale for c in "xyz"])
    met = side(points, "a", keys).join(side(points, "b", keys), list(keys))
    at = lambda s: F.floor(F.col(f"{s}_idx") / size).cast("int")
    cell = ((F.col("a_idx") % size) * size + F.col("b_idx") % size).cast("int")
    found = met.groupBy(*keys, at("a").alias("i"), at("b").alias("j")).agg(F.map_from_entries(F.collect_list(F.struct(cell, apart))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda c: F.coalesce(F.try_element_at("_m", c), F.array(*[F.lit(0.0)] * 3)))
    return found.select(*keys, "i", "j", every.alias("cells"))
