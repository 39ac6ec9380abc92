"""Structure comparison over embeddings read as chains of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import chains, violations
from helixmill.operators import geometry as G
from helixmill.plans.registry import MODELS, POINTS, R, models, points, query, r6, table

PAIRS = POINTS + ", pairs AS (SELECT a.entry, a.idx AS a_idx, b.idx AS b_idx, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM points a JOIN points b ON a.entry = b.entry AND a.idx < b.idx)"
MPAIRS = MODELS + ", mp AS (SELECT a.entry, a.idx AS a_idx, b.idx AS b_idx, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2)) AS p FROM models a JOIN models b ON a.entry = b.entry AND a.idx < b.idx)"
LDDT = "((CASE WHEN abs(d - p) < 0.5 THEN 1 ELSE 0 END + CASE WHEN abs(d - p) < 1 THEN 1 ELSE 0 END + CASE WHEN abs(d - p) < 2 THEN 1 ELSE 0 END + CASE WHEN abs(d - p) < 4 THEN 1 ELSE 0 END) / 4.0)"


@query("JON06 FN32", f"WITH {PAIRS} SELECT entry, count(*) AS n, {R('avg(d)')} AS mean_d, {R('max(d)')} AS max_d FROM pairs WHERE b_idx - a_idx >= 3 GROUP BY entry")
def pair_distances(spark, d):
    return G.pairs(points(spark, d), least_gap=3).groupBy("entry").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_d"), r6(F.max("d")).alias("max_d"))


@query("MET04", f"WITH {MPAIRS} SELECT entry, {R('sqrt(avg(pow(d - p, 2)))')} AS drmsd FROM mp GROUP BY entry")
def drmsd(spark, d):
    return G.drmsd(G.two_model_pairs(models(spark, d))).select("entry", r6("drmsd").alias("drmsd"))


@query("MET05", f"WITH {MPAIRS} SELECT entry, {R(f'(sum(CASE WHEN d < 4 THEN {LDDT} ELSE 0 END) + 1e-10) / (sum(CASE WHEN d < 4 THEN 1 ELSE 0 END) + 1e-10)')} AS lddt FROM mp GROUP BY entry")
def lddt(spark, d):
    return G.lddt(G.two_model_pairs(models(spark, d)), cutoff=4.0).select("entry", r6("lddt").alias("lddt"))


@query("MET05", f"WITH {MPAIRS}, u AS (SELECT entry, a_idx AS idx, d, p FROM mp UNION ALL SELECT entry, b_idx, d, p FROM mp) SELECT entry, idx, {R(f'(sum(CASE WHEN d < 4 THEN {LDDT} ELSE 0 END) + 1e-10) / (sum(CASE WHEN d < 4 THEN 1 ELSE 0 END) + 1e-10)')} AS lddt FROM u GROUP BY entry, idx")
def lddt_per_residue(spark, d):
    return G.lddt_per_point(G.two_model_pairs(models(spark, d)), cutoff=4.0).select("entry", "idx", r6("lddt").alias("lddt"))


@query("MET01", f"WITH {MODELS}, q AS (SELECT entry, pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2) AS d2 FROM models) SELECT entry, {R('sqrt(avg(d2))')} AS rmsd, {R('avg(sqrt(d2))')} AS mean_dist FROM q GROUP BY entry")
def rmsd_unaligned(spark, d):
    return G.rmsd(models(spark, d)).select("entry", r6("rmsd").alias("rmsd"), r6("mean_dist").alias("mean_dist"))


@query("MET02 MET03")
def rmsd_aligned(spark, d):
    return G.aligned(models(spark, d)).select("entry", "n", r6("rmsd_aligned").alias("rmsd_aligned"))


@query(
    "MET06 MET08",
    f"WITH {MODELS}, q AS (SELECT entry, sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)) AS d FROM models), s AS (SELECT entry, d, greatest(1.24 * cbrt(CAST(greatest(count(*) OVER (PARTITION BY entry), 19) - 15 AS DOUBLE)) - 1.8, 0.5) AS d0 FROM q) "
    f"SELECT entry, {R('avg(1 / (1 + pow(d / d0, 2)))')} AS tm, {R('(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0 END) + avg(CASE WHEN d <= 2 THEN 1.0 ELSE 0 END) + avg(CASE WHEN d <= 4 THEN 1.0 ELSE 0 END) + avg(CASE WHEN d <= 8 THEN 1.0 ELSE 0 END)) / 4')} AS gdt_ts FROM s GROUP BY entry",
)
def fixed_superposition_scores(spark, d):
    return G.fixed_scores(models(spark, d)).select("entry", r6("tm").alias("tm"), r6("gdt_ts").alias("gdt_ts"))


@query(
    "MET09 WIN03",
    f"WITH {PAIRS}, s AS (SELECT entry, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2) + pow(lead(z) OVER w - z, 2)) AS st FROM points WINDOW w AS (PARTITION BY entry ORDER BY idx)), b AS (SELECT entry, avg(abs(st - 3.8)) AS dev, avg(CASE WHEN st < 3.9 THEN 1.0 ELSE 0 END) AS ok FROM s WHERE st IS NOT NULL GROUP BY entry), c AS (SELECT entry, CAST(sum(CASE WHEN d < 1 THEN 1 ELSE 0 END) AS BIGINT) AS clashes FROM pairs GROUP BY entry) "
    f"SELECT b.entry, {R('dev')} AS bond_deviation, {R('ok')} AS bond_valid, clashes FROM b JOIN c ON b.entry = c.entry",
)
def ca_bond_geometry(spark, d):
    return G.chain_geometry(points(spark, d)).select("entry", r6("bond_deviation").alias("bond_deviation"), r6("bond_valid").alias("bond_valid"), "clashes")


@query(
    "WIN04 MET14",
    f"WITH {POINTS}, s AS (SELECT entry, sqrt(pow(x - coalesce(lag(x) OVER w, last_value(x) OVER v), 2) + pow(y - coalesce(lag(y) OVER w, last_value(y) OVER v), 2) + pow(z - coalesce(lag(z) OVER w, last_value(z) OVER v), 2)) AS st FROM points WINDOW w AS (PARTITION BY entry ORDER BY idx), v AS (PARTITION BY entry ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT entry, {R('stddev_pop(st)')} AS symmetry FROM s GROUP BY entry",
)
def symmetry_ring(spark, d):
    return G.ring_steps(points(spark, d)).groupBy("entry").agg(r6(F.stddev_pop("step")).alias("symmetry"))


@query("PRJ08", f"WITH {POINTS} SELECT entry, {R('sqrt(var_pop(x) + var_pop(y) + var_pop(z))')} AS rog FROM points GROUP BY entry")
def radius_of_gyration(spark, d):
    return G.radius_of_gyration(points(spark, d)).select("entry", r6("rog").alias("rog"))


@query(
    "JON07",
    f"WITH {POINTS} SELECT count(*) AS n, {R('sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)))')} AS total FROM points a JOIN points b ON a.idx = 0 AND b.idx = 20 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.5",
)
def radius_join(spark, d):
    p = points(spark, d)
    near = G.radius_join(p.filter("idx = 0").withColumnRenamed("entry", "l_id"), p.filter("idx = 20").withColumnRenamed("entry", "r_id"), 0.5)
    return near.agg(F.count("*").alias("n"), r6(F.coalesce(F.sum("d"), F.lit(0.0))).alias("total"))


@query(
    "WIN06",
    f"""WITH {MPAIRS}, s AS (SELECT *, CASE WHEN b_idx - a_idx BETWEEN 3 AND 5 THEN 'local' WHEN b_idx - a_idx BETWEEN 6 AND 11 THEN 'short' WHEN b_idx - a_idx >= 12 THEN 'medium' END AS band FROM mp WHERE b_idx - a_idx >= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY entry, band ORDER BY -round(p, 9) DESC, a_idx, b_idx) AS rn FROM s)
    SELECT entry, band, {R('avg(CASE WHEN rn <= 21 THEN CASE WHEN d < 2 THEN 1.0 ELSE 0 END END)')} AS p_l, {R('avg(CASE WHEN rn <= 10 THEN CASE WHEN d < 2 THEN 1.0 ELSE 0 END END)')} AS p_l2, {R('avg(CASE WHEN rn <= 4 THEN CASE WHEN d < 2 THEN 1.0 ELSE 0 END END)')} AS p_l5 FROM r GROUP BY entry, band""",
)
def contact_precision(spark, d):
    rows = G.two_model_pairs(models(spark, d)).withColumn("gap", F.col("b_idx") - F.col("a_idx")).withColumn("score", -F.round("p", 9)).withColumn("hit", F.col("d") < 2).withColumn("len", F.lit(21))
    out = G.contact_precision(rows, ["entry"], "score", "hit", "len", "gap")
    return out.select("entry", "band", *[r6(c).alias(c) for c in ("p_l", "p_l2", "p_l5")])


@query("FN37", f"WITH {POINTS}, w AS (SELECT entry, max(CASE WHEN idx=0 THEN x END) ax, max(CASE WHEN idx=0 THEN y END) ay, max(CASE WHEN idx=0 THEN z END) az, max(CASE WHEN idx=1 THEN x END) bx, max(CASE WHEN idx=1 THEN y END) by_, max(CASE WHEN idx=1 THEN z END) bz, max(CASE WHEN idx=2 THEN x END) cx, max(CASE WHEN idx=2 THEN y END) cy, max(CASE WHEN idx=2 THEN z END) cz FROM points GROUP BY entry), v AS (SELECT entry, ax-bx ux, ay-by_ uy, az-bz uz, cx-bx vx, cy-by_ vy, cz-bz vz FROM w) SELECT entry, {R('acos(greatest(-1, least(1, (ux*vx+uy*vy+uz*vz)/sqrt((ux*ux+uy*uy+uz*uz)*(vx*vx+vy*vy+vz*vz)))))')} AS angle FROM v")
def planar_angles(spark, d):
    rows = points(spark, d).filter("idx < 4").groupBy("entry").agg(*[F.max(F.when(F.col("idx") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in "xyz"])
    at = lambda i: [F.col(f"{c}{i}") for c in "xyz"]
    return rows.select("entry", r6(G.angle(at(0), at(1), at(2))).alias("angle"))


@query("FN36 FN37")
def backbone_angles(spark, d):
    rows = points(spark, d).filter("idx < 4").groupBy("entry").agg(*[F.max(F.when(F.col("idx") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in "xyz"])
    at = lambda i: [F.col(f"{c}{i}") for c in "xyz"]
    beta = G.virtual_beta(*[F.array(*at(i)) for i in range(3)])
    return rows.select("entry", r6(G.dihedral(*[at(i) for i in range(4)])).alias("dihedral"), *[r6(F.get(beta, F.lit(i))).alias(f"beta_{c}") for i, c in enumerate("xyz")])


@query(
    "MET15",
    f"""WITH {MODELS}, perm AS (SELECT unnest([0, 1, 2]) AS perm), s AS (SELECT m.entry, p.perm, sqrt(avg(pow(m.x - o.px, 2) + pow(m.y - o.py, 2) + pow(m.z - o.pz, 2))) AS dev FROM models m, perm p JOIN models o ON o.entry = m.entry AND o.idx = (m.idx + p.perm) % 21 GROUP BY ALL)
    SELECT entry, arg_min(perm, (round(dev, 9), perm)) AS perm, {R('min(round(dev, 9))')} AS dev FROM s GROUP BY entry""",
)
def permutation_best(spark, d):
    m = models(spark, d)
    moved = m.select("entry", F.col("idx").alias("j"), "px", "py", "pz")
    rows = m.select("entry", "idx", "x", "y", "z", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("perm")).withColumn("j", ((F.col("idx") + F.col("perm")) % 21).cast("int")).join(moved, ["entry", "j"])
    dev = rows.groupBy("entry", "perm").agg(F.round(F.sqrt(F.avg(sum((F.pow(F.col(c) - F.col(f"p{c}"), 2) for c in "xyz"), F.lit(0.0)))), 9).alias("dev"))
    return G.best_permutation(dev, ["entry"], "perm", "dev").select("entry", "perm", r6("dev").alias("dev"))


@query("MET16")
def chain_matching(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    a = e.filter("vec_id % 2 = 0").select("label", F.col("vec_id").alias("pred"), F.size("e").alias("length"), F.col("e").alias("p"))
    b = e.filter("vec_id % 2 = 1").select("label", F.col("vec_id").alias("true"), F.col("e").alias("t"))
    return G.greedy_chain_match(a, b, ("label",))


#: Complexes of four vectors, a chain each; the truth is the next chain of the complex, mixed with a tenth of its own points.
COMPLEX = f"{POINTS}, pred AS (SELECT entry // 4 AS k, entry % 4 AS chain, idx, x, y, z FROM points), truth AS (SELECT a.k, a.chain, a.idx, 0.9 * b.x + 0.1 * a.x AS x, 0.9 * b.y + 0.1 * a.y AS y, 0.9 * b.z + 0.1 * a.z AS z FROM pred a JOIN pred b ON b.k = a.k AND b.chain = (a.chain + 1) % 4 AND b.idx = a.idx)"
APART = "sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2))"


def _complexes(spark, d):
    one = points(spark, d).select(F.floor(F.col("entry") / 4).alias("k"), (F.col("entry") % 4).alias("chain"), "idx", *[F.col(c).alias(c) for c in "xyz"])
    two = one.select("k", ((F.col("chain") + 3) % 4).alias("chain"), "idx", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    true = one.join(two, ["k", "chain", "idx"]).select("k", "chain", "idx", *[(0.9 * F.col(f"n{c}") + 0.1 * F.col(c)).alias(c) for c in "xyz"])
    return one.withColumn("entity", F.lit(0)), true.withColumn("entity", F.lit(0))


@query(
    "MET17",
    f"""WITH {COMPLEX}, t AS (SELECT p.k, p.chain AS a, q.chain AS b, p.idx AS r, q.idx AS s, {APART} AS d FROM truth p JOIN truth q ON p.k = q.k AND p.chain <= q.chain AND (p.chain < q.chain OR p.idx < q.idx)),
    m AS (SELECT p.k, p.chain AS i, q.chain AS j, p.idx AS r, q.idx AS s, {APART} AS d FROM pred p JOIN pred q ON p.k = q.k AND (p.chain <> q.chain OR p.idx < q.idx)),
    c AS (SELECT t.k, a, b, i, j, sum(CASE WHEN abs(t.d - m.d) < 0.5 THEN 1 ELSE 0 END + CASE WHEN abs(t.d - m.d) < 1 THEN 1 ELSE 0 END + CASE WHEN abs(t.d - m.d) < 2 THEN 1 ELSE 0 END + CASE WHEN abs(t.d - m.d) < 4 THEN 1 ELSE 0 END) / 4 AS kept, count(*) AS n
      FROM t JOIN m ON t.k = m.k AND t.r = m.r AND t.s = m.s AND (a = b) = (i = j) WHERE t.d < 15 GROUP BY ALL),
    four AS (SELECT k FROM pred GROUP BY k HAVING count(DISTINCT chain) = 4), o AS (SELECT k, [a.c, b.c, e.c, f.c] AS o FROM (VALUES (0), (1), (2), (3)) a(c), (VALUES (0), (1), (2), (3)) b(c), (VALUES (0), (1), (2), (3)) e(c), (VALUES (0), (1), (2), (3)) f(c), four WHERE len(list_distinct([a.c, b.c, e.c, f.c])) = 4),
    w AS (SELECT o.k, o, sum(kept) AS kept, sum(n) AS n FROM o JOIN c ON c.k = o.k AND i = o[a + 1] AND j = o[b + 1] GROUP BY ALL)
    SELECT k, {R('max(kept / n)')} AS lddt FROM w GROUP BY k""",
)
def chain_assignment(spark, d):
    """The lDDT of the best assignment of each complex of four chains."""
    pred, true = _complexes(spark, d)
    whole = true.groupBy("k").agg(F.countDistinct("chain").alias("n")).filter("n = 4").select("k")
    found = chains.assigned(chains.contributions(pred.join(whole, "k", "left_semi"), true.join(whole, "k", "left_semi"), ("k",)), ("k",))
    return found.groupBy("k").agg(r6(F.max("lddt")).alias("lddt"))


@query("MET16")
def anchored_chains(spark, d):
    pred, true = _complexes(spark, d)
    return chains.anchored(pred, true, ("k",)).groupBy("k").agg(F.count("*").alias("matched"), F.sum(((F.col("true") + 1) % 4 == F.col("pred")).cast("int")).alias("right"))


#: Residues of three atoms; their names by label, with atoms that may be exchanged.
ATOMS_OF = "m AS (SELECT entry, idx // 3 AS res, 'R' || (label % 3) AS resname, idx % 3 AS atom, x, y, z, px, py, pz FROM models)"
ORDERS_OF = "(VALUES ('R0', 1, 1, 2), ('R0', 1, 2, 1), ('R1', 1, 0, 1), ('R1', 1, 1, 2), ('R1', 1, 2, 0), ('R1', 2, 0, 2), ('R1', 2, 2, 0))"


@query(
    "MET15",
    f"""WITH {MODELS}, {ATOMS_OF}, o AS (SELECT * FROM {ORDERS_OF} t(resname, perm, atom, renamed)), p AS (SELECT DISTINCT resname, perm FROM o UNION SELECT DISTINCT resname, 0 FROM m),
    s AS (SELECT m.entry, m.res, p.perm, sqrt(avg(pow(m.x - n.px, 2) + pow(m.y - n.py, 2) + pow(m.z - n.pz, 2))) AS dev FROM m JOIN p ON p.resname = m.resname LEFT JOIN o ON o.resname = m.resname AND o.perm = p.perm AND o.atom = m.atom JOIN m n ON n.entry = m.entry AND n.res = m.res AND n.atom = coalesce(o.renamed, m.atom) GROUP BY ALL)
    SELECT entry, CAST(res AS INTEGER) AS res, CAST(arg_min(perm, (round(dev, 9), perm)) AS INTEGER) AS perm, {R('arg_min(dev, (round(dev, 9), perm))')} AS deviation FROM s GROUP BY entry, res""",
)
def symmetric_atoms(spark, d):
    """For every residue, the exchange of like atoms that brings it nearest."""
    m = models(spark, d).select("entry", F.floor(F.col("idx") / 3).cast("int").alias("res"), F.concat(F.lit("R"), (F.col("label") % 3).cast("string")).alias("resname"), (F.col("idx") % 3).alias("atom"), "x", "y", "z", "px", "py", "pz")
    orders = spark.createDataFrame([("R0", 1, 1, 2), ("R0", 1, 2, 1), ("R1", 1, 0, 1), ("R1", 1, 1, 2), ("R1", 1, 2, 0), ("R1", 2, 0, 2), ("R1", 2, 2, 0)], "resname string, perm int, atom int, renamed int")
    return chains.symmetric(m, orders, ("entry", "res")).select("entry", "res", "perm", r6("deviation").alias("deviation"))


@query("MET19", "SELECT l_orderkey, count(DISTINCT l_linenumber - 1) = count(*) AND max(l_linenumber - 1) = count(*) - 1 AND min(l_linenumber - 1) = 0 AS valid FROM lineitem GROUP BY l_orderkey")
def permutation_valid(spark, d):
    return G.valid_permutation(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("place")), ["l_orderkey"], "place")


@query("MET10", f"WITH {PAIRS} SELECT entry, CAST(sum(CASE WHEN b_idx - a_idx = 1 AND d > 3.8 + 1.5 THEN 1 ELSE 0 END) AS BIGINT) AS stretched, CAST(sum(CASE WHEN b_idx - a_idx > 1 AND d < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS overlaps, {R('sum(CASE WHEN b_idx - a_idx > 1 AND d < 0.8 THEN 0.8 - d ELSE 0 END)')} AS overlap FROM pairs GROUP BY entry")
def steric_violations(spark, d):
    p, gap, dist = G.pairs(points(spark, d)), F.col("b_idx") - F.col("a_idx"), F.col("d")
    close = (gap > 1) & (dist < 0.8)
    return p.groupBy("entry").agg(F.sum(F.when((gap == 1) & (dist > 3.8 + 1.5), 1).otherwise(0)).alias("stretched"), F.sum(F.when(close, 1).otherwise(0)).alias("overlaps"), r6(F.sum(F.when(close, 0.8 - dist).otherwise(0.0))).alias("overlap"))


@query("FN32", f"WITH {POINTS} SELECT a.entry, CAST(a.idx // 4 AS INTEGER) AS i, CAST(b.idx // 4 AS INTEGER) AS j, CAST(16 AS INTEGER) AS cells, {R('sum((a.x - b.x) / 2)')} AS dx, {R('sum(abs(a.y - b.y) / 2)')} AS dy, {R('max(CASE WHEN a.idx % 4 = 0 AND b.idx % 4 = 0 THEN (a.z - b.z) / 2 END)')} AS corner FROM points a JOIN points b ON a.entry = b.entry GROUP BY a.entry, a.idx // 4, b.idx // 4")
def distance_patches(spark, d):
    """Difference vectors of every chain in patches of four by four, with zeros up to a multiple of four."""
    rows = G.patches(points(spark, d), 4, scale=2.0)
    add = lambda i, f: F.aggregate("cells", F.lit(0.0), lambda a, v: a + f(F.get(v, F.lit(i))))
    return rows.select("entry", "i", "j", F.size("cells").alias("cells"), r6(add(0, lambda x: x)).alias("dx"), r6(add(1, F.abs)).alias("dy"), r6(F.get(F.get("cells", F.lit(0)), F.lit(2))).alias("corner"))


NAMES = ("N", "CA", "C")
BACKBONE_SQL = "b AS (SELECT entry, idx // 3 AS res, CASE WHEN label % 3 = 0 THEN 'PRO' ELSE 'GLY' END AS resname, ['N', 'CA', 'C'][idx % 3 + 1] AS atom, x, y, z FROM points)"
RADII_SQL = "r AS (SELECT * FROM (VALUES ('N', 1.55::DOUBLE), ('CA', 1.7), ('C', 1.7)) t(atom, r))"


def _dot_sql(u, v):
    """Scalar product of two differences of points, each given as a pair of table aliases."""
    return "(" + " + ".join(f"({u[0]}.{c} - {u[1]}.{c}) * ({v[0]}.{c} - {v[1]}.{c})" for c in "xyz") + ")"


def _size_sql(u, eps="1e-6"):
    return f"sqrt({eps} + {_dot_sql(u, u)})"


def _error_sql(value, wanted):
    return f"sqrt(1e-6 + pow({value} - ({wanted}), 2))"


LINKS_SQL = f"""l AS (SELECT c.entry, c.res, {_error_sql(_size_sql(('n', 'c')), "CASE WHEN n.resname = 'PRO' THEN 1.341 ELSE 1.329 END")} - 12 * CASE WHEN n.resname = 'PRO' THEN 0.016 ELSE 0.014 END AS c_n,
    {_error_sql(f"{_dot_sql(('a', 'c'), ('n', 'c'))} / {_size_sql(('a', 'c'))} / {_size_sql(('n', 'c'))}", -0.4473)} - 12 * 0.014 AS ca_c_n,
    {_error_sql(f"{_dot_sql(('c', 'n'), ('m', 'n'))} / {_size_sql(('n', 'c'))} / {_size_sql(('m', 'n'))}", -0.5203)} - 12 * 0.0353 AS c_n_ca, {_size_sql(('m', 'a'))} AS step
    FROM b c JOIN b a ON a.entry = c.entry AND a.res = c.res AND a.atom = 'CA' JOIN b n ON n.entry = c.entry AND n.res = c.res + 1 AND n.atom = 'N' JOIN b m ON m.entry = c.entry AND m.res = c.res + 1 AND m.atom = 'CA' WHERE c.atom = 'C')"""
MET_SQL = f"""p AS (SELECT a.entry, a.res AS ar, b.res AS br, greatest(ra.r + rb.r - 1.5 - {_size_sql(('a', 'b'), '1e-10')}, 0) AS over
    FROM b a JOIN b ON a.entry = b.entry AND a.res < b.res AND NOT (b.res = a.res + 1 AND a.atom = 'C' AND b.atom = 'N') JOIN r ra ON ra.atom = a.atom JOIN r rb ON rb.atom = b.atom)"""


def _backbone(spark, d):
    p = points(spark, d)
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("idx") % 3).cast("int"))
    return p.select("entry", F.floor(F.col("idx") / 3).cast("int").alias("res"), F.when(F.col("label") % 3 == 0, "PRO").otherwise("GLY").alias("resname"), name.alias("atom"), "x", "y", "z")


@query(
    "MET10",
    f"""WITH {POINTS}, {BACKBONE_SQL}, {RADII_SQL}, {LINKS_SQL}, {MET_SQL}, lm AS (SELECT entry, sum(greatest(c_n, 0)) / (count(*) + 1e-6) AS c_n, sum(greatest(ca_c_n, 0)) / (count(*) + 1e-6) AS ca_c_n, sum(greatest(c_n_ca, 0)) / (count(*) + 1e-6) AS c_n_ca, avg(CASE WHEN step - 3.80209737096 > 1.5 THEN 1.0 ELSE 0 END) AS far_steps FROM l GROUP BY entry),
    pm AS (SELECT entry, sum(over) / (count(*) + 1e-6) AS clash, count(*) AS n_pairs FROM p GROUP BY entry)
    SELECT entry, {R('c_n')} AS c_n, {R('ca_c_n')} AS ca_c_n, {R('c_n_ca')} AS c_n_ca, {R('far_steps')} AS far_steps, {R('clash')} AS clash, n_pairs FROM lm JOIN pm USING (entry)""",
)
def violation_losses(spark, d):
    """Means of the losses of bonds, angles and clashes of every chain of backbone atoms."""
    atoms = _backbone(spark, d)
    over = violations.clashes(atoms).groupBy("entry").agg(F.sum("over").alias("over"))
    rows = violations.connection_means(violations.connections(atoms)).join(violations.compared_pairs(atoms), "entry").join(over, "entry", "left")
    clash = F.coalesce("over", F.lit(0.0)) / (F.col("n_pairs") + violations.EPS)
    return rows.select("entry", *[r6(c).alias(c) for c in ("c_n", "ca_c_n", "c_n_ca", "far_steps")], r6(clash).alias("clash"), "n_pairs")


@query(
    "MET10",
    f"""WITH {POINTS}, {BACKBONE_SQL}, {RADII_SQL}, {LINKS_SQL}, {MET_SQL}, k AS (SELECT entry, res FROM l WHERE greatest(c_n, ca_c_n, c_n_ca) > 0 UNION SELECT entry, res + 1 FROM l WHERE greatest(c_n, ca_c_n, c_n_ca) > 0),
    h AS (SELECT entry, ar AS res FROM p WHERE over > 0 UNION SELECT entry, br FROM p WHERE over > 0),
    w AS (SELECT DISTINCT a.entry, a.res FROM b a JOIN b ON a.entry = b.entry AND a.res = b.res AND a.atom <> b.atom JOIN r ra ON ra.atom = a.atom JOIN r rb ON rb.atom = b.atom WHERE {_size_sql(('a', 'b'), '1e-10')} < ra.r + rb.r - 1.5),
    o AS (SELECT DISTINCT entry, res FROM b)
    SELECT o.entry, CAST(o.res AS INTEGER) AS res, k.res IS NOT NULL AS connection, h.res IS NOT NULL AS clash, w.res IS NOT NULL AS inside, k.res IS NOT NULL OR h.res IS NOT NULL OR w.res IS NOT NULL AS any_violation
    FROM o LEFT JOIN k ON k.entry = o.entry AND k.res = o.res LEFT JOIN h ON h.entry = o.entry AND h.res = o.res LEFT JOIN w ON w.entry = o.entry AND w.res = o.res""",
)
def residue_violations(spark, d):
    """Which residues break a bond or an angle, clash, or hold atoms too close together."""
    pairs = spark.createDataFrame([(r, a, b) for r in ("PRO", "GLY") for a, b in (("N", "CA"), ("N", "C"), ("CA", "C"))], "resname string, atom string, other string")
    return violations.residues(_backbone(spark, d), violations.contact_bounds(pairs))


@query("MET11", f"WITH t AS (SELECT doc_id, string_split(text, '') AS s FROM documents WHERE length(text) > 0) SELECT a.doc_id, {R('list_sum(list_transform(list_zip(a.s, b.s), lambda x: CASE WHEN x[1] = x[2] THEN 1 ELSE 0 END)) / greatest(len(a.s), len(b.s))')} AS identity FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def sequence_identity(spark, d):
    t = table(spark, d, "documents").filter("length(text) > 0").select("doc_id", F.split("text", "").alias("s"))
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("o"))
    same = F.aggregate(F.zip_with("s", "o", lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return t.join(other, "doc_id").select("doc_id", r6(same / F.greatest(F.size("s"), F.size("o"))).alias("identity"))


@query("MET13")
def best_offset_rmsd(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    short = e.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("e", 1, 48).alias("s"))
    offsets = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda o: F.sqrt(F.aggregate(F.zip_with(F.slice("e", o + 1, F.lit(48)), "s", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) / 48))
    return e.join(short, "vec_id").select("vec_id", offsets.alias("r")).select("vec_id", r6(F.array_min("r")).alias("rmsd"), (F.array_position("r", F.array_min("r")) - 1).cast("int").alias("offset"))
