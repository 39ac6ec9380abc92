"""Steric violations of structures in long form: (keys, res, resname, atom, x, y, z), res the residue's number in its chain.

Bonds and angles between neighbours come from one row a residue; clashes from an equi-join on
grid cells inside an entry, so only atoms near each other ever meet; distances inside a
residue from a join with a table of bounds. A residue that repeats an atom counts its least
place; atoms without coordinates take no part, and neither do atoms of other elements than the four of `RADIUS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Van der Waals radii by element.
RADIUS = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}
#: Length of the bond between residues and its deviation, before proline and before any other residue.
BOND = {"PRO": (1.341, 0.016), None: (1.329, 0.014)}
#: Cosine of the angle at C and at N, and its deviation. The first is held to the bond's deviation.
ANGLE_AT_C = (-0.4473, 0.014)
ANGLE_AT_N = (-0.5203, 0.0353)
#: Fixed value: distance of neighbouring alpha carbons.
CA_STEP = 3.80209737096
#: What is added under a root or to a divisor.
EPS, EPS_ATOMS = 1e-6, 1e-10


def _atoms(atoms: DataFrame, keys) -> DataFrame:
    place = F.struct("x", "y", "z")
    fine = atoms.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT (isnan(x) OR isnan(y) OR isnan(z))")
    return fine.groupBy(*keys, "res", "resname", "atom").agg(F.min(place).alias("at"))


def _minus(a, b):
    return [a[c] - b[c] for c in "xyz"]


def _dot(u, v):
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def connections(atoms: DataFrame, keys=("entry",), tolerance: float = 12.0) -> DataFrame:
    """A row per residue: keys, res, losses c_n, ca_c_n and c_n_ca of its bond with the next residue, whether that bond is `bad`, and the step to the next alpha carbon.

    A loss is what an error exceeds `tolerance` deviations by. It is null, and the bond not bad, where
    an atom is missing or the next number is not res + 1; so is the step.
    """
    at = lambda name: F.min(F.when(F.col("atom") == name, F.col("at"))).alias(name)
    rows = _atoms(atoms, keys).groupBy(*keys, "res").agg(F.min("resname").alias("resname"), at("N"), at("CA"), at("C"))
    order = Window.partitionBy(*keys).orderBy("res")
    rows = rows.withColumn("_next", F.lead(F.struct("res", "resname", "N", "CA")).over(order))
    rows = rows.withColumn("_next", F.when(F.col("_next.res") == F.col("res") + 1, F.col("_next")))
    bond = _minus(F.col("_next.N"), F.col("C"))
    back = _minus(F.col("CA"), F.col("C"))
    on = _minus(F.col("_next.CA"), F.col("_next.N"))
    step = _minus(F.col("_next.CA"), F.col("CA"))
    size = lambda v: F.sqrt(EPS + _dot(v, v))
    error = lambda value, wanted: F.sqrt(EPS + (value - wanted) * (value - wanted))
    proline = F.col("_next.resname") == "PRO"
    length, spread = (F.when(proline, BOND["PRO"][i]).otherwise(BOND[None][i]) for i in (0, 1))
    over = {
        "c_n": error(size(bond), length) - tolerance * spread,
        "ca_c_n": error(_dot(back, bond) / size(back) / size(bond), ANGLE_AT_C[0]) - tolerance * ANGLE_AT_C[1],
        "c_n_ca": error(-_dot(bond, on) / size(bond) / size(on), ANGLE_AT_N[0]) - tolerance * ANGLE_AT_N[1],
    }
    rows = rows.select(*keys, "res", *[v.alias(k) for k, v in over.items()], size(step).alias("step"))
    bad = F.greatest(*over) > 0  # greatest leaves nulls out
    return rows.select(*keys, "res", *[F.when(F.col(k).isNotNull(), F.greatest(F.col(k), F.lit(0.0))).alias(k) for k in over], F.coalesce(bad, F.lit(False)).alias("bad"), "step")


def connection_residues(links: DataFrame, keys=("entry",)) -> DataFrame:
    """Per residue: half the losses of its two bonds, and whether either is bad."""
    order = Window.partitionBy(*keys).orderBy("res")
    rows = links.withColumn("_l", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("c_n", "ca_c_n", "c_n_ca")), F.lit(0.0)))
    return rows.select(*keys, "res", ((F.col("_l") + F.coalesce(F.lag("_l").over(order), F.lit(0.0))) / 2).alias("loss"), (F.col("bad") | F.coalesce(F.lag("bad").over(order), F.lit(False))).alias("bad"))


def connection_means(links: DataFrame, keys=("entry",), most: float = 1.5) -> DataFrame:
    """Per entry: mean of each loss over the bonds that have one, and the share of steps more than `most` beyond the usual."""
    mean = lambda c: (F.coalesce(F.sum(c), F.lit(0.0)) / (F.count(c) + EPS)).alias(c)
    far = F.when(F.col("step") - CA_STEP > most, 1.0).when(F.col("step").isNotNull(), 0.0)
    return links.groupBy(*keys).agg(mean("c_n"), mean("ca_c_n"), mean("c_n_ca"), F.coalesce(F.avg(far), F.lit(0.0)).alias("far_steps"))


def _radius(atom):
    first, out = F.substring(atom, 1, 1), None
    for element, size in RADIUS.items():
        out = F.when(first == element, size) if out is None else out.when(first == element, size)
    return out


def clashes(atoms: DataFrame, keys=("entry",), tolerance: float = 1.5) -> DataFrame:
    """Pairs of atoms of different residues that overlap by more than `tolerance`: keys, a_res, a_atom, b_res, b_atom, over.

    The bond from C to the next residue's N and pairs of SG do not count. Each atom looks into the 27 cells round its own.
    """
    reach = 2 * max(RADIUS.values()) - tolerance
    rows = _atoms(atoms, keys).withColumn("r", _radius(F.col("atom"))).filter("r IS NOT NULL")
    if reach <= 0:
        return rows.select(*keys, F.col("res").alias("a_res"), F.col("atom").alias("a_atom"), F.col("res").alias("b_res"), F.col("atom").alias("b_atom"), F.col("r").alias("over")).limit(0)
    cell = lambda c: F.floor(F.col(f"at.{c}") / reach)
    rows = rows.select(*keys, "res", "atom", "at", "r", *[cell(c).alias(f"c{c}") for c in "xyz"])
    one = rows.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("res", "atom", "at", "r")], "cx", "cy", "cz")
    for c in "xyz":
        one = one.withColumn("_o", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_o")).drop("_o")
    two = rows.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("res", "atom", "at", "r")], "cx", "cy", "cz")
    apart = _minus(F.col("a_at"), F.col("b_at"))
    bond = (F.col("b_res") == F.col("a_res") + 1) & (F.col("a_atom") == "C") & (F.col("b_atom") == "N")
    bridge = (F.col("a_atom") == "SG") & (F.col("b_atom") == "SG")
    met = one.join(two, [*keys, "cx", "cy", "cz"]).filter((F.col("a_res") < F.col("b_res")) & ~bond & ~bridge)
    met = met.withColumn("over", F.col("a_r") + F.col("b_r") - tolerance - F.sqrt(EPS_ATOMS + _dot(apart, apart)))
    return met.filter("over > 0").select(*keys, "a_res", "a_atom", "b_res", "b_atom", "over")


def compared_pairs(atoms: DataFrame, keys=("entry",)) -> DataFrame:
    """(keys, n_pairs): pairs of atoms of different residues that `clashes` holds against each other, counted without making them."""
    rows = _atoms(atoms, keys).filter(_radius(F.col("atom")).isNotNull())
    has = lambda name: F.max(F.when(F.col("atom") == name, 1).otherwise(0)).cast("long")
    by = rows.groupBy(*keys, "res").agg(F.count("*").alias("n"), has("C").alias("c"), has("N").alias("nn"), has("SG").alias("sg"))
    nxt = F.lead(F.struct("res", "nn")).over(Window.partitionBy(*keys).orderBy("res"))
    by = by.withColumn("bond", F.coalesce(F.when(nxt["res"] == F.col("res") + 1, F.col("c") * nxt["nn"]), F.lit(0)))
    pairs = lambda c: (F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c))) / 2
    return by.groupBy(*keys).agg((pairs("n") - pairs("sg") - F.sum("bond")).cast("long").alias("n_pairs"))


def within(atoms: DataFrame, bounds: DataFrame, keys=("entry",), tighten: float = 0.0) -> DataFrame:
    """Atoms whose distance to another of their residue leaves its bounds: keys, res, atom, loss, bad (without `tighten`).

    bounds: (resname, atom, other, low, high), each pair of a residue's atoms once. Only atoms with a loss or a violation come back.
    """
    rows = _atoms(atoms, keys)
    one = rows.join(bounds, ["resname", "atom"])
    two = rows.select(*keys, "res", F.col("atom").alias("other"), F.col("at").alias("b_at"))
    apart = _minus(F.col("at"), F.col("b_at"))
    met = one.join(two, [*keys, "res", "other"]).withColumn("d", F.sqrt(EPS_ATOMS + _dot(apart, apart)))
    loss = F.greatest(F.col("low") + tighten - F.col("d"), F.lit(0.0)) + F.greatest(F.col("d") - F.col("high") + tighten, F.lit(0.0))
    met = met.withColumn("loss", loss).withColumn("bad", (F.col("d") < F.col("low")) | (F.col("d") > F.col("high"))).filter("loss > 0 OR bad")
    both = met.withColumn("atom", F.explode(F.array("atom", "other")))
    return both.groupBy(*keys, "res", "atom").agg((2 * F.sum("loss")).alias("loss"), F.max("bad").alias("bad"))


def contact_bounds(pairs: DataFrame, tolerance: float = 1.5, far: float = 1e10) -> DataFrame:
    """Bounds of atoms that no bond holds together, from (resname, atom, other): radii less `tolerance`, no upper bound."""
    return pairs.select("resname", "atom", "other", (_radius(F.col("atom")) + _radius(F.col("other")) - tolerance).alias("low"), F.lit(far).alias("high"))


def residues(atoms: DataFrame, bounds: DataFrame, keys=("entry",), deviations: float = 12.0, tolerance: float = 1.5) -> DataFrame:
    """Per residue: keys, res, connection, clash, inside, any_violation."""
    links = connection_residues(connections(atoms, keys, deviations), keys)
    hit = clashes(atoms, keys, tolerance)
    hit = hit.select(*keys, F.explode(F.array("a_res", "b_res")).alias("res")).distinct().withColumn("clash", F.lit(True))
    inner = within(atoms, bounds, keys).filter("bad").select(*keys, "res").distinct().withColumn("inside", F.lit(True))
    rows = links.join(hit, [*keys, "res"], "left").join(inner, [*keys, "res"], "left")
    flags = [F.col("bad").alias("connection"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("clash", "inside")]]
    return rows.select(*keys, "res", *flags).withColumn("any_violation", F.col("connection") | F.col("clash") | F.col("inside"))


def shares(flags: DataFrame, keys=("entry",)) -> DataFrame:
    """Per entry, the share of residues with each kind of violation."""
    return flags.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in ("connection", "clash", "inside", "any_violation")])
