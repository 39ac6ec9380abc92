"""Steric violations against planted and random structures; nearest neighbours, ranks, dumps and copies against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from helixmill.operators import evaluate, nearest, sampling, violations
from helixmill.sinks import writers

SCHEMA = "entry string, res int, resname string, atom string, x double, y double, z double"


def placed(a, b, c, length, angle, torsion):
    """An atom bound to c."""
    a, b, c = (np.array(v, float) for v in (a, b, c))
    bc = (c - b) / np.linalg.norm(c - b)
    n = np.cross(b - a, bc)
    n /= np.linalg.norm(n)
    m = np.cross(n, bc)
    return c + length * (-math.cos(angle) * bc + math.sin(angle) * math.cos(torsion) * m + math.sin(angle) * math.sin(torsion) * n)


def backbone(n, entry="e", proline=()):
    """An extended chain with ideal bonds and angles between residues."""
    at = [np.zeros(3), np.array([1.458, 0, 0]), np.array([1.458 + 1.525 * math.cos(math.radians(69)), 1.525 * math.sin(math.radians(69)), 0])]
    for i in range(1, n):
        a, b, c = at[-3:]
        at.append(placed(a, b, c, 1.341 if i in proline else 1.329, math.acos(-0.4473), math.pi))
        at.append(placed(*at[-3:], 1.458, math.acos(-0.5203), math.pi))
        at.append(placed(*at[-3:], 1.525, math.radians(111), math.pi))
    return [(entry, i // 3, "PRO" if i // 3 in proline else "ALA", ("N", "CA", "C")[i % 3], *map(float, p)) for i, p in enumerate(at)]


def links(spark, rows, tolerance=12.0):
    return {r.res: r for r in violations.connections(spark.createDataFrame(rows, SCHEMA), tolerance=tolerance).collect()}


def test_an_ideal_chain_has_no_violation(spark):
    rows = backbone(8, proline=(3,))
    atoms = spark.createDataFrame(rows, SCHEMA)
    # What is added under the root of an error, 0.001, is all there is to a deviation of none.
    got = links(spark, rows, tolerance=0.1)
    assert not any(r.bad for r in got.values()) and got[7].c_n is None and got[7].step is None
    assert max(r.c_n for r in got.values() if r.res < 7) == 0
    m = violations.connection_means(violations.connections(atoms)).first()
    assert (m.c_n, m.ca_c_n, m.c_n_ca, m.far_steps) == (0, 0, 0, 0)
    assert violations.clashes(atoms).count() == 0
    assert violations.compared_pairs(atoms).first().n_pairs == 24 * 23 // 2 - 8 * 3 - 7


def test_a_stretched_bond_marks_both_residues_and_a_gap_none(spark):
    rows = [(e, r, n, a, x + (3.0 if r >= 4 else 0), y, z) for e, r, n, a, x, y, z in backbone(8)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.res: r for r in violations.connection_residues(violations.connections(frame)).collect()}
    assert [r for r in sorted(got) if got[r].bad] == [3, 4] and got[3].loss == pytest.approx(got[4].loss) and got[3].loss > 0
    assert violations.connection_means(violations.connections(frame)).first().far_steps == pytest.approx(1 / 7)
    away = [(e, r + (r >= 4), n, a, x, y, z) for e, r, n, a, x, y, z in rows]
    assert not any(r.bad for r in links(spark, away).values()) and links(spark, away)[3].step is None
    lacking = [r for r in rows if not (r[1] == 4 and r[3] == "N")]
    got = links(spark, lacking)
    assert got[3].c_n is None and not got[3].bad and got[3].step is not None


def test_clashes_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [("ab"[k % 2], r, "CYS", a, *(rng.uniform(-4, 4) for _ in "xyz")) for k in range(2) for r in range(12) for a in ("N", "CA", "C", "O", "SG", "H1")]
    rows += [rows[0], ("a", 40, "ALA", "CA", None, 0.0, 0.0), ("a", 41, "ALA", "CA", float("nan"), 0.0, 0.0)]
    radius = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}
    want, pairs = {}, {"a": 0, "b": 0}
    fine = sorted({r for r in rows if r[4] is not None and r[4] == r[4] and r[3][0] in radius})
    for p, q in itertools.product(fine, fine):
        if p[0] != q[0] or p[1] >= q[1] or (q[1] == p[1] + 1 and (p[3], q[3]) == ("C", "N")) or (p[3], q[3]) == ("SG", "SG"):
            continue
        pairs[p[0]] += 1
        over = radius[p[3][0]] + radius[q[3][0]] - 1.5 - math.sqrt(1e-10 + math.dist(p[4:], q[4:]) ** 2)
        if over > 0:
            want[p[0], p[1], p[3], q[1], q[3]] = over
    atoms = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r)[:5]: r.over for r in violations.clashes(atoms).collect()}
    assert len(want) > 10 and got == pytest.approx(want)
    assert {r.entry: r.n_pairs for r in violations.compared_pairs(atoms).collect()} == pairs
    assert violations.clashes(atoms, tolerance=4.0).count() == 0


def test_distances_inside_a_residue(spark):
    rows = [("e", 0, "ALA", "N", 0.0, 0.0, 0.0), ("e", 0, "ALA", "CA", 1.0, 0.0, 0.0), ("e", 0, "ALA", "C", 0.0, 9.0, 0.0), ("e", 1, "GLY", "N", 0.0, 0.0, 5.0), ("e", 1, "GLY", "CA", 0.0, 0.0, 6.46)]
    bounds = spark.createDataFrame([("ALA", "N", "CA", 1.3, 1.6), ("ALA", "N", "C", 2.0, 3.0), ("GLY", "N", "CA", 1.3, 1.6)], "resname string, atom string, other string, low double, high double")
    atoms = spark.createDataFrame(rows, SCHEMA)
    got = {(r.res, r.atom): (r.loss, r.bad) for r in violations.within(atoms, bounds).collect()}
    assert set(got) == {(0, "N"), (0, "CA"), (0, "C")}
    assert got[0, "CA"] == (pytest.approx(0.6), True) and got[0, "N"][0] == pytest.approx(0.6 + 12)
    flags = {r.res: r for r in violations.residues(atoms, bounds).collect()}
    assert flags[0].inside and not flags[1].inside and flags[0].any_violation
    share = violations.shares(violations.residues(atoms, bounds)).first()
    assert share.inside == 0.5
    none = spark.createDataFrame([], SCHEMA)
    assert violations.residues(none, bounds).count() == 0 and violations.connection_means(violations.connections(none)).count() == 0


@pytest.mark.parametrize("measure", ["dot", "l1", "l2"])
def test_nearest_equals_brute_force(spark, measure):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 4 else f"g{i % 3}", i, [float(v) for v in rng.integers(-3, 4, 5)]) for i in range(90)]  # many ties
    rows += [("hot", 200, None), ("hot", 201, []), ("hot", 202, [float("nan")] * 5), ("hot", 203, [1.0, 2.0]), (None, 204, [0.0] * 5)]
    df = spark.createDataFrame(rows, "g string, id long, point array<double>")
    got = {(r.q, r["rank"]): (r.id, r.score) for r in nearest.nearest(df.withColumnRenamed("id", "q"), df, 3, ["g"], measure, others=True, block=16).collect()}
    fine = [r for r in rows[:90]]
    score = {"dot": lambda a, b: -float(np.dot(a, b)), "l1": lambda a, b: float(np.abs(np.subtract(a, b)).sum()), "l2": math.dist}[measure]
    want = {}
    for g, i, p in fine:
        near = sorted((score(p, v), j) for h, j, v in fine if h == g and j != i)[:3]
        want |= {(i, k + 1): (j, -s if measure == "dot" else s) for k, (s, j) in enumerate(near)}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


@pytest.mark.parametrize("scale", [1.0, 1e-44, 1e30, 1e60])
@pytest.mark.parametrize("measure", ["l1", "l2"])
def test_quick_distances_lose_no_neighbour(measure, scale):
    """Rows far from zero and close to each other, where quick distances cannot tell; copies, and numbers that single precision has not."""
    rng = np.random.default_rng(9)
    y = np.concatenate([(1000 + 1e-5 * rng.normal(size=(150, 8))), rng.normal(size=(150, 8))]) * scale
    y = np.concatenate([y, y[:40]])
    x = np.concatenate([y[:50], y[160:190]])
    rows, cols, score = nearest._nearest_places(x, y, 5, measure, None)
    exact = np.array([nearest._scores(np.repeat(v[None], len(y), 0), y, measure) for v in x])
    want = np.argsort(exact, axis=1, kind="stable")[:, :5]
    assert (cols.reshape(-1, 5) == want).all() and (score == exact[rows, cols]).all()


def test_one_plan_deals_the_blocks_of_all_measures(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], float(i), i % 2) for i in range(30)], "id long, point array<double>, y double, fold int")
    predicted = nearest.neighbour_regression(df, 2, (2,), ("l1", "l2"))
    assert predicted._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1


def test_neighbours_at_no_distance_decide_alone(spark):
    rows = [(1, [0.0], 5.0, 0), (2, [0.0], 7.0, 1), (3, [1.0], 100.0, 1), (4, [9.0], 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, point array<double>, y double, fold int")
    got = {(r.q, r.weights): r.prediction for r in nearest.neighbour_regression(df, 2, (2,)).collect()}
    assert got[1, "distance"] == 7.0 and got[1, "uniform"] == 53.5 and got[3, "distance"] == 5.0
    score = nearest.r_squared(spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, 3.0), (1, 4.0, 4.0)], "fold int, y double, prediction double"), [])
    assert score.first().r2 == 1.0 and score.first().n == 3


def test_average_ranks_of_all_kinds_of_numbers(spark):
    values = [0.0, -0.5, -4.0, 1e-300, 3.0, 3.0, 1e300, float("inf"), float("-inf"), 0.3, 0.30001, -1e-12, 3.0, 0.0]
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values] + [("b", 1.0)], "g string, v double")
    got = sorted((r.g or "", r.v, r.r) for r in evaluate.average_ranks(df, "v", "r", ["g"]).collect())
    rank = lambda v: sum(x < v for x in values) + (values.count(v) + 1) / 2
    assert got == sorted([(k, v, rank(v)) for k in ("a", "") for v in values] + [("b", 1.0, 1.0)])


def test_representations_keep_to_the_length(spark):
    rows = [("p", 1, i, [float(i), 1.0]) for i in range(6)] + [("p", 2, 1, [8.0, 2.0]), ("q", 1, 0, [4.0, 4.0])]
    got = {(r.label, r.layer): r for r in writers.representations(spark.createDataFrame(rows, "label string, layer int, place int, vector array<double>"), most=3).collect()}
    one = got["p", 1]
    assert (one.n, one.bos, one["mean"], one.per_tok) == (3, [0.0, 1.0], [2.0, 1.0], [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]])
    assert got["p", 2].bos is None and got["q", 1]["mean"] is None and got["q", 1].per_tok == []


def test_copies_are_whole_and_written_once(spark, tmp_path):
    rows = [("a", 1, 9.0, True, 50, "x" * 50), ("a", 2, 9.0, True, 60, "y"), ("b", 3, 1.0, True, 50, "zé"), ("c", 4, 5.0, False, 50, "no"), ("d", 5, 1.0, True, 40, None)]
    df = spark.createDataFrame(rows, "g string, id long, score double, ok boolean, n int, text string")
    best = writers.best_samples(df, ["g"], "id", [df.score.desc()], df.ok, "n").persist()
    names = {r.id: r.name for r in best.collect()}
    assert names == {5: "sample_id_0_length_40.pdb", 1: "sample_id_1_length_50.pdb", 3: "sample_id_2_length_50.pdb"}
    folder = f"file://{tmp_path}/designable"
    assert {r.status for r in writers.write_named(best, folder).collect()} == {"success"}
    assert {p.name: p.read_text() for p in (tmp_path / "designable").iterdir()} == {names[5]: "", names[1]: "x" * 50, names[3]: "zé"}
    assert {r.status for r in writers.write_named(best, folder).collect()} == {"skipped"}


def test_ladders_and_grids_follow_the_rows(spark):
    df = spark.createDataFrame([("a", 250, 10), ("b", 20, 90)], "k string, top int, low int")
    got = sorted((r.k, r.length, r["copy"], len(r.seq)) for r in sampling.length_ladder(df.drop("low"), "top", 100, 2).collect())
    assert got == [("a", 100, 1, 100), ("a", 100, 2, 100), ("a", 200, 1, 200), ("a", 200, 2, 200), ("b", 100, 1, 100), ("b", 100, 2, 100)]
    grid = sampling.length_grid(df.filter("k = 'a'"), "low", "top", 120, 2)
    assert sorted((r.length, r["sample"]) for r in grid.collect()) == [(10, 0), (10, 1), (130, 0), (130, 1), (250, 0), (250, 1)]
