"""Queries without SQL run over whole tables: each against a brute force."""

import collections
import math
import random

from helixmill.operators import sampling
from helixmill.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_chain_matching_takes_every_chain(spark):
    chains = collections.defaultdict(lambda: ([], []))
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect():
        chains[r.label][r.vec_id % 2].append((r.vec_id, [float(x) for x in r.embedding]))
    want = set()
    for label, (a, b) in chains.items():
        used = set()
        for _, i, j in sorted((sum((x - y) * (x - y) for x, y in zip(p, t)), i, j) for i, p in a for j, t in b):
            if ("p", i) not in used and ("t", j) not in used:
                used |= {("p", i), ("t", j)}
                want.add((label, i, j))
    got = [tuple(r) for r in catalog.QUERIES["chain_matching"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(max(i, j) for _, i, j in got) >= 160


def greedy(rows, n, most=True):
    """rows: (key, text), padded with gaps to one width."""
    rows = sorted((k, s or "") for k, s in rows)
    width = max(len(s) for _, s in rows)
    rows = [(k, s.ljust(width, "-")) for k, s in rows]
    chosen = [0]
    while len(chosen) < min(n, len(rows)):
        far = {i: sum(x != y for j in chosen for x, y in zip(rows[i][1], rows[j][1])) for i in range(len(rows)) if i not in chosen}
        chosen.append(min(far, key=lambda i: (-far[i] if most else far[i], i)))
    return [rows[i][0] for i in chosen]


def test_diverse_rows_looks_at_all_rows_and_places(spark):
    rnd = random.Random(3)
    rows = [(g, i, "".join(rnd.choice("AC-é") for _ in range(rnd.choice([0, 5, 60, 90])))) for g in "xy" for i in range(40)] + [("z", 7, None), ("z", 3, "A")]
    df = spark.createDataFrame(rows, "g string, i int, s string").repartition(5)
    # Whole groups in tasks; scans of all groups at once, and of lots of one group; both ways at once.
    for most, bounds in [(True, {}), (False, {}), (True, {"group_bytes": 0}), (False, {"group_bytes": 0, "carried_bytes": 1}), (True, {"group_bytes": 2000, "carried_bytes": 1})]:
        got = collections.defaultdict(list)
        for r in sampling.diverse_rows(df, ["g"], "i", "s", 6, most, **bounds).orderBy("step").collect():
            got[r.g].append(r.i)
        assert got == {g: greedy([(i, s) for h, i, s in rows if h == g], 6, most) for g in "xyz"}


def test_msa_diverse_select_takes_the_farthest_of_a_language(spark, tmp_path):
    rows = [("en", i, "A" * 60 + "C" * (i % 3)) for i in range(400)] + [("en", 400, "A" * 60 + "G" * 30), ("en", 401, "T")]
    spark.createDataFrame(rows, "lang string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.doc_id for r in catalog.QUERIES["msa_diverse_select"](spark, str(tmp_path)).orderBy("step").collect()]
    assert got == greedy([(i, s) for _, i, s in rows], 16) and got[:3] == [0, 401, 400]


def test_forest_regression_reads_whole_vectors(spark, tmp_path):
    rnd = random.Random(2)
    vectors = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(200)]
    rows = [(i, v, 10 * int(v[40] > 0)) for i, v in enumerate(vectors)]  # the label hangs on component 40 alone
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.prediction for r in catalog.QUERIES["forest_regression"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(0, 200, 5))
    assert sum((got[i] > 5) == (rows[i][2] > 5) for i in got) >= 36
