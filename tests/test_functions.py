import math
import random

import numpy as np
from pyspark.sql import functions as F

from helixmill.functions import numeric, sequence
from helixmill.operators import batching, corpus, geometry, sampling


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_alphabet_golden(spark):
    rows = {
        "MKTVRQG": [0, 20, 15, 11, 7, 10, 16, 6, 2],
        "KALTA<mask>ISQP": [0, 15, 5, 4, 11, 5, 32, 12, 8, 16, 14, 2],
        "K A <mask> I S Q": [0, 15, 5, 32, 12, 8, 16, 2],
    }
    for text, ids in rows.items():
        got = one(spark, x=sequence.wrapped(sequence.esm_ids(F.lit(text)))).x
        assert got == ids
    short = one(spark, x=sequence.wrapped(sequence.esm_ids(F.lit("MKTVRQGMKTVRQG")), limit=10)).x
    assert len(short) == 12 and short[-1] == 2
    assert one(spark, x=sequence.esm_ids(F.lit("K?"), strict=True)).x == [15, None]


def test_text_round_trip(spark):
    r = one(spark, t=sequence.train_text(F.lit("AC"), F.array(F.lit(3), F.lit(1234))))
    assert r.t == "<seq>A C</seq><struct><|s0003|><|s1234|></struct>"
    assert one(spark, c=sequence.struct_codes(F.lit(r.t + "x" + r.t))).c == [3, 1234, 3, 1234]
    assert one(spark, c=sequence.struct_codes(F.lit(r.t + r.t), skip_first=True)).c == [3, 1234]
    assert one(spark, c=sequence.codes_from_text(sequence.codes_text(F.array(F.lit(7), F.lit(42))))).c == [7, 42]


def test_chain_codec_is_bijective(spark):
    df = spark.range(62 + 62 * 62 + 500).select("id", sequence.chain_name(F.col("id")).alias("n"))
    assert df.select("n").distinct().count() == df.count()
    assert df.filter(sequence.chain_number(F.col("n")) != F.col("id")).count() == 0


def test_stem_strips_suffixes_only(spark):
    for name, want in {"1bcf.cif": "1bcf", "AF-P1-F1-model_v4.cif.gz": "AF-P1-F1-model_v4", "gz.pdb": "gz", "x.txt": "x.txt"}.items():
        assert one(spark, s=sequence.stem(F.lit(name))).s == want


def test_truncate_and_mutations(spark):
    assert one(spark, s=sequence.truncated(F.lit("1AB2CD1"))).s == "1AB2"
    assert one(spark, s=sequence.truncated(F.lit("1ABC"))).s == "1ABC"
    r = one(spark, a=sequence.substitute(F.lit("ABCD"), F.lit(1), F.lit("X")), b=sequence.delete(F.lit("ABCD"), F.lit(0)), c=sequence.insert(F.lit("AB"), F.lit(2), F.lit("Z")))
    assert (r.a, r.b, r.c) == ("AXCD", "BCD", "ABZ")


def test_probabilities(spark):
    xs = [0.3, -1.0, 2.0, 0.5]
    p = np.exp(xs) / np.exp(xs).sum()
    col = F.array(*map(F.lit, xs))
    r = one(spark, p=numeric.softmax(col), ce=numeric.cross_entropy(col, F.lit(2)), k=numeric.top_k_top_p(col, k=2), q=numeric.top_k_top_p(col, p=0.5))
    assert np.allclose(r.p, p) and math.isclose(r.ce, -math.log(p[2]))
    assert [x is None for x in r.k] == [True, True, False, False]
    assert [x is None for x in r.q] == [True, True, False, True]


def test_quantisers_round_trip(spark):
    levels = (8, 5, 5, 5)
    df = spark.range(1000).select("id", numeric.fsq_index(numeric.fsq_levels(F.col("id"), levels), levels).alias("b"), numeric.bits_to_index(numeric.index_to_bits(F.col("id"), 10)).alias("c"))
    assert df.filter("id <> b OR id <> c").count() == 0


def test_trim(spark):
    df = spark.createDataFrame([([10.0, 80.0, 20.0, 90.0, 5.0],), ([1.0, 2.0],), ([],)], "c array<double>")
    span = corpus.trim_to(F.col("c"), lambda x: x > 50)
    assert [r.t for r in df.select(corpus.trimmed(F.col("c"), span).alias("t")).collect()] == [[80.0, 20.0, 90.0], [], []]


def test_islands(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 9, 10)] + [("b", 5)], "k string, i int")
    assert sorted(tuple(r) for r in corpus.islands(df, ["k"], "i").select("k", "start", "end").collect()) == [("a", 1, 3), ("a", 7, 7), ("a", 9, 10), ("b", 5, 5)]


def test_fold_never_breaks_a_bound():
    rnd = random.Random(5)
    for _ in range(200):
        lengths = [rnd.randint(1, 120) for _ in range(rnd.randint(0, 60))]
        got = batching.fold(lengths, 300, 9000, 5)
        assert len(got) == len(lengths)
        for b in {x for x in got if x is not None}:
            mine = [n for n, x in zip(lengths, got) if x == b]
            assert len(mine) * max(mine) <= 300 and len(mine) * max(mine) ** 2 < 9000 and len(mine) <= 5
        assert all(n > 300 or n * n >= 9000 for n, x in zip(lengths, got) if x is None)


def test_sortish_deals_evenly(spark):
    df = spark.range(103).select(F.col("id").alias("k"), (F.col("id") % 17).cast("int").alias("n"))
    out = batching.sortish(df, "k", "n", 10, 4, 1)
    assert {r["count"] for r in out.groupBy("replica").count().collect()} == {26}
    assert out.select("k").distinct().count() == 103


def test_diverse_rows_takes_the_far_ones(spark):
    df = spark.createDataFrame([("m", 0, "AAAA"), ("m", 1, "AAAB"), ("m", 2, "CCCC")], "g string, i int, s string")
    assert [r.i for r in sampling.diverse_rows(df, ["g"], "i", "s", 2).orderBy("step").collect()] == [0, 2]


def _cloud(seed, n=12):
    return np.random.default_rng(seed).normal(size=(n, 3)) * 5


def _frame(spark, p, q):
    return spark.createDataFrame([(1, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(p, q))], "entry int, idx int, x double, y double, z double, px double, py double, pz double")


def test_metrics_ignore_rigid_motion(spark):
    p = _cloud(1)
    angle = 0.7
    rot = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    moved = _frame(spark, p, p @ rot.T + [3.0, -2.0, 9.0])
    pairs = geometry.two_model_pairs(moved)
    assert geometry.drmsd(pairs).first().drmsd < 1e-9
    assert geometry.lddt(pairs).first().lddt > 1 - 1e-9
    assert geometry.aligned(moved).first().rmsd_aligned < 1e-6
    assert geometry.rmsd(moved).first().rmsd > 1
    mirrored = _frame(spark, p, p * [1, 1, -1])
    assert geometry.aligned(mirrored).first().rmsd_aligned > 0.5
    assert geometry.aligned(mirrored, reflect=True).first().rmsd_aligned < 1e-6


def test_radius_join_finds_all(spark):
    p = _cloud(3, 60)
    df = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(p)], "id int, x double, y double, z double")
    got = {(r.l_id, r.r_id) for r in geometry.radius_join(df.withColumnRenamed("id", "l_id"), df.withColumnRenamed("id", "r_id"), 2.5).collect()}
    want = {(i, j) for i in range(60) for j in range(60) if np.linalg.norm(p[i] - p[j]) <= 2.5}
    assert got == want


def test_grammar(spark):
    ok = ["<seq>", "A", "</seq>", "<struct>", "<|s0001|>", "</struct>", "<eos>"]
    df = spark.createDataFrame([(ok,), (ok[:-1],), (["<seq>", "<|s0001|>", "</seq>", "<eos>"],), (ok + ["A"],)], "t array<string>")
    assert [r.g for r in df.select(sequence.grammatical(F.col("t")).alias("g")).collect()] == [True, False, False, False]


def test_pocket_alignment(spark):
    p = _cloud(7)
    angle = 1.1
    rot = np.array([[1, 0, 0], [0, math.cos(angle), -math.sin(angle)], [0, math.sin(angle), math.cos(angle)]])
    q = p @ rot.T + [1.0, 2.0, 3.0]
    df = _frame(spark, p, q).withColumn("pocket", F.col("idx") < 6).withColumn("ligand", F.col("idx") >= 6)
    assert geometry.pocket_rmsd(df, "pocket", "ligand").first().pocket_rmsd < 1e-6
    q[6:] += [0.0, 0.0, 2.0]
    assert abs(geometry.pocket_rmsd(_frame(spark, p, q).withColumn("pocket", F.col("idx") < 6).withColumn("ligand", F.col("idx") >= 6), "pocket", "ligand").first().pocket_rmsd - 2.0) < 1e-6
