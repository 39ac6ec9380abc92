import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import numeric, sequence
from helixmill.operators import geometry as G
from helixmill.operators.score import scored
from helixmill.sources import tables


def test_json_rows_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "ACD", "n": 3}\nnot json\n{"text": null}\n')
    rows, broken = tables.read_rows(spark, str(tmp_path / "in"), "text string, n int")
    assert sorted((r.text or "", r.n) for r in rows.collect()) == [("", None), ("ACD", 3)]
    assert [r.line for r in broken.collect()] == ["not json"]
    rows, _ = tables.read_rows(spark, str(tmp_path / "in"), "text string, n int", stream=True, files=1)
    rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_splits(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("".join(json.dumps({"name": n, "seq": s}) + "\n" for n, s in (("a", "AC"), ("b", "ACDEFG"), ("c", "A"), ("d", "G"))))
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b", "a"], "validation": [], "test": ["c", "nobody"]}, indent=1))
    rows = tables.read_splits(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "s.json"), "name string, seq string", longest=5, length="seq")
    assert sorted((r.name, r.split) for r in rows.collect()) == [("a", "train"), ("c", "test")]


def test_metric_and_metadata_files(spark, tmp_path):
    for length in (100, 200):
        (tmp_path / f"length_{length}").mkdir()
        (tmp_path / f"length_{length}" / "top.csv").write_text(f"name,tm\nx,{length / 1000}\n")
    rows = tables.read_metrics(spark, str(tmp_path / "*" / "top.csv"), r"length_(\d+)", "name string, tm double")
    assert sorted((r.key, r.tm) for r in rows.collect()) == [("100", 0.1), ("200", 0.2)]
    (tmp_path / "m.csv").write_text("id,raw_path,processed_path\n1,a.pdb,/abs/a.pkl\n2,,b.pkl\n")
    got = [(r.raw_path, r.processed_path) for r in tables.read_metadata(spark, str(tmp_path / "m.csv"), "id int, raw_path string, processed_path string", "/root/").orderBy("id").collect()]
    assert got == [("/root/a.pdb", "/abs/a.pkl"), (None, "/root/b.pkl")]


def test_merge_skips_broken_parts(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "zz-broken.parquet").write_bytes(b"no parquet at all")
    rows = tables.merge_parts(spark, str(tmp_path / "p"), "train")
    assert sorted(r.id for r in rows.collect()) == list(range(5)) and rows.filter("split = 'train'").count() == 5


def test_scorer_gets_its_own_model(spark):
    def load(k):
        import pyarrow.compute as pc

        return lambda: lambda batch: [pc.multiply(batch.column(0), k)]

    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, other string")
    for k in (2, 3):
        assert sorted(r.y for r in scored(df, f"times-{k}", load(k), ["id"], "y long").collect()) == [k, 2 * k]


def test_mutation_needs_its_wild_type(spark):
    df = spark.createDataFrame([("AR", "R2A", [[0.0, 0.0], [0.0, 0.0], [1.5, 0.25]])], "s string, m string, p array<array<double>>")
    score = lambda s: sequence.mutation_score(F.lit(s), F.col("m"), F.col("p"), "AR")
    assert df.select(score("AR")).first()[0] == 1.25
    for wrong in ("AA", "A", ""):
        with pytest.raises(Exception, match="wild type"):
            df.select(score(wrong)).collect()


def test_likelihood_leaves_terminals_out(spark):
    x = np.random.default_rng(3).normal(size=(4, 6))
    df = spark.createDataFrame([(x.tolist(), [0, 3, 2, 1])], "l array<array<double>>, t array<int>")
    part = x[:, 2:] - np.log(np.exp(x[:, 2:]).sum(1, keepdims=True))
    want = part[0, 1] + part[1, 0]  # tokens 3 and 2 among classes 2 to 5; 1 ends the sequence
    for mean, value in ((False, want), (True, want / 2)):
        assert abs(df.select(numeric.sequence_log_likelihood(F.col("l"), F.col("t"), 2, 5, (0, 1), mean)).first()[0] - value) < 1e-9
    with pytest.raises(Exception, match="terminal"):
        df.select(numeric.sequence_log_likelihood(F.col("l"), F.array(*map(F.lit, (0, 1, 2, 3))), 2, 5, (0, 1))).collect()


def test_chain_means(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for chain in range(2):
        p, q = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
        rows += [("e", chain, i, *map(float, (*p[i], *q[i]))) for i in range(6)]
        a, b = p - p.mean(0), q - q.mean(0)
        u, s, vt = np.linalg.svd(a.T @ b)
        s[2] *= np.sign(np.linalg.det(u @ vt))
        want.append(np.sqrt(max(0, (a * a).sum() + (b * b).sum() - 2 * s.sum()) / 6))
    df = spark.createDataFrame(rows, "entry string, chain int, idx int, x double, y double, z double, px double, py double, pz double")
    got = G.chain_means(df).first()
    assert got.chains == 2 and abs(got.rmsd_aligned - np.mean(want)) < 1e-6
