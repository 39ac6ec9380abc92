"""Cluster listings, mmCIF text, patches, motifs, joint vocabularies and batch defaults on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import sequence
from helixmill.operators import batching, geometry, tokenizer
from helixmill.session import ATOMS
from helixmill.sinks import writers
from helixmill.sources import structures, text

RULE = "INFO  : ======================================\n"
HEAD = "INFO  : Item     Cluster\n"


def test_listings_of_a_log(spark, tmp_path):
    (tmp_path / "one.log").write_text(f"INFO  : 1 : 2 not/this\n{RULE}INFO  : 2 Clusters\n{HEAD}INFO  :     1 :        3  a/x.pdb\nINFO  :     2 :       12  a/y.pdb\n{RULE}INFO  : Centroids\nINFO  : 1 : 5 nor/this\n{RULE}")
    (tmp_path / "two.log").write_text(f"{HEAD}INFO  :     1 :        1  b/z.pdb\n")
    (tmp_path / "empty.log").write_text("")
    got = {(r.file[-7:], r.cluster, r.path) for r in text.read_clusters(spark, f"{tmp_path}/*.log").collect()}
    assert got == {("one.log", 3, "a/x.pdb"), ("one.log", 12, "a/y.pdb"), ("two.log", 1, "b/z.pdb")}
    (tmp_path / "bad").write_text(f"{HEAD}INFO  :     1 :        1  b/z.pdb\nsomething else\n{RULE}")
    with pytest.raises(Exception, match="not a line of a listing"):
        text.read_clusters(spark, f"{tmp_path}/bad").collect()


def test_mmcif_text_reads_back(spark, tmp_path):
    rows = [
        ("1abc", 1, "A", 1, "", "ALA", "N", "", 1.25, -2.5, 3.0, 10.0, False),
        ("1abc", 1, "A", 2, "B", "DA", "O5'", "", 0.0, 0.0, 100.125, 20.5, False),
        ("1abc", 1, "data_x", 3, "", "LIG", 'C1"', "A", 1.0, 2.0, 3.0, 0.0, True),
        ("1abc", 2, "#", 1, None, "ALA", "CA", None, 9.0, 9.0, 9.0, 1.0, False),
    ]
    out = writers.mmcif_text(spark.createDataFrame(rows, ATOMS)).first()
    assert out.text.startswith("data_1abc\n_entry.id 1abc\n") and "\"O5'\"" in out.text and "'data_x'" in out.text
    (tmp_path / "1abc.cif").write_text(out.text)
    atoms, errors = structures.parse(structures.read_files(spark, str(tmp_path)))
    keys = ("model", "chain", "res_idx", "icode", "resname", "atom", "altloc", "x", "y", "z", "bfactor", "hetatm")
    got = sorted(tuple(r[k] or ("" if k in ("icode", "altloc") else r[k]) for k in keys) for r in atoms.collect())
    assert got == sorted(tuple("" if v is None else v for v in r[1:]) for r in rows) and errors.count() == 0
    impossible = spark.createDataFrame([("e", 1, "A", 1, "", "ALA", "a'b\"c", "", 0.0, 0.0, 0.0, 0.0, False)], ATOMS)
    with pytest.raises(Exception, match="no mmCIF form"):
        writers.mmcif_text(impossible).collect()


@pytest.mark.parametrize("n", [1, 4, 5])
def test_patches_are_the_padded_matrix(spark, n):
    at = np.random.default_rng(n).normal(size=(n, 3))
    rows = spark.createDataFrame([("e", i, *map(float, p)) for i, p in enumerate(at)], "entry string, idx int, x double, y double, z double")
    wide = -(-n // 4) * 4
    want = np.zeros((wide, wide, 3))
    want[:n, :n] = (at[:, None] - at[None]) / 3
    got = np.zeros_like(want)
    found = geometry.patches(rows, 4, scale=3.0).collect()
    for r in found:
        got[4 * r.i : 4 * r.i + 4, 4 * r.j : 4 * r.j + 4] = np.array(r.cells).reshape(4, 4, 3)
    assert len(found) == (wide // 4) ** 2 and np.allclose(got, want)


def test_motifs_keep_their_order_and_spacers_their_interval(spark):
    rows = [(i, s) for i, s in enumerate([["AC", "D", "EFG"], ["K"], [], ["", ""]] * 30)]
    df = spark.createDataFrame(rows, "k int, s array<string>")
    gaps = sequence.spacers(F.size("s"), lambda i: (i * 2).cast("int"), lambda i: (i * 2 + 3).cast("int"), "seed", F.col("k"))
    got = df.withColumn("g", gaps).withColumn("t", sequence.assembled(F.col("s"), F.col("g"), "#")).collect()
    for r in got:
        assert len(r.g) == max(len(r.s) - 1, 0) and all(2 * i <= g <= 2 * i + 3 for i, g in enumerate(r.g))
        assert r.t == "".join(("#" * r.g[i - 1] if i else "") + s for i, s in enumerate(r.s))
    assert len({r.g[0] for r in got if len(r.s) == 3}) == 4


def test_joint_vocabulary(spark):
    vocabulary = ["<cls_aa>", "<pad>", "<eos_aa>", "<unk_aa>", "A", "C", "<mask_aa>", "<cls_struct>", "<eos_struct>", "<unk_struct>", "<mask_struct>", "0000", "0001"]
    df = spark.createDataFrame([(1, ["A", "Z", None, "<mask_aa>"]), (2, []), (3, None)], "k int, t array<string>")
    got = {r.k: (r.a, r.s) for r in df.select("k", tokenizer.modal_ids(vocabulary, "aa")("t").alias("a"), tokenizer.modal_ids(vocabulary, "struct")("t").alias("s")).collect()}
    assert got[1] == ([0, 4, 3, 3, 6, 2], [7, 4, 9, 9, 6, 8]) and got[2] == got[3] == ([0, 2], [7, 8])
    with pytest.raises(ValueError, match="<mask_struct>"):
        tokenizer.modal_ids(vocabulary[:10] + vocabulary[11:], "struct")


def test_defaults_hold_both_budgets(spark):
    df = spark.createDataFrame([(i, (i * 37) % 900) for i in range(1200)], "k long, n int")
    rows = batching.assembled(df, "k", "n").collect()
    assert len(rows) == 1200 and max(r.bucket for r in rows) == 1
    by = {}
    for r in rows:
        by.setdefault((r.bucket, r.batch), []).append(min(r.n, 512))
    assert all(len(b) <= 800 and len(b) * max(b) <= 6000 and len(b) * max(b) ** 2 < 1_000_000 for b in by.values())
