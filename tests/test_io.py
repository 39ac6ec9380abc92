import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from helixmill.sinks import writers
from helixmill.sources import structures, text
from helixmill.streaming import streams

PDB = "\n".join(
    f"{kind:<6}{i:>5} {atom:^4}{alt}{res} {chain}{num:>4}{ic}   {x:8.3f}{1.0:8.3f}{2.0:8.3f}{1.0:6.2f}{b:6.2f}"
    for i, (kind, atom, alt, res, chain, num, ic, x, b) in enumerate(
        [("ATOM", "N", " ", "ALA", "A", 5, " ", 0.5, 90), ("ATOM", "CA", "A", "ALA", "A", 5, " ", 1.5, 90), ("ATOM", "CA", "B", "ALA", "A", 5, " ", 9.5, 90), ("HETATM", "CA", " ", "MSE", "A", 6, "A", 2.5, 80), ("HETATM", "O", " ", "HOH", "A", 90, " ", 3.0, 10), ("ATOM", "CA", " ", "GLY", "B", 1, " ", 4.5, 70)]
    )
)
CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.B_iso_or_equiv
ATOM CA ALA A 1 1.0 2.0 3.0 88.0
ATOM "O5'" GLY A 2 1.5 2.5 3.5 77.0
#
"""


def test_structures(spark, tmp_path):
    (tmp_path / "AF-q.pdb").write_text(PDB)
    (tmp_path / "c.cif.gz").write_bytes(gzip.compress(CIF.encode()))
    (tmp_path / "bad.pdb").write_text("ATOM  nonsense")
    atoms, errors = structures.parse(structures.read_files(spark, str(tmp_path)))
    assert [r.entry for r in errors.collect()] == ["bad"]
    clean = structures.polymer(atoms)
    assert clean.filter("entry = 'AF-q'").count() == 4  # one alternative, no water
    seqs = {(r.entry, r.chain): (r.seq, r.plddt) for r in structures.sequences(structures.residues(clean)).collect()}
    assert seqs[("AF-q", "A")] == ("AM", 85.0) and seqs[("AF-q", "B")] == ("G", 70.0) and seqs[("c", "A")] == ("AG", 0.0)
    meta = {r.entry: r.quaternary_category for r in structures.metadata(structures.sequences(structures.residues(clean))).collect()}
    assert meta == {"AF-q": "heteromer", "c": "homomer"}


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "p.tar", "w") as tar:
        for name in ("AF-A-F1-model_v4.cif.gz", "other.txt"):
            data = gzip.compress(CIF.encode())
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "broken.tar").write_bytes(b"no tar")
    assert [r.path for r in structures.source(spark, "afdb", str(tmp_path)).collect()] == ["AF-A-F1-model_v4.cif.gz"]
    with pytest.raises(ValueError):
        structures.source(spark, "nowhere", str(tmp_path))


def test_pdb_round_trip(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    atoms = structures.polymer(structures.parse(structures.read_files(spark, str(tmp_path)))[0])
    out = writers.pdb_text(atoms).first().text
    assert all(len(x) == 80 for x in out.split("\n")[:-1]) and out.count("TER") == 2
    again = list(structures.parse_pdb(out))
    assert len(again) == atoms.count() and {a[7] for a in again} == {r.x for r in atoms.collect()}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nACD\nEF\n>\nGG\n>two\nA-c.D\n")
    rows = {r.header: r.seq for r in text.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert rows["one x"] == "ACDEF" and rows["two"] == "A-c.D" and len(rows) == 3 and any(h.startswith("seqnum") for h in rows)
    (tmp_path / "empty.fasta").write_text("")
    assert text.read_fasta(spark, str(tmp_path / "empty.fasta")).count() == 0
    (tmp_path / "dup.fasta").write_text(">a\nA\n>a\nC\n")
    with pytest.raises(Exception, match="duplicate label"):
        text.read_fasta(spark, str(tmp_path / "dup.fasta")).collect()
    (tmp_path / "m.a3m").write_text(">a\nACaD\n>b\nA-D\n")
    assert [r.seq for r in text.read_msa(spark, str(tmp_path / "m.a3m")).orderBy("ordinal").collect()] == ["ACD", "A-D"]


def test_fasta_sink(spark, tmp_path):
    df = spark.createDataFrame([("h", "ACD")], "h string, s string")
    writers.write_fasta(df, str(tmp_path / "o"), F.col("h"), F.col("s"))
    assert [(r.header, r.seq) for r in text.read_fasta(spark, str(tmp_path / "o")).collect()] == [("h", "ACD")]


def test_parts_and_status(spark, tmp_path):
    writers.write_parts(spark.range(25).coalesce(1), str(tmp_path / "p"), 10, split="train")
    files = list((tmp_path / "p").glob("*.parquet"))
    assert len(files) == 3 and spark.read.parquet(str(tmp_path / "p")).filter("split = 'train'").count() == 25
    rows = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "k string, error string")
    got = {r.k: r.status for r in writers.new_rows(rows, spark.createDataFrame([("c",)], "k string"), "k").collect()}
    assert got == {"a": "success", "b": "failed", "c": "skipped"}


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(src).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), schema, files=1)
    for _ in range(2):  # a second run adds nothing
        streams.upsert(stream, "event_id", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(src).select("event_id").distinct().count()
    timed = streams.event_time(stream, "ts", "1 hour")
    streams.drain(streams.windowed(timed, "ts", "1 hour", None, ["event_type"], n=F.count("*")), str(tmp_path / "w"), str(tmp_path / "cw"))
    assert spark.read.parquet(str(tmp_path / "w")).count() > 0
    unique = streams.distinct_events(timed.select("ts", "user_id"), ["user_id"])
    streams.drain(unique, str(tmp_path / "u"), str(tmp_path / "cu"))
    assert spark.read.parquet(str(tmp_path / "u")).count() > 0


def test_backbone_and_residue_coordinates(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    atoms = structures.parse(structures.read_files(spark, str(tmp_path)))[0]
    assert structures.backbone(atoms, ["B"]).count() == 1
    with pytest.raises(Exception, match="missing chains"):
        structures.backbone(atoms, ["Z"]).collect()
    rows = {(r.chain, r.res_idx): r for r in structures.by_residue(structures.polymer(atoms)).collect()}
    assert rows[("A", 5)].N.x == 0.5 and rows[("A", 5)].C is None
    with pytest.raises(Exception, match="duplicate atom CA"):
        structures.by_residue(atoms.filter("resname = 'ALA'")).collect()


def test_trajectory(spark):
    df = spark.createDataFrame([("s", "step_10", "B"), ("s", "step_9", "A")], "k string, n string, t string")
    assert writers.trajectory_text(df, ["k"], "n", "t").first().text == "MODEL     1\nA\nENDMDL\nMODEL     2\nB\nENDMDL\nEND"
