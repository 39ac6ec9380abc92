"""The corpus job, killed and rerun; archives as a data source; structure categories, selectors and features."""

import gzip
import io
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import mmcif
from helixmill.jobs import ingest
from helixmill.sources import archives, structures, text

# --- the corpus job


def prepare(lines):
    row = F.from_json("value", "id long, text string")
    rows = lines.select(row["id"].alias("id"), row["text"].alias("text"))
    return rows.withColumn("error", F.when(F.col("id").isNull(), "parse_error").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no_sequence"))


def source_of(tmp_path, n, first=0, files=6):
    (tmp_path / "in").mkdir(exist_ok=True)
    for k in range(files):
        lines = ["not json" if i % 7 == 3 else f'{{"id": {i}, "text": "{"" if i % 5 == 0 else "x" * (i % 4 + 1)}"}}' for i in range(first, first + n) if i % files == k]
        (tmp_path / "in" / f"f{first}-{k}.json").write_text("\n".join(lines) + "\n")
    return f"{tmp_path}/in/*.json", f"{tmp_path}/out"


def batches_of(spark, pattern):
    return ingest.by_files(spark, pattern, lambda paths: spark.read.text(paths), 3)


def good(n, first=0):
    return sorted(i for i in range(first, first + n) if i % 7 != 3 and i % 5)


def test_job_once_and_again(spark, tmp_path):
    pattern, out = source_of(tmp_path, 60)
    first = ingest.run(spark, batches_of(spark, pattern), out, "id", prepare, F.col("id") % 2, part_rows=4)
    assert len(first) == len(batches_of(spark, pattern))
    assert sorted(r.id for r in ingest.published(spark, out).collect()) == good(60)
    assert {(r.id, r.fan) for r in ingest.published(spark, out).collect()} == {(i, i % 2) for i in good(60)}
    status = {r.status: r["count"] for r in ingest.statuses(spark, out, "id", first).groupBy("status").count().collect()}
    assert status == {"success": len(good(60)), "failed": 60 - len(good(60))}
    assert {r.error: r["count"] for r in ingest.rejects(spark, out).groupBy("error").count().collect()} == {"parse_error": 9, "no_sequence": sum(i % 5 == 0 and i % 7 != 3 for i in range(60))}
    largest = max(len(spark.read.parquet(os.path.join(d, f)).collect()) for d, _, names in os.walk(out) for f in names if f.endswith(".parquet"))
    assert largest <= 4
    assert ingest.run(spark, batches_of(spark, pattern), out, "id", prepare) == []  # nothing is left to do
    assert {r.status for r in ingest.statuses(spark, out, "id", []).collect()} == {"skipped", "failed"}


@pytest.mark.parametrize("at", ["write", "manifest", "publish"])
def test_job_killed_and_rerun(spark, tmp_path, monkeypatch, at):
    """Wherever it is killed, what is published is whole, and a rerun publishes each record once."""
    pattern, out = source_of(tmp_path, 60)
    calls = {"n": 0}
    name = {"write": "write", "manifest": "write", "publish": "publish"}[at]
    real = getattr(ingest._Store, name)

    def dies(self, *a):
        calls["n"] += 1
        if calls["n"] == 2:
            if at == "manifest":  # a manifest that is cut off
                real(self, a[0], a[1][:10])
            raise KeyboardInterrupt
        return real(self, *a)

    monkeypatch.setattr(ingest._Store, name, dies)
    with pytest.raises(KeyboardInterrupt):
        ingest.run(spark, batches_of(spark, pattern), out, "id", prepare)
    monkeypatch.undo()
    done = ingest.manifests(spark, out)
    assert len(done) == 1 and len(ingest.published(spark, out).collect()) == done[0].good
    new = ingest.run(spark, batches_of(spark, pattern), out, "id", prepare)
    assert len(new) == len(batches_of(spark, pattern)) - 1
    assert sorted(r.id for r in ingest.published(spark, out).collect()) == good(60)
    status = ingest.statuses(spark, out, "id", new).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in status}["skipped"] == done[0].good
    ingest.sweep(spark, out)
    assert not os.path.exists(f"{out}/attempts") and sorted(r.id for r in ingest.published(spark, out).collect()) == good(60)


def test_job_grows_by_generations(spark, tmp_path):
    pattern, out = source_of(tmp_path, 40)
    ingest.run(spark, batches_of(spark, pattern), out, "id", prepare)
    source_of(tmp_path, 30, first=30)  # ten records again, twenty new ones
    new = ingest.run(spark, batches_of(spark, pattern), out, "id", prepare)
    assert new and any(m.generation for m in ingest.manifests(spark, out))
    ids = [r.id for r in ingest.published(spark, out).collect()]
    assert set(ids) == set(good(60))
    assert ingest.run(spark, batches_of(spark, pattern), out, "id", prepare) == []


def test_job_two_runs_publish_once(spark, tmp_path):
    pattern, out = source_of(tmp_path, 20)
    other = []

    def meanwhile(lines):
        if not other:
            other.append(None)
            other[0] = ingest.run(spark, batches_of(spark, pattern), out, "id", prepare)
        return prepare(lines)

    mine = ingest.run(spark, batches_of(spark, pattern), out, "id", meanwhile)
    assert other[0] and len(ingest.published(spark, out).collect()) == len(good(20))
    assert not set(mine) & set(other[0])


def test_job_clears_and_takes_nothing(spark, tmp_path):
    pattern, out = source_of(tmp_path, 20)
    ingest.run(spark, batches_of(spark, pattern), out, "id", prepare, clear=True)
    assert not os.listdir(tmp_path / "in") or all(f.endswith(".crc") for f in os.listdir(tmp_path / "in"))
    assert ingest.run(spark, [], out + "2", "id", prepare) == [] and ingest.published(spark, out + "2") is None and ingest.statuses(spark, out + "2", "id", []) is None


# --- archives


def tar_of(path, members, end=True):
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    if not end:
        size = sum(512 + -(-len(d) // 512) * 512 for _, d in members)
        os.truncate(path, size)


def test_archive_over_two_gigabytes(spark, tmp_path):
    """A huge member costs a seek; those behind it are read, by several ranges."""
    with open(tmp_path / "big.tar", "wb") as f:
        def add(name, size, data=b""):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf(tarfile.GNU_FORMAT))
            f.write(data)
            f.seek(-(-size // 512) * 512 - len(data), os.SEEK_CUR)
        add("a.txt", 5, b"first")
        add("huge.bin", (2 << 30) + 1000)
        for i in range(20):
            add(f"n{i}.txt", 600, bytes([65 + i]) * 600)
        f.write(b"\0" * 1024)
    rows = archives.scan(spark, str(tmp_path), rangeBytes=2000)
    assert rows.rdd.getNumPartitions() > 3
    got = {r.member: r for r in rows.collect()}
    assert got["a.txt"].content == b"first" and bytes(got["n19.txt"].content) == b"T" * 600 and len(got) == 22
    assert got["huge.bin"].error == "too large" and got["huge.bin"].content is None and got["huge.bin"].size == (2 << 30) + 1000


@pytest.mark.parametrize("range_bytes", [1, 1 << 20])
def test_archives_that_are_broken(spark, tmp_path, range_bytes):
    members = [(f"m{i}.txt", bytes([97 + i]) * (i * 300)) for i in range(6)]
    tar_of(tmp_path / "good.tar", [*members, ("x" * 150 + "/long.txt", b"long name")])
    tar_of(tmp_path / "cut.tar", members)
    os.truncate(tmp_path / "cut.tar", 4000)
    tar_of(tmp_path / "open.tar", members, end=False)
    data = bytearray((tmp_path / "good.tar").read_bytes())
    data[1536:1600] = b"\xff" * 64  # the third header
    (tmp_path / "bad.tar").write_bytes(data)
    (tmp_path / "no.tar").write_bytes(b"no tar" * 200)
    (tmp_path / "empty.tar").write_bytes(b"")
    rows = archives.scan(spark, str(tmp_path), ".txt", rangeBytes=range_bytes).collect()
    of = lambda name: [r for r in rows if r.archive.endswith("/" + name)]
    assert {r.member: bytes(r.content) for r in of("good.tar")} == dict([*members, ("x" * 150 + "/long.txt", b"long name")])
    assert [r.error for r in of("cut.tar") if r.error] == ["truncated"] and {r.member for r in of("cut.tar") if not r.error} < {m for m, _ in members}
    assert [r.error for r in of("open.tar") if r.error] == ["no end mark"] and len(of("open.tar")) == 7
    assert [r.error for r in of("bad.tar") if r.error] == ["broken header"] and {r.member for r in of("bad.tar") if not r.error} == {"m0.txt", "m1.txt"}
    assert [r.error for r in of("no.tar")] == ["no tar archive"] and [r.error for r in of("empty.tar")] == ["no tar archive"]
    small = archives.members(spark, str(tmp_path), ".txt").collect()
    key = lambda r: (r.archive.rsplit("/", 1)[1], r.member or "", r.error or "", r.size or 0)
    assert sorted(map(key, small)) == sorted(key(r) for r in rows if "empty" not in r.archive)  # Spark has no row for a file without bytes
    assert {r.error for r in structures.tar_rejects(spark, str(tmp_path)).collect()} == {"truncated", "no end mark", "broken header", "no tar archive"}


def test_extract_and_skip(spark, tmp_path):
    tar_of(tmp_path / "a.tar", [("d/x.txt", b"x"), ("d/y.txt", b"y"), ("../out.txt", b"no")])
    (tmp_path / "to/d").mkdir(parents=True)
    (tmp_path / "to/d/x.txt").write_bytes(b"there")
    found = archives.scan(spark, str(tmp_path))
    assert {r.member: r.status for r in archives.extract(found, str(tmp_path / "to")).collect()} == {"d/x.txt": "skipped", "d/y.txt": "success", "../out.txt": "failed"}
    assert (tmp_path / "to/d/x.txt").read_bytes() == b"there" and (tmp_path / "to/d/y.txt").read_bytes() == b"y" and not (tmp_path / "out.txt").exists()


# --- structure files


def cif_of(resolution="1.8", chains=(("A", "X"), ("B", "Y")), residues=("ALA", "GLY"), extra=""):
    rows = "\n".join(f"ATOM {atom} {res} {label} {auth} {i + 1} {i}.0 {k}.5 2.0 50.0" for auth, label in chains for i, res in enumerate(residues) for k, atom in enumerate(("N", "CA")))
    names = "group_PDB label_atom_id label_comp_id label_asym_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z B_iso_or_equiv".split()
    return f"""data_t
# a comment
_struct.title
;a title
_atom_site.not_an_item loop_ 'quoted
;
_exptl.method 'SOLUTION O'NEILL'
_refine.ls_d_res_high {resolution}
loop_
_pdbx_struct_assembly.id
_pdbx_struct_assembly.oligomeric_count
_pdbx_struct_assembly.oligomeric_details
1 2 "Dimeric"
2 4
;Tetra
meric
;
{extra}loop_
""" + "\n".join(f"_atom_site.{n}" for n in names) + "\n" + rows + "\n#\n"


def test_categories():
    cats = mmcif.categories(cif_of())
    assert cats["_struct"]["title"] == ["a title\n_atom_site.not_an_item loop_ 'quoted"]
    assert mmcif.header(cats) == (1.8, "solution o'neill", "2,4", "dimeric,tetra\nmeric")
    assert cats["_atom_site"]["label_asym_id"] == ["X"] * 4 + ["Y"] * 4
    assert mmcif.header(mmcif.categories("data_a\n_refine.ls_d_res_high ?\n_em_3d_reconstruction.resolution 3.2"))[0] == 3.2
    assert mmcif.categories("data_a\nloop_\n_c.x\n_c.y\n1 '_q.z'\n\"#3\" a'b\n_d.e f\ndata_b\n_g.h 1") == {"_c": {"x": ["1", "#3"], "y": ["_q.z", "a'b"]}, "_d": {"e": ["f"]}}
    for broken in ("data_a\nloop_\n_c.x\n_c.y\n1 2 3", "data_a\n_c.x\n;never ends\n", "data_a\n_c.x 'open\n", "data_a\n5"):
        with pytest.raises(ValueError):
            mmcif.categories(broken)


def files_of(spark, files):
    return spark.createDataFrame([(f"s/{n}", c.encode() if isinstance(c, str) else c) for n, c in files.items()], "path string, content binary")


def test_five_reject_reasons(spark):
    files = files_of(spark, {
        "ok.cif": cif_of(), "gz.cif.gz": gzip.compress(cif_of(residues=("ALA", "TRP", "LYS")).encode()), "low.cif": cif_of("9.5"), "none.cif": cif_of("?"), "unk.cif": cif_of(residues=("UNK", "UNK")),
        "long.cif": cif_of(residues=("ALA",) * 30), "cut.cif": cif_of() + "loop_\n_a.b\n_a.c\n1 2 3", "water.cif": cif_of(residues=("HOH",)), "notgz.cif.gz": b"plain",
    })
    atoms, errors = structures.parse(files)
    assert {r.entry for r in errors.collect()} == {"cut", "notgz"}
    seqs = structures.sequences(structures.residues(structures.polymer(atoms)))
    meta = {r.entry: r for r in structures.metadata(seqs, 50, structures.headers(files), 9.0).collect()}
    assert {k: v.reject for k, v in meta.items()} == {
        "ok": None, "gz": None, "low": "resolution_too_low", "none": "no_resolution", "unk": "no_residues", "long": "too_long", "cut": "parse_error", "water": "no_residues", "notgz": "parse_error",
    }
    assert set(structures.REJECTS) == {v.reject for v in meta.values() if v.reject}
    assert (meta["ok"].num_chains, meta["ok"].resolution, meta["ok"].oligomeric_count, meta["gz"].seq_len) == (2, 1.8, "2,4", 6)


def test_chain_selectors(spark):
    atoms, _ = structures.parse(files_of(spark, {"p.cif": cif_of(), "q.cif": cif_of(chains=(("X", "A"),))}))
    specs = spark.createDataFrame([("p@B",), ("p%X%Y",), ("q",), ("p@A@Z",), ("q%X",), ("gone",)], "spec string")
    found, missing = structures.select_chains(atoms, specs)
    got = {}
    for r in found.collect():
        got.setdefault(r.spec, set()).add((r.chain, r.label_chain))
    assert got == {"p@B": {("B", "Y")}, "p%X%Y": {("A", "X"), ("B", "Y")}, "q": {("X", "A")}, "p@A@Z": {("A", "X")}}
    assert {r.spec: r.missing for r in missing.collect()} == {"p@A@Z": ["Z"], "q%X": ["X"], "gone": ["*"]}


def test_slots_and_chain_features(spark):
    atoms, _ = structures.parse(files_of(spark, {"p.cif": cif_of(residues=("GLY", "ALA", "TRP"))}))
    slots = structures.atom37(structures.residues(structures.polymer(atoms)))
    row = slots.filter("chain = 'A' AND ordinal = 2").first()
    assert len(row.positions) == len(row.mask) == 37 and row.mask[:3] == [1.0, 1.0, 0.0] and row.positions[1] == [2.0, 1.5, 2.0] and row.positions[5] == [0.0] * 3
    assert [r.chain for r in structures.chain_features(slots).collect()] == ["A"]
    assert sorted(r.chain for r in structures.chain_features(slots, None).collect()) == ["A", "B"]
    f = structures.chain_features(slots, ["A", "B"], scale=2.0).filter("chain = 'B'").first()
    ca = np.array([[i, 1.5, 2.0] for i in range(3)])
    want = (ca - ca.sum(axis=0) / (3 + 1e-5)) / 2.0
    assert np.allclose(f.bb_positions, want) and f.bb_mask == [1.0] * 3 and f.residue_index == [1, 2, 3] and f.aatype == [7, 0, 17]
    assert np.allclose(np.array(f.atom_positions)[:, 2:], 0)


def test_listed_sources(spark, tmp_path):
    for n in ("a.cif", "b.cif", "c.pdb"):
        (tmp_path / n).write_text(cif_of())
    names = lambda name: sorted(r.path.rsplit("/", 1)[1] for r in structures.source(spark, name, str(tmp_path)).collect())
    assert names("rcsb") == ["a.cif", "b.cif"]
    (tmp_path / "file_list.txt").write_text(f"b.cif\n\n{tmp_path}/c.pdb\n")
    assert names("rcsb") == ["b.cif", "c.pdb"]
    with pytest.raises(ValueError):
        structures.source(spark, "cameo", str(tmp_path))
    (tmp_path / "fpath.txt").write_text("a.cif\n")
    assert names("cameo") == ["a.cif"]


def test_fasta_over_blocks(spark, tmp_path):
    """Places and lines go on from block to block of a file."""
    rows = [(f"h{i}" if i % 50 else "", "ACDEF" * (i % 9 + 1)) for i in range(400)]
    (tmp_path / "a.fasta").write_text("".join(f">{h}\n{s}\n{s}\n" for h, s in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = text.read_fasta(spark, str(tmp_path))
        assert df.select("ordinal").count() == 400
        got = df.orderBy("ordinal").collect()
        (tmp_path / "b.fasta").write_text(">x\nA\n" * 2)
        with pytest.raises(Exception, match="duplicate label"):
            text.read_fasta(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.ordinal, r.seq) for r in got] == [(i, s + s) for i, (_, s) in enumerate(rows)]
    assert [r.header for r in got] == [h or f"seqnum{3 * i:09d}" for i, (h, _) in enumerate(rows)]
