"""Structure files to atoms and features: fixed-column text, mmCIF, gzip, and tar members.

Files are read as binary rows and parsed inside Arrow batches; a file that cannot be
parsed gives one row with its error instead of an exception.
"""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions import mmcif
from helixmill.functions.sequence import ATOM37, RESIDUE_NAMES, RESIDUES, stem
from helixmill.session import ATOMS
from helixmill.sources import archives
from helixmill.sources.text import read_manifest

#: Residue names that are read as another.
MODIFIED = {"MSE": "MET"}
WATER = ("HOH", "WAT", "DOD")
NUCLEIC = ("A", "C", "G", "U", "DA", "DC", "DG", "DT", "DU", "N")
GLOBS = {"afdb": "*-F1-model_v4.cif.gz", "swissprot": "AF-*-F1-model_v4.cif.gz", "rcsb": "*.cif", "casp": "*.pdb"}


def parse_pdb(text: str):
    """Atom rows of fixed-column records: (model, chain, res_idx, icode, resname, atom, altloc, x, y, z, bfactor, hetatm, label chain)."""
    model = 1
    for line in text.splitlines():
        kind = line[:6].strip()
        if kind == "MODEL":
            model = int(line[10:14])
        elif kind in ("ATOM", "HETATM"):
            name, chain = line[17:20].strip(), line[21].strip()
            yield (model, chain, int(line[22:26]), line[26].strip(), MODIFIED.get(name, name), line[12:16].strip(), line[16].strip(), float(line[30:38]), float(line[38:46]), float(line[46:54]), float(line[60:66] or 0), kind == "HETATM" and name not in MODIFIED, chain)


def parse_cif(text: str):
    """Atom rows of the atom_site category of an mmCIF text."""
    return atom_site(mmcif.categories(text))


def atom_site(cats: dict):
    site = cats.get("_atom_site", {})
    n = len(site.get("Cartn_x", ()))

    def column(*names: str, default: str = ""):
        """Of each row, the first of the items that is known."""
        at = [site[x] for x in names if x in site]
        return [next((c[i] for c in at if c[i] not in (".", "?")), default) for i in range(n)]

    names = column("auth_comp_id", "label_comp_id")
    rows = zip(
        column("pdbx_PDB_model_num", default="1"), column("auth_asym_id", "label_asym_id"), column("auth_seq_id", "label_seq_id", default="0"), column("pdbx_PDB_ins_code"), names,
        column("auth_atom_id", "label_atom_id"), column("label_alt_id"), *[column(f"Cartn_{x}", default="nan") for x in "xyz"], column("B_iso_or_equiv", default="0"), column("group_PDB"), column("label_asym_id", "auth_asym_id"),
    )
    for model, chain, number, icode, name, atom, alt, x, y, z, b, group, label in rows:
        yield (int(model), chain, int(number), icode, MODIFIED.get(name, name), atom, alt, float(x), float(y), float(z), float(b), group == "HETATM" and name not in MODIFIED, label)


def _text(name: str, content: bytes) -> str:
    raw = gzip.decompress(content) if name.endswith(".gz") else content
    return raw.decode("utf-8", "replace")


#: Atoms after which a batch is given on.
ATOM_ROWS = 1 << 16


def _parse(batches):
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4, *[pa.float64()] * 4, pa.bool_(), pa.string(), pa.string()]
    names = ["file", *[f.name for f in ATOMS.fields if f.name != "entry"], "label_chain", "error"]

    def out(rows):
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            name = path.rsplit("/", 1)[-1]
            try:
                text = _text(name, content)
                atoms = [(name, *a, None) for a in (parse_cif(text) if CIF_MARK in text else parse_pdb(text))]
                rows += atoms or [(name, *[None] * 13, "no atoms")]
            except (ValueError, KeyError, OSError, EOFError, IndexError, TypeError) as e:
                rows.append((name, *[None] * 13, f"{type(e).__name__}: {e}"))
            if len(rows) >= ATOM_ROWS:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


CIF_MARK = "_atom_site."
SCHEMA = "file string, model int, chain string, res_idx int, icode string, resname string, atom string, altloc string, x double, y double, z double, bfactor double, hetatm boolean, label_chain string, error string"
HEADER = "file string, resolution double, method string, oligomeric_count string, oligomeric_details string, error string"


def _headers(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            name = path.rsplit("/", 1)[-1]
            try:
                text = _text(name, content)
                rows.append((name, *(mmcif.header(mmcif.categories(text)) if CIF_MARK in text else (None,) * 4), None))
            except (ValueError, KeyError, OSError, EOFError, TypeError) as e:
                rows.append((name, *[None] * 4, f"{type(e).__name__}: {e}"))
        kinds = [pa.string(), pa.float64(), *[pa.string()] * 4]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in HEADER.split(", ")])


def headers(files: DataFrame) -> DataFrame:
    """(path, content) -> (entry, resolution, method, oligomeric_count, oligomeric_details, error). Resolution is null for PDB text, 0 where an mmCIF has none."""
    return files.mapInArrow(_headers, HEADER).select(stem(F.col("file")).alias("entry"), "resolution", "method", "oligomeric_count", "oligomeric_details", "error")


def read_files(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """(path, content) of structure files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def read_tars(spark: SparkSession, path, suffix: str = "-F1-model_v4.cif.gz") -> DataFrame:
    """(path, content) of members of tar files; what cannot be read is logged by `tar_rejects`."""
    return _tars(spark, path, suffix).filter("error IS NULL").select(F.col("member").alias("path"), "content")


def tar_rejects(spark: SparkSession, path, suffix: str = "-F1-model_v4.cif.gz") -> DataFrame:
    """(archive, member, offset, error) of what `read_tars` leaves out."""
    return _tars(spark, path, suffix).filter("error IS NOT NULL").select("archive", "member", "offset", "error")


def _tars(spark: SparkSession, path, suffix: str) -> DataFrame:
    mounted = "://" not in path or path.startswith("file://")
    return archives.scan(spark, path, suffix) if mounted else archives.members(spark, path, suffix)


def listed(spark: SparkSession, folder: str, manifest: str, glob: str | None = None) -> DataFrame:
    """(path, content) of the files that a list in the folder names, a path a line; without such a list, of the folder's files.

    Paths that are not absolute lie below the folder.
    """
    root = folder.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{manifest}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        if glob is None:
            raise ValueError(f"{root} has no {manifest}")
        return read_files(spark, folder, glob)
    names = [r.path for r in read_manifest(spark, f"{root}/{manifest}").distinct().collect()]  # the list is a driver's: a load takes paths
    if not names:
        return read_files(spark, folder, glob or "*").limit(0)
    return read_files(spark, [n if n.startswith("/") or "://" in n else f"{root}/{n}" for n in names])


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) -> atoms in canonical form, and (entry, error) of files that gave none."""
    rows = files.mapInArrow(_parse, SCHEMA).withColumn("entry", stem(F.col("file")))
    return rows.filter("error IS NULL").select(*[f.name for f in ATOMS.fields], "label_chain"), rows.filter("error IS NOT NULL").select("entry", "error")


def polymer(atoms: DataFrame, standard_only: bool = False, keep_ligands: bool = False) -> DataFrame:
    """First model, first alternative location; without water and nucleic acid, and without ligands unless kept."""
    first = Window.partitionBy("entry")
    out = atoms.withColumn("_m", F.min("model").over(first)).filter("model = _m").drop("_m")
    alt = Window.partitionBy("entry", "chain", "res_idx", "icode", "atom").orderBy("altloc", "x", "y", "z")
    out = out.withColumn("_a", F.row_number().over(alt)).filter("_a = 1").drop("_a").filter(~F.col("resname").isin(*WATER, *NUCLEIC))
    out = out if keep_ligands else out.filter(~F.col("hetatm"))
    return out.filter(F.col("resname").isin(*RESIDUE_NAMES)) if standard_only else out


def select_chains(atoms: DataFrame, specs: DataFrame, spec: str = "spec") -> tuple[DataFrame, DataFrame]:
    """Atoms of the chains that specs name, and the (spec, missing) that have none of them.

    entry@A@B names author chains, entry%A%B label chains, entry alone all chains. The
    atoms come with their spec, so an entry may be asked for several times.
    """
    whole = F.col(spec)
    mark = F.when(F.instr(whole, "%") > 0, "%").otherwise("@")
    parts = F.when(mark == "%", F.split(whole, "%")).otherwise(F.split(whole, "@"))
    asked = specs.select(whole.alias("spec"), (mark == "%").alias("_label"), F.get(parts, F.lit(0)).alias("entry"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("_chains")).distinct()
    there = F.when(F.col("_label"), F.col("label_chain")).otherwise(F.col("chain"))
    found = atoms.join(asked, "entry").filter((F.size("_chains") == 0) | F.array_contains("_chains", there))
    has = found.groupBy("spec").agg(F.collect_set(there).alias("_there"))
    lacking = asked.join(has, "spec", "left").select("spec", F.when(F.col("_there").isNull() & (F.size("_chains") == 0), F.array(F.lit("*"))).otherwise(F.array_except("_chains", F.coalesce("_there", F.array().cast("array<string>")))).alias("missing"))
    return found.drop("_label", "_chains"), lacking.filter(F.size("missing") > 0)


def residues(atoms: DataFrame) -> DataFrame:
    """One row per residue, in order: entry, chain, res_idx, icode, ordinal, letter, plddt, and a map of atoms to [x, y, z]."""
    letters = F.create_map(*[F.lit(x) for pair in zip(RESIDUE_NAMES, RESIDUES) for x in pair])
    rows = atoms.groupBy("entry", "chain", "res_idx", "icode").agg(
        F.first("resname").alias("resname"), F.avg("bfactor").alias("plddt"), F.map_from_entries(F.collect_list(F.struct("atom", F.array("x", "y", "z")))).alias("atoms")
    )
    w = Window.partitionBy("entry", "chain").orderBy("res_idx", "icode")
    return rows.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("letter", F.coalesce(F.element_at(letters, F.col("resname")), F.lit("X"))).drop("resname")


def sequences(residue_rows: DataFrame) -> DataFrame:
    """(entry, chain, seq, length, plddt)."""
    rows = residue_rows.groupBy("entry", "chain").agg(F.sort_array(F.collect_list(F.struct("ordinal", "letter"))).alias("r"), F.avg("plddt").alias("plddt"))
    return rows.select("entry", "chain", F.array_join(F.transform("r", lambda x: x["letter"]), "").alias("seq"), F.size("r").alias("length"), F.when(F.col("entry").startswith("AF"), F.col("plddt")).otherwise(F.lit(0.0)).alias("plddt"))


#: Why an entry is rejected, in the order in which it is asked.
REJECTS = ("parse_error", "resolution_too_low", "no_resolution", "no_residues", "too_long")


def metadata(seqs: DataFrame, max_len: int = 1024, heads: DataFrame | None = None, max_resolution: float | None = None) -> DataFrame:
    """One row per entry with its chains' make-up, and a reject reason where it has one.

    heads: rows of `headers`, for entries without chains, too; with max_resolution, the
    resolution of an mmCIF must be below it and known. PDB text has none and is not asked.
    """
    modeled = F.length(F.regexp_replace(F.regexp_replace("seq", "^X+", ""), "X+$", ""))
    rows = seqs.groupBy("entry").agg(F.count("*").alias("num_chains"), F.countDistinct("seq").alias("kinds"), F.sum("length").alias("seq_len"), F.sum(modeled).alias("modeled_seq_len"))
    if heads is not None:
        rows = heads.join(rows, "entry", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = F.when(zero("modeled_seq_len") == 0, REJECTS[3]).when(F.col("seq_len") > max_len, REJECTS[4])
    if heads is not None and max_resolution is not None:
        reason = F.when(F.col("resolution") >= max_resolution, REJECTS[1]).when(F.col("resolution") == 0, REJECTS[2]).otherwise(reason)
    if heads is not None:
        reason = F.when(F.col("error").isNotNull(), REJECTS[0]).otherwise(reason)
    more = ["resolution", "method", "oligomeric_count", "oligomeric_details"] if heads is not None else []
    return rows.select("entry", zero("num_chains").alias("num_chains"), zero("seq_len").alias("seq_len"), zero("modeled_seq_len").alias("modeled_seq_len"), F.when(F.col("kinds") > 1, "heteromer").otherwise("homomer").alias("quaternary_category"), *more, reason.alias("reject"))


def atom37(residue_rows: DataFrame) -> DataFrame:
    """Rows of `residues` with 37 slots an atom name: coordinates (zeros where there is none), mask and residue index."""
    slots = F.array(*[F.try_element_at("atoms", F.lit(n)) for n in ATOM37])
    zeros = F.array(*[F.lit(0.0)] * 3)
    rows = residue_rows.withColumn("_slots", slots)
    letters = F.instr(F.lit(RESIDUES), F.col("letter"))
    return rows.select(
        *residue_rows.columns, F.transform("_slots", lambda s: F.coalesce(s, zeros)).alias("positions"), F.transform("_slots", lambda s: F.when(s.isNull(), 0.0).otherwise(1.0)).alias("mask"),
        F.when(letters == 0, 20).otherwise(letters - 1).alias("aatype"),
    )


def chain_features(rows: DataFrame, chains: str | list[str] | None = "A", scale: float = 1.0) -> DataFrame:
    """One row per entry and chain of `atom37` rows: arrays by residue, centred on the CA atoms and scaled.

    chains: one, several, or None for all. The centre is the sum of CA positions over their number + 1e-5.
    """
    if chains is not None:
        rows = rows.filter(F.col("chain").isin(*([chains] if isinstance(chains, str) else chains)))
    item = F.struct("ordinal", "res_idx", "aatype", "positions", "mask")
    whole = rows.groupBy("entry", "chain").agg(F.sort_array(F.collect_list(item)).alias("r"))  # one chain's residues
    ca = ATOM37.index("CA")
    total = F.aggregate("r", F.array(*[F.lit(0.0)] * 4), lambda acc, r: F.zip_with(acc, F.concat(r["positions"][ca], F.array(r["mask"][ca])), lambda a, b: a + b))
    whole = whole.withColumn("_t", total).withColumn("_c", F.transform(F.slice("_t", 1, 3), lambda x: x / (F.get("_t", F.lit(3)) + 1e-5)))
    moved = F.transform("r", lambda r: F.zip_with(r["positions"], r["mask"], lambda p, m: F.zip_with(p, F.col("_c"), lambda x, c: (x - c) / scale * m)))
    return whole.select(
        "entry", "chain", F.transform("r", lambda r: r["aatype"]).alias("aatype"), F.transform("r", lambda r: r["res_idx"]).alias("residue_index"), moved.alias("atom_positions"),
        F.transform("r", lambda r: r["mask"]).alias("atom_mask"), F.transform("r", lambda r: r["mask"][ca]).alias("bb_mask"),
    ).withColumn("bb_positions", F.transform("atom_positions", lambda p: p[ca]))


REGISTRY = {
    "afdb": lambda spark, path: read_tars(spark, path),
    "swissprot": lambda spark, path: read_files(spark, path, GLOBS["swissprot"]),
    "rcsb": lambda spark, path: listed(spark, path, "file_list.txt", GLOBS["rcsb"]),
    "cameo": lambda spark, path: listed(spark, path, "fpath.txt"),
    "casp": lambda spark, path: read_files(spark, path, GLOBS["casp"]),
}


def source(spark: SparkSession, name: str, path) -> DataFrame:
    """Files of a registered source."""
    if name not in REGISTRY:
        raise ValueError(f"unknown source {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](spark, path)


def backbone(atoms: DataFrame, chains: list[str] | None = None, names=("N", "CA", "C")) -> DataFrame:
    """Backbone atoms of the first model; a chain asked for that an entry lacks is an error."""
    rows = polymer(atoms).filter(F.col("atom").isin(*names))
    if chains is None:
        return rows
    wanted = F.array(*map(F.lit, chains))
    there = F.collect_set("chain").over(Window.partitionBy("entry"))
    lacking = F.array_except(wanted, F.col("_there"))
    checked = rows.withColumn("_there", there).withColumn("chain", F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("missing chains in "), "entry", F.lit(": "), F.array_join(lacking, ",")))).otherwise(F.col("chain")))
    return checked.filter(F.col("chain").isin(*chains)).drop("_there")


def by_residue(atoms: DataFrame, names=("N", "CA", "C")) -> DataFrame:
    """One row per residue with an [x, y, z] column per atom name; a name that occurs twice in a residue is an error."""
    at = lambda n: F.when(F.col("atom") == n, F.struct("x", "y", "z"))
    one = [F.when(F.count(at(n)) > 1, F.raise_error(F.lit(f"duplicate atom {n}")).cast("struct<x:double,y:double,z:double>")).otherwise(F.max(at(n))).alias(n) for n in names]
    return atoms.groupBy("entry", "chain", "res_idx", "icode").agg(*one)
