"""Writers: FASTA, structure text, training parts, and idempotent appends with a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fasta_lines(df: DataFrame, header, seq) -> DataFrame:
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))


def write_fasta(df: DataFrame, path: str, header, seq, mode: str = "append") -> None:
    fasta_lines(df, header, seq).write.mode(mode).text(path)


def annotated_header(name, length, **metrics):
    """name L=.. key=value, two decimals."""
    parts = [F.concat(F.lit(f" {k}="), F.format_string("%.2f", v)) for k, v in metrics.items()]
    return F.concat(name, F.lit(" L="), length.cast("string"), *parts)


def atom_line(serial, atom, resname, chain, res_idx, x, y, z, bfactor, icode=None):
    """One 80-column ATOM record."""
    name = F.when(F.length(atom) < 4, F.concat(F.lit(" "), F.rpad(atom, 3, " "))).otherwise(atom)
    return F.format_string("ATOM  %5d %4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s  ", serial, name, resname, chain, res_idx, icode if icode is not None else F.lit(" "), x, y, z, F.lit(1.0), bfactor, F.lpad(F.substring(atom, 1, 1), 2, " "))


def pdb_text(atoms: DataFrame, keys=("entry",), model: bool = False) -> DataFrame:
    """(keys, text): records of each structure in order, a TER after each chain, END last. A structure is one row."""
    order = Window.partitionBy(*keys).orderBy("chain", "res_idx", "icode", "atom")
    last = F.lead("chain").over(order)
    lines = atoms.withColumn("_n", F.row_number().over(order)).withColumn(
        "_t",
        F.concat(
            atom_line(F.col("_n"), F.col("atom"), F.col("resname"), F.col("chain"), F.col("res_idx"), F.col("x"), F.col("y"), F.col("z"), F.col("bfactor"), F.rpad(F.coalesce("icode", F.lit("")), 1, " ")),
            F.when(last.isNull() | (last != F.col("chain")), F.rpad(F.concat(F.lit("\nTER   "), F.lpad((F.col("_n") + 1).cast("string"), 5, " "), F.lit("      "), "resname", F.lit(" "), "chain", F.lpad(F.col("res_idx").cast("string"), 4, " ")), 81, " ")).otherwise(F.lit("")),
        ),
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t"))), lambda s: s["_t"]), "\n")
    head, tail = ("MODEL     1\n", "\nENDMDL\nEND") if model else ("", "\nEND")
    return lines.groupBy(*keys).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def trajectory_text(frames: DataFrame, keys, name: str, text: str) -> DataFrame:
    """Frames joined in the order of the number in their names, each as a model."""
    number = F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).cast("int")
    rows = frames.withColumn("_i", number)
    joined = F.transform(F.sort_array(F.collect_list(F.struct("_i", F.col(text).alias("t")))), lambda s, i: F.concat(F.lit("MODEL     "), (i + 1).cast("string"), F.lit("\n"), s["t"], F.lit("\nENDMDL")))
    return rows.groupBy(*keys).agg(F.concat(F.array_join(joined, "\n"), F.lit("\nEND")).alias("text"))


def write_parts(df: DataFrame, path: str, rows: int, mode: str = "overwrite", split: str | None = None) -> None:
    """Parquet parts of at most `rows` rows, snappy; with a constant split column if given."""
    df = df.withColumn("split", F.lit(split)) if split else df
    df.write.mode(mode).option("maxRecordsPerFile", rows).option("compression", "snappy").parquet(path)


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def new_rows(df: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """df with status: skipped where the key is there already, failed where error is set, else success."""
    out = df if existing is None else df.join(existing.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    there = F.lit(False) if existing is None else F.coalesce("_there", F.lit(False))
    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    return out.withColumn("status", F.when(there, "skipped").when(failed, "failed").otherwise("success")).drop("_there")


def write_csv(df: DataFrame, path: str) -> None:
    """A small summary as one CSV file with a header."""
    df.repartition(1).write.mode("overwrite").option("header", "true").csv(path)


def representations(tokens: DataFrame, include=("per_tok", "mean", "bos"), most: int = 1022, keys=("label",)) -> DataFrame:
    """What a model gave for each token, one row a label and layer: keys, layer, n, and as asked per_tok, mean, bos.

    tokens: keys, layer, place (0: the start token, then the residues), vector. Residues after the first `most` are left out;
    places after the last residue (end token, padding) belong to the caller to drop. per_tok is in order of place; mean is null without residues, bos without a start.
    """
    inside = (F.col("place") >= 1) & (F.col("place") <= most)
    order = F.struct("place", F.col("vector").cast("array<double>").alias("vector"))
    rows = tokens.groupBy(*keys, "layer").agg(F.sort_array(F.collect_list(F.when(inside, order))).alias("_r"), F.min(F.when(F.col("place") == 0, order))["vector"].alias("bos"))
    rows = rows.withColumn("per_tok", F.transform("_r", lambda r: r["vector"])).withColumn("n", F.size("_r"))
    width = F.size(F.get("per_tok", F.lit(0)))
    mean = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate("per_tok", F.lit(0.0), lambda a, v: a + F.get(v, i)) / F.col("n"))
    rows = rows.withColumn("mean", F.when(F.col("n") > 0, mean))
    return rows.select(*keys, "layer", "n", *[F.col(c).cast("array<array<float>>" if c == "per_tok" else "array<float>").alias(c) for c in include])


def best_samples(samples: DataFrame, by, key: str, order, designable, length: str, suffix: str = "pdb") -> DataFrame:
    """The best sample of each group that is designable, with the name of its copy: sample_id_<place>_length_<length>.<suffix>.

    order: columns, best first; the key decides between equals and gives the places (from 0).
    """
    from helixmill.operators.corpus import best_per
    from helixmill.operators.sampling import global_rank

    best = best_per(samples, by, [*order, F.col(key)]).filter(designable)
    placed = global_rank(best, F.col(length), [key], "_place")
    return placed.withColumn("name", F.format_string(f"sample_id_%d_length_%d.{suffix}", F.col("_place") - 1, F.col(length).cast("long"))).drop("_place")


def write_named(files: DataFrame, folder: str, name: str = "name", text: str = "text") -> DataFrame:
    """Each row's text as a file of its name in a shared folder: (name, path, size, status). Runs when the result is read.

    A file is written under a name of its attempt and moved into place, so a retried task or a second run leaves whole files only; one
    that is there with the same size is skipped. Null text is an empty file.
    """
    target = folder

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        system.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                path = f"{root}/{n}"
                there = system.get_file_info(path)
                status = "skipped" if there.type == fs.FileType.File and there.size == len(data) else "success"
                if status == "success":
                    part = f"{root}/_{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(data)
                    system.move(part, path)
                rows.append((n, path, len(data), status))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.string())], names=["name", "path", "size", "status"])

    return files.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInArrow(run, "name string, path string, size long, status string")


#: Items of an atom in mmCIF text, in the order in which they are written.
SITE = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_entity_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv auth_seq_id auth_comp_id auth_asym_id auth_atom_id pdbx_PDB_model_num".split()


def cif_value(value, unknown: str = "?"):
    """A value as mmCIF writes it: quoted where it must be, `unknown` for null and empty text. Line ends and both quotes at once have no such form."""
    plain = value.rlike(r"^[^\s'\"#$_;\[\]][^\s'\"]*$") & ~F.lower(value).rlike(r"^(data_|save_|loop_|global_|stop_)")
    quoted = F.when(value.contains("'"), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.concat(F.lit("'"), value, F.lit("'")))
    impossible = value.contains("\n") | (value.contains("'") & value.contains('"'))
    return F.when(F.coalesce(value, F.lit("")) == "", unknown).when(impossible, F.raise_error(F.concat(F.lit("no mmCIF form: "), value))).when(plain & ~value.isin(".", "?"), value).otherwise(quoted)


def mmcif_text(atoms: DataFrame, key: str = "entry", entity=None) -> DataFrame:
    """(key, text): each structure as one mmCIF block, its atoms by model, chain and residue. entity: a column, 1 if not given. A structure is one row."""
    order = Window.partitionBy(key).orderBy("model", "chain", "res_idx", "icode", "atom", "altloc")
    text = lambda c, unknown="?": cif_value(F.col(c).cast("string"), unknown)
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "?").otherwise(F.format_string("%.3f", F.col(c)))
    of = F.lit("1") if entity is None else cif_value(entity.cast("string"))
    fields = [
        F.when(F.col("hetatm"), "HETATM").otherwise("ATOM"), F.col("_n").cast("string"), cif_value(F.substring("atom", 1, 1)), text("atom"), text("altloc", "."), text("resname"), text("chain"), of,
        text("res_idx"), text("icode"), number("x"), number("y"), number("z"), F.lit("1.0"), number("bfactor"), text("res_idx"), text("resname"), text("chain"), text("atom"), F.coalesce(F.col("model"), F.lit(1)).cast("string"),
    ]
    lines = atoms.withColumn("_n", F.row_number().over(order)).select(key, "_n", F.concat_ws(" ", *fields).alias("_t"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t"))), lambda s: s["_t"]), "\n")
    head = F.concat(F.lit("data_"), F.regexp_replace(F.col(key).cast("string"), r"\s", "_"), F.lit("\n_entry.id "), cif_value(F.col(key).cast("string")), F.lit("\n#\nloop_\n" + "".join(f"_atom_site.{i}\n" for i in SITE)))
    return lines.groupBy(key).agg(body.alias("_b")).select(key, F.concat(head, "_b", F.lit("\n#\n")).alias("text"))
