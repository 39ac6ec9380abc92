"""Queries that render the driver's tables as files in the shared folder and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.jobs import ingest
from helixmill.plans.registry import POINTS, R, points, query, r6, table
from helixmill.session import scratch
from helixmill.sinks import writers
from helixmill.sources import archives, structures, tables, text

LONGEST, SHARDS, BROKEN = 10_000, 4, 13


def _prepare(lines):
    """Rendered lines to rows: the document, or why there is none."""
    row = F.from_json("value", "doc_id long, text string, lang string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(row.alias("r"))
    length = F.length("r.text")
    error = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "parse_error").when(F.coalesce(length, F.lit(0)) == 0, "no_sequence").when(length > LONGEST, "too_long")
    known = F.when(F.coalesce(error, F.lit("")) != "parse_error", F.col("r.doc_id"))
    return rows.select(known.alias("doc_id"), F.col("r.lang").alias("lang"), F.when(error.isNull(), F.col("r.text")).alias("text"), error.alias("error"))


@query(
    "SNK01 SNK02 SRC06 AGG21 SRC23",
    f"""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, text, doc_id % {SHARDS} AS shard, doc_id % {BROKEN} = 4 AS broken FROM documents)
    SELECT CASE WHEN NOT broken THEN doc_id END AS doc_id, CASE WHEN broken OR n = 0 OR n > {LONGEST} THEN 'failed' WHEN shard = 0 THEN 'skipped' ELSE 'success' END AS status,
      CASE WHEN broken THEN 'parse_error' WHEN n = 0 THEN 'no_sequence' WHEN n > {LONGEST} THEN 'too_long' END AS error,
      CASE WHEN NOT broken AND n BETWEEN 1 AND {LONGEST} THEN md5(text) END AS digest FROM d""",
)
def ingest_job(spark, d):
    """Documents as JSON lines; the job is stopped after its first batch and run again over all."""
    root = scratch(spark)
    line = F.to_json(F.struct("doc_id", "text", "lang"))
    cut = F.when(F.col("doc_id") % BROKEN == 4, F.concat(F.lit("{"), F.substring(line, 2, 6))).otherwise(line)
    table(spark, d, "documents").select(cut.alias("value"), (F.col("doc_id") % SHARDS).alias("shard")).write.partitionBy("shard").text(f"{root}/source")
    batches = ingest.by_folders(spark, f"{root}/source/shard=*", lambda paths: spark.read.text(paths), "part-*")
    ingest.run(spark, batches[:1], f"{root}/corpus", "doc_id", _prepare, F.col("doc_id") % 2, part_rows=5000)
    new = ingest.run(spark, batches, f"{root}/corpus", "doc_id", _prepare, F.col("doc_id") % 2, part_rows=5000)
    texts = ingest.published(spark, f"{root}/corpus").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    status = ingest.statuses(spark, f"{root}/corpus", "doc_id", new)
    return status.join(texts, F.col("doc_id") == F.col("id"), "left").select("doc_id", "status", "error", "digest")


@query("SRC01 SRC32", "SELECT 'd/' || doc_id || '.txt' AS member, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents")
def tar_members(spark, d):
    """Documents as members of tar archives, read back by byte ranges."""
    root = scratch(spark)
    rows = table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("content"))
    archives.write_tars(rows, f"{root}/tars", 4).collect()  # a row an archive
    return archives.scan(spark, f"{root}/tars", ".txt", rangeBytes=1 << 20).select("member", "size", F.md5("content").alias("digest"))


@query("SRC18 SNK05", r"SELECT CAST(doc_id AS VARCHAR) || ' ' || lang AS header, md5(regexp_replace(coalesce(text, ''), '[\s]', '', 'g')) AS digest FROM documents")
def fasta_round_trip(spark, d):
    root = scratch(spark)
    rows = table(spark, d, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), "lang").alias("h"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "").alias("s"))
    writers.write_fasta(rows, f"{root}/fasta", F.col("h"), F.col("s"))
    return text.read_fasta(spark, f"{root}/fasta").select("header", F.md5("seq").alias("digest"))


@query("SRC24 SNK04 SRC29", "SELECT l_orderkey AS name, CAST(sum(l_quantity) AS DOUBLE) AS total, count(*) AS lines, CASE WHEN l_orderkey % 10 = 0 THEN 'test' WHEN l_orderkey % 10 = 1 THEN 'validation' ELSE 'train' END AS split FROM lineitem WHERE l_orderkey % 10 <> 9 GROUP BY l_orderkey")
def json_splits(spark, d):
    """Orders as JSON lines, and a second file that names each split's orders."""
    root = scratch(spark)
    orders = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.sum("l_quantity").cast("double").alias("total"), F.count("*").alias("lines"))
    orders.write.json(f"{root}/rows")
    place = F.col("name") % 10
    named = orders.filter(place != 9).select("name", F.when(place == 0, "test").when(place == 1, "validation").otherwise("train").alias("split"))
    # A line per thousand names: no row holds a whole split.
    named.groupBy("split", F.floor(F.col("name") / 1000).alias("k")).agg(F.collect_list(F.col("name").cast("string")).alias("names")).select(F.map_from_arrays(F.array("split"), F.array("names")).alias("m")).select(F.to_json("m").alias("value")).write.text(f"{root}/splits")
    return tables.read_splits(spark, f"{root}/rows", f"{root}/splits/part-*", "name string, total double, lines long", multi_line=False).select(F.col("name").cast("long").alias("name"), "total", "lines", "split")


@query("SRC26 SNK10 SRC27", "SELECT event_type AS key, user_id, count(*) AS n FROM events GROUP BY ALL")
def metric_files(spark, d):
    """A metric file for each kind of event, with the kind in its path only."""
    root = scratch(spark)
    table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).write.partitionBy("event_type").option("header", "true").csv(f"{root}/metrics")
    return tables.read_metrics(spark, f"{root}/metrics/event_type=*/*.csv", "event_type=([^/]+)/", "user_id long, n long")


@query("SRC25", "SELECT p_partkey, 'store/' || p_partkey || '.cif' AS raw_path, CASE WHEN p_partkey % 3 = 0 THEN '/abs/' || p_partkey WHEN p_partkey % 3 = 1 THEN 'store/' || p_partkey || '.pkl' END AS processed_path FROM part")
def metadata_paths(spark, d):
    root = scratch(spark)
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    rows = table(spark, d, "part").select("p_partkey", F.concat(key, F.lit(".cif")).alias("raw_path"), F.when(kind == 0, F.concat(F.lit("/abs/"), key)).when(kind == 1, F.concat(key, F.lit(".pkl"))).alias("processed_path"))
    rows.write.option("header", "true").csv(f"{root}/meta")
    return tables.read_metadata(spark, f"{root}/meta", "p_partkey long, raw_path string, processed_path string", "store")


@query("SNK02 SNK03", "SELECT doc_id, n_chars, 'train' AS split FROM documents")
def merged_parts(spark, d):
    root = scratch(spark)
    writers.write_parts(table(spark, d, "documents").select("doc_id", "n_chars"), f"{root}/parts", 400)
    return tables.merge_parts(spark, f"{root}/parts", "train")


#: A vector as an mmCIF text: residues of three atoms, 21 points, a title over several lines.
ATOM_LINE = "concat_ws(' ', 'ATOM', i + 1, element_at(array('N', 'CA', 'C'), i % 3 + 1), element_at(array('ALA', 'GLY', 'MSE', 'UNK'), CAST(vec_id + i DIV 3 AS INT) % 4 + 1), 'L', '?', 'A', i DIV 3 + 1, e[3 * i], e[3 * i + 1], e[3 * i + 2], '1.0')"
ITEMS = "group_PDB id label_atom_id label_comp_id label_asym_id pdbx_PDB_ins_code auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z B_iso_or_equiv".split()


@query(
    "SRC07 SRC15 SRC17",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN label % 5 = 0 THEN 0.0 ELSE label / 2.0 END AS resolution FROM embeddings),
    r AS (SELECT *, CASE WHEN vec_id % 11 = 3 THEN 'parse_error' WHEN resolution >= 4 THEN 'resolution_too_low' WHEN resolution = 0 THEN 'no_resolution' END AS reject FROM e),
    s AS (SELECT vec_id, reject, resolution, list_transform(range(7), lambda k: [3 * 3 * k + 4, 3 * 3 * k + 5, 3 * 3 * k + 6]) AS ca, e FROM r)
    SELECT CAST(vec_id AS VARCHAR) AS entry, reject, CASE WHEN vec_id % 11 = 3 THEN NULL ELSE resolution END AS resolution,
      CASE WHEN reject IS NULL THEN round(list_sum(list_transform(ca, lambda p: e[p[1]])) / 7.00001, 6) END AS cx, CASE WHEN reject IS NULL THEN CAST(7 AS BIGINT) END AS residues,
      CASE WHEN reject IS NULL THEN CAST(21 AS DOUBLE) END AS atoms, CASE WHEN reject IS NULL THEN round(e[4] - list_sum(list_transform(ca, lambda p: e[p[1]])) / 7.00001, 6) END AS x0 FROM s""",
)
def mmcif_features(spark, d):
    """Vectors as mmCIF texts, through the parser, the typed rejects, and centred 37-slot features."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    resolution = F.when(F.col("label") % 5 == 0, F.lit("?")).otherwise((F.col("label") / 2.0).cast("string"))
    atoms = F.expr(f"array_join(transform(sequence(0, 20), i -> {ATOM_LINE}), '\n')")
    title = F.lit("data_v\n_struct.title\n;two lines of\n'title' _with.items # and marks\n;\n_exptl.method 'X-RAY DIFFRACTION'\n_refine.ls_d_res_high ")
    loop = F.lit("\nloop_\n" + "\n".join(f"_atom_site.{x}" for x in ITEMS) + "\n")
    end = F.when(F.col("vec_id") % 11 == 3, F.lit("\nATOM 22")).otherwise(F.lit("\n#\n"))  # a row that is cut off
    files = rows.select(F.concat(F.lit("store/"), F.col("vec_id").cast("string"), F.lit(".cif")).alias("path"), F.concat(title, resolution, loop, atoms, end).cast("binary").alias("content"))
    found, _ = structures.parse(files)
    heads = structures.headers(files)
    slots = structures.atom37(structures.residues(structures.polymer(found)))
    chains = structures.sequences(slots)
    meta = structures.metadata(chains, 512, heads, 4.0)
    ca = structures.ATOM37.index("CA")
    of = structures.chain_features(slots)
    sums = of.select("entry", F.size("aatype").cast("long").alias("residues"), F.aggregate(F.flatten("atom_mask"), F.lit(0.0), lambda a, x: a + x).alias("atoms"), F.col("bb_positions")[0][0].alias("x0"))
    first = slots.filter("ordinal = 0").select("entry", F.col("positions")[ca][0].alias("raw"))
    good = sums.join(first, "entry").select("entry", "residues", "atoms", F.round(F.col("raw") - F.col("x0"), 6).alias("cx"), F.round("x0", 6).alias("x0"))
    return meta.select("entry", "reject", "resolution").join(good.join(meta.filter("reject IS NULL").select("entry"), "entry", "left_semi"), "entry", "left")


@query("SNK11", f"WITH {POINTS} SELECT entry, CAST(1 AS INTEGER) AS layer, CAST(16 AS INTEGER) AS n, {R('CAST(CAST(avg(CASE WHEN idx BETWEEN 1 AND 16 THEN x END) AS FLOAT) AS DOUBLE)')} AS mean_x, {R('CAST(CAST(max(CASE WHEN idx = 0 THEN y END) AS FLOAT) AS DOUBLE)')} AS bos_y, {R('CAST(CAST(max(CASE WHEN idx = 16 THEN z END) AS FLOAT) AS DOUBLE)')} AS last_z FROM points GROUP BY entry")
def representation_dump(spark, d):
    """Chains as tokens with vectors, stored a row a label and read back; residues after the sixteenth are left out."""
    root = scratch(spark)
    tokens = points(spark, d).select("entry", F.lit(1).alias("layer"), F.col("idx").alias("place"), F.array("x", "y", "z").alias("vector"))
    writers.representations(tokens, most=16, keys=("entry",)).write.parquet(f"{root}/representations")
    at = lambda c, i: r6(F.get(c, F.lit(i)).cast("double"))
    return spark.read.parquet(f"{root}/representations").select("entry", "layer", "n", at("mean", 0).alias("mean_x"), at("bos", 1).alias("bos_y"), at(F.get("per_tok", F.lit(15)), 2).alias("last_z"))


@query(
    "SNK12",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS r FROM documents), c AS (SELECT doc_id, text, length(text) AS n FROM b WHERE r = 1 AND length(text) >= 2000)
    SELECT 'sample_id_' || (row_number() OVER (ORDER BY n, doc_id) - 1) || '_length_' || n || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS digest FROM c""",
)
def best_sample_copies(spark, d):
    """The longest document of each language and source, if long enough, as a file of its own."""
    root = scratch(spark)
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "text", F.length("text").alias("n"))
    best = writers.best_samples(rows, ["lang", "source"], "doc_id", [F.col("n").desc()], F.col("n") >= 2000, "n", "txt")
    writers.write_named(best, f"{root}/designable").write.parquet(f"{root}/listing")
    files = spark.read.format("binaryFile").load(f"{root}/designable").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("digest"))
    return spark.read.parquet(f"{root}/listing").join(files, "name").select("name", "size", "digest")


@query("SRC28", "SELECT source, CAST(doc_id % 7 AS INTEGER) AS cluster, 'd/' || doc_id || '.pdb' AS path FROM documents")
def cluster_listing(spark, d):
    """Documents in logs of a structure comparison, one a source, with a section before and after the listing."""
    root = scratch(spark)
    line = F.format_string("INFO  : %7d :       %d  d/%d.pdb", "doc_id", F.col("doc_id") % 7, "doc_id")
    logs = table(spark, d, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))  # rendering a log is one row, reading is not
    text_of = F.concat(F.lit(f"INFO  : Reading\n{text.LISTING_END}INFO  : 7 Clusters\n{text.LISTING_HEAD}"), "lines", F.lit(f"\n{text.LISTING_END}INFO  : Done 1 : 2 3"))
    logs.select("source", text_of.alias("value")).write.partitionBy("source").text(f"{root}/logs")
    return text.read_clusters(spark, f"{root}/logs/*").select(F.regexp_extract("file", "source=([^/]*)", 1).alias("source"), "cluster", "path")


@query("SNK09", f"WITH {POINTS} SELECT CAST(entry AS VARCHAR) AS entry, count(*) AS atoms, {R('sum(round(x, 3))')} AS x, {R('max(CASE WHEN idx = 20 THEN round(z, 3) END)')} AS z, count(DISTINCT idx // 3) AS residues FROM points GROUP BY entry")
def mmcif_round_trip(spark, d):
    """Chains written as mmCIF, with atom names that need quotes, and read back."""
    root = scratch(spark)
    p = points(spark, d)
    name = F.get(F.array(F.lit("O5'"), F.lit("CA"), F.lit('C"')), F.col("idx") % 3)
    number = (F.floor(F.col("idx") / 3) + 1).cast("int")
    atoms = p.select(F.col("entry").cast("string").alias("entry"), F.lit(1).alias("model"), F.lit("A").alias("chain"), number.alias("res_idx"), F.lit("").alias("icode"), F.lit("GLY").alias("resname"), name.alias("atom"), F.lit("").alias("altloc"), "x", "y", "z", F.lit(50.0).alias("bfactor"), F.lit(False).alias("hetatm"))
    files = writers.mmcif_text(atoms).select(F.concat("entry", F.lit(".cif")).alias("name"), "text")
    writers.write_named(files, f"{root}/cif").write.parquet(f"{root}/written")
    found, _ = structures.parse(structures.read_files(spark, f"{root}/cif"))
    last = (F.col("res_idx") == 7) & (F.col("atom") == 'C"')
    return found.groupBy("entry").agg(F.count("*").alias("atoms"), r6(F.sum("x")).alias("x"), r6(F.max(F.when(last, F.col("z")))).alias("z"), F.countDistinct("res_idx").alias("residues"))
