"""Readers of FASTA, alignments and name lists, as DataFrames of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path, unique: bool = True) -> DataFrame:
    """(file, ordinal, header, seq). An empty header becomes seqnum and its line, nine digits.

    Files are split at record starts, so a file of any size is read by many tasks. With
    `unique`, a header that occurs twice in a file is an error when rows are computed.
    """
    blocks = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    blocks = blocks.withColumn("value", F.regexp_replace("value", r"\r", "")).filter(F.length(F.trim("value")) > 0)
    # Places inside a block, and what earlier blocks of the file hold: no task orders a whole file.
    rows = blocks.withColumn("_id", F.monotonically_increasing_id()).withColumn("_lines", F.size(F.split("value", "\n")))
    held = rows.groupBy("file", "block").agg(F.count("*").alias("_n"), F.sum("_lines").alias("_l"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("file", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", "_l")])
    inside = Window.partitionBy("file", "block").orderBy("_id")
    rows = rows.withColumn("_i", F.row_number().over(inside) - 1).withColumn("_j", F.coalesce(F.sum("_lines").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(held, ["file", "block"]).withColumn("ordinal", (F.col("_n") + F.col("_i")).cast("int")).withColumn("line", F.col("_l") + F.col("_j"))
    body = F.regexp_replace("value", r"^>", "")
    header = F.trim(F.substring_index(body, "\n", 1))
    seq = F.regexp_replace(F.when(F.instr(body, "\n") > 0, F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)")).otherwise(F.lit("")), r"\s", "")
    out = rows.select("file", "ordinal", F.when(header == "", F.format_string("seqnum%09d", "line")).otherwise(header).alias("header"), seq.alias("seq"))
    if not unique:
        return out
    twice = out.groupBy("file", "header").agg(F.count("*").alias("_times")).filter("_times > 1")
    checked = out.join(twice, ["file", "header"], "left")
    return checked.select("file", "ordinal", F.when(F.col("_times").isNotNull(), F.raise_error(F.concat(F.lit("duplicate label: "), "header"))).otherwise(F.col("header")).alias("header"), "seq")


def read_msa(spark: SparkSession, path, rows: int | None = None) -> DataFrame:
    """Alignment rows without insertions; the first `rows` of each file. Unequal lengths are an error."""
    from helixmill.functions.sequence import without_insertions

    out = read_fasta(spark, path, unique=False).withColumn("seq", without_insertions(F.col("seq")))
    out = out.filter(F.col("ordinal") < rows) if rows is not None else out
    w = Window.partitionBy("file")
    ok = F.min(F.length("seq")).over(w) == F.max(F.length("seq")).over(w)
    return out.withColumn("_ok", ok).withColumn("seq", F.when(F.col("_ok"), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("unequal lengths in "), "file")))).drop("_ok")


def read_manifest(spark: SparkSession, path) -> DataFrame:
    """Non-empty lines of a list of paths."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def by_split(rows: DataFrame, splits: DataFrame, name: str, split: str) -> DataFrame:
    """Rows named in one split of a (split, names array) table."""
    wanted = splits.filter(F.col("split") == split).select(F.explode("names").alias(name))
    return rows.join(wanted, name, "left_semi")


#: What a listing of clusters begins and ends with, and a line of it.
LISTING_HEAD, LISTING_END = "INFO  : Item     Cluster\n", "INFO  : ======================================\n"
LISTING_LINE = r"INFO\s+:\s+\d+\s:\s+(\d+)\s+(\S+)"


def read_clusters(spark: SparkSession, path) -> DataFrame:
    """(file, cluster, path) of every listing of clusters in logs of a structure comparison.

    Logs are split at the rules between their sections, so a section is the unit of work and no line has to know what stands
    before it. A line of a listing that cannot be read is an error when rows are computed.
    """
    sections = spark.read.option("lineSep", LISTING_END).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    after = F.expr(f"substring(value, instr(value, '{LISTING_HEAD}') + {len(LISTING_HEAD)})".replace("\n", "\\n"))
    lines = sections.filter(F.col("value").contains(LISTING_HEAD)).select("file", F.explode(F.split(after, "\n")).alias("line"))
    lines = lines.filter((F.col("line") != "") & (F.concat("line", F.lit("\n")) != LISTING_HEAD))
    found = lambda i: F.regexp_extract("line", LISTING_LINE, i)
    cluster = F.when(found(1) == "", F.raise_error(F.concat(F.lit("not a line of a listing: "), "line"))).otherwise(found(1))
    return lines.select("file", cluster.cast("int").alias("cluster"), found(2).alias("path"))
