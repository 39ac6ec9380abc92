"""Readers of JSON rows, JSON lines with splits, metric CSVs and metadata CSVs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def read_rows(spark: SparkSession, path, schema: str, stream: bool = False, files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that are no row of the schema) of JSON lines, as batch or as stream of so many files a trigger."""
    reader = spark.readStream if stream else spark.read
    reader = reader.option("maxFilesPerTrigger", files) if stream and files else reader
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    parsed = lines.withColumn("row", F.from_json("line", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}))
    broken = F.col(f"row.{CORRUPT}").isNotNull()
    return parsed.filter(~broken).select("row.*").drop(CORRUPT), parsed.filter(broken).select("file", "line")


def read_splits(spark: SparkSession, rows_path, splits_path, schema: str, name: str = "name", splits=("train", "validation", "test"), longest: int | None = None, length: str | None = None, multi_line: bool = True) -> DataFrame:
    """Rows of a JSON-lines file with the split that a second JSON file (split -> names) puts them in; rows of no split go.

    multi_line: the second file is one object; else it has an object a line, whose lists add up.
    longest: rows whose `length` column is a longer sequence go too.
    """
    rows, _ = read_rows(spark, rows_path, schema)
    lists = spark.read.schema(", ".join(f"`{s}` array<string>" for s in splits)).option("multiLine", multi_line).json(splits_path)
    names = lists.select(F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("names")) for s in splits])).alias("s")).select("s.split", F.explode("s.names").alias(name)).distinct()
    rows = rows.filter(F.length(length) <= longest) if longest is not None and length else rows
    return rows.join(names, name)


def read_metrics(spark: SparkSession, pattern: str, key: str, schema: str, name: str = "key") -> DataFrame:
    """Rows of all CSV files of a pattern (with headers) and the group that the regular expression `key` finds in their path."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(pattern).withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), key, 1))


def read_metadata(spark: SparkSession, path, schema: str, root: str, columns=("raw_path", "processed_path")) -> DataFrame:
    """A metadata CSV whose path columns are put under a root; absolute paths and nulls stay."""
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)
    under = lambda c: F.when(F.col(c).startswith("/") | F.col(c).isNull(), F.col(c)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(c)))
    return rows.withColumns({c: under(c) for c in columns})


def merge_parts(spark: SparkSession, path, split: str | None = None) -> DataFrame:
    """All Parquet parts of a folder, without those that cannot be read, with a constant split column if given."""
    rows = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.withColumn("split", F.lit(split)) if split else rows
