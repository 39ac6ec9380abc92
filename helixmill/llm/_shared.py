"""What the operators of this subpackage share: table access, shared storage, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes as written, up to which a table is broadcast; larger tables are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may do without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='helixmill-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Set while a table is written: its shuffle files go as soon as it stands.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back.

    A lost executor then costs a reread, not a recomputation; a failed write is
    run again from the tables it reads, so shuffle files are of no further use
    once it is over and are removed. `release` drops a table after its last reader;
    what is left in the folder goes with the job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables whose readers have all been materialised in their turn."""
    for t in tables:
        path, fs = _located(t)
        fs.delete(path, True)


def _located(table: DataFrame):
    """Path and file system of a materialised table."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table._materialised)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def slices(batches, column: int, most: int, rows: int = 1 << 16):
    """Arrow batches cut so that a text column holds at most so many bytes, or one text, in so many rows at most."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(size, done + most, "right"))))
            yield batch.slice(at, to - at)
            at = to


def trim() -> None:
    """Give memory that a finished task no longer uses back to the system; workers live on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table, marked for broadcast if it is small in rows and bytes; else left to a shuffled join."""
    path, fs = _located(df)
    return F.broadcast(df) if fs.getContentSummary(path).getLength() <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


#: A key with this share of all rows or more is hot; so there are at most as many hot keys as its inverse.
HOT_SHARE = 1000


def join_skewed(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key; `size` says how many rows have it), whatever share one key has.

    At most HOT_SHARE keys can each hold total / HOT_SHARE rows or more: those are
    broadcast, so their rows stay where they are. All others meet by a shuffle in
    which no key has more than that share.
    """
    hot = F.col(size) * HOT_SHARE >= total
    few = groups.filter(hot)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(groups.filter(~hot), key, how)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def uniform(key, seed: str):
    """A number in [0, 1) from 52 bits of the md5 of seed and key; equal in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def repeatable(df: DataFrame) -> DataFrame:
    """df, written first if it comes out of a shuffle: a task run again then sees its rows in the same order."""
    return materialise(df, "input") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df
