"""The corpus job: files to published Parquet parts, restartable at any point.

Source files are dealt to batches by the hash of their names. A batch is one Spark job: it
prepares its records, writes good ones and rejects into an attempt folder of its own, then
a manifest, and publishes the folder by one rename that fails if the name is taken.
Readers see published folders only, so a job that is killed at any point leaves whole
batches and folders that nobody reads; two runs at once publish a batch once.

A rerun skips batches whose files are as they were. Where files came or changed, only
records whose key is not published yet are prepared, as the batch's next generation.

    out/attempts/<batch>.<generation>-<random>/   written, not yet published
    out/published/gen=<batch>.<generation>/outcome=.../fan=.../*.parquet
    out/published/gen=<batch>.<generation>/_manifest.json
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOOD, REJECTED = "parts", "rejects"


@dataclass(frozen=True)
class Manifest:
    """What a published generation of a batch holds."""

    batch: str
    generation: int
    fingerprint: str
    good: int
    rejected: int
    schema: str

    @property
    def name(self) -> str:
        return f"{self.batch}.{self.generation:05d}"


@dataclass(frozen=True)
class Batch:
    """A named share of the source: its records, and a fingerprint that changes when its files do."""

    name: str
    fingerprint: str
    read: Callable[[], DataFrame]
    files: tuple[str, ...] = field(default=())


class _Store:
    """The file system that holds a path, by Hadoop's interface, whatever store it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def files(self, pattern: str) -> list[tuple[str, int, int]]:
        found = self.fs.globStatus(self.path(pattern)) or []
        return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found if s.isFile())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, to: str) -> bool:
        """Rename, all or nothing; False if `to` is there already."""
        self.fs.mkdirs(self.path(to).getParent())
        options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.gateway.new_array(options, 1)
        none[0] = options.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(name)), self.fs.makeQualified(self.path(to)), none)
        except Exception:
            if self.exists(to):
                return False
            raise
        return True


def by_files(spark: SparkSession, pattern: str, read: Callable[[list[str]], DataFrame], batches: int) -> list[Batch]:
    """Batches of the files of a glob, dealt by the hash of their names; empty ones are left out."""
    store, dealt = _Store(spark, pattern), {}
    for f in store.files(pattern):
        dealt.setdefault(zlib.crc32(f[0].rsplit("/", 1)[-1].encode()) % batches, []).append(f)
    return [_batch(f"{b:05d}", files, read) for b, files in sorted(dealt.items())]


def by_folders(spark: SparkSession, pattern: str, read: Callable[[list[str]], DataFrame], glob: str = "*") -> list[Batch]:
    """One batch for the files of each folder of a glob, by the folder's name."""
    store, dealt = _Store(spark, pattern), {}
    for f in store.files(f"{pattern}/{glob}"):
        dealt.setdefault(f[0].rsplit("/", 2)[-2].replace("=", "-"), []).append(f)
    return [_batch(name, files, read) for name, files in sorted(dealt.items())]


def _batch(name: str, files, read) -> Batch:
    import hashlib

    paths = [f[0] for f in files]
    return Batch(name, hashlib.sha256(json.dumps(files).encode()).hexdigest(), lambda: read(paths), tuple(paths))


def manifests(spark: SparkSession, out: str) -> list[Manifest]:
    """Manifests of published generations, in their order: one per batch and generation."""
    store = _Store(spark, out)
    found = [Manifest(**json.loads(store.read(f[0]))) for f in store.files(f"{store.root}/published/*/_manifest.json")]
    return sorted(found, key=lambda m: (m.batch, m.generation))


def _rows(spark: SparkSession, out: str, of: list[Manifest], outcome: str) -> DataFrame | None:
    with_rows = [m for m in of if (m.good if outcome == GOOD else m.rejected)]
    if not with_rows:
        return None
    schema, root = T.StructType.fromJson(json.loads(with_rows[-1].schema)), f"{out.rstrip('/')}/published"
    found = spark.read.option("basePath", root).schema(schema).parquet(*[f"{root}/gen={m.name}" for m in with_rows])
    return found.filter(F.col("outcome") == outcome).select(*[c for c in schema.names if c != "outcome"])


def published(spark: SparkSession, out: str) -> DataFrame | None:
    """All published records; None if there are none."""
    found = _rows(spark, out, manifests(spark, out), GOOD)
    return None if found is None else found.drop("error")


def rejects(spark: SparkSession, out: str) -> DataFrame | None:
    """All published rejects with their error; None if there are none."""
    return _rows(spark, out, manifests(spark, out), REJECTED)


def run(spark: SparkSession, batches: list[Batch], out: str, key: str, prepare: Callable[[DataFrame], DataFrame], fan: Column | None = None, part_rows: int = 100_000, clear: bool = False) -> list[str]:
    """Publish what is not published yet; the names of the generations that this run published.

    prepare: records to rows with `key` and `error` (null: good). fan: a column that rows
    are dealt by into folders. clear: delete a batch's files once it is published.
    """
    store, done = _Store(spark, out), {}
    for r in manifests(spark, out):
        done.setdefault(r.batch, []).append(r)
    new = []
    for b in batches:
        before = done.get(b.name, [])
        if before and before[-1].fingerprint == b.fingerprint:
            continue
        rows = prepare(b.read())
        there = _rows(spark, out, before, GOOD)
        if there is not None:
            rows = rows.join(there.select(key).distinct(), key, "left_anti")
        rows = rows.withColumn("outcome", F.when(F.col("error").isNull(), GOOD).otherwise(REJECTED)).withColumn("fan", (fan if fan is not None else F.lit(0)).cast("int"))
        generation = before[-1].generation + 1 if before else 0
        attempt = f"{store.root}/attempts/{b.name}.{generation:05d}-{uuid.uuid4().hex}"
        rows.write.partitionBy("outcome", "fan").option("maxRecordsPerFile", part_rows).option("compression", "snappy").parquet(attempt)
        counts = {r["outcome"]: r["count"] for r in spark.read.schema(rows.schema).parquet(attempt).groupBy("outcome").count().collect()}
        manifest = Manifest(b.name, generation, b.fingerprint, counts.get(GOOD, 0), counts.get(REJECTED, 0), rows.schema.json())
        store.write(f"{attempt}/_manifest.json", json.dumps(asdict(manifest)))
        if store.publish(attempt, f"{store.root}/published/gen={manifest.name}"):
            new.append(manifest.name)
        else:  # another run was first
            store.delete(attempt)
        if clear:
            for f in b.files:
                store.delete(f)
    return new


def statuses(spark: SparkSession, out: str, key: str, new: list[str]) -> DataFrame | None:
    """(key, status, error): success for records that this run published, skipped for earlier ones, failed for rejects."""
    of = manifests(spark, out)
    fresh = [m for m in of if m.name in set(new)]
    old = [m for m in of if m.name not in set(new)]
    found = [(_rows(spark, out, old, GOOD), "skipped"), (_rows(spark, out, fresh, GOOD), "success"), (_rows(spark, out, of, REJECTED), "failed")]
    frames = [df.select(key, F.lit(status).alias("status"), "error") for df, status in found if df is not None]
    whole = frames[0] if frames else None
    for df in frames[1:]:
        whole = whole.unionByName(df)
    return whole


def sweep(spark: SparkSession, out: str) -> None:
    """Remove attempts that were never published; only while no run is under way."""
    store = _Store(spark, out)
    store.delete(f"{store.root}/attempts")
