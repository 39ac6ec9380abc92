"""Tar archives as a data source: headers give member offsets, tasks seek to byte ranges.

Archives of up to `rangeBytes` are a task's each. A larger one is planned by a walk over its
headers, which seeks past contents, and is cut into ranges of that size at member
boundaries; a task reads the members that begin in its range, one at a time.

A part that cannot be read gives a row with `error` and its offset instead of content: an
archive that is no tar or ends early ("truncated", "broken header", "no end mark"), and a
member over `memberBytes` ("too large"). Members before the break are read.

The source opens paths as files, so archives lie on a file system that all machines mount;
`members` of other stores' archives are read from whole binary rows.
"""

from __future__ import annotations

import glob as globbing
import io
import os
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, offset long, size long, content binary, error string"
RANGE_BYTES, MEMBER_BYTES = 256 << 20, 1 << 30
BLOCK = 512


class Range(InputPartition):
    """Members of an archive whose headers begin in [start, end), or at start or later; or what is wrong at start."""

    def __init__(self, archive: str, start: int, end: int | None, error: str | None = None):
        self.archive, self.start, self.end, self.error = archive, start, end, error


def walk(f, start: int = 0):
    """(header offset, TarInfo, TarFile) of members from a header on; then (offset, error, None), error None at a proper end."""
    size = f.seek(0, os.SEEK_END)
    f.seek(start)
    if size - start < BLOCK:
        yield start, "no tar archive" if start == 0 else "truncated", None
        return
    try:
        tar = tarfile.open(fileobj=f, mode="r:")
        while (m := tar.next()) is not None:
            tar.members = []
            if m.offset_data + m.size > size:
                yield m.offset, "truncated", None
                return
            yield m.offset, m, tar
    except (tarfile.TarError, EOFError, ValueError, OverflowError) as e:
        f.seek(min(f.tell(), size))
        yield start if f.tell() <= start + BLOCK else f.tell(), "no tar archive" if start == 0 and f.tell() <= BLOCK else "truncated" if "unexpected end" in str(e) else "broken header", None
        return
    # A header that reads as the end must be a block of zeros.
    f.seek(tar.offset - BLOCK if tar.offset > size else tar.offset)
    at, mark = tar.offset, f.read(BLOCK)
    yield at, None if mark and not mark.strip(b"\0") else "no end mark" if not mark else "broken header", None


def ranges(archive: str, most: int = RANGE_BYTES) -> list[Range]:
    """An archive's byte ranges, and what breaks it."""
    out, first, held, last = [], None, 0, None
    try:
        if os.path.getsize(archive) <= most:
            return [Range(archive, 0, None)]
        with open(archive, "rb") as f:
            for at, m, tar in walk(f):
                if tar is None:
                    if first is not None:
                        out.append(Range(archive, first, last + 1))
                    if m:
                        out.append(Range(archive, at, at, m))
                    break
                if first is not None and held >= most:
                    out.append(Range(archive, first, at))
                    first, held = None, 0
                first = at if first is None else first
                held, last = held + m.size, at
    except OSError as e:
        out.append(Range(archive, 0, 0, f"{type(e).__name__}: {e.strerror}"))
    return out


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options.get("path", "")
        self.glob, self.suffix = options.get("glob", "*.tar"), options.get("suffix", "")
        self.range_bytes, self.member_bytes = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("memberBytes", MEMBER_BYTES))

    def archives(self) -> list[str]:
        path = self.paths.removeprefix("file://")
        return sorted(globbing.glob(os.path.join(path, "**", self.glob), recursive=True) if os.path.isdir(path) else globbing.glob(path))

    def partitions(self):
        return [r for a in self.archives() for r in ranges(a, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.error:
            yield part.archive, None, part.start, None, None, part.error
        elif part.archive:
            with open(part.archive, "rb") as f:
                for at, m, tar in walk(f, part.start):
                    if tar is None or part.end is not None and at >= part.end:
                        if tar is None and part.end is None and m:
                            yield part.archive, None, at, None, None, m
                        break
                    if m.isfile() and m.name.endswith(self.suffix):
                        if m.size > self.member_bytes:
                            yield part.archive, m.name, at, m.size, None, "too large"
                        else:
                            yield part.archive, m.name, at, m.size, tar.extractfile(m).read(), None


class TarSource(DataSource):
    """spark.read.format("tar_members"); options path, glob, suffix, rangeBytes, memberBytes."""

    @classmethod
    def name(cls):
        return "tar_members"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TarReader(self.options)


def scan(spark: SparkSession, path: str, suffix: str = "", **options) -> DataFrame:
    """Rows of SCHEMA of the tar archives below a mounted folder."""
    spark.dataSource.register(TarSource)
    reader = spark.read.format("tar_members").option("suffix", suffix)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Rows of SCHEMA of archives under 2 GB in any store that Spark reads."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, m, tar in walk(io.BytesIO(content)):
                    if tar is not None and m.isfile() and m.name.endswith(suffix):
                        row = (name, m.name, at, m.size, tar.extractfile(m).read(), None)
                    elif tar is None and m:
                        row = (name, None, at, None, None, m)
                    else:
                        continue
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["archive", "member", "offset", "size", "content", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def extract(found: DataFrame, folder: str) -> DataFrame:
    """Write members as files below a mounted folder; (member, status): success, skipped where the file is there, or failed.

    A file appears under its name only when it is whole, so tasks may be run again.
    """
    root = folder.removeprefix("file://")

    def run(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            status = []
            for name, content, error in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                to = os.path.normpath(os.path.join(root, name or ""))
                if error is not None or not to.startswith(os.path.normpath(root) + os.sep):
                    status.append("failed")
                elif os.path.exists(to):
                    status.append("skipped")
                else:
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    part = f"{to}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(content)
                    os.replace(part, to)
                    status.append("success")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status)], names=["member", "status"])

    return found.select("member", "content", "error").mapInArrow(run, "member string, status string")


def write_tars(files: DataFrame, folder: str, archives: int) -> DataFrame:
    """(member, content) -> tar archives below a mounted folder, dealt by member; (archive, members, bytes).

    A task streams its rows into one archive, which gets its name when it is whole.
    """
    root = folder.removeprefix("file://")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(root, exist_ok=True)
        to = os.path.join(root, f"{TaskContext.get().partitionId():05d}.tar")
        part, n = f"{to}.{uuid.uuid4().hex}", 0
        with tarfile.open(part, "w") as tar:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    info = tarfile.TarInfo(name)
                    info.size, n = len(content), n + 1
                    tar.addfile(info, io.BytesIO(content))
        size = os.path.getsize(part)
        os.replace(part, to)
        yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["archive", "members", "bytes"])

    return files.select("member", F.coalesce("content", F.lit(b"")).alias("content")).repartition(archives, "member").mapInArrow(run, "archive string, members long, bytes long")
