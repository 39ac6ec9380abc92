"""Streams with a state of their own per key: first rows, and sessions that close by a timer.

State lies in RocksDB and its checkpoints, so a key costs a lookup, not a reread of what was
written; a restart goes on from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class FirstRow(StatefulProcessor):
    """Gives a key's first row of the stream; with initial state, none for keys that are there already."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            if len(part) and not self.seen.exists():
                self.seen.update((True,))
                yield part.iloc[:1]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_rows(df: DataFrame, key: str, there: DataFrame | None = None) -> DataFrame:
    """The first row of each key of a stream; there: a table whose keys count as seen when the stream begins."""
    use_rocksdb(df.sparkSession)
    known = there.select(key).distinct().groupBy(key) if there is not None else None
    return df.groupBy(key).transformWithStateInPandas(FirstRow(), df.schema, "Append", "None", known)


def append_new(df: DataFrame, key: str, path: str, checkpoint: str, there: DataFrame | None = None) -> None:
    """Rows of keys that are not there yet, appended once; a restart adds nothing twice."""
    first_rows(df, key, there).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Sessions(StatefulProcessor):
    """Sessions of a key in event time, kept open until the watermark passes their end plus the gap."""

    def __init__(self, key: str, time: str, gap_ms: int, keep_ms: int):
        self.key, self.time, self.gap, self.keep = key, time, gap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Open sessions by their start.
        self.open = handle.getMapState("open", "start long", "end long, n long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held = sorted((k[0], v[0], v[1]) for k, v in self.open.iterator())
        for part in rows:
            times = part[self.time].astype("datetime64[ms]").astype("int64").tolist()
            held += [(t, t, 1) for t in times]
        merged: list[list[int]] = []
        for start, end, n in sorted(held):
            if merged and start - merged[-1][1] < self.gap:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], end), merged[-1][2] + n
            else:
                merged.append([start, end, n])
        self.open.clear()
        for start, end, n in merged:
            self.open.updateValue((start,), (end, n))
            self.handle.registerTimer(end + self.keep)
        yield pd.DataFrame({c: [] for c in (self.key, "start", "end", "n")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs()
        done = [(k[0], v[0], v[1]) for k, v in self.open.iterator() if v[0] + self.keep <= now]
        for start, _, _ in done:
            self.open.removeKey((start,))
        if done:
            yield pd.DataFrame({self.key: [key[0]] * len(done), "start": [x[0] for x in done], "end": [x[1] for x in done], "n": [x[2] for x in done]})

    def close(self) -> None:
        pass


def closed_sessions(df: DataFrame, key: str, time: str, gap_ms: int, late_ms: int) -> DataFrame:
    """(key, start, end, n) of sessions, in milliseconds, once no row can reach them any more.

    df: a stream; rows less than gap_ms apart are of one session, rows later than late_ms behind the newest
    are dropped, and counted by Spark (`late_rows`). A session is given once, when its timer fires.
    """
    use_rocksdb(df.sparkSession)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n", T.LongType())])
    rows = df.select(key, F.col(time).cast("timestamp").alias(time)).withWatermark(time, f"{late_ms} milliseconds")
    return rows.groupBy(key).transformWithStateInPandas(Sessions(key, time, gap_ms, gap_ms), schema, "Append", "EventTime")


def late_rows(query) -> int:
    """Rows that a query's stateful operators dropped as late, over all its triggers that are remembered."""
    return sum(s.get("numRowsDroppedByWatermark", 0) if isinstance(s, dict) else s.numRowsDroppedByWatermark for p in query.recentProgress for s in p["stateOperators"])
