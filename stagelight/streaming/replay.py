"""Structured Streaming over tables that arrive as files, each query run to the end of what is there.

State is kept per key and ends by watermark: windows when they close, a key's own window by a timer. Sinks are written by batch
under the query's checkpoint, so a query that is started again with the same folder goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stagelight.operators.ingest import latest_wins
from stagelight.sources.saved import shared_dir
from stagelight.sources.upserts import PARTS, KeyedTable


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a table's files; the schema comes from the files' footers once.

    The path is given as a pattern that only it fits: stream sources take a single file in no other way.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


#: Keyed state with timers is kept in this store.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(stream: DataFrame, mode: str, write: Callable[[DataFrame, int, str], None], folder: str) -> StreamingQuery:
    """The query, on its way through all that is there."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # a query takes the store that is set when it starts
    try:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(lambda df, i: write(df, i, f"{folder}/out")).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def run_to_end(stream: DataFrame, mode: str, write: Callable[[DataFrame, int, str], None], folder: str | None = None) -> str:
    """Process all that is there; gives the folder that write() was told to write to."""
    folder = folder or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    started(stream, mode, write, folder).awaitTermination()
    return f"{folder}/out"


def append(df: DataFrame, batch: int, out: str) -> None:
    """A folder a batch, so that a batch that is run again replaces itself."""
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def newest(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """Of what batches wrote in update mode: the row of each key from the last batch that changed it."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Event-time tumbling days per type; rows later than the delay are dropped once their day has closed."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", delay)
    return timed.groupBy(F.window("time", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding_counts(events: DataFrame, width: str, step: str, delay: str = "1 hour") -> DataFrame:
    timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", delay)
    return timed.groupBy(F.window("time", width, step).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], delay: str = "31 days") -> DataFrame:
    """The first row to arrive of each key within the watermark."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", delay)
    return timed.dropDuplicatesWithinWatermark(keys).select(*keys)


class OwnWindow(StatefulProcessor):
    """Counts a key's requests in windows that its first request opens; the state ends with the window, by a timer."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.window.get() if self.window.exists() else None
        opened, n = before or (None, 0)
        given = pd.concat(list(rows)).sort_values("at")
        counts = []
        for t in given["at"].astype("int64"):
            if opened is None or t >= opened + self.width:
                opened, n = t, 0
            n += 1
            counts.append(n)
        if before is None or before[0] != opened:
            if before is not None:
                self.handle.deleteTimer(self._ends(before[0]))
            self.handle.registerTimer(self._ends(opened))
        self.window.update((int(opened), n))
        yield pd.DataFrame({"key": given["key"], "at": given["at"], "n": counts, "allowed": [c <= self.most for c in counts]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "at": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "allowed": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass

    def _ends(self, opened: int) -> int:
        """In milliseconds, not before the last microsecond."""
        return int(-(-(opened + self.width) // 1000))


def limited(requests: DataFrame, key: str, at: str, width_seconds: int, most: int, delay: str = "1 hour") -> DataFrame:
    """key, at, n, allowed of each request, n counting from the first in a window that a request opens when none is open.

    A key's window and count are its state, which ends when the watermark passes the window's end: any later request opens
    another. Requests of one trigger are taken in order of time; later ones than the delay are dropped. Each count depends on
    the one before, so a key's requests of one trigger are worked on in one task: triggers must be bounded (maxFilesPerTrigger).
    """
    time = F.col(at).cast("timestamp")
    timed = requests.select(F.col(key).alias("key"), F.unix_micros(time).alias("at"), time.alias("time")).withWatermark("time", delay)
    return timed.groupBy("key").transformWithStateInPandas(OwnWindow(width_seconds * 1_000_000, most), "key long, at long, n long, allowed boolean", "Append", "EventTime")


def keep_latest(items: DataFrame, keys: list[str], at: str, tie: str, parts: int = PARTS) -> Callable[[DataFrame, int, str], None]:
    """A sink that holds the newest item of each key: each batch is merged into the parts of the table that its keys are in."""

    def write(df: DataFrame, batch: int, out: str) -> None:
        KeyedTable(df.sparkSession, out, keys, parts).upsert(df, batch, lambda old, new: latest_wins(old.unionByName(new), keys, at, tie))

    return write


class Heartbeat(StreamingQueryListener):
    """Remembers when each query last made progress."""

    def __init__(self) -> None:
        self.last: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.last[str(event.id)] = "started"

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.last[str(event.progress.id)] = event.progress.timestamp

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.last[str(event.id)] = "ended"
