"""Operators with state of their own over streams: a running percentile of the newest values, and sums that end when a key goes quiet."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """The store that keyed state needs, for queries started inside; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Newest(StatefulProcessor):
    """Holds the ``recent`` newest values of a key, never more, and gives their percentile after each batch."""

    def __init__(self, p: float, recent: int):
        self.p, self.recent = p, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("newest", "at long, tie long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = pd.DataFrame([*self.held.get()], columns=["at", "tie", "value"])
        for part in rows:
            both = part[["at", "tie", "value"]] if newest.empty else pd.concat([newest, part[["at", "tie", "value"]]])
            newest = both.sort_values(["at", "tie", "value"], ascending=[False, False, True], kind="stable").head(self.recent)
        self.held.put([(int(a), int(t), float(v)) for a, t, v in newest.itertuples(index=False)])
        n = len(newest)
        values = newest["value"].sort_values().to_list()
        yield pd.DataFrame({"key": [key[0]], "n": [n], "value": [values[min(n - 1, int(self.p / 100.0 * n))]]})

    def close(self) -> None:
        pass


def running_percentile(stream: DataFrame, key: str, value: str, ts: str, tie: str, p: float = 95, recent: int = 1000) -> DataFrame:
    """(key, n, value): after each micro-batch, for the keys that it touches, the value at index int(p/100 * n) of the ``recent``
    newest rows by (ts, tie). State is bounded by ``recent`` rows a key; null keys form a key, null values, times and ties are left out.
    A query on it runs within ``state_store`` and in update mode; its last row of a key is what the batch operator gives."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value")).dropna(subset=["at", "tie", "value"])
    return rows.groupBy("key").transformWithStateInPandas(_Newest(p, recent), "key string, n long, value double", outputMode="Update", timeMode="None")


class _Quiet(StatefulProcessor):
    """Sums by name of one trace. They are given, and forgotten, when the watermark has passed the trace's last row by ``idle``.

    A trace is one value, read and written once a batch: each call on state is a message between the worker and the JVM, and there are
    very many traces with few rows each."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "names array<string>, ms array<double>, n array<bigint>, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark, held = timerValues.getCurrentWatermarkInMs(), self.held.get()
        before = None if held is None else held[3]
        sums = {} if held is None else {name: (ms, n) for name, ms, n in zip(*held[:3], strict=True)}
        last, changed = before, False
        for row in rows:
            if row["at"] < watermark:
                yield Row(trace_id=key[0], name=row["name"], ms=row["ms"], n=1, last=row["at"], late=True)
                continue
            ms, n = sums.get(row["name"], (0.0, 0))
            sums[row["name"]] = ms + row["ms"], n + 1
            last, changed = row["at"] if last is None else max(last, row["at"]), True
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last + self.idle_ms)
        if changed:
            self.held.update(([*sums], [ms for ms, _ in sums.values()], [n for _, n in sums.values()], last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        names, all_ms, all_n, last = self.held.get()
        self.held.clear()
        for name, ms, n in zip(names, all_ms, all_n, strict=True):
            yield Row(trace_id=key[0], name=name, ms=ms, n=n, last=last, late=False)

    def close(self) -> None:
        pass


def trace_totals(stream: DataFrame, trace: str, name: str, ms: str, ts: str, idle_ms: int = 60_000, delay: str = "10 minutes") -> DataFrame:
    """(trace_id, name, ms, n, last, late): the sums of each trace by name, once it has been quiet for ``idle_ms`` behind the
    watermark; last is its latest time in milliseconds. A row that comes behind the watermark is given as it is, with late true, so that
    a sink can keep such rows in a table of their own. Nulls in any column are left out. A query on it runs within ``state_store`` and in append mode."""
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    # a plain number carries no watermark, so that rows behind it reach the operator and are not dropped on the way
    rows = rows.select(F.col(trace).cast("string").alias("trace_id"), F.col(name).alias("name"), F.col(ms).cast("double").alias("ms"), F.unix_millis("__ts").alias("at")).dropna()
    schema = "trace_id string, name string, ms double, n long, last long, late boolean"
    return rows.groupBy("trace_id").transformWithState(_Quiet(idle_ms), schema, outputMode="Append", timeMode="EventTime")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a query over all that its source has and gives what it wrote, with the number of the micro-batch. A batch that is replayed
    after a failure overwrites its own folder, so that no row counts twice."""
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_store(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{ddl}, batch int").option("basePath", path).parquet(path)
