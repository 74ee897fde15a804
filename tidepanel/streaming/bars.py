"""Structured Streaming forms of the bar and alert operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepanel.operators.stateful import Trail, hysteresis_walk
from tidepanel.session import shared_folder
from tidepanel.sources import tables as src


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table, one file or a directory of part files, as a stream of files.

    A plain path of a stream must be a directory; a pattern that only the table's own name matches may
    be either.
    """
    schema = src.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


def live_bars(events: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """Tumbling bars per event type.  State is one small buffer per open (type, window): first
    and last price come from the minimum and maximum print key.

    With ``lateness`` a bar is emitted once the watermark passes its end, and later prints are too
    late.  Without it no print is ever late and every bar stays open, which is the form for a bounded
    backfill whose files come in any order.
    """
    stamp = F.col("ts").cast("timestamp")
    ticks = src.tick_count(F.col("value"))
    stamped = events.withColumn("stamp", stamp)
    if lateness is not None:
        stamped = stamped.withWatermark("stamp", lateness)
    prints = stamped.select(
        F.col("event_type").alias("symbol"), F.window("stamp", width).alias("w"), "stamp",
        ticks.alias("ticks"), (F.pmod("user_id", F.lit(100)) + 1).alias("volume"),
    ).select(
        "symbol", "w", "volume", src.tick_price(F.col("ticks")).alias("price"),
        src.print_key(F.unix_micros("stamp") - F.unix_micros("w.start"), F.col("ticks")).alias("key"),
    )
    return (
        prints.groupBy("symbol", "w")
        .agg(
            F.min("key").alias("first_key"), F.max("key").alias("last_key"),
            F.max("price").alias("high"), F.min("price").alias("low"),
            F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("prints"),
        )
        .select(
            "symbol", F.col("w.start").alias("timestamp_utc"),
            src.key_price(F.col("first_key")).alias("open"), "high", "low",
            src.key_price(F.col("last_key")).alias("close"), "volume", "prints",
        )
    )


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there into a parquet table beside the checkpoints and read it back."""
    spark = stream.sparkSession
    root = shared_folder(spark, name)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{root}/table")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


def run_backfill(stream: DataFrame, name: str, *keys: str) -> DataFrame:
    """Process what is there, in however many batches, and read the final state of every group.

    Each batch writes the groups that it changed to a folder of its own, so a repeated batch replaces its own
    rows and no batch writes the rows of others again.  A group's last change is its final state.
    """
    spark = stream.sparkSession
    root = shared_folder(spark, name)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    seen: list[int] = []

    def keep(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
        seen.append(batch)

    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    changes = spark.read.schema(schema).parquet(f"{root}/changes")
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last")).select("last.*")


class OrderedFold(StatefulProcessor):
    """Folds each key's rows in the order of event time, in whatever order and batches they arrive.

    Rows wait in the key's buffer until the watermark passes them, so all rows before them have come or are too
    late for good.  A timer at the earliest waiting row wakes the key; a key whose rows are all folded wakes
    once more after ``forget_ms`` and gives up its state.
    """

    def __init__(self, fields: str, values: list[str], state: str, step: Callable, output: str, forget_ms: int):
        self.fields, self.values, self.state, self.step = fields, values, state, step
        self.output, self.forget_ms = output, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, {self.fields}")
        self.folded = handle.getValueState("folded", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))
        at = fresh["at_ms"].astype("int64")
        self.waiting.appendList([(int(t), *map(float, v)) for t, v in zip(at, fresh[self.values].to_numpy(float), strict=True)])
        self.handle.registerTimer(int(at.min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            state = tuple(self.folded.get()) if self.folded.exists() else None
            out = []
            for row in due:
                state, value = self.step(state, *row[1:])
                out.append((row[0], value))
            self.folded.update(state)
            found = pd.DataFrame(out, columns=["at_ms", self.output])
            for name, part in zip(reversed(self.keys), reversed(key), strict=True):
                found.insert(0, name, part)
            yield found
        if rest:
            self.handle.registerTimer(rest[0][0])
        elif due:
            self.handle.registerTimer(due[-1][0] + self.forget_ms)
        elif not rows:
            self.folded.clear()


def ordered_fold(stream: DataFrame, keys: list[str], stamp: str, values: list[str], state: str, step: Callable,
                 output: str, lateness: str, forget_ms: int = 86_400_000) -> DataFrame:
    """``keys, at_ms, output`` of a fold over each key's rows in event time; numeric values only."""
    fold = OrderedFold(", ".join(f"`{v}` double" for v in values), values, state, step, output, forget_ms)
    fold.keys = keys
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    rows = stream.withWatermark(stamp, lateness).withColumn("at_ms", F.unix_millis(stamp))
    return rows.groupBy(*keys).transformWithStateInPandas(
        fold, f"{kinds}, at_ms long, `{output}` double", "append", "EventTime")


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Timers need the state store on disk; other queries of the session keep theirs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def live_alerts(scores: DataFrame, stamp: str = "timestamp_utc", score: str = "score", entry: float = 0.55, leave: float = 0.15,
                cap: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Streaming on/off alerts per (symbol, trading date); rows may come in any order within the lateness.

    The walk of the batch form, one row at a time: state is (on/off, age).
    """

    def step(state: tuple | None, value: float, minute: float) -> tuple[tuple, float]:
        now, age = (0.0, 0.0) if state is None else state
        out, now, age = hysteresis_walk(
            np.nan_to_num(np.array([value])), np.array([minute]), entry, leave, cap, float(now), int(age))
        return (float(now), float(age)), float(out[0])

    return ordered_fold(scores, ["symbol", "trading_date"], stamp, [score, "session_minute"], "now double, age double", step,
                        "position_signal", lateness)


def live_sar(bars: DataFrame, stamp: str = "timestamp_utc", factor: float = 0.02, limit: float = 0.2,
             lateness: str = "1 hour") -> DataFrame:
    """Streaming parabolic stop-and-reverse level per symbol; bars may come in any order within the lateness."""

    def step(state: tuple | None, high: float, low: float) -> tuple[tuple, float]:
        trail = Trail.first(high, low, factor) if state is None else Trail(*state).advance(high, low, factor, limit)
        return tuple(map(float, trail)), trail.side * trail.level

    return ordered_fold(bars, ["symbol"], stamp, ["high", "low"], ", ".join(f"`{f}` double" for f in Trail._fields), step, "sar",
                        lateness, forget_ms=365 * 86_400_000)


def replay(spark: SparkSession, rows: DataFrame, stamp: str, order, files: int, name: str) -> tuple[DataFrame, str]:
    """A stored table as a stream of files in the given order, one a batch, and a lateness that covers its disorder.

    One more row, a lateness after the last one and without keys, moves the watermark past all rows.
    """
    root = shared_folder(spark, name)
    first, last = rows.agg(F.min(F.unix_millis(stamp)), F.max(F.unix_millis(stamp))).first()
    span = 0 if first is None else last - first + 1000
    rows.repartitionByRange(files, order).write.parquet(f"{root}/rows")
    end = spark.range(1).select(*[
        (F.timestamp_millis(F.lit((last or 0) + 2 * span)) if f.name == stamp else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in rows.schema.fields])
    end.write.mode("append").parquet(f"{root}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/rows")
    return stream, f"{span} milliseconds"
