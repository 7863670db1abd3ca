"""Streaming jobs. State is bounded by watermarks; sinks are files or foreachBatch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampType

from sparkcurate.operators.order import join_same
from sparkcurate.operators.rules import RuleBook, judge_answers


def gate(stream: DataFrame, book: RuleBook, passed_path: str, quarantine_path: str,
         checkpoint: str, columns: Sequence[str] = ("id", "complaint", "answer"),
         trust_label: bool = False) -> StreamingQuery:
    """Judge a stream of answers: accepted ones to one table, the rest with reasons to another.

    The gate keeps no state. Each batch goes to a folder named by its number and a replayed batch
    overwrites it, so a restart does not duplicate rows.
    """
    judged = judge_answers(stream, book, trust_label=trust_label)
    rows = judged.select(*columns, "verdict.ok", "verdict.failures")

    def route(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("ok").select(*columns).write.mode("overwrite").parquet(
            f"{passed_path}/batch={number}")
        batch.where("NOT ok").select(*columns, "failures").write.mode("overwrite").parquet(
            f"{quarantine_path}/batch={number}")
        batch.unpersist()

    return split_stream(rows, route, checkpoint)


def split_stream(rows: DataFrame, route: Callable[[DataFrame, int], None],
                 checkpoint: str) -> StreamingQuery:
    """Run ``route`` on every micro batch until the available input is used up."""
    return (
        rows.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latency_counts(stream: DataFrame, ts: str, key: str, value: str, window: str = "1 day",
                   delay: str = "1 hour") -> DataFrame:
    """How often each value occurs per tumbling window and key; rows later than ``delay`` are dropped.

    The state is one small row per distinct value, spread over all tasks, and goes when its window closes.
    """
    rows = stream.select(F.col(ts).cast("timestamp").alias("ts"), F.col(key).alias("key"),
                         F.col(value).cast("double").alias("v"))
    return (
        rows.where("v IS NOT NULL").withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "key", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "v", "n")
    )


def latency_windows(counts: DataFrame, fractions: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """n, mean and exact percentiles ``p50, p95, ...`` per window and key from the stored counts."""
    group = ["start", "end", "key"]
    upto = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counts.groupBy(*group).agg(
        F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    ranked = join_same(counts.withColumn("last", F.sum("n").over(upto) - 1), totals, group)
    first, out = F.col("last") - F.col("n") + 1, []
    for f in fractions:
        rank = F.lit(float(f)) * (F.col("total") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        at_low = F.max(F.when((first <= low) & (low <= F.col("last")), F.col("v")))
        at_high = F.max(F.when((first <= high) & (high <= F.col("last")), F.col("v")))
        out.append((at_low + (at_high - at_low) * F.max(rank - low)).alias(f"p{round(100 * f)}"))
    return ranked.groupBy(*group).agg(F.max("total").alias("n"), F.max("mean").alias("mean"), *out)


def first_arrivals(stream: DataFrame, ids: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Drop replays of an id within the delay. The first arrival stays, while the batch reader of
    answer files keeps the last one."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a Parquet table, using up the available input."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def closed(ends: Column, newest: Column, delay: str) -> Column:
    """Whether a window's end lies behind the watermark."""
    return ends <= newest - F.expr(f"INTERVAL {delay}")


#: Buckets of ids; the ids of one are judged together.
BUCKETS = 1024


class KeptArrivals(StatefulProcessor):
    """Per id: an arrival is kept unless one was kept within ``delay`` before it; order is that of event time.

    Rows come by bucket of ids, as a call for every id would cost more than its rows. State is one row per id with its
    last kept time, in RocksDB; what the watermark has passed by its delay is not written again, and a timer clears a bucket
    when that holds for all of its ids.
    """

    def __init__(self, ids: Sequence[str], ts: str, delay: timedelta, state: StructType) -> None:
        self.ids, self.ts, self.delay, self.state = list(ids), ts, delay, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = {tuple(row[:-1]): pd.Timestamp(row[-1]) for row in self.kept.get()} if self.kept.exists() else {}
        arrived = pd.concat(list(rows), ignore_index=True)
        arrived = arrived.drop(columns=arrived.columns[-1]).assign(**{self.ts: pd.to_datetime(arrived[self.ts])})
        arrived = arrived.sort_values([self.ts, *[c for c in arrived.columns if c not in (*self.ids, self.ts)]], kind="stable")
        keep = []
        for *who, at in zip(*[arrived[c].tolist() for c in (*self.ids, self.ts)], strict=True):
            before = last.get(tuple(who))
            keep.append(before is None or at > before + self.delay)
            if keep[-1]:
                last[tuple(who)] = at
        if any(keep):
            passed = pd.Timestamp(max(timerValues.getCurrentWatermarkInMs(), 0), unit="ms")
            last = {who: at for who, at in last.items() if at + self.delay >= passed}
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last:
                self.kept.put([(*who, at.to_pydatetime()) for who, at in last.items()])
                end = max(last.values()) + self.delay
                self.handle.registerTimer(int(end.tz_localize("UTC").timestamp() * 1000) + 1)
            else:
                self.kept.clear()
        yield arrived[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        """Nothing to release."""


def kept_arrivals(stream: DataFrame, ids: Sequence[str], ts: str, delay: timedelta) -> DataFrame:
    """First arrivals with a memory: after one is kept, further ones of its ids are dropped until ``delay`` has passed.

    Unlike :func:`first_arrivals` the outcome does not depend on how the input falls into batches, as long as rows are not
    later than ``delay``; later ones are dropped by the watermark. Rows of equal time are ordered by their
    other columns. Ids and time must not be null. The session needs the RocksDB state store and UTC.
    """
    schema = stream.schema
    seconds = f"{int(delay.total_seconds())} seconds"
    bucket = next(name for name in ("bucket" + "_" * i for i in range(len(schema) + 1)) if name not in schema.names)
    dealt = stream.withWatermark(ts, seconds).withColumn(bucket, F.pmod(F.xxhash64(*ids), F.lit(BUCKETS)))
    state = StructType([*[schema[c] for c in ids], StructField("kept_at", TimestampType())])
    return dealt.groupBy(bucket).transformWithStateInPandas(
        KeptArrivals(ids, ts, delay, state), outputStructType=schema, outputMode="append", timeMode="eventTime")


#: What a session needs for :func:`kept_arrivals`.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
