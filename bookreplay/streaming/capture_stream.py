"""Capture under Structured Streaming: numbers, lateness marks, the ledger, counters and frozen targets.

Keyed processors carry a run's or a target's few values over micro-batches, so a stream gives what one pass
over all rows would. Their state is a handful of numbers for each key. Rows of a key are taken in order
inside a batch; batches must follow each other (ordered files with a bound for each trigger)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bookreplay.operators import ledger
from bookreplay.streaming import chunks
from bookreplay.streaming.book_stream import ROCKSDB
from bookreplay.streaming.chunks import Chunks

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def started(writer, spark: SparkSession):
    """Starts a query with the RocksDB state store; the session keeps its own setting."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, na_position="first", kind="stable")


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


# --- numbers of a run -----------------------------------------------------------------------------

NUMBERED = "run string, frame_no long, event_idx int, token_id string, seq long"


class SequenceProcessor(StatefulProcessor):
    """The next numbers of a run for a batch's produced records, by frame, event and token."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        todo = _ordered(rows, ["frame_no", "event_idx", "token_id"])
        seq = self.next.get()[0] if self.next.exists() else 1
        out = [(key[0], int(r.frame_no), _whole(r.event_idx), r.token_id, seq + i) for i, r in enumerate(todo.itertuples(index=False))]
        self.next.update((seq + len(out),))
        yield _frame(out, NUMBERED)

    def close(self) -> None:
        pass


def numbered(produced: DataFrame) -> DataFrame:
    """seq 1, 2, ... of each run over all batches, for produced records only."""
    held = produced.where("status <> 'not_applicable'").select(F.col("run").cast("string").alias("run"), F.col("frame_no").cast("long").alias("frame_no"), F.col("event_idx").cast("int").alias("event_idx"), "token_id")
    return held.groupBy("run").transformWithStateInPandas(statefulProcessor=SequenceProcessor(), outputStructType=NUMBERED, outputMode="append", timeMode="None")


# --- lateness of a run ----------------------------------------------------------------------------

MARKED = "run string, seq long, outcome string, lateness string, watermark_us long, gap long, regressed boolean"


class LatenessProcessor(StatefulProcessor):
    """Marks each arrival by the run's high event time so far, its gap from the number before it, and whether it was
    received before an earlier one. An arrival at or below the last number came out of order: it is marked so and
    moves nothing. Late rows are marked and kept."""

    def __init__(self, allowed_us: int):
        self.allowed_us = allowed_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "high long, clock long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        high, clock, last = self.run.get() if self.run.exists() else (None, None, None)
        out = []
        for r in _ordered(rows, ["seq"]).itertuples(index=False):
            seq, at, received = int(r.seq), _whole(r.event_us), _whole(r.received_us)
            if last is not None and seq <= last:
                out.append((key[0], seq, r.outcome, "out_of_order", None, 0, False))
                continue
            mark = None if high is None else high - self.allowed_us
            lateness = "undatable" if at is None else "late" if mark is not None and at < mark else "on_time"
            out.append((key[0], seq, r.outcome, lateness, mark, 0 if last is None else seq - last - 1, received is not None and clock is not None and received < clock))
            if r.applied and at is not None:
                high = at if high is None else max(high, at)
            if received is not None:
                clock = received if clock is None else max(clock, received)
            last = seq
        self.run.update((high, clock, last))
        yield _frame(out, MARKED)

    def close(self) -> None:
        pass


def marked(outcomes: DataFrame, allowed_seconds: int = 0) -> DataFrame:
    """outcomes: run, seq, outcome, applied, event_time, received_time. The rows of ``lateness.with_lateness`` with the
    gaps and regressions that the run's counters sum up."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = outcomes.select(F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), "outcome", "applied", us("event_time").alias("event_us"), us("received_time").alias("received_us"))
    return held.groupBy("run").transformWithStateInPandas(statefulProcessor=LatenessProcessor(allowed_seconds * 1_000_000), outputStructType=MARKED, outputMode="append", timeMode="None")


# --- targets that freeze --------------------------------------------------------------------------

FROZEN = "run string, condition_id string, token_id string, seq long, midpoint string, previous_midpoint string"


class FreezeProcessor(StatefulProcessor):
    """The last state emitted before a target closes, given out by a timer at its close. Event time is the time of
    receipt, so the watermark says when no row from before the close can come any more. A key is a group of a run's
    targets (``chunks.shard``): an entry for each target, and for each close the names of the targets it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", chunks.KEY, chunks.VALUE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entries, targets, closes = Chunks(self.chunks, "targets"), {}, {}
        for r in _ordered(rows, ["seq"]).itertuples(index=False):
            name = chunks.named(r.condition_id, r.token_id)
            held = targets.get(name) or entries.get(name)
            if held is None:
                held = [int(r.close_us), None, None, None, None, None]
                closes.setdefault(held[0] // 1000, []).append(name)
            close, book, previous, seq, midpoint, kept = held
            at = _whole(r.book_us)
            # A new book time emits again, with the persistence value as it was.
            if (r.changed or at != book) and r.received_us < close:
                seq, midpoint, kept = int(r.seq), r.midpoint, previous
            if r.changed and r.midpoint is not None:
                previous = r.midpoint
            targets[name] = [close, at, previous, seq, midpoint, kept]
        for name, held in targets.items():
            entries[name] = held
        entries.flush()
        for at, names in closes.items():
            due = Chunks(self.chunks, f"close {at}")
            for name in names:
                due[name] = None
            due.flush()
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries, due, out = Chunks(self.chunks, "targets"), Chunks(self.chunks, f"close {expiredTimerInfo.getExpiryTimeInMs()}"), []
        for name in due:
            *_, seq, midpoint, kept = entries.get(name)
            if seq is not None:
                out.append((key[0], *json.loads(name), seq, midpoint, kept))
            del entries[name]
        due.clear()
        entries.flush()
        if out:
            yield _frame(out, FROZEN)

    def close(self) -> None:
        pass


def frozen(states: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """states: run, condition_id, token_id, seq, changed, midpoint, book_event_time, received_time, close_at, as
    ``forecast.states`` gives them. ``delay`` is at least how far receipts of a run fall back."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = states.select(
        *[F.col(c).cast("string").alias(c) for c in ("run", "condition_id", "token_id")], F.col("seq").cast("long").alias("seq"), "changed", F.col("midpoint").cast("string").alias("midpoint"),
        us("book_event_time").alias("book_us"), us("received_time").alias("received_us"), us("close_at").alias("close_us"), F.col("received_time").cast("timestamp").alias("received_time"))
    held = held.withColumn("shard", chunks.shard("condition_id", "token_id")).withWatermark("received_time", delay)
    return held.groupBy("run", "shard").transformWithStateInPandas(statefulProcessor=FreezeProcessor(), outputStructType=FROZEN, outputMode="append", timeMode="EventTime")


# --- the ledger -----------------------------------------------------------------------------------

BUCKETS = 64


def bucket(column: str = "observation_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def open_ledger(spark: SparkSession, folder: str) -> None:
    """A ledger without rows: its commit table has one batch, before all others, and no known ids."""
    spark.createDataFrame([(0,)], "rows long").write.mode("overwrite").parquet(f"{folder}/commits/batch=-1")
    spark.createDataFrame([], "observation_id string").withColumn("bucket", F.lit(0)).write.mode("overwrite").parquet(f"{folder}/observations/batch=-1")


def append_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch once, however often it is played. A batch has folders of its own that a
    second writing replaces, counts the ids of committed earlier batches as known (of the buckets that its own ids
    fall in), and is part of the ledger from when its row in the commit table is there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = spark.read.parquet(f"{folder}/commits").select("batch")
        if not done.where(F.col("batch") == batch_id).isEmpty():
            return
        rows = batch.persist()
        try:
            # At most BUCKETS numbers.
            own = [r.bucket for r in rows.select(bucket()).distinct().collect()]
            known = spark.read.schema("observation_id string, bucket int, batch long").option("basePath", f"{folder}/observations").parquet(f"{folder}/observations")
            known = known.where((F.col("batch") < batch_id) & F.col("bucket").isin(own)).join(done, "batch", "left_semi")
            held = ledger.with_disposition(rows, known)
            held.write.mode("overwrite").parquet(f"{folder}/deliveries/batch={batch_id}")
            fresh = spark.read.parquet(f"{folder}/deliveries/batch={batch_id}")
            fresh.where("disposition = 'accepted_new'").select("observation_id", bucket()).write.mode("overwrite").parquet(f"{folder}/observations/batch={batch_id}")
            fresh.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch_id}")
        finally:
            rows.unpersist()

    return write


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows: those of committed batches."""
    done = spark.read.parquet(f"{folder}/commits").select("batch")
    return spark.read.option("basePath", f"{folder}/deliveries").parquet(f"{folder}/deliveries").join(done, "batch", "left_semi").drop("batch")


# --- live counters --------------------------------------------------------------------------------

#: The counters of a capture by name, over rows with what happened: a frame, an event, or a record's status.
COUNTERS = {
    "frames_consumed": "what = 'frame'", "decode_failures": "what = 'record' and detail in ('not_json', 'scalar_frame')", "events_seen": "what = 'event'", "accepted": "what = 'record' and status = 'accepted'",
    "duplicate": "what = 'record' and status = 'duplicate'", "rejected": "what = 'record' and status = 'rejected'", "not_applicable": "what = 'record' and status = 'not_applicable'",
    "unknown_event_type": "what = 'record' and reason = 'unknown_event_type'",
}


def observed(happened: DataFrame, name: str = "health") -> DataFrame:
    """The same rows; each batch's progress tells the eight counters of all runs that pass."""
    return happened.observe(name, *[F.count_if(F.expr(x)).alias(c) for c, x in COUNTERS.items()])


def totals(query, name: str = "health") -> dict[str, int]:
    """The counters over the batches that a query's recent progress holds."""
    out = dict.fromkeys(COUNTERS, 0)
    for p in query.recentProgress:
        found = p.observedMetrics.get(name)
        for c in COUNTERS if found is not None else ():
            out[c] += found[c]
    return out
