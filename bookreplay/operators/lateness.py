"""Lateness marks, run counters and replay summaries. Late rows are marked, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookreplay.functions.columns import micros
from bookreplay.functions.windows import running

OUTCOMES = ["applied_snapshot", "applied_delta", "applied_auxiliary", "skipped_duplicate", "unhandled_payload", "unscoped"]


def with_lateness(outcomes: DataFrame, allowed_seconds: int = 0, placed: str | None = None) -> DataFrame:
    """Adds ``watermark`` and ``lateness`` (on_time, late, undatable). The watermark is the highest
    event time of the run's earlier applied rows less the allowance; equal to it is on time. ``placed``: see ``running``."""
    held = running(outcomes, {"watermark": ("max", F.when(F.col("applied"), F.col("event_time")))}, nulls=False, placed=placed)
    if allowed_seconds:
        held = held.withColumn("watermark", F.col("watermark") - F.make_interval(secs=F.lit(allowed_seconds)))
    late = F.coalesce(F.col("event_time") < F.col("watermark"), F.lit(False))
    return held.withColumn("lateness", F.when(F.col("event_time").isNull(), "undatable").when(late, "late").otherwise("on_time"))


def dispatch_counts(marked: DataFrame) -> DataFrame:
    """Nine counters per run, zeros kept."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    lateness = [F.count_if(F.col("applied") & (F.col("lateness") == x)).alias(x) for x in ("on_time", "late", "undatable")]
    return marked.groupBy("run").agg(*counts, *lateness)


def sequence_gaps(arrivals: DataFrame) -> DataFrame:
    """Numbers between a run's first and last that no arrival has: the sum of seq - previous - 1."""
    used = arrivals.select("run", "seq").distinct().groupBy("run").agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    return used.select("run", (F.col("_hi") - F.col("_lo") + 1 - F.col("_n")).alias("sequence_gaps"))


def receive_regressions(arrivals: DataFrame) -> DataFrame:
    """Arrivals, rejected ones included, received before the highest receive time so far."""
    held = running(arrivals.select("run", "seq", "received_time"), {"_high": ("max", F.col("received_time"))})
    return held.groupBy("run").agg(F.count_if(F.coalesce(F.col("received_time") < F.col("_high"), F.lit(False))).alias("received_time_regressions"))


def run_counts(arrivals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Accepted, duplicate and rejected arrivals of each run; ``ledger`` names each arrival's disposition."""
    met = arrivals.join(ledger.select("run", "seq", "disposition"), ["run", "seq"], "left")
    return met.groupBy("run").agg(
        F.count(F.lit(1)).alias("arrivals"), F.count_if(F.col("disposition") == "accepted_new").alias("accepted"),
        F.count_if(F.col("disposition") == "duplicate").alias("duplicates"), F.count_if(F.col("kind") == "rejection").alias("rejected"),
    )


def rejection_histogram(arrivals: DataFrame) -> DataFrame:
    gone = arrivals.where("kind = 'rejection'")
    return gone.groupBy("run", "reason").agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def replay_summary(counts: DataFrame, gaps: DataFrame, regressions: DataFrame, dispatch: DataFrame, hashes: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per run: what was replayed, what was odd, and the state it led to."""
    state = marks.groupBy("run").agg(F.max("completion_status").alias("completion_status"))
    out = counts
    for part in (gaps, regressions, dispatch, hashes):
        out = out.join(part, "run", "left")
    return out.join(state, "run", "left").fillna({"completion_status": "incomplete", "books": 0})


def bounded_prefix(frames: DataFrame, max_seconds: int, max_frames: int, max_bytes: int) -> DataFrame:
    """Frames of each run with ``kept`` and ``stop_reason``: the first frame beyond the duration, the
    number of frames or the bytes is the boundary; it and what follows are not kept."""
    held = running(frames, {"_start": ("min", F.struct("frame_no", "received_time")), "_n": ("sum", F.lit(1)), "_size": ("sum", F.col("byte_length"))}, order="frame_no", inclusive=True)
    seconds = micros(F.col("received_time"), F.col("_start.received_time"))
    over = F.when(seconds > max_seconds * 1_000_000, "duration").when(F.col("_n") > max_frames, "frames").when(F.col("_size") > max_bytes, "bytes")
    held = held.withColumn("_over", over).drop("_start", "_n", "_size")
    stops = held.where("_over is not null").groupBy(F.col("run").alias("_run")).agg(F.min("frame_no").alias("_first"))
    held = held.join(stops, F.col("run") == F.col("_run"), "left")
    kept = F.col("_first").isNull() | (F.col("frame_no") < F.col("_first"))
    return held.withColumn("kept", kept).withColumn("stop_reason", F.when(F.col("frame_no") == F.col("_first"), F.col("_over"))).drop("_over", "_first", "_run")
