"""Append-only ledgers: identities, idempotent appends, arrivals, run state and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.functions.columns import stable_id, unix_micros


#: What makes an observation's identity, in order; ``event_time_marker`` is made of the event time's columns.
OBSERVATION = ["source", "source_event_type", "market_id", "condition_id", "token_id", "payload_schema_version", "event_time_marker", "source_sequence", "source_hash", "payload"]


def event_time_marker() -> Column:
    """``present:`` and the time in microseconds, ``missing``, or ``unparseable:`` and the text: an event without
    a time is not one whose time says missing."""
    status = F.col("event_time_status")
    return (
        F.when(status == "present", F.concat(F.lit("present:"), unix_micros(F.col("event_time")).cast("string"))).when(status == "missing", "missing")
        .otherwise(F.concat(F.lit("unparseable:"), F.coalesce("event_time_raw", F.lit(""))))
    )


def observation_id() -> Column:
    """Identity of an observation: what the source said, not when or by which run it was received. The one recipe of
    normalisers and audits."""
    return stable_id("obs", *[event_time_marker() if n == "event_time_marker" else F.col(n) for n in OBSERVATION])


def rejection_id() -> Column:
    """Equal refusals of one raw frame share an id."""
    return stable_id("rej", F.col("raw_sha256"), F.col("reason"), F.col("detail"), F.col("scope"))


def with_disposition(deliveries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``accepted_new`` for the first arrival of an observation in the store, else ``duplicate``. Every
    arrival keeps its row. ``known`` holds the observation ids that the store has already."""
    nth = F.row_number().over(Window.partitionBy("observation_id").orderBy("received_time", "run", "seq"))
    held = deliveries.withColumn("_nth", nth)
    if known is not None:
        held = held.join(known.select("observation_id").distinct().withColumn("_known", F.lit(True)), "observation_id", "left")
    fresh = (F.col("_nth") == 1) & (F.col("_known").isNull() if known is not None else F.lit(True))
    return held.withColumn("disposition", F.when(fresh, "accepted_new").otherwise("duplicate")).drop("_nth", "_known")


def sequence_violations(deliveries: DataFrame, rejections: DataFrame) -> DataFrame:
    """(run, seq) pairs used more than once across both ledgers."""
    both = deliveries.select("run", "seq").unionByName(rejections.select("run", "seq"))
    return both.groupBy("run", "seq").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def arrivals(deliveries: DataFrame, rejections: DataFrame) -> DataFrame:
    """Both ledgers as one sequence with ``kind``; consumers order it by (run, seq)."""
    return deliveries.withColumn("kind", F.lit("delivery")).unionByName(rejections.withColumn("kind", F.lit("rejection")), allowMissingColumns=True)


def resolved_deliveries(deliveries: DataFrame, observations: DataFrame) -> DataFrame:
    return deliveries.join(observations, "observation_id", "left")


def missing_observations(deliveries: DataFrame, observations: DataFrame) -> DataFrame:
    """Deliveries whose observation the store doesn't have: damage."""
    return deliveries.join(observations.select("observation_id"), "observation_id", "left_anti")


def run_states(marks: DataFrame) -> DataFrame:
    """Start, end and completion of each run from its open and close marks."""
    return marks.groupBy("run").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max("completion_status").alias("completion_status"))


def open_runs(marks: DataFrame) -> DataFrame:
    """Runs that never closed: incomplete."""
    closed = marks.where("ended_at is not null").select("run").distinct()
    return marks.join(closed, "run", "left_anti").groupBy("run").agg(F.min("started_at").alias("started_at"))


def happened(frames: DataFrame, decoded: DataFrame, produced: DataFrame) -> DataFrame:
    """run, what (frame, event or record), status, reason, detail: a row for each thing that a capture counts.
    ``produced`` has a record's status: accepted, duplicate, rejected or not_applicable."""
    none = [F.lit(None).cast("string").alias(c) for c in ("status", "reason", "detail")]
    seen = decoded.where("event_idx is not null")
    parts = [frames.select("run", F.lit("frame").alias("what"), *none), seen.select("run", F.lit("event").alias("what"), *none), produced.select("run", F.lit("record").alias("what"), "status", "reason", "detail")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def capture_health(happened_: DataFrame, counters: dict[str, str]) -> DataFrame:
    """The counters (name: condition) of each run, zeros kept."""
    return happened_.groupBy("run").agg(*[F.count_if(F.expr(x)).alias(c) for c, x in counters.items()])


def identity_disagreements(observations: DataFrame) -> DataFrame:
    """Observations whose stored id is not what their fields give."""
    return observations.withColumn("recomputed", observation_id()).where("not recomputed <=> observation_id")


def rejection_disagreements(rejections: DataFrame) -> DataFrame:
    """Rejections whose stored id is not what their fields give."""
    return rejections.withColumn("recomputed", rejection_id()).where("not recomputed <=> rejection_id")


def archived(payloads: DataFrame) -> DataFrame:
    """Raw payloads by content hash: same bytes once, with the provenance of the first copy."""
    held = payloads.withColumn("raw_sha256", F.sha2(F.col("raw").cast("binary"), 256))
    first = F.min_by(F.struct("source", "endpoint", "retrieved_at"), F.struct("retrieved_at", "source", "endpoint"))
    return held.groupBy("raw_sha256").agg(
        F.first("raw").alias("raw"), F.octet_length(F.first("raw")).cast("long").alias("byte_length"), first.alias("_p"), F.count(F.lit(1)).alias("copies")
    ).select("raw_sha256", "raw", "byte_length", "copies", "_p.*")


def archive_conflicts(payloads: DataFrame) -> DataFrame:
    """Claimed hashes under which different bytes came."""
    return payloads.groupBy("raw_sha256").agg(F.count_distinct("raw").alias("contents")).where("contents > 1")


def archive_damage(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """What can't be read back: hashes without bytes, or bytes that have another hash or length."""
    held = wanted.join(archive.select("raw_sha256", "raw", F.col("byte_length").alias("_n")), "raw_sha256", "left")
    why = F.when(F.col("raw").isNull(), "missing").when(F.sha2(F.col("raw").cast("binary"), 256) != F.col("raw_sha256"), "hash").when(F.octet_length("raw") != F.col("_n"), "length")
    return held.withColumn("damage", why).where("damage is not null").drop("raw", "_n")


def ledger_differences(left: DataFrame, right: DataFrame, ignoring: list[str]) -> DataFrame:
    """Rows that only one of two captures has, wall-clock columns aside."""
    a, b = left.drop(*ignoring), right.drop(*ignoring)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))
