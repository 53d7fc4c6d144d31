"""Audits: hash chains, receipts, manifests, chronology, snapshots and accounting. Each returns the
rows that are wrong, with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.functions.columns import digest, reasons, stable_id
from bookreplay.functions.windows import running
from bookreplay.operators.ledger import rejection_id


def chain_violations(links: DataFrame, by: str, order: str, parts: list[str], own: str = "id", previous: str = "previous_id", at: str | None = None) -> DataFrame:
    """Links whose id isn't the hash of their parts and predecessor, that don't name the link before
    them, or that go back in time. ``order`` is a whole number; a long chain is many blocks."""
    held = running(links, {"_before": ("last_row", F.struct(F.col(own).alias("id"), *([F.col(at).alias("at")] if at else [])))}, by=by, order=order)
    checks = [(F.col(own) != digest(*[F.col(p) for p in parts], F.col(previous)), "id"), (~F.col(previous).eqNullSafe(F.col("_before.id")), "predecessor")]
    if at:
        checks.append((F.col(at) < F.col("_before.at"), "time_order"))
    return held.withColumn("violations", reasons(*checks)).where(F.size("violations") > 0).drop("_before")


def seal_violations(links: DataFrame, seals: DataFrame, by: str, order: str, own: str = "id") -> DataFrame:
    """Chains whose number of links or last id is not what the seal says."""
    ends = links.groupBy(by).agg(F.count(F.lit(1)).alias("links"), F.max_by(own, order).alias("tail"))
    held = seals.join(ends, by, "full_outer")
    return held.withColumn("violations", reasons(
        (F.col("sealed_links").isNull(), "unsealed"), (F.coalesce("links", F.lit(0)) != F.col("sealed_links"), "links"), (~F.col("tail").eqNullSafe(F.col("sealed_tail")) & F.col("sealed_links").isNotNull(), "tail"),
    )).where(F.size("violations") > 0)


def receipt_violations(receipts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Receipts whose artifact is missing or has other bytes. ``artifacts``: artifact_id, raw."""
    held = receipts.join(artifacts.select("artifact_id", "raw"), "artifact_id", "left")
    return held.withColumn("violations", reasons(
        (F.col("raw").isNull(), "missing"), (F.sha2(F.col("raw").cast("binary"), 256) != F.col("artifact_sha256"), "hash"), (F.octet_length("raw") != F.col("byte_length"), "length"),
    )).where(F.size("violations") > 0).drop("raw")


def manifest_violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files that are missing or differ, and files that aren't listed. ``files``: path, content."""
    found = files.select("path", F.sha2("content", 256).alias("_sha"), F.octet_length("content").cast("long").alias("_n"))
    held = manifest.join(found, "path", "full_outer")
    return held.withColumn("violation", F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("_sha") != F.col("sha256"), "hash").when(F.col("_n") != F.col("size"), "size")).where("violation is not null").drop("_sha", "_n")


def archive_location(sha256: Column) -> Column:
    """Where the archive keeps the bytes of a hash."""
    return F.concat_ws("/", F.lit("raw"), F.substring(sha256, 1, 2), sha256)


def proof_id() -> Column:
    """Identity of a rejection proof: what it excludes, and by which arrival and bytes."""
    return stable_id("proof", F.col("target_id"), F.col("run"), F.col("seq"), F.col("rejection_id"), F.col("raw_location"))


def proof_violations(proofs: DataFrame, archive: DataFrame, manifests: DataFrame, event_type: str, rejection_schema: str, modelled_schema: str) -> DataFrame:
    """Rejection proofs that don't hold, with their reasons. A proof excludes a target because its run refused an
    ``event_type`` as unknown, so it must be bound to the refused bytes and to a run that could not take them.

    ``proofs``: proof_id, target_id, run, seq, rejection_id, raw_sha256, byte_length, raw_location, reason, detail, scope,
    condition_id, token_id, received_time, retrieved_at, rejected_at. ``archive``: raw_sha256 (as claimed) and raw.
    ``manifests``, one for each run: run, mode, created_at, code_revision, clean, raw_archive, schemas.

    Both identities are worked out again; the archive's bytes must have the hash and length and name the proof's own
    event type, token and condition; a rejection follows its receipt, which is the retrieval, and precedes its
    manifest, which is that of an archiving capture of a clean revision that knows rejections but not the event."""
    bytes_ = archive.select("raw_sha256", F.col("raw").alias("_raw"))
    runs = manifests.select("run", F.struct("mode", "created_at", "code_revision", "clean", "raw_archive", "schemas").alias("_m"))
    held = proofs.join(bytes_, "raw_sha256", "left").join(runs, "run", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    raw, named, there = F.col("_raw"), lambda k: F.get_json_object("_raw", f"$.{k}"), F.col("_m").isNotNull()
    same = (F.sha2(raw.cast("binary"), 256) == F.col("raw_sha256")) & (F.octet_length(raw) == F.col("byte_length"))
    order = (F.col("received_time") == F.col("retrieved_at")) & (F.col("rejected_at") >= F.col("received_time")) & (~there | (F.col("_m.created_at") >= F.col("rejected_at")))
    scope = (named("asset_id") == F.col("token_id").cast("string")) & (named("market") == F.col("condition_id").cast("string"))
    return held.withColumn("violations", reasons(
        (no(F.col("proof_id") == proof_id()), "proof"), (no(F.col("rejection_id") == rejection_id()), "identity"),
        (raw.isNull(), "raw_missing"), (raw.isNotNull() & no(same), "raw"), (no(F.col("raw_location") == archive_location(F.col("raw_sha256"))), "location"),
        (no(order), "chronology"), (no(F.col("_m.mode") == "capture"), "manifest"), (there & no(F.col("_m.clean") & F.col("_m.code_revision").isNotNull()), "revision"),
        (there & no(F.col("_m.raw_archive")), "not_archived"), (there & no(F.array_contains("_m.schemas", rejection_schema) & ~F.array_contains("_m.schemas", modelled_schema)), "schemas"),
        (no(F.col("reason") == "unknown_event_type") | raw.isNotNull() & no(named("event_type") == event_type), "reason"), (raw.isNotNull() & no(scope), "scope"),
    )).where(F.size("violations") > 0).select("proof_id", "target_id", "run", "seq", "violations")


def retrieval_violations(polls: DataFrame, evidence: DataFrame) -> DataFrame:
    """Polls without exactly one retrieval that agrees with them, and retrievals of no poll."""
    held = polls.select("target_id", "poll_id", "retrieved_at", "raw_sha256").join(
        evidence.groupBy("poll_id").agg(F.count(F.lit(1)).alias("_n"), F.min("retrieved_at").alias("_at"), F.min("raw_sha256").alias("_sha")), "poll_id", "full_outer")
    return held.withColumn("violations", reasons(
        (F.col("target_id").isNull(), "unknown_poll"), (F.col("_n").isNull(), "no_evidence"), (F.col("_n") > 1, "more_than_one"),
        (F.col("_at") != F.col("retrieved_at"), "time"), (F.col("_sha") != F.col("raw_sha256"), "hash"),
    )).where(F.size("violations") > 0).select("poll_id", "target_id", "violations")


def missing_archives(polls: DataFrame, archive: DataFrame) -> DataFrame:
    return polls.join(archive.select("raw_sha256"), "raw_sha256", "left_anti")


def trajectory_digests(arrivals: DataFrame, columns: list[str], range_rows: int = 10_000) -> DataFrame:
    """An ordered hash of all arrivals of each run: a hash per range of seq, then a hash of those, so
    no run is collected whole."""
    row = digest(*[F.col(c) for c in columns])
    ranges = arrivals.withColumn("_range", F.floor(F.col("seq") / range_rows)).groupBy("run", "_range").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("h")))), lambda x: x["h"]), "").alias("_all"), F.count(F.lit(1)).alias("_n"))
    hashed = ranges.select("run", "_range", "_n", F.sha2("_all", 256).alias("h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "h"))), lambda x: x["h"]), "")
    return hashed.groupBy("run").agg(F.sum("_n").alias("arrivals"), F.sha2(F.concat(F.lit("trajectory.v1:"), ordered), 256).alias("trajectory_sha256"))


def chronology_violations(targets: DataFrame, strict_polls: DataFrame | None = None) -> DataFrame:
    """One wide row per target: protocol_at, market_at, contract_at, target_at, first_forecast_at,
    last_forecast_at, cutoff_at, window_start, window_end, and the scope ids on both sides."""
    steps = ["protocol_at", "market_at", "contract_at", "target_at", "first_forecast_at"]
    checks: list[tuple[Column, str]] = [(F.col(a) > F.col(b), f"{a}_after_{b}") for a, b in zip(steps, steps[1:])]
    checks += [
        (F.col("last_forecast_at") >= F.col("cutoff_at"), "forecast_at_or_after_cutoff"), (F.col("first_forecast_at") < F.col("window_start"), "forecast_before_window"),
        (F.col("last_forecast_at") > F.col("window_end"), "forecast_after_window"), (F.col("condition_id") != F.col("market_condition_id"), "scope"),
    ]
    held = targets.withColumn("violations", reasons(*checks))
    if strict_polls is not None:
        bad = strict_polls.groupBy("target_id").agg(F.lit("polls").alias("_polls"))
        held = held.join(bad, "target_id", "left").withColumn("violations", F.when(F.col("_polls").isNotNull(), F.array_append("violations", F.lit("polls"))).otherwise(F.col("violations"))).drop("_polls")
    return held.where(F.size("violations") > 0)


def snapshot_violations(forecasts: DataFrame, methods: list[str], blind_until: Column) -> DataFrame:
    """Frozen snapshots that aren't one forecast per method on one shared state within their window.
    Needs snapshot_id, method, state_key, as_of, admitted_at, freeze_at."""
    held = forecasts.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("method").alias("_m"), F.count_distinct("state_key").alias("_s"), F.min("as_of").alias("_lo"), F.max("as_of").alias("_hi"),
        F.min("admitted_at").alias("_adm"), F.max("freeze_at").alias("_frz"), F.max(blind_until).alias("_blind"),
    )
    return held.withColumn("violations", reasons(
        ((F.col("_n") != len(methods)) | (F.col("_m") != len(methods)), "methods"), (F.col("_s") != 1, "state"), (F.col("_lo") < F.col("_adm"), "before_admission"),
        (F.col("_hi") > F.col("_frz"), "after_freeze"), (F.col("_frz") >= F.col("_blind"), "not_blind"),
    )).where(F.size("violations") > 0).select("snapshot_id", "violations")


def cap_violations(captures: DataFrame) -> DataFrame:
    """Captures against their protocol: seconds, frames, bytes, max_seconds, max_frames, max_bytes,
    stop_reason, closed_at, freeze_at."""
    over = [("seconds", "max_seconds", "duration"), ("frames", "max_frames", "frames"), ("bytes", "max_bytes", "bytes")]
    checks = [(F.col(a) > F.col(m), f"{r}_cap") for a, m, r in over]
    checks += [((F.col("stop_reason") == r) & (F.col(a) < F.col(m)), f"stopped_early_by_{r}") for a, m, r in over]
    checks.append((F.col("closed_at") < F.col("freeze_at"), "closed_before_freeze"))
    return captures.withColumn("violations", reasons(*checks)).where(F.size("violations") > 0)


def inventory_violations(frames: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs whose frames are out of order or whose totals aren't those of the run's outcome."""
    held = running(frames, {"_before": ("last_row", F.struct("frame_no", "received_time"))}, order="frame_no")
    held = held.withColumn("_gap", F.col("frame_no") != F.col("_before.frame_no") + 1).withColumn("_back", F.col("received_time") < F.col("_before.received_time"))
    totals = held.groupBy("run").agg(F.count(F.lit(1)).alias("_n"), F.sum("byte_length").alias("_bytes"), F.max("_gap").alias("_g"), F.max("_back").alias("_b"))
    return totals.join(outcomes, "run", "full_outer").withColumn("violations", reasons(
        (F.col("_g"), "frame_numbers"), (F.col("_b"), "time_order"), (~F.col("_n").eqNullSafe(F.col("frames")), "frames"), (~F.col("_bytes").eqNullSafe(F.col("bytes")), "bytes"),
    )).where(F.size("violations") > 0).select("run", "violations")


def protocol_violations(targets: DataFrame, protocols: DataFrame) -> DataFrame:
    """Targets outside their protocol's bounds or window, and runs that serve more than one target."""
    held = targets.join(protocols, "experiment_id", "left").withColumn("_shared", F.count(F.lit(1)).over(Window.partitionBy("run")))
    return held.withColumn("violations", reasons(
        (F.col("max_runtime_s").isNull(), "no_protocol"), (F.col("runtime_s") > F.col("max_runtime_s"), "runtime"), (F.col("starts_at") < F.col("window_start"), "before_window"),
        (F.col("ends_at") > F.col("window_end"), "after_window"), (F.col("_shared") > 1, "shared_run"),
    )).where(F.size("violations") > 0).select("target_id", "violations")


def run_health(counts: DataFrame, health: DataFrame, archive_files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per run: loop counts equal store counts, the archive isn't empty, both replays give one hash."""
    held = counts.join(health.select("run", F.col("accepted").alias("_a"), F.col("rejected").alias("_r")), "run", "left").join(archive_files, "run", "left").join(hashes, "run", "left")
    return held.withColumn("failures", reasons(
        (~F.col("accepted").eqNullSafe(F.col("_a")), "accepted"), (~F.col("rejected").eqNullSafe(F.col("_r")), "rejected"),
        (F.coalesce("files", F.lit(0)) == 0, "empty_archive"), (~F.col("first_hash").eqNullSafe(F.col("second_hash")), "state_hash"),
    )).withColumn("healthy", F.size("failures") == 0).drop("_a", "_r")


def campaign_accounting(specs: DataFrame, results: DataFrame) -> DataFrame:
    """Scenarios without exactly one spec and one result, or outside their bounds."""
    s = specs.groupBy("scenario").agg(F.count(F.lit(1)).alias("specs"), F.max("max_seconds").alias("max_seconds"))
    r = results.groupBy("scenario").agg(F.count(F.lit(1)).alias("results"), F.max("seconds").alias("seconds"), F.max("status").alias("status"))
    return s.join(r, "scenario", "full_outer").fillna(0, ["specs", "results"]).withColumn("violations", reasons(
        (F.col("specs") != 1, "spec"), (F.col("results") != 1, "result"), (F.col("seconds") > F.col("max_seconds"), "bounds"),
    ))
