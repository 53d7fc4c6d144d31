"""Lifecycle polling: continuity, chains, cutoffs, late outcomes and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.functions.columns import first_reason, micros, reasons, unix_micros


def continuity(polls: DataFrame, deadline: Column, interval_seconds: int) -> DataFrame:
    """Largest and last gap between polls, the one to the deadline included; complete if none exceeds
    twice the interval."""
    after = F.coalesce(F.lead("retrieved_at").over(Window.partitionBy("target_id").orderBy("ordinal")), deadline)
    gap = micros(after, F.col("retrieved_at"))
    held = polls.withColumn("_gap", gap).groupBy("target_id").agg(F.count(F.lit(1)).alias("polls"), F.max_by("_gap", "ordinal").alias("final_gap_us"), F.max("_gap").alias("max_gap_us"))
    return held.withColumn("continuity", F.when(F.col("max_gap_us") <= 2 * interval_seconds * 1_000_000, "complete").otherwise("incomplete"))


def chain_violations(polls: DataFrame, strict: bool = False) -> DataFrame:
    """Polls whose place in the chain is wrong, with the reasons. ``strict``: times must increase."""
    w = Window.partitionBy("target_id").orderBy("ordinal", "poll_id")
    before = lambda c: F.lag(c).over(w)
    ended = F.max(F.col("finality") == "final").over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = F.col("retrieved_at") <= before("retrieved_at") if strict else F.col("retrieved_at") < before("retrieved_at")
    held = polls.withColumn("violations", reasons(
        (F.col("ordinal") != F.row_number().over(w), "ordinal"), (~F.col("previous_id").eqNullSafe(before("poll_id")), "predecessor"),
        (back, "time_order"), (F.coalesce(ended, F.lit(False)), "after_final"),
    ))
    return held.where(F.size("violations") > 0)


def cutoffs(polls: DataFrame, policy: str = "first_observed_final") -> DataFrame:
    """When a target's outcome became final: the retrieval of the first final poll, or the source's own
    terminal time."""
    final = polls.where("finality = 'final'").groupBy("target_id").agg(F.min_by(F.struct("*"), "ordinal").alias("_p"))
    at = F.col("_p.retrieved_at") if policy == "first_observed_final" else F.col("_p.source_time")
    return final.select("target_id", at.alias("cutoff_at"), F.col("_p.ordinal").alias("cutoff_ordinal"), F.col("_p.resolution_id").alias("resolution_id"))


def progress(polls: DataFrame, interval_seconds: int) -> DataFrame:
    """Latest finality, last poll, cutoff and the next poll due, per target."""
    last = polls.groupBy("target_id").agg(F.max_by("finality", "ordinal").alias("finality"), F.max_by("retrieved_at", "ordinal").alias("last_seen"), F.max("ordinal").alias("polls"))
    held = last.join(cutoffs(polls).select("target_id", "cutoff_at"), "target_id", "left")
    due = F.timestamp_micros(unix_micros(F.col("last_seen")) + interval_seconds * 1_000_000)
    return held.withColumn("next_due", F.when(F.col("cutoff_at").isNull(), due))


def late_scores(frozen: DataFrame, late: DataFrame) -> DataFrame:
    """Frozen forecasts against late outcomes: pending, scored or final_unscorable per forecast.

    Needs target_id, forecast_id, token_id, score on the left; target_id, status, winning_token_id on
    the right."""
    held = frozen.join(late.select("target_id", "status", "winning_token_id"), "target_id", "left")
    state = F.when(F.col("status").isNull() | (F.col("status") != "final"), "pending").when(F.col("winning_token_id").isNull(), "final_unscorable").when(F.col("score").isNull(), "abstained").otherwise("scored")
    return held.withColumn("state", state).withColumn("outcome", F.when(state == "scored", (F.col("winning_token_id") == F.col("token_id")).cast("int")))


def late_partition(scored: DataFrame) -> DataFrame:
    """Per target: planned = scored + abstained once final, and nothing scored while pending."""
    of = lambda s: F.count_if(F.col("state") == s)
    held = scored.groupBy("target_id").agg(F.count(F.lit(1)).alias("planned"), of("scored").alias("scored"), of("abstained").alias("abstained"), of("pending").alias("pending"), of("final_unscorable").alias("unscorable"))
    whole = F.col("planned") == F.col("scored") + F.col("abstained") + F.col("pending") + F.col("unscorable")
    return held.withColumn("violations", reasons((~whole, "unaccounted"), ((F.col("pending") > 0) & (F.col("scored") > 0), "scored_while_pending")))


def admissibility(late: DataFrame) -> DataFrame:
    """Reasons against a late outcome: needs cutoff_at, deadline, snapshot_persisted_at,
    winning_token_id, token_ids."""
    return late.withColumn("refusals", reasons(
        (F.col("cutoff_at") <= F.col("deadline"), "cutoff_before_deadline"), (F.coalesce(F.col("snapshot_persisted_at") >= F.col("cutoff_at"), F.lit(True)), "snapshot_not_durable"),
        (~F.coalesce(F.array_contains("token_ids", F.col("winning_token_id")), F.lit(False)), "foreign_winner"),
    ))


def merged_gaps(gaps: DataFrame, polls: DataFrame) -> DataFrame:
    """Gap log entries once each, with those that name a predecessor the chain doesn't have marked."""
    once = gaps.dropDuplicates(["target_id", "ordinal", "started_at", "ended_at", "reason"])
    known = polls.select("target_id", F.col("poll_id").alias("predecessor_id")).withColumn("_k", F.lit(True))
    return once.join(known, ["target_id", "predecessor_id"], "left").withColumn("valid", F.col("predecessor_id").isNull() | F.col("_k").isNotNull()).drop("_k")


def cadence(samples: DataFrame, by: str, at: str, bounds: DataFrame, max_gap_seconds: float, **limits: float) -> DataFrame:
    """Largest gap between samples, the start and end edges included, and the highest value of each
    limited column, with the reasons to fail. ``bounds`` has started_at and ended_at per ``by``."""
    w = Window.partitionBy(by).orderBy(at)
    held = bounds.join(samples, by, "left").withColumn("_before", F.coalesce(F.lag(at).over(w), F.col("started_at"))).withColumn("_gap", micros(F.coalesce(F.col(at), F.col("ended_at")), F.col("_before")))
    out = held.groupBy(by, "started_at", "ended_at").agg(
        F.count(at).alias("samples"), F.greatest(F.max("_gap"), micros(F.first("ended_at"), F.coalesce(F.max(at), F.first("started_at")))).alias("max_gap_us"),
        *[F.max(c).alias(f"max_{c}") for c in limits], *([F.max_by("state", at).alias("last_state")] if "state" in samples.columns else []),
    )
    checks = [(F.col("samples") == 0, "no_samples"), (F.col("max_gap_us") > max_gap_seconds * 1_000_000, "gap")]
    checks += [(F.col(f"max_{c}") > v, f"{c}_bound") for c, v in limits.items()]
    if "state" in samples.columns:
        checks.append((~F.coalesce(F.col("last_state").isin("completed", "stopped"), F.lit(False)), "not_terminal"))
    return out.withColumn("failures", reasons(*checks))


def terminal_report(targets: DataFrame, outcomes: DataFrame, continuity_: DataFrame, cutoffs_: DataFrame) -> DataFrame:
    """Per experiment: targets, terminal outcomes, complete polling and cutoffs."""
    held = targets.join(outcomes.select("target_id", "terminal_state"), "target_id", "left").join(continuity_.select("target_id", "continuity"), "target_id", "left").join(cutoffs_.select("target_id", "cutoff_at"), "target_id", "left")
    return held.groupBy("experiment_id").agg(
        F.count_distinct("target_id").alias("targets"), F.count("terminal_state").alias("terminal"), F.count_if(F.col("continuity") == "complete").alias("continuous"), F.count("cutoff_at").alias("cutoffs"),
    ).withColumn("accounting", F.when(F.col("targets") == F.col("terminal"), "closed").otherwise("open"))


def first_violation(df: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    return df.withColumn("violation", first_reason(*checks)).where("violation is not null")
