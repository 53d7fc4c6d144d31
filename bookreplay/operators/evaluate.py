"""Evaluations of runs, targets and experiments, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookreplay.functions.columns import reasons
from bookreplay.operators import scoring

TARGET_EXCLUSIONS = ["capture_incomplete", "no_forecast", "unmodelled_trade", "unresolved", "lifecycle_incomplete", "no_admissible_evaluation"]


def evaluated(forecasts: DataFrame, resolutions: DataFrame, contracts: DataFrame, runs: DataFrame, epsilon: float = scoring.EPSILON) -> DataFrame:
    """Every forecast with its outcome, exclusion and, where it is scored, its scores. ``runs`` has the
    replay summary by run."""
    held = scoring.joined_outcomes(forecasts, resolutions, contracts)
    held = held.join(runs.select("run", "completion_status", "sequence_gaps", "received_time_regressions", "unhandled_payload"), "run", "left")
    held = scoring.with_exclusion(scoring.headline_blockers(held))
    scored = scoring.with_scores(held.where("exclusion is null"), epsilon=epsilon)
    return scored.unionByName(held.where("exclusion is not null"), allowMissingColumns=True)


def with_cutoffs(resolutions: DataFrame, cutoffs: DataFrame, targets: DataFrame) -> DataFrame:
    """Resolutions whose time is the lifecycle cutoff of the condition's target, for prospective runs."""
    at = targets.select("target_id", "condition_id").join(cutoffs.select("target_id", "cutoff_at"), "target_id")
    at = at.groupBy("condition_id").agg(F.min("cutoff_at").alias("_at"))
    return resolutions.join(at, "condition_id", "left").withColumn("resolved_at", F.col("_at")).drop("_at")


def run_report(evaluated_: DataFrame) -> DataFrame:
    """Per run and method: forecasts, scored, excluded by reason, means, headline status."""
    reason = lambda r: F.count_if(F.col("exclusion") == r).alias(f"excluded_{r}")
    kinds = ["abstained", "capture_incomplete", "contract_identity_missing", "resolution_time_unknown", "replay_integrity", "post_resolution"]
    held = evaluated_.groupBy("run", "method").agg(
        F.count(F.lit(1)).alias("forecasts"), F.count_if(F.col("exclusion").isNull()).alias("scored"), *[reason(r) for r in kinds],
        F.avg(F.col("brier").cast("double")).alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss"), F.max(F.size("blockers")).alias("blockers"),
    )
    return held.withColumn("headline", F.when((F.col("blockers") == 0) & (F.col("scored") > 0), "reportable").otherwise("withheld"))


def experiment_report(contributions: DataFrame, targets: DataFrame, minimum: int) -> DataFrame:
    """Per experiment and method: diagnostics over one contribution per target, category and outcome
    counts, and whether there are enough targets."""
    held = contributions.join(targets.select("target_id", "experiment_id", "category"), "target_id")
    out = held.groupBy("experiment_id", "method").agg(
        F.count_distinct("target_id").alias("targets"), F.count_distinct("category").alias("categories"), F.count_if(F.col("outcome") == 1).alias("yes"), F.count_if(F.col("outcome") == 0).alias("no"),
        F.avg(F.col("brier").cast("double")).alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss"), F.avg(F.col("absolute_error").cast("double")).alias("mean_absolute_error"),
    )
    enough = (F.col("targets") >= minimum) & (F.col("yes") > 0) & (F.col("no") > 0)
    return out.withColumn("verdict", F.when(enough, "reportable").otherwise("insufficient_targets"))


def target_exclusions(targets: DataFrame, contributions: DataFrame, causes: DataFrame) -> DataFrame:
    """Targets without a contribution, each with the first of its causes (target_id, reason)."""
    order = F.element_at(F.create_map(*[x for i, r in enumerate(TARGET_EXCLUSIONS) for x in (F.lit(r), F.lit(i))]), F.col("reason"))
    first = causes.groupBy("target_id").agg(F.min_by("reason", order).alias("reason"))
    gone = targets.join(contributions.select("target_id").distinct(), "target_id", "left_anti")
    return gone.join(first, "target_id", "left").fillna({"reason": "no_admissible_evaluation"}).select("target_id", "reason")


def target_accounting(targets: DataFrame, contributions: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Targets that are not accounted for exactly once."""
    told = contributions.select("target_id").distinct().unionByName(exclusions.select("target_id"))
    n = told.groupBy("target_id").agg(F.count(F.lit(1)).alias("times"))
    return targets.select("target_id").join(n, "target_id", "full_outer").fillna(0, ["times"]).where("times <> 1")


def rejection_proofs(rejections: DataFrame, targets: DataFrame, reason: Column) -> DataFrame:
    """The first rejection of each target's run that qualifies as a reason to exclude it: one row of each run
    meets its targets."""
    first = rejections.where(reason).groupBy("run").agg(F.min_by(F.struct("seq", "reason"), "seq").alias("_r"))
    held = targets.select("run", "target_id").join(first, "run")
    return held.groupBy("target_id").agg(F.min_by("_r", "_r.seq").alias("_r")).select("target_id", "_r.*")


def capture_summary(arrivals: DataFrame) -> DataFrame:
    """Per run: counts by payload type and by reason as maps, and whether they add up."""
    kinds = arrivals.where("kind = 'delivery'").groupBy("run", "payload_type").agg(F.count(F.lit(1)).alias("n"))
    why = arrivals.where("kind = 'rejection'").groupBy("run", "reason").agg(F.count(F.lit(1)).alias("n"))
    as_map = lambda df, k, name: df.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(name))
    out = arrivals.groupBy("run").agg(F.count(F.lit(1)).alias("arrivals")).join(as_map(kinds, "payload_type", "schema_counts"), "run", "left").join(as_map(why, "reason", "reason_counts"), "run", "left")
    total = lambda c: F.aggregate(F.coalesce(F.map_values(c), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("reconciles", total(F.col("schema_counts")) + total(F.col("reason_counts")) == F.col("arrivals"))


def outcome_violations(outcomes: DataFrame) -> DataFrame:
    """Run outcomes whose counts can't be: frames, health_frames, accepted, duplicate, rejected,
    not_applicable, tokens, stop_reason, boundary_frame."""
    events = F.col("accepted") + F.col("duplicate") + F.col("rejected") + F.col("not_applicable")
    return outcomes.withColumn("violations", reasons(
        (F.col("frames") != F.col("health_frames"), "frames"), (events < F.col("frames"), "too_few_events"), (F.col("tokens") < 1, "tokens"),
        ((F.col("stop_reason") == "completed") & F.col("boundary_frame").isNotNull(), "boundary_without_cap"),
        (F.col("stop_reason").isin("frames", "bytes") & F.col("boundary_frame").isNull(), "cap_without_boundary"),
    )).where(F.size("violations") > 0)
