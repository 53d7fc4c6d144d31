"""Scores of forecasts against settled outcomes, calibration and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookreplay.functions.columns import first_reason, micros, reasons

EPSILON = 1e-6


def with_scores(df: DataFrame, score: str = "score", outcome: str = "outcome", epsilon: float = EPSILON) -> DataFrame:
    """brier (exact decimal), absolute_error, log_loss (double, clipped to [epsilon, 1 - epsilon]) and
    whether it was clipped."""
    if not 0 < epsilon < 0.5:
        raise ValueError("epsilon must be between 0 and 0.5")
    gap = (F.col(score) - F.col(outcome)).cast("decimal(13,11)")
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(epsilon)), F.lit(1 - epsilon))
    clipped = (F.col(score).cast("double") < epsilon) | (F.col(score).cast("double") > 1 - epsilon)
    return (
        df.withColumn("brier", (gap * gap).cast("decimal(29,22)")).withColumn("absolute_error", F.abs(gap))
        .withColumn("log_loss", -F.log(F.when(F.col(outcome) == 1, p).otherwise(1 - p))).withColumn("clipped", clipped)
    )


def score_disagreements(scored: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Stored scores that recomputing doesn't give again."""
    kept = scored.withColumnsRenamed({"brier": "_b", "absolute_error": "_a", "log_loss": "_l", "clipped": "_c"})
    again = with_scores(kept, epsilon=epsilon)
    off = (F.col("brier") != F.col("_b")) | (F.col("absolute_error") != F.col("_a")) | (F.abs(F.col("log_loss") - F.col("_l")) > 1e-12) | (F.col("clipped") != F.col("_c"))
    return again.where(F.coalesce(off, F.lit(True)))


def calibration_bins(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins stay, with null means."""
    index = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    found = scored.withColumn("bin", index).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col("score").cast("double")).alias("mean_score"), F.avg(F.col("outcome").cast("double")).alias("observed_rate")
    )
    dense = scored.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    keys = [*by, "bin"]
    return dense.join(found, keys, "left").fillna(0, ["count"]).withColumn("lower", F.col("bin") / bins).withColumn("upper", (F.col("bin") + 1) / bins)


def calibration_report(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Per group: sample count, ECE, mean Brier and log loss, clipped count, calibration status."""
    status = F.col("calibration_status") if "calibration_status" in scored.columns else F.lit("none")
    gaps = calibration_bins(scored, by, bins).groupBy(*by).agg((F.sum(F.col("count") * F.abs(F.col("mean_score") - F.col("observed_rate"))) / F.sum("count")).alias("ece"))
    means = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(F.col("brier").cast("double")).alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss"),
        F.avg(F.col("absolute_error").cast("double")).alias("mean_absolute_error"), F.count_if("clipped").alias("clipped_count"),
        F.when(F.count_distinct(status) > 1, "mixed").otherwise(F.min(status)).alias("calibration_status"),
    )
    return means.join(gaps, by)


def slices(scored: DataFrame, dimensions: list[str], bins: int = 10) -> DataFrame:
    """The report for every value of every dimension at once; a missing value is ``unknown``.

    Rows are summed once by all dimensions and their bin; the grouping sets, one for each dimension, go over
    those sums, and a slice's report over the sums of its bins."""
    status = F.col("calibration_status") if "calibration_status" in scored.columns else F.lit("none")
    names = [f"_d{i}" for i in range(len(dimensions))]
    held = scored.withColumns({n: F.coalesce(F.col(d).cast("string"), F.lit("unknown")) for n, d in zip(names, dimensions)})
    held = held.withColumn("_bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int"))
    total = {"_score": "score", "_outcome": "outcome", "_brier": "brier", "_log_loss": "log_loss", "_absolute": "absolute_error"}
    sums = [F.sum(F.col(c).cast("double")).alias(n) for n, c in total.items()]
    part = held.groupBy("method", *names, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.count_if("clipped").alias("_clipped"), F.min(status).alias("_low"), F.max(status).alias("_high"), *sums)
    again = [F.sum(c).alias(c) for c in ("_n", "_clipped", *total)] + [F.min("_low").alias("_low"), F.max("_high").alias("_high")]
    of = F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(d)) for n, d in zip(names, dimensions)]).alias("dimension")
    by_bin = part.groupingSets([["method", "_bin", n] for n in names], "method", "_bin", *names).agg(of, *again).withColumn("slice", F.coalesce(*names))
    n = F.sum("_n")
    return by_bin.groupBy("method", "dimension", "slice").agg(
        n.alias("sample_count"), (F.sum("_brier") / n).alias("mean_brier"), (F.sum("_log_loss") / n).alias("mean_log_loss"), (F.sum("_absolute") / n).alias("mean_absolute_error"), F.sum("_clipped").alias("clipped_count"),
        F.when(F.min("_low") != F.max("_high"), "mixed").otherwise(F.min("_low")).alias("calibration_status"), (F.sum(F.abs(F.col("_score") - F.col("_outcome"))) / n).alias("ece"),
    )


def spread_bucket(spread: Column) -> Column:
    s = spread.cast("double")
    return F.when(s.isNull(), "unknown").when(s <= 0.01, "0-1c").when(s <= 0.05, "1-5c").when(s <= 0.10, "5-10c").otherwise("over-10c")


def lead_bucket(made_at: Column, resolved_at: Column) -> Column:
    hours = micros(resolved_at, made_at) / 3_600_000_000
    return (
        F.when(hours.isNull(), "unknown").when(hours <= 0, "after-resolution").when(hours < 1, "under-1h").when(hours < 24, "1h-1d")
        .when(hours < 168, "1d-7d").otherwise("over-7d")
    )


def outcome_of(winning_token: Column, token: Column) -> Column:
    return F.when(winning_token == token, 1).otherwise(0)


def headline_blockers(runs: DataFrame) -> DataFrame:
    """``blockers`` of each run and target from completion_status, resolved_at, contract_id,
    sequence_gaps, received_time_regressions, unhandled_payload."""
    checks = (
        (~F.col("completion_status").eqNullSafe(F.lit("completed")), "capture_incomplete"), (F.col("resolved_at").isNull(), "resolution_time_unknown"),
        (F.col("contract_id").isNull(), "contract_identity_missing"), (F.col("sequence_gaps") > 0, "replay_sequence_gaps"),
        (F.col("received_time_regressions") > 0, "replay_received_time_regressions"), (F.col("unhandled_payload") > 0, "replay_unhandled_payloads"),
    )
    return runs.withColumn("blockers", reasons(*checks))


def with_exclusion(forecasts: DataFrame) -> DataFrame:
    """``exclusion``: the first reason that holds, null where the forecast is scored. Needs abstained,
    blockers, received_time, resolved_at."""
    has = lambda b: F.array_contains("blockers", b)
    why = first_reason(
        (F.col("abstained"), "abstained"), (has("capture_incomplete"), "capture_incomplete"), (has("contract_identity_missing"), "contract_identity_missing"),
        (has("resolution_time_unknown"), "resolution_time_unknown"), (F.exists("blockers", lambda b: b.startswith("replay_")), "replay_integrity"),
        (F.col("received_time") >= F.col("resolved_at"), "post_resolution"),
    )
    return forecasts.withColumn("exclusion", why)


def joined_outcomes(forecasts: DataFrame, resolutions: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Forecasts with their condition's resolution and contract; Spark broadcasts the small sides by
    their size."""
    held = forecasts.join(resolutions.select("condition_id", "winning_token_id", "status", "resolved_at"), "condition_id")
    held = held.withColumn("outcome", outcome_of(F.col("winning_token_id"), F.col("token_id")))
    if contracts is None:
        return held.withColumn("contract_id", F.lit(None).cast("string"))
    return held.join(contracts.select("condition_id", "contract_id"), "condition_id", "left")


def accounting_violations(forecasts: DataFrame, scored: DataFrame, excluded: DataFrame) -> DataFrame:
    """Forecast ids that are not accounted for exactly once, and ids that name no forecast."""
    ids = lambda df: df.select("forecast_id")
    told = ids(scored).unionByName(ids(excluded))
    missing = ids(forecasts).join(told, "forecast_id", "left_anti").withColumn("violation", F.lit("unaccounted"))
    unknown = told.join(ids(forecasts), "forecast_id", "left_anti").withColumn("violation", F.lit("unknown_forecast"))
    both = ids(scored).intersect(ids(excluded)).withColumn("violation", F.lit("scored_and_excluded"))
    again = told.groupBy("forecast_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("forecast_id", F.lit("more_than_once").alias("violation"))
    return missing.unionByName(unknown).unionByName(both).unionByName(again)


def target_contributions(scored: DataFrame) -> DataFrame:
    """The last evaluation of each target and method, by receive time, seq and id; weight 1."""
    order = F.struct("received_time", "seq", "forecast_id")
    columns = [c for c in scored.columns if c not in ("target_id", "method")]
    top = scored.groupBy("target_id", "method").agg(F.max_by(F.struct(*columns), order).alias("_e"))
    return top.select("target_id", "method", "_e.*").withColumn("weight", F.lit(1))
