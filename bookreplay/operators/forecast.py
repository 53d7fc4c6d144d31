"""Forecasts from quotes: four baselines, emitted when the information state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookreplay.functions.columns import stable_id
from bookreplay.functions.storage import stored
from bookreplay.functions.windows import running
from bookreplay.operators.book import KEY

METHODS = ["midpoint", "last_trade", "displayed_price", "persistence"]
WIDE_SPREAD = "0.10"


def information_changes(outcomes: DataFrame, inputs: DataFrame, writes: DataFrame, divergence: DataFrame, trades: DataFrame) -> DataFrame:
    """Applied arrivals of seeded tokens with ``segment`` and ``changed``.

    A delta changes the state where a level gets another size than it had (nothing and zero are
    alike); a snapshot where it is the first or disagrees with the book; whatever carries a trade always,
    since its identity is part of the state. The first arrival after seeding, which is the snapshot that opens
    segment 1, counts as a change too. What marks an arrival is gathered by (run, seq) first, so arrivals meet it in
    one join; segments reach the rows between book inputs by blocks."""
    moved = writes.where("outcome = 'applied_delta'").where(~F.coalesce("before", F.lit(0)).eqNullSafe(F.col("size")))
    marks = [rows.select("run", "seq", F.lit(name).alias("_mark")) for name, rows in (("_moved", moved), ("_differs", divergence), ("_sold", trades))]
    marks = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("run", "seq")
    marks = marks.agg(*[F.bool_or(F.col("_mark") == name).alias(name) for name in ("_moved", "_differs", "_sold")])
    held = outcomes.where("applied").join(inputs.select("run", "seq", F.col("segment").alias("_own")), ["run", "seq"], "left")
    held = running(held, {"segment": ("max", F.col("_own"))}, by=KEY, inclusive=True, nulls=False).fillna(0, ["segment"]).join(marks, ["run", "seq"], "left")
    first = (F.col("outcome") == "applied_snapshot") & F.coalesce(F.col("_own") == 1, F.lit(False))
    changed = (
        F.when(F.col("segment") == 0, False).when((F.col("outcome") == "applied_auxiliary") | F.col("_sold"), True).when(first, True)
        .when(F.col("outcome") == "applied_snapshot", F.coalesce("_differs", F.lit(False))).otherwise(F.coalesce("_moved", F.lit(False)))
    )
    return held.withColumn("changed", changed).drop("_own", "_moved", "_differs", "_sold")


def states(changes: DataFrame, top: DataFrame, trades: DataFrame) -> DataFrame:
    """The quote after every applied arrival of a seeded token: book columns as of the last input that
    the book took, the last trade (one before the first snapshot counts), and the event time of the book
    beside that of the trigger. Arrivals with their own quotes and trades are stored once, then carried by blocks."""
    book = ["best_bid", "best_ask", "bid_size", "ask_size", "bid_levels", "ask_levels", "midpoint", "spread"]
    held = changes.join(top.select("run", "seq", *book), ["run", "seq"], "left")
    sold = trades.select("run", "seq", F.col("price").alias("_trade"))
    held = stored(held.join(sold, ["run", "seq"], "left"), "quoted")
    taken = F.when(F.col("bid_levels").isNotNull(), F.struct(*book, F.col("event_time").alias("book_event_time")))
    held = running(held, {"_book": ("last", taken), "last_trade": ("last", F.col("_trade"))}, by=KEY, inclusive=True, nulls=False).drop(*book)
    return held.where("segment > 0").select("*", "_book.*").drop("_book", "_trade")


def emitted(states_: DataFrame) -> DataFrame:
    """States with changed information, each with the midpoint before it among emitted states."""
    return running(states_.where("changed"), {"previous_midpoint": ("last", F.col("midpoint"))}, by=KEY, nulls=False)


def forecasts(emitted_: DataFrame) -> DataFrame:
    """One row per state and method: score, abstained and the reason."""
    displayed = F.when(F.col("spread") > F.lit(WIDE_SPREAD).cast("decimal(3,2)"), F.col("last_trade").cast("decimal(13,11)")).otherwise(F.col("midpoint"))
    scores = {"midpoint": F.col("midpoint"), "last_trade": F.col("last_trade"), "displayed_price": displayed, "persistence": F.col("previous_midpoint")}
    why = {"midpoint": "no_two_sided_book", "last_trade": "no_last_trade", "displayed_price": "no_displayed_price", "persistence": "no_prior_forecast"}
    rows = [F.struct(F.lit(m).alias("method"), s.cast("decimal(13,11)").alias("score"), F.when(s.isNull(), why[m]).alias("abstention_reason")) for m, s in scores.items()]
    out = emitted_.withColumn("_f", F.explode(F.array(*rows))).select("*", "_f.*").drop("_f").withColumn("abstained", F.col("score").isNull())
    return out.withColumn("forecast_id", stable_id("forecast", F.col("run"), F.col("seq"), F.col("token_id"), F.col("method")))


def decisions(outcomes: DataFrame, changes: DataFrame, target: Column) -> DataFrame:
    """One reason per arrival for a target (a condition over condition_id and token_id)."""
    held = outcomes.join(changes.select("run", "seq", "segment", "changed"), ["run", "seq"], "left")
    reason = (
        F.when(F.col("kind") != "delivery", "rejected_arrival").when(F.col("outcome") == "skipped_duplicate", "duplicate_observation")
        .when(F.col("outcome") == "unhandled_payload", "unhandled_payload").when(F.col("outcome") == "unscoped", "unscoped_observation")
        .when(~target, "irrelevant_scope").when(F.coalesce("segment", F.lit(0)) == 0, "target_not_seeded")
        .when(~F.col("changed"), "target_state_unchanged").otherwise("included_information_change")
    )
    return held.withColumn("decision", reason)


def frozen(states_: DataFrame, closes: DataFrame) -> DataFrame:
    """For each target (run, condition_id, token_id, close_at) the last state emitted before it closes.

    A new book time emits again even where the information is equal, and keeps the earlier
    persistence value."""
    before = {"_time": ("last_row", F.col("book_event_time")), "previous_midpoint": ("last", F.when(F.col("changed"), F.col("midpoint")))}
    held = running(states_, before, by=KEY, nulls=False).where(F.col("changed") | ~F.col("_time").eqNullSafe(F.col("book_event_time"))).drop("_time")
    inside = held.join(closes, KEY).where(F.col("received_time") < F.col("close_at"))
    columns = [c for c in inside.columns if c not in KEY]
    return inside.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "seq").alias("_s")).select(*KEY, "_s.*")


def abstention_counts(forecasts_: DataFrame) -> DataFrame:
    return forecasts_.where("abstained").groupBy("method", "abstention_reason").agg(F.count(F.lit(1)).alias("count"))
