"""Order books from snapshots and level changes.

A snapshot resets a book, so what follows it until the next one, a *segment*, is a unit of its own,
and in a segment each level holds from its last write until the next: ``[seq, until)``. The
sequential fold becomes windows over levels and a join of intervals with arrivals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.functions.columns import digest
from bookreplay.functions.windows import running

KEY = ["run", "condition_id", "token_id"]
HANDLED = ["snapshot", "delta", "trade"]
BOOK_OUTCOMES = ["applied_snapshot", "applied_delta"]
#: Span lengths of top_of_book: up to 8^10 places.
SPANS = 11
ANOMALIES = ["delta_before_snapshot", "event_time_regression", "removal_of_absent_level", "scope_mismatch", "snapshot_disagrees"]


def dispatched(arrivals: DataFrame) -> DataFrame:
    """Adds ``outcome`` and ``applied``. Only applied observations are remembered, so an unscoped or
    unhandled row that repeats is counted as such again."""
    handled = F.col("payload_type").isin(HANDLED)
    scoped = F.col("token_id").isNotNull() & F.col("condition_id").isNotNull()
    able = (F.col("kind") == "delivery") & handled & scoped
    # Other rows stand alone, so those without an id don't gather.
    alone = F.when(F.col("_able"), F.lit(None).cast("long")).otherwise(F.col("seq"))
    nth = F.row_number().over(Window.partitionBy("run", F.when(F.col("_able"), F.col("observation_id")), alone).orderBy("seq"))
    outcome = (
        F.when(F.col("kind") != "delivery", "rejected")
        .when(~F.coalesce(handled, F.lit(False)), "unhandled_payload")
        .when(~scoped, "unscoped")
        .when(nth > 1, "skipped_duplicate")
        .when(F.col("payload_type") == "snapshot", "applied_snapshot")
        .when(F.col("payload_type") == "delta", "applied_delta")
        .otherwise("applied_auxiliary")
    )
    held = arrivals.withColumn("_able", F.coalesce(able, F.lit(False))).withColumn("outcome", outcome).drop("_able")
    return held.withColumn("applied", F.col("outcome").startswith("applied"))


def off_scope(outcomes: DataFrame) -> Column:
    """Whether a payload names another token or condition than its envelope; one that names none does not."""
    off = F.lit(False)
    for c in ("token_id", "condition_id"):
        if f"payload_{c}" in outcomes.columns:
            off = off | F.coalesce(F.col(f"payload_{c}") != F.col(c), F.lit(False))
    return off


def segmented(outcomes: DataFrame) -> DataFrame:
    """Applied book inputs (snapshots and deltas) with ``segment``: snapshots of the token so far. A
    payload whose own scope differs from its envelope's (``payload_token_id`` and
    ``payload_condition_id``, where those columns exist) is refused: it stays out of the book and opens
    no segment. ``last_segment`` is the token's, ``place`` numbers the token's accepted inputs. All are counted by blocks,
    so a token's length is no one task's."""
    own = outcomes.where(F.col("outcome").isin(BOOK_OUTCOMES)).where(~off_scope(outcomes))
    snapshot = (F.col("outcome") == "applied_snapshot").cast("long")
    return running(own, {"segment": ("sum", snapshot), "last_segment": ("total", snapshot), "place": ("sum", F.lit(1).cast("long"))}, by=KEY, inclusive=True, nulls=False)


def level_writes(inputs: DataFrame, level_ops: DataFrame) -> DataFrame:
    """A row per level write of an accepted input, with ``before`` (the level's size so far in the
    segment, null if absent) and ``until`` (seq of the next write, null for the last); ``place`` and
    ``until_place`` are the inputs' places of both. A removal has size 0. Deltas before any snapshot (segment 0) are not in."""
    held = level_ops.join(inputs.select(*KEY, "seq", "segment", "last_segment", "place", "outcome", "event_time"), [*KEY, "seq"]).where("segment > 0")
    size = F.when(F.col("kind") == "remove", F.lit(0).cast("decimal(28,10)")).otherwise(F.col("size"))
    w = Window.partitionBy(*KEY, "segment", "side", "price").orderBy("seq")
    held = held.withColumn("size", size)
    return held.withColumn("before", F.lag("size").over(w)).withColumn("until", F.lead("seq").over(w)).withColumn("until_place", F.lead("place").over(w))


def final_levels(writes: DataFrame) -> DataFrame:
    """The last book of each token: its levels of the last segment with a size above zero."""
    held = writes.where("until is null and size > 0 and segment = last_segment")
    return held.select(*KEY, "side", "price", "size")


def levels_as_of(inputs: DataFrame, writes: DataFrame, seq: int) -> DataFrame:
    """The books after the arrival ``seq`` of every run."""
    last = inputs.where(F.col("seq") <= seq).groupBy(*KEY).agg(F.max("segment").alias("_last"))
    top = writes.where(F.col("seq") <= seq).join(last, KEY).where("segment = _last").groupBy(*KEY, "side", "price").agg(F.max_by("size", "seq").alias("size"))
    return top.where("size > 0")


def top_of_book(inputs: DataFrame, writes: DataFrame) -> DataFrame:
    """Best prices, their sizes and level counts after every accepted input.

    Places count a segment's accepted inputs, whatever else its run holds between them. A level's interval is cut into aligned spans of 1, 8, 64,
    ... places, at most fourteen of each length; the levels of a span are summed up before any input is met, and an
    input looks up the spans that hold its place, one of each length. So neither the depth of the book nor
    the life of a level is multiplied by the inputs, and a long segment is spread over its spans."""
    unit = [*KEY, "segment"]
    ends = inputs.where("segment > 0").groupBy(*unit).agg(F.min("place").alias("_start"), F.max("place").alias("_end"))
    held = writes.where("size > 0").join(ends, unit)
    lo, hi = F.col("place") - F.col("_start"), F.coalesce(F.col("until_place"), F.col("_end") + 1) - F.col("_start")
    held = held.select(*unit, "side", "price", "size", lo.alias("_lo"), hi.alias("_hi")).withColumn("_span", F.explode(spans(F.col("_lo"), F.col("_hi"))))
    bid, ask, level = F.col("side") == "bid", F.col("side") == "ask", F.struct("price", "size")
    best = [F.max(F.when(bid, level)).alias("_b"), F.min(F.when(ask, level)).alias("_a"), F.count_if(bid).alias("_nb"), F.count_if(ask).alias("_na")]
    held = held.groupBy(*unit, "_span").agg(*best)
    asked = inputs.where("segment > 0").join(ends, unit).select(*unit, "seq", (F.col("place") - F.col("_start")).alias("_at"), (F.col("_end") - F.col("_start")).alias("_n"))
    ladder = F.transform(lengths(F.col("_n") + 1), lambda k: F.struct(k.alias("k"), F.call_function("shiftright", F.col("_at"), 3 * k).alias("place")))
    asked = asked.select(*unit, "seq", F.explode(ladder).alias("_span"))
    met = asked.join(held, [*unit, "_span"], "left").groupBy(*unit, "seq").agg(F.max("_b").alias("_b"), F.min("_a").alias("_a"), F.sum("_nb").alias("_nb"), F.sum("_na").alias("_na"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return met.select(
        *unit, "seq", F.col("_b.price").alias("best_bid"), F.col("_a.price").alias("best_ask"), F.col("_b.size").alias("bid_size"), F.col("_a.size").alias("ask_size"),
        zero("_nb").alias("bid_levels"), zero("_na").alias("ask_levels"),
    )


def lengths(n: Column) -> Column:
    """0, 1, 2, ... up to the largest k that 8^k is at most n."""
    return F.sequence(F.lit(0), F.least(F.floor((F.length(F.bin(n)) - 1) / 3), F.lit(SPANS - 1)).cast("int"))


def spans(lo: Column, hi: Column) -> Column:
    """[lo, hi) as aligned spans: (k, place) is [place * 8^k, (place + 1) * 8^k)."""
    down = lambda x, k: F.call_function("shiftright", x, 3 * k)
    up = lambda x, k: down(x + F.call_function("shiftleft", F.lit(1).cast("long"), 3 * k) - 1, k)
    between = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def of(k: Column) -> Column:
        a, b, inner, outer = up(lo, k), down(hi, k), up(lo, k + 1), down(hi, k + 1)
        places = F.when(inner < outer, F.concat(between(a, inner * 8), between(outer * 8, b))).otherwise(between(a, b))
        return F.transform(places, lambda p: F.struct(k.alias("k"), p.alias("place")))

    return F.flatten(F.transform(lengths(hi - lo), of))


def with_midpoint(top: DataFrame) -> DataFrame:
    """midpoint and spread, null unless both sides have a price."""
    return top.withColumn("midpoint", ((F.col("best_bid") + F.col("best_ask")) * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(13,11)")).withColumn(
        "spread", (F.col("best_ask") - F.col("best_bid")).cast("decimal(13,11)")
    )


def final_quotes(levels: DataFrame, trades: DataFrame) -> DataFrame:
    """A quote per token from final levels and the last trade of the token."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    top = levels.groupBy(*KEY).agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.max_by(F.col("size"), F.when(bid, F.col("price"))).alias("bid_size"), F.min_by(F.col("size"), F.when(ask, F.col("price"))).alias("ask_size"),
        F.count_if(bid).alias("bid_levels"), F.count_if(ask).alias("ask_levels"),
    )
    return with_midpoint(top).join(last_trades(trades), KEY, "left")


def quote_disagreements(quotes: DataFrame) -> DataFrame:
    """Quotes whose midpoint or spread is not what their sides give."""
    again = with_midpoint(quotes.withColumnRenamed("midpoint", "_m").withColumnRenamed("spread", "_s"))
    return again.where(~F.col("midpoint").eqNullSafe(F.col("_m")) | ~F.col("spread").eqNullSafe(F.col("_s")))


def last_trades(trades: DataFrame) -> DataFrame:
    """The last trade price of each token, by seq."""
    return trades.groupBy(*KEY).agg(F.max_by("price", "seq").alias("last_trade"))


def applied_trades(outcomes: DataFrame, trades: DataFrame) -> DataFrame:
    """Trades of applied trade events and those that applied snapshots carry, whether or not the book
    took the snapshot."""
    return trades.join(outcomes.where("outcome in ('applied_auxiliary', 'applied_snapshot')").select("run", "seq"), ["run", "seq"])


def last_seen(inputs: DataFrame) -> DataFrame:
    """Per token: the last datable event time and the last hash that the source asserted."""
    hashed = [F.max_by("source_hash", F.when(F.col("source_hash").isNotNull(), F.col("seq"))).alias("source_asserted_hash")] if "source_hash" in inputs.columns else []
    return inputs.where("segment > 0").groupBy(*KEY).agg(F.max_by("event_time", F.when(F.col("event_time").isNotNull(), F.col("seq"))).alias("last_event_time"), *hashed)


def delta_before_snapshot(inputs: DataFrame) -> DataFrame:
    return inputs.where("segment = 0").select(*KEY, "seq", F.lit("delta_before_snapshot").alias("anomaly"), F.lit(1).cast("long").alias("n"))


def absent_removals(writes: DataFrame) -> DataFrame:
    gone = writes.where("kind = 'remove' and (before is null or before = 0)")
    return gone.groupBy(*KEY, "seq").agg(F.count(F.lit(1)).alias("n")).select(*KEY, "seq", F.lit("removal_of_absent_level").alias("anomaly"), "n")


def event_time_regressions(inputs: DataFrame) -> DataFrame:
    """Strictly earlier than the last datable accepted input of the token, not than the highest."""
    seeded = inputs.where("segment > 0").select(*KEY, "seq", "event_time")
    back = running(seeded, {"_before": ("last", F.col("event_time"))}, by=KEY, nulls=False).where(F.col("event_time") < F.col("_before"))
    return back.select(*KEY, "seq", F.lit("event_time_regression").alias("anomaly"), F.lit(1).cast("long").alias("n"))


def snapshot_divergence(inputs: DataFrame, writes: DataFrame) -> DataFrame:
    """Where a snapshot disagrees with the book projected so far: how many levels differ, and the
    first five."""
    projected = writes.where("until is null and size > 0").select(*KEY, (F.col("segment") + 1).alias("segment"), "side", "price", F.col("size").alias("had"))
    sent = writes.where("outcome = 'applied_snapshot' and size > 0").select(*KEY, "segment", "side", "price", F.col("size").alias("sent"), "seq")
    starts = inputs.where("outcome = 'applied_snapshot'").select(*KEY, "segment", F.col("seq").alias("_seq")).where("segment > 1")
    both = projected.join(sent, [*KEY, "segment", "side", "price"], "full_outer").where(~F.col("had").eqNullSafe(F.col("sent")))
    level = F.struct("side", "price", "had", "sent")
    ranked = both.join(starts, [*KEY, "segment"]).withColumn("_nth", F.row_number().over(Window.partitionBy(*KEY, "segment").orderBy("side", "price")))
    differing = ranked.groupBy(*KEY, "segment", F.col("_seq").alias("seq")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_nth") <= 5, level))).alias("levels"))
    return differing.select(*KEY, "seq", F.lit("snapshot_disagrees").alias("anomaly"), "n", "levels")


def scope_mismatches(outcomes: DataFrame) -> DataFrame:
    off = outcomes.where(F.col("outcome").isin(BOOK_OUTCOMES)).where(off_scope(outcomes))
    return off.select(*KEY, "seq", F.lit("scope_mismatch").alias("anomaly"), F.lit(1).cast("long").alias("n"))


def anomalies(inputs: DataFrame, writes: DataFrame, outcomes: DataFrame) -> DataFrame:
    parts = [delta_before_snapshot(inputs), absent_removals(writes), event_time_regressions(inputs), scope_mismatches(outcomes)]
    out = snapshot_divergence(inputs, writes).drop("levels")
    for p in parts:
        out = out.unionByName(p)
    return out


def anomaly_counts(found: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row per kind and token with a book input, taken or not, zeros kept. Absent removals count levels, the others inputs."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ANOMALIES])).alias("anomaly")
    n = F.sum(F.when(F.col("anomaly") == "removal_of_absent_level", F.col("n")).otherwise(1)).alias("count")
    counts = found.groupBy(*KEY, "anomaly").agg(n)
    return outcomes.where(F.col("outcome").isin(BOOK_OUTCOMES)).select(*KEY).distinct().select(*KEY, kinds).join(counts, [*KEY, "anomaly"], "left").fillna(0, ["count"])


def applied_counts(inputs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per token: snapshots and deltas that the book took, and inputs it refused."""
    off = outcomes.where(F.col("outcome").isin(BOOK_OUTCOMES)).where(off_scope(outcomes)).select(*KEY, "outcome", F.lit(0).cast("long").alias("segment"))
    return inputs.select(*KEY, "outcome", "segment").unionByName(off).groupBy(*KEY).agg(
        F.count_if((F.col("outcome") == "applied_snapshot") & (F.col("segment") > 0)).alias("snapshots"), F.count_if((F.col("outcome") == "applied_delta") & (F.col("segment") > 0)).alias("deltas"),
        F.count_if(F.col("segment") == 0).alias("refused"),
    )


def book_digests(levels: DataFrame) -> DataFrame:
    """A digest of each final book, the same whatever path built it."""
    line = F.concat_ws(":", "side", F.col("price").cast("string"), F.col("size").cast("string"))
    return levels.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(line)), "|").alias("_all")).select(*KEY, digest(F.lit("book.v1"), F.col("_all")).alias("book_digest"))


def state_hashes(digests: DataFrame, groups: int = 64) -> DataFrame:
    """A hash of all books of a run: the books fall into ``groups`` by their condition's and token's hash,
    each group is hashed by itself, and the run's hash is that of its groups' in order."""
    name = F.concat_ws(":", F.col("condition_id").cast("string"), F.col("token_id").cast("string"))
    group = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % groups
    held = digests.select("run", group.alias("_g"), F.concat_ws(":", name, "book_digest").alias("_line")).groupBy("run", "_g").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), "|"), 256).alias("_h"), F.count(F.lit(1)).alias("_n"))
    line = F.concat_ws(":", F.col("_g").cast("string"), "_h")
    held = held.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_g", line.alias("line")))), lambda x: x["line"]), "|").alias("_all"), F.sum("_n").alias("books"))
    return held.select("run", "books", digest(F.lit("state.v2"), F.col("_all")).alias("state_hash"))


def level_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Levels that only one of two replays has; no row if both give the same state."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))
