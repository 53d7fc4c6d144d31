"""Market selection, contracts, market audits and block selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.functions.columns import first_reason, micros, reasons, stable_id, unix_micros, without_leading_zeros
from bookreplay.functions.storage import stored
from bookreplay.functions.windows import as_of

LABELS = ("No", "Yes")


@dataclass(frozen=True)
class Policy:
    require_binary: bool = True
    require_standard_labels: bool = True
    require_active: bool = True
    exclude_closed: bool = True
    exclude_archived: bool = True
    require_end_time: bool = True
    exclude_ended: bool = True
    min_liquidity: float | None = None
    min_volume: float | None = None
    min_hours_to_end: float | None = None


def standard_labels() -> Column:
    return F.array_sort("outcomes") == F.array(*[F.lit(x) for x in LABELS])


def with_exclusion(markets: DataFrame, policy: Policy, as_of: Column | None = None) -> DataFrame:
    """``exclusion``: the first rule that the market fails, null if it is selected."""
    on = lambda flag, c: F.lit(bool(flag)) & F.coalesce(c, F.lit(False))
    zero = F.lit(0)
    checks = [
        (on(policy.require_binary, F.size("outcomes") != 2), "not_binary"), (on(policy.require_standard_labels, ~standard_labels()), "nonstandard_outcomes"),
        (on(policy.require_active, ~F.col("active")), "not_active"), (on(policy.exclude_closed, F.col("closed")), "closed"),
        (on(policy.exclude_archived, F.col("archived")), "archived"),
        (on(policy.min_liquidity is not None, F.coalesce("liquidity", zero) < (policy.min_liquidity or 0)), "below_min_liquidity"),
        (on(policy.min_volume is not None, F.coalesce("volume", zero) < (policy.min_volume or 0)), "below_min_volume"),
        (on(policy.require_end_time, F.col("end_time").isNull()), "no_end_time"),
    ]
    if as_of is not None:
        hours = micros(F.col("end_time"), as_of) / 3_600_000_000
        checks += [(on(policy.exclude_ended, F.col("end_time") <= as_of), "already_ended"), (on(policy.min_hours_to_end is not None, hours < (policy.min_hours_to_end or 0)), "ends_too_soon")]
    return markets.withColumn("exclusion", first_reason(*checks))


def exclusion_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("exclusion", F.lit("selected")).alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def contracts(markets: DataFrame) -> DataFrame:
    """Contract id, ambiguity flags in fixed order, and their number, per market."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    flags = reasons(
        (blank("resolution_source"), "resolution_source_missing"), (blank("description"), "description_missing"), (F.col("end_time").isNull(), "end_boundary_missing"),
        (F.col("end_time") < F.col("start_time"), "end_before_start"), (F.size("outcomes") != 2, "non_binary_outcomes"),
        ((F.size("outcomes") == 2) & ~standard_labels(), "nonstandard_outcome_labels"), (F.col("closed"), "already_closed"), (F.lit(True), "conditions_not_extracted"),
    )
    tokens = F.array_join(F.transform("outcomes", lambda o: F.concat(o, F.lit("="), F.coalesce(F.col("outcome_token_map")[o], F.lit("")))), "|")
    parts = [F.col(c).cast("string") for c in ("market_id", "condition_id", "question", "description", "resolution_source", "start_time", "end_time")]
    out = markets.withColumn("ambiguity_flags", flags).withColumn("contract_id", stable_id("contract", *parts, tokens))
    return out.withColumn("ambiguity_score", F.size("ambiguity_flags"))


def market_audit(markets: DataFrame, policy: Policy, as_of: Column) -> DataFrame:
    """Whether a market is in scope, and what would stop a capture of it."""
    held = contracts(with_exclusion(markets, policy, as_of))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    blockers = reasons(
        (F.col("closed"), "closed"), (~F.col("active"), "not_active"), (F.coalesce(F.size("outcome_token_map"), F.lit(0)) <= 0, "no_tokens"),
        (F.col("end_time").isNull(), "no_end_time"), (blank("resolution_source") & blank("description"), "unverifiable"),
    )
    return held.withColumn("in_scope", F.col("exclusion").isNull()).withColumn("capture_blockers", blockers).withColumn("capture_ready", F.size("capture_blockers") == 0)


def canonical_identities(markets: DataFrame) -> DataFrame:
    """Market and event ids without leading zeros, condition ids in lower case and, where there is an outcome
    map, ``token_keys``: the set of its tokens without leading zeros."""
    held = (
        markets.withColumn("market_key", without_leading_zeros(F.col("market_id"))).withColumn("event_key", without_leading_zeros(F.trim("event_id")))
        .withColumn("condition_key", F.lower("condition_id"))
    )
    if "outcome_token_map" not in markets.columns:
        return held
    tokens = F.transform(F.map_values("outcome_token_map"), lambda t: F.when(t.rlike("^0+$"), "0").otherwise(F.regexp_replace(t, "^0+", "")))
    return held.withColumn("token_keys", F.array_sort(F.array_distinct(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull()))))


def identity_pairs(held: DataFrame, kinds: dict[str, str]) -> Column:
    """The identities of a row as ``kind:value`` texts, nulls left out; ``kinds``: kind to column, which may hold a
    set. Two rows share an identity where these overlap, whatever places their tokens stand in."""
    types = dict(held.dtypes)

    def named(kind: str, c: str) -> Column:
        values = F.col(c) if types[c].startswith("array") else F.array(F.col(c).cast("string"))
        known = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull())
        return F.transform(known, lambda x: F.concat(F.lit(f"{kind}:"), x))

    return F.array_distinct(F.concat(*[named(kind, c) for kind, c in kinds.items()]))


def duplicate_identities(markets: DataFrame, page: str) -> DataFrame:
    """Ids that a page holds more than once."""
    return canonical_identities(markets).groupBy(page, "market_key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def shared_tokens(markets: DataFrame, page: str) -> DataFrame:
    """Tokens that more than one market of a page names, equal ones by identity, not by spelling."""
    held = canonical_identities(markets).select(page, "market_key", F.explode("token_keys").alias("token_key"))
    return held.groupBy(page, "token_key").agg(F.count_distinct("market_key").alias("markets")).where("markets > 1")


def matching_strata(candidates: DataFrame, strata: DataFrame) -> DataFrame:
    """``stratum_id``: the lowest stratum whose category and half-open bands hold the candidate, else
    null. Every row keeps its own: strata are a few dozen rows of protocol, gathered per category into
    one array that joins on the category."""
    bands = ["min_liquidity", "max_liquidity", "min_spread", "max_spread", "min_horizon_s", "max_horizon_s"]
    lists = strata.groupBy(F.col("category").alias("_category")).agg(F.array_sort(F.collect_list(F.struct("stratum_id", *bands))).alias("_strata"))
    inside = lambda v, x, lo, hi: (F.col(v) >= x[lo]) & (x[hi].isNull() | (F.col(v) < x[hi]))
    fits = F.filter("_strata", lambda x: inside("liquidity", x, *bands[:2]) & inside("spread", x, *bands[2:4]) & inside("horizon_s", x, *bands[4:]))
    held = candidates.join(lists, F.col("category") == F.col("_category"), "left")
    return held.withColumn("stratum_id", F.get(fits, 0)["stratum_id"]).drop("_category", "_strata")


def overlapping_strata(strata: DataFrame) -> DataFrame:
    a, b = strata.alias("a"), strata.alias("b")
    top = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(float("inf")))
    meet = F.col("a.stratum_id") < F.col("b.stratum_id")
    for lo, hi in (("min_liquidity", "max_liquidity"), ("min_spread", "max_spread"), ("min_horizon_s", "max_horizon_s")):
        meet = meet & (F.col(f"a.{lo}").cast("double") < top("b", hi)) & (F.col(f"b.{lo}").cast("double") < top("a", hi))
    return a.join(b, (F.col("a.category") == F.col("b.category")) & meet).select(F.col("a.stratum_id").alias("left_id"), F.col("b.stratum_id").alias("right_id"))


def with_used(candidates: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """``already_used``: the first of ``keys`` whose value a used target has."""
    held, checks = candidates, []
    for k in keys:
        seen = used.where(F.col(k).isNotNull()).select(F.col(k)).distinct().withColumn(f"_{k}", F.lit(True))
        held = held.join(seen, k, "left")
        checks.append((F.col(f"_{k}").isNotNull(), f"{k}_already_used"))
    return held.withColumn("already_used", first_reason(*checks)).drop(*[f"_{k}" for k in keys])


def preference() -> Column:
    """Ascending in order of preference: liquidity down (null counts as zero), then the numeric market id."""
    down = -F.coalesce(F.col("liquidity").cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)"))
    return F.struct(down.alias("b"), F.length("market_key").alias("c"), F.col("market_key").alias("d"))


#: A candidate as the greedy pass sees it: its group, its order in it, the identities it would use up, and
#: the limits it counts against.
CANDIDATE = ["_group", "_pref", "_ids", "_limits"]


def choose(candidates: DataFrame, batch: int) -> DataFrame:
    """The candidates (CANDIDATE columns) that a greedy pass over each group takes: in order of ``_pref``, unless one
    taken before shares an identity, or one of their ``_limits`` (name, most) has been reached.

    By rounds: a group's next ``batch`` candidates that nothing taken forbids yet go through the pass, which
    begins with those taken so far. Spark finds them by a partial top-k, so a task sees at most what is taken and
    one batch of a group, however large the group. What a pass refuses stays forbidden, and the first of a
    batch is free, so each round takes one candidate of each group that has any."""
    schema = ", ".join(f"{c} {t}" for c, t in candidates.select(*CANDIDATE).dtypes)
    taken, rest = candidates.limit(0), candidates

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen, counts = None, set(), {}
        for b in batches:
            keep = []
            for g, ids, limits, old in zip(b["_group"], b["_ids"], b["_limits"], b["_old"]):
                if g != at:
                    at, seen, counts = g, set(), {}
                own = set(ids)
                names = [(x["name"], x["most"]) for x in limits if x["most"] is not None]
                good = bool(old) or not own & seen and all(counts.get(n, 0) < most for n, most in names)
                if good:
                    seen |= own
                    for n, _ in names:
                        counts[n] = counts.get(n, 0) + 1
                keep.append(good)
            yield b.loc[keep, CANDIDATE]

    while True:
        top = rest.withColumn("_n", F.row_number().over(Window.partitionBy("_group").orderBy("_pref"))).where(F.col("_n") <= batch).drop("_n")
        both = taken.withColumn("_old", F.lit(True)).unionByName(top.withColumn("_old", F.lit(False)))
        dealt = both.repartition("_group").sortWithinPartitions("_group", F.col("_old").desc(), "_pref")
        taken = stored(dealt.mapInPandas(step, schema).select(*CANDIDATE), "taken")
        # What is taken is at most the limits of each group allow.
        gone = taken.select("_group", F.explode("_ids").alias("_x")).groupBy("_group").agg(F.collect_set("_x").alias("_gone"))
        used = taken.select("_group", F.explode("_limits").alias("_l")).groupBy("_group", "_l.name").agg(F.count(F.lit(1)).alias("n"), F.max("_l.most").alias("most"))
        full = used.where("n >= most").groupBy("_group").agg(F.collect_set("name").alias("_full"))
        held = rest.join(gone, "_group", "left").join(full, "_group", "left")
        meets = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
        forbidden = meets(F.col("_ids"), F.col("_gone")) | meets(F.transform("_limits", lambda x: x["name"]), F.col("_full"))
        rest = stored(held.where(~forbidden).join(taken.select("_group", "_pref"), ["_group", "_pref"], "left_anti").select(*CANDIDATE), "rest")
        if rest.isEmpty():
            return taken


def limits(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(n.alias("name"), most.cast("int").alias("most")) for n, most in pairs])


def select_blocks(
    candidates: DataFrame, group: str, quota: int, identity: list[str], all_or_nothing: bool = True, per_stratum: DataFrame | None = None, batch: int | None = None
) -> DataFrame:
    """Adds ``decision`` to candidates (columns: group, liquidity, market_key, exclusion, identity keys), each group
    by itself.

    Eligible candidates are taken in order of preference unless one chosen before shares an identity
    with them, until the quota (and, with ``per_stratum``, the stratum's max_targets) is full; see
    ``choose``. A shortfall empties the group where it is all or nothing. Why a candidate isn't taken
    follows from what was taken before it."""
    held, most = candidates, F.lit(None).cast("int")
    if per_stratum is not None:
        held, most = held.join(per_stratum.select("stratum_id", F.col("max_targets").alias("_most")), "stratum_id", "left"), F.col("_most")
    stratum = F.concat(F.lit("stratum:"), F.coalesce(F.col("stratum_id") if "stratum_id" in candidates.columns else F.lit(""), F.lit("")))
    keyed = held.withColumns({"_group": F.col(group).cast("string"), "_pref": preference(), "_ids": identity_pairs(held, {c: c for c in identity}), "_limits": limits((F.lit("all"), F.lit(quota)), (stratum, most))})
    taken = choose(stored(keyed.where("exclusion is null").select(*CANDIDATE), "eligible"), batch or 8 * quota)
    ends = taken.groupBy(F.col("_group").alias("_g")).agg(F.count(F.lit(1)).alias("_taken"), F.max("_pref").alias("_last"))
    strata = taken.groupBy(F.col("_group").alias("_sg"), F.get("_limits", F.lit(1))["name"].alias("_ss")).agg(F.sort_array(F.collect_list("_pref")).alias("_of"))
    told = keyed.join(ends, F.col("_group") == F.col("_g"), "left").join(strata, (F.col("_group") == F.col("_sg")) & (F.get("_limits", F.lit(1))["name"] == F.col("_ss")), "left")
    chosen = F.coalesce(F.array_contains("_of", F.col("_pref")), F.lit(False))
    before = F.size(F.filter("_of", lambda x: x < F.col("_pref")))
    why = (
        F.when(chosen, F.when(F.lit(all_or_nothing) & (F.col("_taken") < quota), "block_shortfall").otherwise("selected"))
        .when((F.col("_taken") >= quota) & (F.col("_pref") > F.col("_last")), "quota_full").when(F.greatest(before, F.lit(0)) >= F.get("_limits", F.lit(1))["most"], "stratum_quota_full").otherwise("identity_conflict")
    )
    return told.withColumn("decision", F.coalesce("exclusion", why)).select(*candidates.columns, "decision")


def capacity(intended: Column, ends_at: Column, selected_at: Column, seconds_each: int) -> Column:
    """Targets that a block can still take: those intended, or as many captures as fit in the time that is left."""
    return F.greatest(F.lit(0), F.least(intended.cast("long"), F.floor(micros(ends_at, selected_at) / (seconds_each * 1_000_000)))).cast("int")


def with_fresh_spread(candidates: DataFrame, books: DataFrame, max_age_seconds: int) -> DataFrame:
    """Adds ``spread`` and ``book_exclusion`` from the token's latest book at ``selected_at``.

    candidates: token_key, selected_at. books: token_key, observed_at, best_bid, best_ask, failed. No book, or a
    request that failed: book_unavailable; older than the bound: book_stale; a side without a price, crossed or
    locked sides: book_invalid."""
    held = candidates.withColumn("_us", unix_micros(F.col("selected_at")))
    facts = books.withColumn("_us", unix_micros(F.col("observed_at")))
    met = as_of(held, facts, ["token_key"], "_us", F.struct("_us", "failed", "best_bid", "best_ask"), "_book")
    b = F.col("_book")
    spread = (b["best_ask"] - b["best_bid"]).cast("decimal(13,11)")
    why = first_reason(
        (b.isNull(), "book_unavailable"), (F.col("_us") - b["_us"] > max_age_seconds * 1_000_000, "book_stale"), (F.coalesce(b["failed"], F.lit(False)), "book_unavailable"),
        (spread.isNull() | (spread <= 0) | (spread > 1), "book_invalid"))
    return met.withColumns({"book_exclusion": why, "spread": F.when(why.isNull(), spread)}).drop("_us", "_book")


#: Identities of a candidate: kind to column. Event groups have a reason of their own.
IDENTITIES = {"market": "market_key", "event": "event_key", "condition": "condition_key", "token": "token_keys"}


def select_in_order(candidates: DataFrame, blocks: DataFrame, partial: bool, batch: int = 64) -> DataFrame:
    """Adds ``decision`` to the candidates of experiments whose blocks follow each other: what a block takes, its
    markets, events, conditions and tokens, no later block may take again.

    candidates: experiment_id, block_no, market_key, event_key, condition_key, token_keys, liquidity, exclusion;
    for partial blocks also stratum_id, max_targets and event_group. blocks: experiment_id, block_no, capacity.
    The fold is one greedy pass over an experiment, ordered by block, in which each block and each stratum
    (over all blocks) is a limit; experiments run beside each other.

    All or nothing: reasons market_identity_reused, event_id_reused, rank_below_cutoff; the first block of an
    experiment that falls short of its capacity takes nothing (block_shortfall), and no block after it is
    selected (predecessor_rejected). Partial: strata come first in a block's order; reasons identity_reused,
    event_group_reused, stratum_quota, block_capacity; an empty block is no hindrance to the next."""
    limit = blocks.select(F.col("experiment_id").alias("_e"), F.col("block_no").alias("_b"), F.col("capacity").alias("_capacity"))
    held = candidates.join(limit, (F.col("experiment_id") == F.col("_e")) & (F.col("block_no") == F.col("_b")), "left").drop("_e", "_b")
    kinds = IDENTITIES | ({"group": "event_group"} if partial else {})
    order = F.struct(F.col("block_no").alias("block"), (F.col("stratum_id") if partial else F.lit("")).alias("stratum"), preference().alias("own"))
    pairs = [(F.concat(F.lit("block:"), F.col("block_no").cast("string")), F.coalesce("_capacity", F.lit(0)))]
    if partial:
        pairs.append((F.concat(F.lit("stratum:"), F.col("stratum_id")), F.col("max_targets")))
    keyed = held.withColumns({"_group": F.col("experiment_id").cast("string"), "_pref": order, "_ids": identity_pairs(held, kinds), "_limits": limits(*pairs)})
    keyed = stored(keyed, "candidates")
    # Without room a block takes nothing, which no round has to find out.
    eligible = keyed.where("exclusion is null and _capacity > 0")
    taken = choose(stored(eligible.select(*CANDIDATE), "eligible"), batch)
    # At most what the blocks' capacities allow for an experiment.
    lists = taken.groupBy(F.col("_group").alias("_g")).agg(F.collect_list(F.struct("_pref", "_ids", F.transform("_limits", lambda x: x["name"]).alias("names"))).alias("_of"))
    told = keyed.join(lists, F.col("_group") == F.col("_g"), "left")
    earlier = F.filter("_of", lambda x: x["_pref"] < F.col("_pref"))
    used = F.flatten(F.transform(earlier, lambda x: x["_ids"]))
    shares = lambda *k: F.coalesce(F.arrays_overlap(F.filter("_ids", lambda x: F.substring_index(x, ":", 1).isin(*k)), used), F.lit(False))
    chosen = F.coalesce(F.exists("_of", lambda x: x["_pref"] == F.col("_pref")), F.lit(False))
    if partial:
        of_stratum = F.size(F.filter(earlier, lambda x: F.array_contains(x["names"], F.concat(F.lit("stratum:"), F.col("stratum_id")))))
        why = F.when(chosen, "selected").when(shares(*IDENTITIES), "identity_reused").when(shares("group"), "event_group_reused").when(F.greatest(of_stratum, F.lit(0)) >= F.col("max_targets"), "stratum_quota").otherwise("block_capacity")
    else:
        counts = taken.groupBy(F.col("_group").alias("_e"), F.col("_pref.block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        short = blocks.join(counts, (F.col("experiment_id").cast("string") == F.col("_e")) & (F.col("block_no") == F.col("_b")), "left").where(F.coalesce("_n", F.lit(0)) < F.col("capacity"))
        told = told.join(short.groupBy(F.col("experiment_id").alias("_x")).agg(F.min("block_no").alias("_short")), F.col("experiment_id") == F.col("_x"), "left")
        why = (
            F.when(F.col("block_no") > F.col("_short"), "predecessor_rejected").when(chosen, F.when(F.col("block_no") == F.col("_short"), "block_shortfall").otherwise("selected"))
            .when(shares("market"), "market_identity_reused").when(shares("event"), "event_id_reused").when(shares("condition", "token"), "market_identity_reused").otherwise("rank_below_cutoff"))
    return told.withColumn("decision", F.coalesce("exclusion", why)).select(*candidates.columns, "decision")


def selection_differences(stored: DataFrame, again: DataFrame) -> DataFrame:
    return stored.exceptAll(again).withColumn("only_in", F.lit("stored")).unionByName(again.exceptAll(stored).withColumn("only_in", F.lit("recomputed")))


def budget_violations(protocols: DataFrame, blocks: DataFrame, strata: DataFrame) -> DataFrame:
    """experiment_id, violation: blocks that leave gaps, overlap or don't sum to the budget; strata
    whose caps exceed it."""
    w = Window.partitionBy("experiment_id").orderBy("block_no")
    held = blocks.withColumn("_before", F.lag("ends_at").over(w)).withColumn("_no", F.lag("block_no").over(w))
    order = held.where("_before is not null").withColumn("violation", F.when(F.col("starts_at") < F.col("_before"), "blocks_overlap").when(F.col("starts_at") > F.col("_before"), "blocks_apart").when(F.col("block_no") != F.col("_no") + 1, "block_numbers"))
    out = order.where("violation is not null").select("experiment_id", "violation")
    for df, column, name in ((blocks, "max_targets", "block_caps"), (strata, "max_targets", "stratum_caps")):
        sums = df.groupBy("experiment_id").agg(F.sum(column).alias("_sum")).join(protocols.select("experiment_id", "budget"), "experiment_id")
        out = out.unionByName(sums.where("_sum <> budget").select("experiment_id", F.lit(name).alias("violation")))
    return out.distinct()


def evidence_violations(candidates: DataFrame, evidence: DataFrame, key: str, deadline: Column) -> DataFrame:
    """Review or book evidence that names no candidate, comes twice or late, and candidates without any."""
    unmatched = evidence.join(candidates.select(key), key, "left_anti").select(key, F.lit("unmatched").alias("violation"))
    absent = candidates.join(evidence.select(key), key, "left_anti").select(key, F.lit("missing").alias("violation"))
    twice = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.lit("duplicate").alias("violation"))
    late = evidence.where(F.col("observed_at") > deadline).select(key, F.lit("late").alias("violation")).distinct()
    return unmatched.unionByName(absent).unionByName(twice).unionByName(late)
