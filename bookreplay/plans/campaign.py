"""Queries over evaluations, selection evidence, lifecycles and audits.

The records that an audit compares are derived from the given tables; damage is planted by the rows'
numbers, and the SQL names the damaged rows by the same numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookreplay.functions.storage import fresh_dir
from bookreplay.operators import audit, book, evaluate, forecast, lateness, ledger, lifecycle, scoring, selection
from bookreplay.plans import views as v
from bookreplay.plans.queries import BOOK, CHANGES, COUNTERS, EVALUATED, MARKETS, POLICY, POLLS, Replay, as_of, contracts, dbl, query
from bookreplay.plans.views import with_views
from bookreplay.sources import landing

T0 = "2024-01-01 00:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def later(time: Column, seconds: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(time.cast("timestamp")) + (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("long") * 1_000_000)


def joined(c: str = "violations") -> Column:
    return F.array_join(c, "|").alias(c)


def every(c: str, n: int) -> Column:
    return F.col(c) % n == 0


# --- quotes, scores, reports ------------------------------------------------------------------------


@query(BOOK + """SELECT run, token_id FROM final_levels WHERE token_id % 7 = 0 GROUP BY ALL HAVING count(*) FILTER (side = 'bid') > 0 AND count(*) FILTER (side = 'ask') > 0""")
def quote_audit(spark: SparkSession, d: str) -> DataFrame:
    """Stored midpoints that the sides don't give: every seventh token's is off by a cent."""
    r = Replay(spark, d)
    q = book.final_quotes(book.final_levels(r.writes), r.trades)
    off = (F.col("midpoint") + F.lit("0.01").cast("decimal(3,2)")).cast("decimal(13,11)")
    return book.quote_disagreements(q.withColumn("midpoint", F.when(every("token_id", 7), off).otherwise(F.col("midpoint")))).select("run", "token_id")


@query("SELECT doc_id AS target_id FROM labels JOIN documents USING (doc_id) WHERE doc_id % 9 = 0")
def score_audit(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.with_scores(v.scored(spark, d))
    off = (F.col("brier") + F.lit("0.01").cast("decimal(3,2)")).cast("decimal(29,22)")
    return scoring.score_disagreements(s.withColumn("brier", F.when(every("target_id", 9), off).otherwise(F.col("brier")))).select("target_id")


@query(with_views("numbered", "arrivals", "dispatched") + COUNTERS + """, u AS (SELECT run, count(*) FILTER (outcome = 'unhandled_payload') AS n FROM outcomes GROUP BY run), c AS (SELECT DISTINCT user_id // 2 AS condition_id FROM events)
SELECT run, concat_ws('|', CASE WHEN run % 3 = 2 THEN 'capture_incomplete' END, CASE WHEN condition_id IS NULL OR run % 7 = 0 THEN 'resolution_time_unknown' END, CASE WHEN condition_id IS NULL OR run % 4 = 0 THEN 'contract_identity_missing' END, CASE WHEN sequence_gaps > 0 THEN 'replay_sequence_gaps' END,
 CASE WHEN received_time_regressions > 0 THEN 'replay_received_time_regressions' END, CASE WHEN n > 0 THEN 'replay_unhandled_payloads' END) AS blockers FROM gaps JOIN back USING (run) JOIN u USING (run) LEFT JOIN c ON c.condition_id = run""")
def headline_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Each run for the condition of its own number."""
    r = Replay(spark, d)
    held = r.counters().withColumn("condition_id", F.col("run")).join(v.resolutions(spark, d), "condition_id", "left").join(contracts(r), "condition_id", "left")
    return scoring.headline_blockers(held).select("run", joined("blockers"))


PROSPECTIVE = EVALUATED.replace("CASE WHEN condition_id % 7 <> 0 THEN TIMESTAMP '2024-01-25 00:00:00' END AS resolved_at FROM resolutions)", "cutoff_at AS resolved_at FROM resolutions LEFT JOIN (SELECT user_id // 2 AS condition_id, min(ts) AS cutoff_at FROM events WHERE event_type = 'purchase' AND CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) > 90 GROUP BY 1) USING (condition_id))")


@query(CHANGES + PROSPECTIVE + "SELECT run, method, count(*) AS forecasts, count(*) FILTER (exclusion IS NULL) AS scored, count(*) FILTER (exclusion = 'post_resolution') AS post_resolution, round(avg((score - outcome) ** 2) FILTER (exclusion IS NULL), 9) AS mean_brier FROM evaluated GROUP BY ALL")
def prospective_report(spark: SparkSession, d: str) -> DataFrame:
    """The run report with cutoffs from lifecycle polls in place of settlement times."""
    r = Replay(spark, d, shared=True)
    polls = v.polls(spark, d)
    targets = polls.select("target_id", F.floor(F.col("target_id") / 2).alias("condition_id")).distinct()
    res = evaluate.with_cutoffs(v.resolutions(spark, d), lifecycle.cutoffs(polls), targets)
    found = evaluate.run_report(evaluate.evaluated(forecast.forecasts(forecast.emitted(r.states())), res, contracts(r), r.counters()))
    return found.select("run", "method", "forecasts", "scored", F.col("excluded_post_resolution").alias("post_resolution"), *dbl("mean_brier"))


@query("""WITH s AS (SELECT source, lang, (n_chars % 101) / 100.0 AS score, quality AS outcome FROM labels JOIN documents USING (doc_id)), g AS (SELECT source AS experiment_id, count(*) AS targets, count(DISTINCT lang) AS categories, count(*) FILTER (outcome = 1) AS yes, count(*) FILTER (outcome = 0) AS no,
 round(avg((score - outcome) ** 2), 9) AS mean_brier, round(avg(abs(score - outcome)), 9) AS mean_absolute_error FROM s GROUP BY source) SELECT *, CASE WHEN targets >= 20 AND yes > 0 AND no > 0 THEN 'reportable' ELSE 'insufficient_targets' END AS verdict FROM g""")
def experiment_reports(spark: SparkSession, d: str) -> DataFrame:
    """Sources as experiments, languages as categories. Every target has an earlier evaluation too."""
    s = scoring.with_scores(v.scored(spark, d)).withColumn("received_time", at(T0)).withColumn("forecast_id", F.col("target_id").cast("string"))
    both = s.withColumn("seq", F.lit(2)).unionByName(s.withColumn("seq", F.lit(1)).withColumn("brier", F.lit(9).cast("decimal(29,22)")))
    targets = v.table(spark, d, "documents").select(F.col("doc_id").alias("target_id"), F.col("source").alias("experiment_id"), F.col("lang").alias("category"))
    found = evaluate.experiment_report(scoring.target_contributions(both), targets, 20)
    return found.select("experiment_id", "targets", "categories", "yes", "no", "verdict", *dbl("mean_brier", "mean_absolute_error"))


def exclusions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as targets, the labelled ones contribute; causes by doc_id."""
    targets = v.table(spark, d, "documents").select(F.col("doc_id").alias("target_id"))
    contributions = v.table(spark, d, "labels").select(F.col("doc_id").alias("target_id"))
    causes = targets.where(every("target_id", 3)).withColumn("reason", F.lit("no_forecast")).unionByName(targets.where(every("target_id", 5)).withColumn("reason", F.lit("capture_incomplete")))
    return targets, contributions, evaluate.target_exclusions(targets, contributions, causes)


@query("SELECT doc_id AS target_id, CASE WHEN doc_id % 5 = 0 THEN 'capture_incomplete' WHEN doc_id % 3 = 0 THEN 'no_forecast' ELSE 'no_admissible_evaluation' END AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def target_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return exclusions(spark, d)[2]


@query("SELECT doc_id AS target_id, CAST(0 AS BIGINT) AS times FROM documents WHERE doc_id % 7 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 2 FROM labels WHERE doc_id % 4 = 0")
def target_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Targets not accounted for exactly once: some exclusions are lost, some contributions excluded too."""
    targets, contributions, gone = exclusions(spark, d)
    extra = contributions.where(every("target_id", 4)).withColumn("reason", F.lit("unresolved"))
    return evaluate.target_accounting(targets, contributions, gone.where(~every("target_id", 7)).unionByName(extra))


@query(with_views("numbered", "arrivals") + """, t AS (SELECT DISTINCT run, run * 1000000 + token_id AS target_id FROM arrivals WHERE token_id IS NOT NULL)
SELECT target_id, min(seq) AS seq, 'unknown_event_type' AS reason FROM t JOIN arrivals a USING (run) WHERE kind = 'rejection' AND reason = 'unknown_event_type' GROUP BY target_id""")
def rejection_proofs(spark: SparkSession, d: str) -> DataFrame:
    a = v.arrivals(spark, d)
    targets = a.where("token_id is not null").select("run", (F.col("run") * 1_000_000 + F.col("token_id")).alias("target_id")).distinct()
    return evaluate.rejection_proofs(a.where("kind = 'rejection'"), targets, F.col("reason") == "unknown_event_type")


@query(POLLS + """, g AS (SELECT target_id, ordinal, epoch_us(coalesce(lead(retrieved_at) OVER (PARTITION BY target_id ORDER BY ordinal), TIMESTAMP '2024-01-31 00:00:00')) - epoch_us(retrieved_at) AS gap FROM polls), c AS (SELECT target_id, max(gap) <= 2 * 43200000000 AS whole FROM g GROUP BY target_id),
f AS (SELECT DISTINCT target_id FROM polls WHERE finality = 'final'), t AS (SELECT DISTINCT target_id FROM polls), r AS (SELECT target_id % 5 AS experiment_id, count(*) AS targets, count(*) FILTER (target_id % 3 <> 0) AS terminal, count(*) FILTER (whole) AS continuous, count(f.target_id) AS cutoffs FROM t JOIN c USING (target_id) LEFT JOIN f USING (target_id) GROUP BY 1)
SELECT *, CASE WHEN targets = terminal THEN 'closed' ELSE 'open' END AS accounting FROM r""")
def terminal_reports(spark: SparkSession, d: str) -> DataFrame:
    polls = v.polls(spark, d)
    targets = polls.select("target_id", (F.col("target_id") % 5).alias("experiment_id")).distinct()
    outcomes = targets.where(~every("target_id", 3)).withColumn("terminal_state", F.lit("completed"))
    return lifecycle.terminal_report(targets, outcomes, lifecycle.continuity(polls, at("2024-01-31 00:00:00"), 43_200), lifecycle.cutoffs(polls))


@query("""WITH r AS (SELECT event_id // 250 AS run, count(*) AS n FROM events GROUP BY 1) SELECT run, concat_ws('|', CASE WHEN run % 5 = 1 THEN 'frames' END, CASE WHEN run % 11 = 0 THEN 'too_few_events' END, CASE WHEN run % 7 = 0 THEN 'tokens' END, CASE WHEN run % 3 = 0 AND run % 2 = 0 THEN 'boundary_without_cap' END, CASE WHEN run % 3 = 1 AND run % 4 = 1 THEN 'cap_without_boundary' END) AS violations
 FROM r WHERE run % 5 = 1 OR run % 11 = 0 OR run % 7 = 0 OR run % 6 = 0 OR run % 12 = 1""")
def outcome_violations(spark: SparkSession, d: str) -> DataFrame:
    runs = v.table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 250).alias("run")).agg(F.count(F.lit(1)).alias("frames"))
    run, zero = F.col("run"), F.lit(0)
    boundary = F.when((run % 3 == 0) & (run % 2 == 0) | (run % 3 == 1) & (run % 4 != 1), 1)
    held = runs.select(
        "run", "frames", (F.col("frames") + F.when(run % 5 == 1, 1).otherwise(0)).alias("health_frames"), F.when(run % 11 == 0, F.col("frames") - 1).otherwise(F.col("frames")).alias("accepted"), zero.alias("duplicate"), zero.alias("rejected"), zero.alias("not_applicable"),
        (run % 7).alias("tokens"), F.element_at(F.array(F.lit("completed"), F.lit("frames"), F.lit("duration")), (run % 3 + 1).cast("int")).alias("stop_reason"), boundary.alias("boundary_frame"))
    return evaluate.outcome_violations(held).select("run", joined())


# --- selection evidence -----------------------------------------------------------------------------


@query("""WITH s AS (SELECT left(o_orderpriority, 1) || '-' || CAST(floor(o_totalprice / 20000) AS INTEGER) || '-' || o_custkey % 3 AS id, o_orderpriority AS category, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL)
SELECT a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.category = b.category AND a.id < b.id AND a.lo < b.hi AND b.lo < a.hi""")
def overlapping_strata(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    name = F.concat_ws("-", F.substring("o_orderpriority", 1, 1), F.floor(F.col("o_totalprice") / 20_000).cast("string"), (F.col("o_custkey") % 3).cast("string"))
    s = o.groupBy(name.alias("stratum_id"), F.col("o_orderpriority").alias("category")).agg(F.min("o_totalprice").alias("min_liquidity"), F.max("o_totalprice").alias("max_liquidity"))
    none = F.lit(None).cast("double")
    return selection.overlapping_strata(s.withColumns({"min_spread": F.lit(0.0), "max_spread": none, "min_horizon_s": F.lit(0), "max_horizon_s": none}))


@query("SELECT o_orderkey // 200 AS page, CAST(o_orderkey // 2 AS VARCHAR) AS market_key, count(*) AS times FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_identities(spark: SparkSession, d: str) -> DataFrame:
    """Every second id is its neighbour's with leading zeros."""
    k = F.col("o_orderkey")
    half = F.floor(k / 2).cast("string")
    m = v.table(spark, d, "orders").select(F.floor(k / 200).alias("page"), F.when((k % 2 == 1) & (k > 1), F.concat(F.lit("00"), half)).otherwise(half).alias("market_id"), k.cast("string").alias("event_id"), k.cast("string").alias("condition_id"))
    return selection.duplicate_identities(m, "page")


@query(MARKETS + "SELECT CAST(k AS VARCHAR) AS market_id, unnest(['stored', 'recomputed']) AS only_in FROM j WHERE k % 97 = 0")
def selection_audit(spark: SparkSession, d: str) -> DataFrame:
    """A stored selection against the recomputed one; every 97th decision was altered."""
    again = selection.with_exclusion(v.markets(spark, d), POLICY, as_of()).select("market_id", F.coalesce("exclusion", F.lit("selected")).alias("decision"))
    altered = F.when(F.col("market_id").cast("long") % 97 == 0, "altered").otherwise(F.col("decision"))
    return selection.selection_differences(again.withColumn("decision", altered), again).select("market_id", "only_in")


@query("""WITH b AS (SELECT c_custkey // 10 AS experiment_id, c_custkey % 10 AS block_no, c_custkey AS k FROM customer), s AS (SELECT experiment_id, 2 * count(*) AS blocks, 2 * count(*) + count(*) FILTER (k % 53 = 0) AS strata, 20 + CASE WHEN experiment_id % 7 = 0 THEN 1 ELSE 0 END AS budget FROM b GROUP BY experiment_id)
SELECT DISTINCT experiment_id, CASE WHEN k % 41 = 0 THEN 'blocks_overlap' ELSE 'blocks_apart' END AS violation FROM b WHERE block_no > 0 AND (k % 41 = 0 OR k % 37 = 0) UNION ALL SELECT experiment_id, 'block_caps' FROM s WHERE blocks <> budget UNION ALL SELECT experiment_id, 'stratum_caps' FROM s WHERE strata <> budget""")
def budget_violations(spark: SparkSession, d: str) -> DataFrame:
    """Customers as blocks, ten to an experiment, an hour each."""
    k = F.col("c_custkey")
    b = v.table(spark, d, "customer").select(k, F.floor(k / 10).alias("experiment_id"), (k % 10).alias("block_no"), F.lit(2).alias("max_targets"))
    shift = F.when(k % 41 == 0, -600).when(k % 37 == 0, 600).otherwise(0)
    blocks = b.withColumn("starts_at", later(at(T0), F.col("block_no") * 3600 + shift)).withColumn("ends_at", later(at(T0), (F.col("block_no") + 1) * 3600))
    protocols = b.select("experiment_id", (F.lit(20) + F.when(every("experiment_id", 7), 1).otherwise(0)).alias("budget")).distinct()
    strata = b.withColumn("max_targets", F.when(every("c_custkey", 53), 3).otherwise(2))
    return selection.budget_violations(protocols, blocks, strata)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS market_key, unnest(list_filter([CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN 'unmatched' END, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'missing' END, CASE WHEN o_orderkey % 12 = 0 THEN 'duplicate' END,
 CASE WHEN o_orderkey % 3 = 0 AND o_orderdate > TIMESTAMP '1997-01-01 00:00:00' THEN 'late' END], lambda x: x IS NOT NULL)) AS violation FROM orders""")
def evidence_violations(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("market_key"), F.col("o_orderdate").alias("observed_at"))
    evidence = o.where(every("o_orderkey", 3))
    return selection.evidence_violations(o.where(every("o_orderkey", 2)), evidence.unionByName(evidence.where(every("o_orderkey", 12))), "market_key", at("1997-01-01 00:00:00"))


# --- lifecycles and late outcomes -------------------------------------------------------------------


def late(spark: SparkSession, d: str) -> DataFrame:
    frozen = v.table(spark, d, "documents").select(
        F.col("doc_id").alias("target_id"), F.floor(F.col("doc_id") / 10).alias("group_id"), F.col("doc_id").cast("string").alias("forecast_id"), (F.col("doc_id") % 2).alias("token_id"), F.when(~every("doc_id", 11), F.lit(0.5)).alias("score"))
    outcomes = v.table(spark, d, "labels").select(F.col("doc_id").alias("target_id"), F.when(every("doc_id", 5), "open").otherwise("final").alias("status"), F.when(~every("doc_id", 13), F.col("quality")).alias("winning_token_id"))
    return lifecycle.late_scores(frozen, outcomes)


LATE = """WITH s AS (SELECT doc_id, doc_id // 10 AS group_id, CASE WHEN quality IS NULL OR doc_id % 5 = 0 THEN 'pending' WHEN doc_id % 13 = 0 THEN 'final_unscorable' WHEN doc_id % 11 = 0 THEN 'abstained' ELSE 'scored' END AS state, quality FROM documents LEFT JOIN labels USING (doc_id))
"""


@query(LATE + "SELECT doc_id AS target_id, state, CASE WHEN state = 'scored' THEN CASE WHEN quality = doc_id % 2 THEN 1 ELSE 0 END END AS outcome FROM s")
def late_scores(spark: SparkSession, d: str) -> DataFrame:
    return late(spark, d).select("target_id", "state", "outcome")


@query(LATE + """SELECT group_id AS target_id, count(*) AS planned, count(*) FILTER (state = 'scored') AS scored, count(*) FILTER (state = 'abstained') AS abstained, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'final_unscorable') AS unscorable,
 CASE WHEN count(*) FILTER (state = 'pending') > 0 AND count(*) FILTER (state = 'scored') > 0 THEN 'scored_while_pending' ELSE '' END AS violations FROM s GROUP BY group_id""")
def late_partition(spark: SparkSession, d: str) -> DataFrame:
    """Ten forecasts of one target, of which some are still pending."""
    found = lifecycle.late_partition(late(spark, d).withColumn("target_id", F.col("group_id")))
    return found.select("target_id", "planned", "scored", "abstained", "pending", "unscorable", joined())


@query(POLLS + """, c AS (SELECT target_id, min(retrieved_at) AS cutoff_at FROM polls WHERE finality = 'final' GROUP BY target_id) SELECT target_id, concat_ws('|', CASE WHEN cutoff_at <= TIMESTAMP '2024-01-10 00:00:00' THEN 'cutoff_before_deadline' END,
 CASE WHEN target_id % 9 = 0 OR TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(target_id % 400 AS INTEGER)) >= cutoff_at THEN 'snapshot_not_durable' END, CASE WHEN target_id % 3 = 2 THEN 'foreign_winner' END) AS refusals FROM c""")
def late_admissibility(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("target_id")
    held = lifecycle.cutoffs(v.polls(spark, d)).select("target_id", "cutoff_at").withColumns({
        "deadline": at("2024-01-10 00:00:00"), "snapshot_persisted_at": F.when(t % 9 != 0, later(at(T0), t % 400 * 3600)), "winning_token_id": t % 3, "token_ids": F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))})
    return lifecycle.admissibility(held).select("target_id", joined("refusals"))


@query(POLLS + "SELECT target_id, ordinal, CASE WHEN ordinal % 5 = 0 THEN false ELSE true END AS valid FROM polls")
def merged_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A gap after every poll, logged twice; every fifth names a predecessor that the chain doesn't have."""
    p = v.polls(spark, d)
    gaps = p.select("target_id", "ordinal", F.col("retrieved_at").alias("started_at"), later(F.col("retrieved_at"), 60).alias("ended_at"), F.lit("late").alias("reason"), F.when(every("ordinal", 5), "x").otherwise(F.col("previous_id")).alias("predecessor_id"))
    return lifecycle.merged_gaps(gaps.unionByName(gaps), p).select("target_id", "ordinal", "valid")


@query("""WITH g AS (SELECT user_id AS target_id, ts, event_type, epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts), TIMESTAMP '2024-01-01 00:00:00')) AS gap FROM events),
a AS (SELECT target_id, count(*) AS samples, greatest(max(gap), epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) AS max_gap_us, arg_max(event_type, ts) AS last FROM g GROUP BY target_id)
SELECT target_id, samples, max_gap_us, concat_ws('|', CASE WHEN max_gap_us > 2 * 86400000000 THEN 'gap' END, CASE WHEN last <> 'purchase' THEN 'not_terminal' END) AS failures FROM a""")
def checkpoint_cadence(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint per event of a user, a purchase being terminal."""
    state = F.when(F.col("event_type") == "purchase", "completed").otherwise("running")
    samples = v.table(spark, d, "events").select(F.col("user_id").alias("target_id"), F.col("ts").cast("timestamp").alias("ts"), state.alias("state"))
    bounds = samples.select("target_id").distinct().withColumn("started_at", at(T0)).withColumn("ended_at", at("2024-01-31 00:00:00"))
    return lifecycle.cadence(samples, "target_id", "ts", bounds, 2 * 86_400).select("target_id", "samples", "max_gap_us", joined("failures"))


# --- audits ---------------------------------------------------------------------------------------


@query(with_views("numbered", "arrivals") + """SELECT run, concat_ws('|', CASE WHEN run % 4 = 1 THEN 'accepted' END, CASE WHEN run % 5 = 2 THEN 'rejected' END, CASE WHEN run % 7 = 3 THEN 'empty_archive' END, CASE WHEN run % 3 = 1 THEN 'state_hash' END) AS failures FROM (SELECT DISTINCT run FROM arrivals)""")
def run_health(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d)
    counts = lateness.run_counts(r.arrivals, ledger.with_disposition(r.arrivals.where("kind = 'delivery'")))
    health = counts.select("run", (F.col("accepted") + F.when(F.col("run") % 4 == 1, 1).otherwise(0)).alias("accepted"), (F.col("rejected") + F.when(F.col("run") % 5 == 2, 1).otherwise(0)).alias("rejected"))
    files = counts.where("run % 7 <> 3").select("run", F.col("arrivals").alias("files"))
    hashes = book.state_hashes(book.book_digests(book.final_levels(r.writes))).select("run", F.col("state_hash").alias("first_hash"), F.when(F.col("run") % 3 == 1, F.reverse("state_hash")).otherwise(F.col("state_hash")).alias("second_hash"))
    return audit.run_health(counts, health, files, hashes).select("run", joined("failures"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey % 7 <> 0), n AS (SELECT k, CASE WHEN k % 10 = 0 THEN 0 WHEN k % 17 = 0 THEN 2 ELSE 1 END::BIGINT AS specs, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 19 = 0 THEN 2 ELSE 1 END::BIGINT AS results FROM c)
SELECT k AS scenario, specs, results, concat_ws('|', CASE WHEN specs <> 1 THEN 'spec' END, CASE WHEN results <> 1 THEN 'result' END, CASE WHEN specs > 0 AND results > 0 AND k % 100 > 90 THEN 'bounds' END) AS violations FROM n""")
def campaign_accounting(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("scenario"))
    s, r = c.where(~every("scenario", 10)).withColumn("max_seconds", F.lit(90)), c.where(~every("scenario", 7)).withColumn("seconds", F.col("scenario") % 100).withColumn("status", F.lit("passed"))
    found = audit.campaign_accounting(s.unionByName(s.where(every("scenario", 17))), r.unionByName(r.where(every("scenario", 19))))
    return found.select("scenario", "specs", "results", joined())


@query("""SELECT doc_id AS artifact_id, CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE concat_ws('|', CASE WHEN doc_id % 13 = 0 THEN 'hash' END, CASE WHEN doc_id % 11 = 0 THEN 'length' END) END AS violations FROM documents WHERE doc_id % 17 = 0 OR doc_id % 13 = 0 OR doc_id % 11 = 0""")
def receipt_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("artifact_id"), F.col("text").alias("raw"))
    sha = F.when(every("artifact_id", 13), F.sha2(F.lit("x"), 256)).otherwise(F.sha2("raw", 256))
    receipts = docs.select("artifact_id", sha.alias("artifact_sha256"), (F.octet_length("raw") + F.when(every("artifact_id", 11), 1).otherwise(0)).alias("byte_length"))
    return audit.receipt_violations(receipts, docs.where(~every("artifact_id", 17))).select("artifact_id", joined())


@query("WITH r AS (SELECT DISTINCT event_id // 250 AS run FROM events) SELECT 'run=' || run AS path, CASE WHEN run % 7 = 2 THEN 'unlisted' ELSE 'hash' END AS violation FROM r WHERE run % 7 = 2 OR run % 5 = 1 UNION ALL SELECT 'gone-' || run, 'missing' FROM r WHERE run % 3 = 1")
def manifest_audit(spark: SparkSession, d: str) -> DataFrame:
    """Files written to a folder against a manifest of them with damage."""
    folder = fresh_dir(spark, "files")
    rows = v.table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 250).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("value"))
    rows.write.partitionBy("run").text(folder)
    name, body, run = F.concat(F.lit("run="), F.col("run").cast("string")), F.concat("value", F.lit("\n")), F.col("run")
    listed = rows.where("run % 7 <> 2").select(name.alias("path"), F.when(run % 5 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(body, 256)).alias("sha256"), F.octet_length(body).cast("long").alias("size"))
    gone = rows.where("run % 3 = 1").select(F.concat(F.lit("gone-"), run.cast("string")).alias("path"), F.sha2(body, 256).alias("sha256"), F.lit(1).cast("long").alias("size"))
    found = landing.files(spark, folder).where(F.col("path").contains("run=")).withColumn("path", F.regexp_extract("path", "(run=\\d+)", 1))
    return audit.manifest_violations(listed.unionByName(gone), found).select("path", "violation")


@query("""WITH p AS (SELECT event_id AS e, event_id // 250 AS run FROM events WHERE event_type = 'purchase'), w AS (SELECT e, run, concat_ws('|', CASE WHEN e % 37 = 0 THEN 'proof' END, CASE WHEN e % 11 = 0 THEN 'identity' END,
 CASE WHEN e % 17 = 0 THEN 'raw_missing' WHEN e % 13 = 0 THEN 'raw' END, CASE WHEN e % 19 = 0 THEN 'location' END, CASE WHEN e % 23 = 0 OR (run % 8 = 3 AND run % 7 <> 5) THEN 'chronology' END,
 CASE WHEN run % 7 = 5 OR run % 10 = 9 THEN 'manifest' END, CASE WHEN run % 7 <> 5 AND run % 6 = 1 THEN 'revision' END, CASE WHEN run % 7 <> 5 AND run % 9 = 4 THEN 'not_archived' END,
 CASE WHEN run % 7 <> 5 AND run % 5 = 2 THEN 'schemas' END, CASE WHEN e % 31 = 0 THEN 'reason' END, CASE WHEN e % 29 = 0 AND e % 17 <> 0 THEN 'scope' END) AS violations FROM p)
SELECT e AS target_id, run, e AS seq, violations FROM w WHERE violations <> ''""")
def proof_audit(spark: SparkSession, d: str) -> DataFrame:
    """Proofs of refused trades against the archive's bytes and the runs' manifests, each damaged somewhere."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = v.table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.floor(e / 250).alias("run"))
    raw = F.to_json(F.struct(u.cast("string").alias("asset_id"), F.lit("last_trade_price").alias("event_type"), F.floor(u / 2).cast("string").alias("market"), e.cast("string").alias("timestamp")))
    rows = rows.withColumn("raw", raw).withColumn("raw_sha256", F.sha2("raw", 256))
    proofs = rows.select(
        e.alias("target_id"), "run", e.alias("seq"), "raw_sha256", F.octet_length("raw").alias("byte_length"),
        F.when(e % 19 == 0, F.lit("raw/elsewhere")).otherwise(audit.archive_location(F.col("raw_sha256"))).alias("raw_location"),
        F.when(e % 31 == 0, "malformed_payload").otherwise("unknown_event_type").alias("reason"), F.lit("last_trade_price").alias("detail"), u.cast("string").alias("scope"),
        F.floor(u / 2).alias("condition_id"), F.when(e % 29 == 0, u + 1).otherwise(u).alias("token_id"),
        F.col("ts").alias("received_time"), F.col("ts").alias("retrieved_at"), later(F.col("ts"), F.when(e % 23 == 0, -1).otherwise(1)).alias("rejected_at"))
    turned = lambda n, c: F.when(e_ % n == 0, F.reverse(c)).otherwise(c)
    e_ = F.col("target_id")
    proofs = proofs.withColumn("rejection_id", turned(11, ledger.rejection_id())).withColumn("proof_id", turned(37, audit.proof_id()))
    archive = rows.where(e % 17 != 0).select("raw_sha256", F.when(e % 13 == 0, F.concat("raw", F.lit(" "))).otherwise(F.col("raw")).alias("raw"))
    run = F.col("run")
    manifests = rows.select("run").distinct().where(run % 7 != 5).select(
        "run", F.when(run % 10 == 9, "replay").otherwise("capture").alias("mode"), F.when(run % 8 == 3, at("2000-01-01 00:00:00")).otherwise(at("2100-01-01 00:00:00")).alias("created_at"),
        F.lit("r1").alias("code_revision"), (run % 6 != 1).alias("clean"), (run % 9 != 4).alias("raw_archive"),
        F.when(run % 5 == 2, F.array(F.lit("rejection"), F.lit("trade"))).otherwise(F.array(F.lit("rejection"))).alias("schemas"))
    return audit.proof_violations(proofs, archive, manifests, "last_trade_price", "rejection", "trade").select("target_id", "run", "seq", joined())


@query("""WITH e AS (SELECT event_id AS i, sha256(CAST(event_id AS VARCHAR)) AS poll_id FROM events) SELECT poll_id, CASE WHEN i % 11 = 0 THEN 'no_evidence' ELSE concat_ws('|', CASE WHEN i % 13 = 0 THEN 'more_than_one' END, CASE WHEN i % 17 = 0 THEN 'time' END, CASE WHEN i % 19 = 0 THEN 'hash' END) END AS violations FROM e WHERE i % 11 = 0 OR i % 13 = 0 OR i % 17 = 0 OR i % 19 = 0
 UNION ALL SELECT 'u' || i, 'unknown_poll' FROM e WHERE i % 23 = 0""")
def retrieval_audit(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    polls = v.table(spark, d, "events").select(i, F.col("user_id").alias("target_id"), F.sha2(i.cast("string"), 256).alias("poll_id"), F.col("ts").cast("timestamp").alias("retrieved_at"), F.sha2("props", 256).alias("raw_sha256"))
    told = polls.where("event_id % 11 <> 0").withColumn("retrieved_at", F.when(i % 17 == 0, later(F.col("retrieved_at"), 1)).otherwise(F.col("retrieved_at"))).withColumn("raw_sha256", F.when(i % 19 == 0, "x").otherwise(F.col("raw_sha256")))
    strange = polls.where("event_id % 23 = 0").withColumn("poll_id", F.concat(F.lit("u"), i.cast("string")))
    return audit.retrieval_violations(polls, told.unionByName(told.where("event_id % 13 = 0")).unionByName(strange)).select("poll_id", joined())


@query(with_views("numbered", "arrivals") + "SELECT run, seq, 'left' AS only_in FROM arrivals WHERE seq % 101 = 0 UNION ALL SELECT run, seq, unnest(['left', 'right']) FROM arrivals WHERE seq % 103 = 0 AND seq % 101 <> 0")
def ledger_differences(spark: SparkSession, d: str) -> DataFrame:
    """Two captures of the same arrivals at other times; one lost some and altered others."""
    a = v.arrivals(spark, d).select("run", "seq", "kind", "observation_id", "received_time")
    other = a.where("seq % 101 <> 0").withColumn("received_time", later(F.col("received_time"), 9)).withColumn("observation_id", F.when(every("seq", 103), "x").otherwise(F.col("observation_id")))
    return ledger.ledger_differences(a, other, ["received_time"]).select("run", "seq", "only_in")


@query("""WITH t AS (SELECT user_id AS target_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id), c AS (SELECT *, concat_ws('|', CASE WHEN target_id % 7 = 0 THEN 'protocol_at_after_market_at' END, CASE WHEN target_id % 11 = 0 THEN 'contract_at_after_target_at' END,
 CASE WHEN hi >= TIMESTAMP '2024-01-29 12:00:00' THEN 'forecast_at_or_after_cutoff' END, CASE WHEN lo < TIMESTAMP '2024-01-01 03:00:00' THEN 'forecast_before_window' END, CASE WHEN target_id % 13 = 0 THEN 'scope' END, CASE WHEN target_id % 17 = 0 THEN 'polls' END) AS violations FROM t) SELECT target_id, violations FROM c WHERE violations <> ''""")
def chronology_audit(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("target_id")
    base = v.table(spark, d, "events").groupBy(F.col("user_id").alias("target_id")).agg(F.min("ts").cast("timestamp").alias("first_forecast_at"), F.max("ts").cast("timestamp").alias("last_forecast_at"))
    hour = lambda h: later(at("2023-12-31 00:00:00"), h * 3600)
    held = base.withColumns({
        "protocol_at": F.when(t % 7 == 0, hour(2)).otherwise(hour(1)), "market_at": F.when(t % 7 == 0, hour(1)).otherwise(hour(2)), "contract_at": F.when(t % 11 == 0, hour(5)).otherwise(hour(3)), "target_at": hour(4),
        "cutoff_at": at("2024-01-29 12:00:00"), "window_start": at("2024-01-01 03:00:00"), "window_end": at("2024-03-01 00:00:00"), "condition_id": t, "market_condition_id": F.when(t % 13 == 0, t + 1).otherwise(t)})
    return audit.chronology_violations(held, base.where("target_id % 17 = 0").select("target_id")).select("target_id", joined())


@query("""WITH s AS (SELECT event_id // 4 AS s, count(*) AS n FROM events GROUP BY 1), c AS (SELECT s AS snapshot_id, concat_ws('|', CASE WHEN s % 11 = 0 OR n <> 4 THEN 'methods' END, CASE WHEN s % 13 = 0 AND n > 1 THEN 'state' END, CASE WHEN s % 17 = 0 THEN 'before_admission' END, CASE WHEN s % 23 = 0 THEN 'after_freeze' END, CASE WHEN s % 19 = 0 THEN 'not_blind' END) AS violations FROM s)
SELECT * FROM c WHERE violations <> ''""")
def snapshot_audit(spark: SparkSession, d: str) -> DataFrame:
    """Four events as the four methods' forecasts of one frozen state."""
    s, m = F.col("snapshot_id"), F.col("event_id") % 4
    base = v.table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 4).alias("snapshot_id"))
    held = base.withColumns({
        "method": F.element_at(F.array(*[F.lit(x) for x in forecast.METHODS]), F.when((s % 11 == 0) & (m == 3), 1).otherwise(m + 1).cast("int")), "state_key": F.when((s % 13 == 0) & (m == 0), -1).otherwise(s), "as_of": later(at(T0), s),
        "admitted_at": later(at(T0), s + F.when(s % 17 == 0, 1).otherwise(-10)), "freeze_at": later(at(T0), s + F.when(s % 23 == 0, -1).otherwise(10)), "blind": later(at(T0), s + F.when(s % 19 == 0, -5).otherwise(60))})
    return audit.snapshot_violations(held, forecast.METHODS, F.col("blind")).select("snapshot_id", joined())


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), j AS (SELECT k AS run, concat_ws('|', CASE WHEN k % 130 > 120 THEN 'duration_cap' END, CASE WHEN k % 70 > 60 THEN 'frames_cap' END, CASE WHEN k % 50 > 40 THEN 'bytes_cap' END, CASE WHEN k % 4 = 0 AND k % 130 < 120 THEN 'stopped_early_by_duration' END,
 CASE WHEN k % 4 = 1 AND k % 70 < 60 THEN 'stopped_early_by_frames' END, CASE WHEN k % 4 = 2 AND k % 50 < 40 THEN 'stopped_early_by_bytes' END, CASE WHEN k % 9 = 0 THEN 'closed_before_freeze' END) AS violations FROM c) SELECT * FROM j WHERE violations <> ''""")
def capture_caps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    held = v.table(spark, d, "customer").select(
        k.alias("run"), (k % 130).alias("seconds"), (k % 70).alias("frames"), (k % 50).alias("bytes"), F.lit(120).alias("max_seconds"), F.lit(60).alias("max_frames"), F.lit(40).alias("max_bytes"),
        F.element_at(F.array(*[F.lit(x) for x in ("duration", "frames", "bytes", "completed")]), (k % 4 + 1).cast("int")).alias("stop_reason"), at(T0).alias("freeze_at"), later(at(T0), F.when(k % 9 == 0, -1).otherwise(1)).alias("closed_at"))
    return audit.cap_violations(held).select("run", joined())


@query("""WITH f AS (SELECT event_id // 250 AS run, event_id % 250 AS frame_no, ts - CASE WHEN event_id % 89 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END AS t_at, 100 + event_id % 7 AS n FROM events WHERE event_id % 83 <> 0), w AS (SELECT *, lag(frame_no) OVER o AS before, lag(t_at) OVER o AS earlier FROM f WINDOW o AS (PARTITION BY run ORDER BY frame_no)),
g AS (SELECT run, coalesce(bool_or(frame_no <> before + 1), false) AS gap, coalesce(bool_or(t_at < earlier), false) AS back FROM w GROUP BY run) SELECT run, concat_ws('|', CASE WHEN gap THEN 'frame_numbers' END, CASE WHEN back THEN 'time_order' END, CASE WHEN run % 5 = 2 THEN 'frames' END, CASE WHEN run % 7 = 3 THEN 'bytes' END) AS violations FROM g WHERE gap OR back OR run % 5 = 2 OR run % 7 = 3""")
def frame_inventory(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    f = v.table(spark, d, "events").where("event_id % 83 <> 0").select(F.floor(i / 250).alias("run"), (i % 250).alias("frame_no"), later(F.col("ts"), F.when(i % 89 == 0, -6 * 3600).otherwise(0)).alias("received_time"), (F.lit(100) + i % 7).alias("byte_length"))
    totals = f.groupBy("run").agg(F.count(F.lit(1)).alias("frames"), F.sum("byte_length").alias("bytes"))
    said = totals.select("run", (F.col("frames") + F.when(F.col("run") % 5 == 2, 1).otherwise(0)).alias("frames"), (F.col("bytes") + F.when(F.col("run") % 7 == 3, 1).otherwise(0)).alias("bytes"))
    return audit.inventory_violations(f, said).select("run", joined())


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 10 AS x FROM orders), j AS (SELECT k AS target_id, CASE WHEN x = 9 THEN concat_ws('|', 'no_protocol', CASE WHEN shared THEN 'shared_run' END) ELSE concat_ws('|', CASE WHEN k % 100 > 90 THEN 'runtime' END, CASE WHEN k % 11 = 0 THEN 'before_window' END, CASE WHEN k % 13 = 0 THEN 'after_window' END, CASE WHEN shared THEN 'shared_run' END) END AS violations
 FROM (SELECT *, count(*) OVER (PARTITION BY CASE WHEN k % 40 = 1 THEN k - 1 ELSE k END) > 1 AS shared FROM o)) SELECT * FROM j WHERE violations <> ''""")
def protocol_audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    targets = v.table(spark, d, "orders").select(
        k.alias("target_id"), (F.col("o_custkey") % 10).alias("experiment_id"), F.when(k % 40 == 1, k - 1).otherwise(k).alias("run"), (k % 100).alias("runtime_s"),
        later(at(T0), F.when(k % 11 == 0, -1).otherwise(1)).alias("starts_at"), later(at(T0), F.when(k % 13 == 0, 7201).otherwise(7199)).alias("ends_at"))
    protocols = targets.where("experiment_id <> 9").select("experiment_id", F.lit(90).alias("max_runtime_s"), at(T0).alias("window_start"), later(at(T0), 7200).alias("window_end")).distinct()
    return audit.protocol_violations(targets, protocols).select("target_id", joined())


@query("SELECT event_id FROM events WHERE CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 9 = 0")
def missing_archives(spark: SparkSession, d: str) -> DataFrame:
    """Polls whose bytes the archive lacks: those with a property divisible by nine."""
    polls = v.table(spark, d, "events").select("event_id", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"), F.sha2("props", 256).alias("raw_sha256"))
    return audit.missing_archives(polls, polls.where("k % 9 <> 0")).select("event_id")


@query("SELECT sha256(CAST(doc_id % 500 AS VARCHAR)) AS raw_sha256, count(DISTINCT text) AS contents FROM documents GROUP BY doc_id % 500 HAVING count(DISTINCT text) > 1")
def archive_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Hashes under which different bytes came: documents claim the hash of their number's remainder."""
    claimed = F.sha2((F.col("doc_id") % 500).cast("string"), 256)
    return ledger.archive_conflicts(v.table(spark, d, "documents").select(claimed.alias("raw_sha256"), F.col("text").alias("raw")))


@query("""WITH c AS (SELECT conv_id, count(*) AS links, max(turn) AS top FROM conversations GROUP BY conv_id) SELECT conv_id, concat_ws('|', CASE WHEN conv_id % 9 = 0 THEN 'unsealed' END, CASE WHEN conv_id % 9 <> 0 AND conv_id % 5 = 0 THEN 'links' END, CASE WHEN conv_id % 9 <> 0 AND conv_id % 7 = 0 THEN 'tail' END) AS violations FROM c WHERE conv_id % 9 = 0 OR conv_id % 5 = 0 OR conv_id % 7 = 0""")
def chain_seals(spark: SparkSession, d: str) -> DataFrame:
    """Conversations against seals of their length and last id."""
    links = v.chain(spark, d)
    ends = links.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", "turn").alias("tail"))
    c = F.col("conv_id")
    seals = ends.where("conv_id % 9 <> 0").select("conv_id", (F.col("n") + F.when(c % 5 == 0, 1).otherwise(0)).alias("sealed_links"), F.when(c % 7 == 0, "x").otherwise(F.col("tail")).alias("sealed_tail"))
    return audit.seal_violations(links, seals, "conv_id", "turn").select("conv_id", joined())
