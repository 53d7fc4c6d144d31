"""Selection, lifecycle, ledger, scoring and audit operators on small tables."""

import hashlib
import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from bookreplay.functions.columns import digest
from bookreplay.operators import audit, evaluate, ledger, lifecycle, scoring, selection
from bookreplay.sources import landing

T0 = datetime(2024, 1, 1)
H = timedelta(hours=1)


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(d, *cols):
    return sorted(tuple(r) for r in d.select(*cols).collect())


def test_block_selection_is_the_greedy_fold(spark):
    rng = random.Random(1)
    data = [(g, Decimal(rng.randrange(50)), str(i), None if rng.random() < 0.8 else "closed", str(rng.randrange(12)), f"s{rng.randrange(3)}") for g in ("a", "b", "c") for i in range(40)]
    c = df(spark, "block string, liquidity decimal(28,10), market_key string, exclusion string, event_key string, stratum_id string", *data)
    strata = df(spark, "stratum_id string, max_targets int", ("s0", 2), ("s1", 9), ("s2", 9))

    def fold(group, quota, limits):
        seen, n, per, out = set(), 0, {}, {}
        for g, _, m, ex, e, s in sorted((x for x in data if x[0] == group), key=lambda x: (-x[1], len(x[2]), x[2])):
            if ex:
                out[m] = ex
            elif n >= quota:
                out[m] = "quota_full"
            elif limits and per.get(s, 0) >= limits[s]:
                out[m] = "stratum_quota_full"
            elif e in seen:
                out[m] = "identity_conflict"
            else:
                out[m], n = "selected", n + 1
                seen.add(e)
                per[s] = per.get(s, 0) + 1
        return out, n

    for quota, whole, limits in ((6, True, None), (8, False, {"s0": 2, "s1": 9, "s2": 9}), (13, True, None)):
        got = selection.select_blocks(c, "block", quota, ["event_key"], whole, strata if limits else None, batch=None if whole else 3)
        for g in ("a", "b", "c"):
            want, n = fold(g, quota, limits)
            if whole and n < quota:
                want = {m: "block_shortfall" if w == "selected" else w for m, w in want.items()}
            assert {r.market_key: r.decision for r in got.where(F.col("block") == g).collect()} == want


def test_selection_helpers(spark):
    strata = df(spark, "stratum_id string, category string, min_liquidity double, max_liquidity double, min_spread double, max_spread double, min_horizon_s long, max_horizon_s long",
                ("a", "x", 0.0, 10.0, 0.0, None, 0, None), ("b", "x", 9.0, None, 0.0, 1.0, 0, 5), ("c", "x", 10.0, None, 1.0, None, 0, None), ("d", "y", 0.0, None, 0.0, None, 0, None))
    assert rows(selection.overlapping_strata(strata), "left_id", "right_id") == [("a", "b")]
    pages = df(spark, "page string, market_id string, event_id string, condition_id string", ("p", "007", "1", "0xA"), ("p", "7", "2", "0xB"), ("q", "7", "3", "0xC"))
    assert rows(selection.duplicate_identities(pages, "page"), "page", "market_key", "times") == [("p", "7", 2)]
    protocols = df(spark, "experiment_id string, budget int", ("e", 10))
    blocks = df(spark, "experiment_id string, block_no int, starts_at timestamp, ends_at timestamp, max_targets int", ("e", 1, T0, T0 + H, 5), ("e", 2, T0 + 2 * H, T0 + 3 * H, 5))
    caps = df(spark, "experiment_id string, max_targets int", ("e", 9))
    assert rows(selection.budget_violations(protocols, blocks, caps), "violation") == [("blocks_apart",), ("stratum_caps",)]
    cand = df(spark, "k string", ("1",), ("2",))
    ev = df(spark, "k string, observed_at timestamp", ("1", T0), ("1", T0 + H), ("3", T0))
    assert rows(selection.evidence_violations(cand, ev, "k", F.lit(T0)), "k", "violation") == [("1", "duplicate"), ("1", "late"), ("2", "missing"), ("3", "unmatched")]
    assert selection.selection_differences(cand, cand).count() == 0


POLL = "target_id string, ordinal long, previous_id string, poll_id string, retrieved_at timestamp, source_time timestamp, finality string, resolution_id string, raw_sha256 string"


def polls(spark):
    p = lambda t, o, prev, i, h, f: (t, o, prev, i, T0 + h * H, T0, f, "r" if f == "final" else None, f"sha{i}")
    return df(spark, POLL, p("a", 1, None, "1", 0, "open"), p("a", 2, "1", "2", 5, "final"), p("a", 3, "2", "3", 6, "open"), p("b", 1, None, "4", 3, "open"), p("b", 3, "9", "5", 2, "open"))


def test_lifecycle(spark):
    p = polls(spark)
    got = lifecycle.continuity(p.where("target_id = 'a'"), F.lit(T0 + 9 * H), 3 * 3600).first()
    assert (got.max_gap_us, got.final_gap_us, got.continuity) == (5 * 3600 * 10**6, 3 * 3600 * 10**6, "complete")
    assert rows(lifecycle.chain_violations(p), "poll_id", "violations") == [("3", ["after_final"]), ("5", ["ordinal", "predecessor", "time_order"])]
    assert rows(lifecycle.cutoffs(p), "target_id", "cutoff_at") == [("a", T0 + 5 * H)] and lifecycle.cutoffs(p, "source").first().cutoff_at == T0
    assert {r.target_id: r.next_due for r in lifecycle.progress(p, 3600).collect()} == {"a": None, "b": T0 + 3 * H}
    frozen = df(spark, "target_id string, forecast_id string, token_id string, score double", ("a", "f1", "t", 0.4), ("a", "f2", "t", None), ("b", "f3", "t", 0.1), ("c", "f4", "t", 0.2))
    late = df(spark, "target_id string, status string, winning_token_id string", ("a", "final", "t"), ("c", "final", None))
    scored = lifecycle.late_scores(frozen, late)
    assert rows(scored, "forecast_id", "state") == [("f1", "scored"), ("f2", "abstained"), ("f3", "pending"), ("f4", "final_unscorable")]
    assert all(not r.violations for r in lifecycle.late_partition(scored).collect())
    adm = df(spark, "cutoff_at timestamp, deadline timestamp, snapshot_persisted_at timestamp, winning_token_id string, token_ids array<string>", (T0 + 2 * H, T0 + H, T0, "t", ["t"]), (T0, T0, None, "x", ["t"]))
    assert [r.refusals for r in lifecycle.admissibility(adm).collect()] == [[], ["cutoff_before_deadline", "snapshot_not_durable", "foreign_winner"]]
    gaps = df(spark, "target_id string, ordinal long, started_at timestamp, ended_at timestamp, reason string, predecessor_id string", *[("a", 1, T0, T0, "x", "1")] * 2, ("a", 2, T0, T0, "x", "nope"))
    assert rows(lifecycle.merged_gaps(gaps, p), "ordinal", "valid") == [(1, True), (2, False)]
    samples = df(spark, "s string, at timestamp, rss long, state string", ("a", T0 + H, 5, "running"), ("a", T0 + 2 * H, 9, "completed"))
    bounds = df(spark, "s string, started_at timestamp, ended_at timestamp", ("a", T0, T0 + 5 * H), ("b", T0, T0 + H))
    assert {r.s: r.failures for r in lifecycle.cadence(samples, "s", "at", bounds, 2 * 3600, rss=8).collect()} == {"a": ["gap", "rss_bound"], "b": ["no_samples", "not_terminal"]}
    targets = df(spark, "target_id string, experiment_id string", ("a", "e"), ("b", "e"))
    out = lifecycle.terminal_report(targets, df(spark, "target_id string, terminal_state string", ("a", "done")), lifecycle.continuity(p, F.lit(T0 + 9 * H), 3600), lifecycle.cutoffs(p)).first()
    assert (out.targets, out.terminal, out.cutoffs, out.accounting) == (2, 1, 1, "open")


def test_ledger(spark):
    d = df(spark, "run string, seq long, observation_id string, received_time timestamp", ("r", 1, "a", T0), ("r", 2, "a", T0 + H), ("s", 1, "b", T0), ("s", 2, "c", T0))
    assert rows(ledger.with_disposition(d, d.where("observation_id = 'c'").select("observation_id")), "run", "seq", "disposition") == [("r", 1, "accepted_new"), ("r", 2, "duplicate"), ("s", 1, "accepted_new"), ("s", 2, "duplicate")]
    rej = df(spark, "run string, seq long, reason string", ("r", 2, "x"))
    assert ledger.arrivals(d, rej).count() == 5 and rows(ledger.sequence_violations(d, rej), "run", "seq", "uses") == [("r", 2, 2)]
    assert ledger.resolved_deliveries(d, d.select("observation_id").distinct().withColumn("payload", F.lit(1))).where("payload is null").count() == 0
    raw = df(spark, "raw string, source string, endpoint string, retrieved_at timestamp, raw_sha256 string", ("x", "late", "e", T0 + H, "k"), ("x", "first", "e", T0, "k"), ("y", "s", "e", T0, "k"))
    assert rows(ledger.archived(raw), "raw", "source", "copies") == [("x", "first", 2), ("y", "s", 1)] and ledger.archive_conflicts(raw).first().contents == 2
    obs = df(spark, "source string, source_event_type string, market_id string, condition_id string, token_id string, payload_schema_version string, event_time_status string, event_time timestamp, event_time_raw string, source_sequence string, source_hash string, payload string", ("s", "t", None, "c", "1", "v", "missing", None, None, None, None, "{}"), ("s", "t", None, "c", "1", "v", "unparseable", None, "missing", None, None, "{}"), ("s", "t", None, "c", "1", "v", "present", T0, "5", None, None, "{}"))
    held = obs.withColumn("observation_id", ledger.observation_id())
    assert ledger.identity_disagreements(held).count() == 0 and ledger.identity_disagreements(held.withColumn("payload", F.lit("[]"))).count() == 3
    assert held.select("observation_id").distinct().count() == 3 and ledger.identity_disagreements(held.withColumn("observation_id", F.lit(None).cast("string"))).count() == 3
    assert ledger.ledger_differences(d, d.withColumn("received_time", F.lit(T0)), ["received_time"]).count() == 0


def test_scoring_rules(spark):
    s = df(spark, "score decimal(13,11), outcome int", (Decimal("0.25"), 1), (Decimal("0"), 1), (Decimal("1"), 1))
    got = scoring.with_scores(s).collect()
    assert [str(r.brier)[:6] for r in got] == ["0.5625", "1.0000", "0E-22"[:6]] or got[0].brier == Decimal("0.5625")
    assert [r.clipped for r in got] == [False, True, True] and abs(got[1].log_loss - 13.815510557964274) < 1e-9
    assert scoring.score_disagreements(scoring.with_scores(s)).count() == 0 and scoring.score_disagreements(scoring.with_scores(s).withColumn("clipped", F.lit(True))).count() == 1
    runs = df(spark, "completion_status string, resolved_at timestamp, contract_id string, sequence_gaps int, received_time_regressions int, unhandled_payload int", (None, None, None, 1, 1, 1), ("completed", T0, "c", 0, 0, 0))
    assert [len(r.blockers) for r in scoring.headline_blockers(runs).collect()] == [6, 0]
    f = df(spark, "forecast_id string, abstained boolean, blockers array<string>, received_time timestamp, resolved_at timestamp", ("1", True, ["capture_incomplete"], T0, T0), ("2", False, ["replay_sequence_gaps", "resolution_time_unknown"], T0, None), ("3", False, ["replay_sequence_gaps"], T0, T0), ("4", False, [], T0, T0), ("5", False, [], T0, T0 + H))
    got = scoring.with_exclusion(f)
    assert rows(got.fillna("-", ["exclusion"]), "forecast_id", "exclusion") == [("1", "abstained"), ("2", "resolution_time_unknown"), ("3", "replay_integrity"), ("4", "post_resolution"), ("5", "-")]
    assert rows(scoring.accounting_violations(f, f.where("forecast_id in ('1','2')"), f.where("forecast_id in ('2','3','4')")), "forecast_id", "violation") == [("2", "more_than_once"), ("2", "scored_and_excluded"), ("5", "unaccounted")]


def test_targets(spark):
    targets = df(spark, "target_id string, experiment_id string, category string, run string, condition_id string", ("a", "e", "x", "r", "c"), ("b", "e", "y", "s", "d"))
    contributions = df(spark, "target_id string, method string, outcome int, brier double, log_loss double, absolute_error double", ("a", "m", 1, 0.1, 0.2, 0.3))
    causes = df(spark, "target_id string, reason string", ("b", "unresolved"), ("b", "no_forecast"))
    gone = evaluate.target_exclusions(targets, contributions, causes)
    assert rows(gone, "target_id", "reason") == [("b", "no_forecast")] and evaluate.target_accounting(targets, contributions, gone).count() == 0
    assert evaluate.experiment_report(contributions, targets, 1).first().verdict == "insufficient_targets"
    rej = df(spark, "run string, seq long, reason string", ("r", 5, "unmodelled"), ("r", 3, "unmodelled"), ("r", 1, "other"))
    assert rows(evaluate.rejection_proofs(rej, targets, F.col("reason") == "unmodelled"), "target_id", "seq") == [("a", 3)]
    res = df(spark, "condition_id string, resolved_at timestamp", ("c", None), ("d", T0))
    assert rows(evaluate.with_cutoffs(res, df(spark, "target_id string, cutoff_at timestamp", ("a", T0)), targets).where("resolved_at is not null"), "condition_id") == [("c",)]
    o = df(spark, "frames int, health_frames int, accepted int, duplicate int, rejected int, not_applicable int, tokens int, stop_reason string, boundary_frame int", (2, 3, 1, 0, 0, 0, 0, "bytes", None))
    assert evaluate.outcome_violations(o).first().violations == ["frames", "too_few_events", "tokens", "cap_without_boundary"]


def test_audits(spark, tmp_path):
    links = df(spark, "run string, n int, body string, at timestamp", ("r", 1, "x", T0), ("r", 2, "y", T0 + H))
    one = links.where("n = 1").withColumn("previous_id", F.lit(None).cast("string")).withColumn("id", digest(F.col("body"), F.col("previous_id")))
    first = one.first().id
    two = links.where("n = 2").withColumn("previous_id", F.lit(first)).withColumn("id", digest(F.col("body"), F.col("previous_id")))
    chain = one.unionByName(two)
    assert audit.chain_violations(chain, "run", "n", ["body"], at="at").count() == 0
    bad = chain.withColumn("body", F.when(F.col("n") == 2, "z").otherwise(F.col("body"))).withColumn("at", F.lit(T0) - F.make_interval(hours=F.col("n")))
    assert rows(audit.chain_violations(bad, "run", "n", ["body"], at="at"), "n", "violations") == [(2, ["id", "time_order"])]
    seals = df(spark, "run string, sealed_links long, sealed_tail string", ("r", 3, "t"), ("q", 0, None))
    assert rows(audit.seal_violations(chain, seals, "run", "n"), "run", "violations") == [("r", ["links", "tail"])]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    receipts = df(spark, "receipt_id string, artifact_id string, artifact_sha256 string, byte_length long", ("1", "a", sha("x"), 1), ("2", "a", sha("y"), 2), ("3", "b", "", 0))
    assert rows(audit.receipt_violations(receipts, df(spark, "artifact_id string, raw string", ("a", "x"))), "receipt_id", "violations") == [("2", ["hash", "length"]), ("3", ["missing"])]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/one").write_text("one")
    (tmp_path / "f/two").write_text("two")
    files = landing.files(spark, f"{tmp_path}/f").withColumn("path", F.element_at(F.split("path", "/"), -1))
    manifest = df(spark, "path string, sha256 string, size long", ("one", sha("one"), 3), ("gone", sha("g"), 1))
    assert rows(audit.manifest_violations(manifest, files), "path", "violation") == [("gone", "missing"), ("two", "unlisted")]
    p = polls(spark)
    evidence = df(spark, "poll_id string, retrieved_at timestamp, raw_sha256 string", ("1", T0, "sha1"), ("2", T0, "other"), ("8", T0, "x"), *[("3", T0 + 6 * H, "sha3")] * 2)
    assert rows(audit.retrieval_violations(p.where("target_id = 'a'"), evidence), "poll_id", "violations") == [("2", ["time", "hash"]), ("3", ["more_than_one"]), ("8", ["unknown_poll"])]
    assert audit.missing_archives(p, df(spark, "raw_sha256 string", ("sha1",))).count() == 4
    a = df(spark, "run string, seq long, x string", *[("r", i, str(i)) for i in range(25)])
    assert rows(audit.trajectory_digests(a, ["seq", "x"], 10), "trajectory_sha256") == rows(audit.trajectory_digests(a.repartition(3), ["seq", "x"], 10), "trajectory_sha256")
    snap = df(spark, "snapshot_id string, method string, state_key string, as_of timestamp, admitted_at timestamp, freeze_at timestamp, blind timestamp", ("s", "m", "k", T0, T0, T0, T0 + H), ("s", "n", "k2", T0 + H, T0, T0, T0 + H), ("t", "m", "k", T0, T0, T0, T0 + H), ("t", "n", "k", T0, T0, T0, T0 + H))
    assert rows(audit.snapshot_violations(snap, ["m", "n"], F.col("blind")), "snapshot_id", "violations") == [("s", ["state", "after_freeze"])]
    caps = df(spark, "seconds int, frames int, bytes int, max_seconds int, max_frames int, max_bytes int, stop_reason string, closed_at timestamp, freeze_at timestamp", (5, 3, 9, 4, 3, 9, "frames", T0, T0 + H), (1, 1, 1, 9, 9, 9, "bytes", T0, T0))
    assert [r.violations for r in audit.cap_violations(caps).collect()] == [["duration_cap", "closed_before_freeze"], ["stopped_early_by_bytes"]]
    frames = df(spark, "run string, frame_no long, received_time timestamp, byte_length long", ("r", 1, T0, 5), ("r", 3, T0 - H, 5))
    assert audit.inventory_violations(frames, df(spark, "run string, frames long, bytes long", ("r", 2, 11))).first().violations == ["frame_numbers", "time_order", "bytes"]
    targets = df(spark, "target_id string, experiment_id string, run string, runtime_s int, starts_at timestamp, ends_at timestamp", ("a", "e", "r", 9, T0, T0 + H), ("b", "e", "r", 1, T0 + H, T0 + 9 * H))
    protocols = df(spark, "experiment_id string, max_runtime_s int, window_start timestamp, window_end timestamp", ("e", 5, T0, T0 + 2 * H))
    assert rows(audit.protocol_violations(targets, protocols), "target_id", "violations") == [("a", ["runtime", "shared_run"]), ("b", ["after_window", "shared_run"])]
    wide = df(spark, "target_id string, protocol_at timestamp, market_at timestamp, contract_at timestamp, target_at timestamp, first_forecast_at timestamp, last_forecast_at timestamp, cutoff_at timestamp, window_start timestamp, window_end timestamp, condition_id string, market_condition_id string",
              ("a", T0 + H, T0, T0 + H, T0 + H, T0 + H, T0 + 2 * H, T0 + 2 * H, T0, T0 + 3 * H, "c", "c"))
    assert audit.chronology_violations(wide, p).first().violations == ["protocol_at_after_market_at", "forecast_at_or_after_cutoff", "polls"]
    counts = df(spark, "run string, accepted long, rejected long", ("r", 5, 1))
    health = audit.run_health(counts, df(spark, "run string, accepted long, rejected long", ("r", 5, 2)), df(spark, "run string, files long", ("r", 1)), df(spark, "run string, first_hash string, second_hash string", ("r", "h", "h"))).first()
    assert health.failures == ["rejected"] and not health.healthy
    camp = audit.campaign_accounting(df(spark, "scenario string, max_seconds int", ("a", 5), ("b", 5)), df(spark, "scenario string, seconds int, status string", ("a", 9, "passed")))
    assert rows(camp, "scenario", "violations") == [("a", ["bounds"]), ("b", ["result"])]


def test_sources(spark, tmp_path):
    f = df(spark, "run string, frame_no long, received_time timestamp, raw string, source string, endpoint string", ("r", 1, T0, "{}", "s", "e"), ("q", 1, T0, "é", "s", "e"))
    f.write.json(f"{tmp_path}/landing")
    back = landing.frames(spark, f"{tmp_path}/landing")
    assert {r.raw: r.byte_length for r in back.collect()} == {"{}": 2, "é": 2}
    landing.append(back.withColumnRenamed("frame_no", "seq"), f"{tmp_path}/ledger")
    assert [r.raw for r in landing.scan_run(spark, f"{tmp_path}/ledger", "q").collect()] == ["é"]
    assert landing.bodies(spark, f"{tmp_path}/landing").where("raw like '%run%'").count() >= 1
    landing.write_report(back, f"{tmp_path}/report")
    assert landing.frame_stream(spark, f"{tmp_path}/landing").isStreaming


def test_a_rejection_proof_is_bound_to_bytes_and_run(spark):
    raw = '{"asset_id":"7","event_type":"last_trade_price","market":"3"}'
    base = spark.createDataFrame([(i, "r", i, raw, "unknown_event_type", 3, 7) for i in range(3)], "target_id int, run string, seq int, raw string, reason string, condition_id int, token_id int")
    base = base.withColumn("raw_sha256", F.sha2("raw", 256)).withColumn("byte_length", F.octet_length("raw")).withColumn("detail", F.lit(None).cast("string")).withColumn("scope", F.lit("7"))
    for c in ("received_time", "retrieved_at", "rejected_at"):
        base = base.withColumn(c, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    base = base.withColumn("raw_location", audit.archive_location(F.col("raw_sha256"))).withColumn("rejection_id", ledger.rejection_id())
    proofs = base.drop("raw").withColumn("proof_id", audit.proof_id())
    archive = base.select("raw_sha256", "raw").distinct()
    manifest = spark.createDataFrame([("r", "capture", "c0ffee", True, True, ["rejection"])], "run string, mode string, code_revision string, clean boolean, raw_archive boolean, schemas array<string>").withColumn("created_at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    found = lambda p=proofs, a=archive, m=manifest, modelled="trade", kind="last_trade_price": {tuple(r.violations) for r in audit.proof_violations(p, a, m, kind, "rejection", modelled).collect()}
    assert found() == set()
    assert found(p=proofs.withColumn("detail", F.lit("x"))) == {("identity",)} and found(p=proofs.withColumn("seq", F.lit(9))) == {("proof",)}
    assert found(a=archive.withColumn("raw", F.lit(raw + " "))) == {("raw",)} and found(a=archive.limit(0)) == {("raw_missing",)} and found(a=archive.withColumn("raw", F.lit("{"))) == {("raw", "reason", "scope")}
    assert found(m=manifest.limit(0)) == {("manifest",)} and found(m=manifest.withColumn("code_revision", F.lit(None).cast("string"))) == {("revision",)}
    assert found(modelled="rejection") == {("schemas",)} and found(kind="book") == {("reason",)} and found(p=proofs.withColumn("token_id", F.lit(8))) == {("scope",)}
    assert found(p=proofs.withColumn("received_time", F.lit(None).cast("timestamp"))) == {("chronology",)} and found(p=proofs.limit(0)) == set()
