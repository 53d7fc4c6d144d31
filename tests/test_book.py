"""Book operators against a plain sequential model, batch and stream."""

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bookreplay.operators import book, forecast, lateness
from bookreplay.streaming import book_stream

T0 = datetime(2024, 1, 1)
ARRIVAL = "run long, seq long, kind string, observation_id string, condition_id long, token_id long, payload_type string, event_time timestamp, received_time timestamp, reason string"
OPS = "run long, seq long, condition_id long, token_id long, kind string, side string, price decimal(12,10), size decimal(28,10)"


def history(seed, n=400):
    rng = random.Random(seed)
    arrivals, ops = [], []
    for seq in range(1, n):
        token = rng.randrange(3)
        kind = rng.choice(["snapshot", "delta", "delta", "delta", "delta", "trade", "other"])
        obs = f"o{rng.randrange(seq) if rng.random() < 0.2 else seq}-{token}"  # an identity includes its token
        at = None if rng.random() < 0.05 else T0 + timedelta(seconds=seq - rng.choice([0, 0, 0, 30]))
        scope = None if rng.random() < 0.05 else token
        rejected = rng.random() < 0.05
        arrivals.append((1, seq, "rejection" if rejected else "delivery", obs, token // 2, scope, kind, at, T0 + timedelta(seconds=seq), "malformed_payload" if rejected else None))
        if kind in ("snapshot", "delta") and scope is not None and not rejected:
            prices = rng.sample(range(1, 12), 3 if kind == "snapshot" else rng.choice([1, 2]))
            for side, base in (("bid", 0), ("ask", 12)):
                for p in prices[: rng.randrange(len(prices) + 1)]:
                    gone = kind == "delta" and rng.random() < 0.4
                    ops.append((1, seq, token // 2, token, "snapshot" if kind == "snapshot" else "remove" if gone else "set", side, Decimal(p + base) / 100, Decimal(0 if gone else rng.randrange(1, 4))))
    return arrivals, ops


def fold(arrivals, ops):
    """One arrival after another."""
    by = {}
    for o in ops:
        by.setdefault(o[1], []).append(o)
    books, applied, out, high, last, absent, regress = {}, set(), {}, None, {}, 0, 0
    for _, seq, kind, obs, _, token, payload, at, *_ in arrivals:
        late = "undatable" if at is None else "late" if high is not None and at < high else "on_time"
        if kind == "rejection":
            out[seq] = ("rejected", late, None)
            continue
        if payload == "other":
            out[seq] = ("unhandled_payload", late, None)
            continue
        if token is None:
            out[seq] = ("unscoped", late, None)
            continue
        if obs in applied:
            out[seq] = ("skipped_duplicate", late, None)
            continue
        applied.add(obs)
        if at is not None:
            high = at if high is None else max(high, at)
        name = {"snapshot": "applied_snapshot", "delta": "applied_delta", "trade": "applied_auxiliary"}[payload]
        top = None
        if payload != "trade":
            if payload == "snapshot":
                books[token] = {}
            if token in books:
                for *_, op, side, price, size in by.get(seq, []):
                    if op == "remove":
                        absent += books[token].pop((side, price), None) is None
                    else:
                        books[token][side, price] = size
                if at is not None:
                    regress += token in last and at < last[token]
                    last[token] = at
                bids = [p for s, p in books[token] if s == "bid"]
                asks = [p for s, p in books[token] if s == "ask"]
                top = (max(bids, default=None), min(asks, default=None), len(bids), len(asks))
        out[seq] = (name, late, top)
    return out, books, absent, regress


@pytest.fixture(scope="module", params=[1, 2])
def replay(spark, request):
    arrivals, ops = history(request.param)
    a, o = spark.createDataFrame(arrivals, ARRIVAL), spark.createDataFrame(ops, OPS)
    outcomes = book.dispatched(a)
    inputs = book.segmented(outcomes)
    return fold(arrivals, ops), a, o, outcomes, inputs, book.level_writes(inputs, o)


def test_outcomes_and_lateness(replay):
    (want, *_), a, _, outcomes, *_ = replay
    assert {r.seq: (r.outcome, r.lateness) for r in lateness.with_lateness(outcomes).collect()} == {s: w[:2] for s, w in want.items()}


def test_top_of_book_after_every_input(replay):
    (want, *_), _, _, _, inputs, writes = replay
    got = {r.seq: (r.best_bid, r.best_ask, r.bid_levels, r.ask_levels) for r in book.top_of_book(inputs, writes).collect()}
    assert got == {s: w[2] for s, w in want.items() if w[2]}


def test_spans_cover_an_interval_once(spark):
    rng = random.Random(3)
    pairs = [(a, a + rng.choice([0, 1, 7, 8, 9, 63, 64, 500, 5000])) for a in (0, 1, 5, 8, 64, 100, 511)]
    for r in spark.createDataFrame(pairs, "lo long, hi long").withColumn("s", book.spans(F.col("lo"), F.col("hi"))).collect():
        covered = [x for k, p in r.s for x in range(p * 8**k, (p + 1) * 8**k)]
        assert sorted(covered) == list(range(r.lo, r.hi)) and len(r.s) <= 60


def test_final_levels_and_anomalies(replay):
    (_, books, absent, regress), _, _, outcomes, inputs, writes = replay
    got = {(r.token_id, r.side, r.price): r.size for r in book.final_levels(writes).collect()}
    assert got == {(t, *k): v for t, b in books.items() for k, v in b.items()}
    found = {r.anomaly: r.n for r in book.anomalies(inputs, writes, outcomes).groupBy("anomaly").agg(F.sum("n").alias("n")).collect()}
    assert found.get("removal_of_absent_level", 0) == absent and found.get("event_time_regression", 0) == regress


def test_digest_does_not_depend_on_the_path(spark, replay):
    *_, writes = replay
    levels = book.final_levels(writes)
    assert sorted(book.book_digests(levels).collect()) == sorted(book.book_digests(levels.repartition(3)).collect())
    assert book.state_hashes(book.book_digests(levels)).first().books == levels.select("token_id").distinct().count()


def test_merge_of_last_writes_gives_the_same_books(spark, replay):
    _, _, o, _, inputs, writes = replay
    accepted = o.join(inputs.where("segment > 0").select("run", "seq"), ["run", "seq"], "left_semi")
    known = accepted.limit(0).withColumn("reset_seq", F.lit(None).cast("long"))
    resets = inputs.where("outcome = 'applied_snapshot'")
    for lo, hi in ((0, 90), (90, 250), (250, 10**6)):
        part = f"seq >= {lo} and seq < {hi}"
        known = book_stream.merge_levels(known, accepted.where(part), resets.where(part))
        known = spark.createDataFrame(known.collect(), known.schema)
    again = known.where("size > 0").select("run", "condition_id", "token_id", "side", "price", "size")
    assert book.level_differences(book.final_levels(writes), again).count() == 0


def test_stream_gives_the_batch_tops(spark, replay, tmp_path):
    (want, *_), a, o, *_ = replay
    rows = book_stream.book_inputs(a, o)
    for i, (lo, hi) in enumerate(((0, 200), (200, 10**6))):
        rows.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = book_stream.replay_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.seq: r for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.status in ("applied_snapshot", "applied_delta")}
    tops = {s: w[2] for s, w in want.items() if w[2]}
    assert set(got) == set(tops)
    for s, (bid, ask, bids, asks) in tops.items():
        assert (got[s].bid_levels, got[s].ask_levels) == (bids, asks) and got[s].best_bid == (float(bid) if bid is not None else None)


def test_merge_keeps_an_empty_snapshot(spark):
    D = Decimal
    ops = spark.createDataFrame([(1, 1, 0, 1, "snapshot", "bid", D("0.1"), D(1)), (1, 3, 0, 1, "set", "ask", D("0.2"), D(2))], OPS)
    resets = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 0, 1)], "run long, seq long, condition_id long, token_id long")
    known = ops.limit(0).withColumn("reset_seq", F.lit(None).cast("long"))
    for part in ("seq = 1", "seq = 2", "seq = 3"):
        known = book_stream.merge_levels(known, ops.where(part), resets.where(part))
        known = spark.createDataFrame(known.collect(), known.schema)
    assert [(r.side, r.price, r.size) for r in known.where("size > 0").collect()] == [("ask", D("0.2"), D(2))]


def test_running_values_by_blocks(spark):
    from bookreplay.functions.windows import running

    rng = random.Random(8)
    data = [(r, s, rng.randrange(100) if rng.random() < 0.7 else None) for r in (1, 2) for s in range(1, 60) if rng.random() < 0.8]
    df = spark.createDataFrame(data, "run long, seq long, x long")
    for inclusive in (False, True):
        got = running(df, {"hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "all": ("sum", F.col("x"))}, inclusive=inclusive, block=7).collect()
        assert len(got) == len(data)
        for r in got:
            own = [x for a, s, x in data if a == r.run and (s <= r.seq if inclusive else s < r.seq) and x is not None]
            assert (r.hi, r.lo, r.all) == ((max(own), min(own), sum(own)) if own else (None, None, None))


def test_snapshots_carry_trades_and_refused_ones_leave_the_book(spark):
    """A snapshot's own trade is a change of state; a payload of another token counts as a mismatch."""
    D = Decimal
    rows = [(1, s, "delivery", f"o{s}", 0, 1, kind, T0 + timedelta(seconds=s), T0, None) for s, kind in ((1, "trade"), (2, "snapshot"), (3, "snapshot"), (4, "snapshot"), (5, "delta"))]
    a = spark.createDataFrame(rows, ARRIVAL).withColumn("payload_token_id", F.when(F.col("seq") == 4, 9).otherwise(1))
    ops = spark.createDataFrame([(1, s, 0, 1, "snapshot", "bid", D("0.1"), D(1)) for s in (2, 3, 4)] + [(1, 5, 0, 1, "set", "bid", D("0.1"), D(1))], OPS)
    outcomes = book.dispatched(a)
    inputs = book.segmented(outcomes)
    writes = book.level_writes(inputs, ops)
    trades = book.applied_trades(outcomes, spark.createDataFrame([(1, 1, 0, 1, D("0.3")), (1, 3, 0, 1, D("0.4")), (1, 4, 0, 1, D("0.5"))], "run long, seq long, condition_id long, token_id long, price decimal(12,10)"))
    changes = forecast.information_changes(outcomes, inputs, writes, book.snapshot_divergence(inputs, writes), trades)
    assert {r.seq: r.changed for r in changes.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}
    states = {r.seq: (r.last_trade, r.bid_levels, r.book_event_time) for r in forecast.states(changes, book.with_midpoint(book.top_of_book(inputs, writes)), trades).collect()}
    assert states == {s: (D(p), 1, T0 + timedelta(seconds=b)) for s, p, b in ((2, "0.3", 2), (3, "0.4", 3), (4, "0.5", 3), (5, "0.5", 5))}
    counts = {r.anomaly: r["count"] for r in book.anomaly_counts(book.anomalies(inputs, writes, outcomes), outcomes).collect()}
    assert counts["scope_mismatch"] == 1 and sum(counts.values()) == 1
    assert [tuple(r)[3:] for r in book.applied_counts(inputs, outcomes).collect()] == [(2, 1, 1)]


def test_scope_mismatch_is_refused(spark):
    a = spark.createDataFrame([(1, 1, "delivery", "a", 0, 1, "snapshot", T0, T0, None), (1, 2, "delivery", "b", 0, 1, "snapshot", T0, T0, None)], ARRIVAL).withColumn("payload_token_id", F.when(F.col("seq") == 2, 9).otherwise(1))
    outcomes = book.dispatched(a)
    assert [r.seq for r in book.segmented(outcomes).collect()] == [1] and [r.seq for r in book.scope_mismatches(outcomes).collect()] == [2]


def test_watermark_equality_is_on_time(spark):
    rows = [(1, i, "delivery", f"o{i}", 0, 1, "delta", T0 + timedelta(seconds=s), T0, None) for i, s in ((1, 10), (2, 10), (3, 9), (4, 4))]
    outcomes = book.dispatched(spark.createDataFrame(rows, ARRIVAL))
    assert [r.lateness for r in lateness.with_lateness(outcomes).orderBy("seq").collect()] == ["on_time", "on_time", "late", "late"]
    assert [r.lateness for r in lateness.with_lateness(outcomes, 5).orderBy("seq").collect()] == ["on_time", "on_time", "on_time", "late"]


def test_forecast_rules(spark):
    schema = "run long, seq long, condition_id long, token_id long, changed boolean, midpoint decimal(13,11), spread decimal(13,11), last_trade decimal(12,10), received_time timestamp"
    D = Decimal
    rows = [(1, 1, 0, 1, True, D("0.5"), D("0.10"), None, T0), (1, 2, 0, 1, False, D("0.9"), D("0.02"), None, T0), (1, 3, 0, 1, True, D("0.6"), D("0.11"), D("0.3"), T0), (1, 4, 0, 1, True, None, None, D("0.3"), T0)]
    got = {(r.seq, r.method): (r.score, r.abstention_reason) for r in forecast.forecasts(forecast.emitted(spark.createDataFrame(rows, schema))).collect()}
    assert len(got) == 12
    assert got[1, "persistence"] == (None, "no_prior_forecast") and got[3, "persistence"][0] == D("0.5") and got[4, "persistence"][0] == D("0.6")
    assert got[1, "displayed_price"][0] == D("0.5") and got[3, "displayed_price"][0] == D("0.3") and got[4, "displayed_price"] == (None, "no_displayed_price")
    assert got[1, "last_trade"] == (None, "no_last_trade") and got[4, "midpoint"] == (None, "no_two_sided_book")


def test_no_window_by_token_alone(spark, replay):
    """A token's rows are many tasks: windows go by its blocks or segments, but for those over blocks' sums."""
    *_, a, o, outcomes, inputs, writes = replay
    states = forecast.states(
        forecast.information_changes(outcomes, inputs, writes, book.snapshot_divergence(inputs, writes), spark.createDataFrame([], "run long, seq long, condition_id long, token_id long, price decimal(12,10)")),
        book.with_midpoint(book.top_of_book(inputs, writes)), spark.createDataFrame([], "run long, seq long, condition_id long, token_id long, price decimal(12,10)"))
    closes = a.select(*book.KEY).distinct().withColumn("close_at", F.lit(T0 + timedelta(seconds=300)))
    for df in (inputs, book.event_time_regressions(inputs), forecast.emitted(states), forecast.frozen(states, closes)):
        for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
            if " Window [" in line or line.startswith("Window ["):
                by = {re.sub("#.*", "", c.strip()) for c in re.findall(r"\[([^\[\]]*)\]", line)[1].split(",")}
                assert "_p_" in line or not by <= set(book.KEY), line
