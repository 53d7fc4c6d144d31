"""Streaming forms against one pass over all rows, and what batches played twice leave."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from bookreplay.operators import forecast, lateness, ledger, normalise
from bookreplay.plans.streams import played
from bookreplay.sources import landing
from bookreplay.streaming import book_stream, capture_stream
from bookreplay.streaming.chunks import Chunks
from tests.test_book import ARRIVAL, OPS, fold, history

T0 = datetime(2024, 1, 1)
S = timedelta(seconds=1)


def test_marks_of_batch_and_stream_agree(spark):
    rng, rows = random.Random(3), []
    for run in (1, 2):
        for i, seq in enumerate(sorted(rng.sample(range(1, 200), 90))):
            at = None if rng.random() < 0.1 else T0 + (i + rng.randrange(-8, 3)) * S
            rows.append((run, seq, "applied_delta" if rng.random() < 0.8 else "unscoped", at, T0 + (i + rng.choice([0, 0, 0, -2])) * S))
    o = spark.createDataFrame(rows, "run long, seq long, outcome string, event_time timestamp, received_time timestamp").withColumn("applied", F.col("outcome").startswith("applied"))
    got = {(int(r.run), r.seq): r for r in played(spark, o, lambda s: capture_stream.marked(s, 2), "seq").collect()}
    want = lateness.with_lateness(o, 2).collect()
    assert len(got) == len(want) == 180
    assert all(got[r.run, r.seq].lateness == r.lateness for r in want) and len({r.lateness for r in want}) == 3
    gaps = {r.run: r.sequence_gaps for r in lateness.sequence_gaps(o).collect()}
    back = {r.run: r.received_time_regressions for r in lateness.receive_regressions(o).collect()}
    for run in (1, 2):
        own = [r for k, r in got.items() if k[0] == run]
        assert sum(r.gap for r in own) == gaps[run] and sum(r.regressed for r in own) == back[run] > 0


def test_an_arrival_that_comes_too_late_moves_nothing(spark):
    rows = [(1, 5, "applied_delta", T0 + 9 * S, T0), (1, 3, "applied_delta", T0 + 90 * S, T0 + S), (1, 6, "applied_delta", T0 + 8 * S, T0)]
    o = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "run long, seq long, outcome string, event_time timestamp, received_time timestamp, piece int").withColumn("applied", F.lit(True))
    got = {r.seq: r for r in played(spark, o, lambda s: capture_stream.marked(s), "piece").collect()}
    assert (got[3].lateness, got[6].lateness, got[6].gap, got[5].gap) in {("out_of_order", "late", 0, 0), ("on_time", "late", 0, 1)}


def test_numbers_of_batch_and_stream_agree(spark):
    rng = random.Random(5)
    rows = [(run, f, e, t, rng.choice(["accepted", "rejected", "not_applicable"])) for run in ("a", "b") for f in range(40) for e, t in ((None, None), (0, "1"), (0, "2"), (1, "1")) if rng.random() < 0.7]
    p = spark.createDataFrame(rows, "run string, frame_no long, event_idx int, token_id string, status string")
    key = lambda d: sorted(map(str, d.select("run", "frame_no", "event_idx", "token_id", "seq").collect()))
    assert key(played(spark, p, capture_stream.numbered, "frame_no")) == key(normalise.with_sequence(p))


def test_a_batch_played_twice_leaves_the_ledger_equal(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    d = spark.createDataFrame([("r", i, f"o{i % 7}", T0 + i * S) for i in range(20)], "run string, seq long, observation_id string, received_time timestamp")
    capture_stream.open_ledger(spark, folder)
    write = capture_stream.append_batch(folder)
    parts = ["seq < 5", "seq >= 5 and seq < 9", "seq >= 9"]
    for n, part in enumerate(parts):
        write(d.where(part), n)
    rows = lambda: sorted(map(tuple, capture_stream.deliveries(spark, folder).select("run", "seq", "disposition").collect()))
    want = sorted(map(tuple, ledger.with_disposition(d).select("run", "seq", "disposition").collect()))
    assert rows() == want
    for n in (0, 2, 1, 1):
        write(d.where(parts[n]), n)
    assert rows() == want
    # A batch that broke off before its commit: its folders are there, its row is not.
    d.where("seq < 3").withColumn("disposition", F.lit("accepted_new")).write.parquet(f"{folder}/deliveries/batch=3")
    spark.createDataFrame([("new",)], "observation_id string").withColumn("bucket", capture_stream.bucket()).write.parquet(f"{folder}/observations/batch=3")
    assert rows() == want
    write(spark.createDataFrame([("r", 50, "new", T0), ("r", 51, "o1", T0)], d.schema), 3)
    assert rows() == sorted([*want, ("r", 50, "accepted_new"), ("r", 51, "duplicate")])


def test_targets_freeze_at_their_close(spark):
    rng, rows = random.Random(11), []
    for token in range(4):
        for i in range(30):
            mid = None if rng.random() < 0.2 else str(rng.randrange(100) / 100)
            rows.append((1, token // 2, token, 4 * i + token, rng.random() < 0.4, mid, None if rng.random() < 0.2 else T0 + (i // 3) * S, T0 + (i + rng.choice([0, -3])) * S, T0 + (12 + 5 * token) * S))
    s = spark.createDataFrame(rows, "run long, condition_id long, token_id long, seq long, changed boolean, midpoint string, book_event_time timestamp, received_time timestamp, close_at timestamp")
    s = s.withColumn("midpoint", F.col("midpoint").cast("decimal(13,11)"))
    closes = s.select("run", "condition_id", "token_id", "close_at").distinct()
    want = {r.token_id: (r.seq, r.midpoint, r.previous_midpoint) for r in forecast.frozen(s.drop("close_at"), closes).collect()}
    tick = spark.createDataFrame([(9, 9, 9, 1, False, None, None, T0 + timedelta(hours=1), T0 + timedelta(hours=1))], s.schema)
    played_ = played(spark, s.unionByName(tick), capture_stream.frozen, "received_time").where("run = '1'")
    got = {int(r.token_id): (r.seq, r.midpoint, r.previous_midpoint) for r in played_.select("token_id", "seq", *[F.col(c).cast("decimal(13,11)").alias(c) for c in ("midpoint", "previous_midpoint")]).collect()}
    assert got == want and len(want) == 4


def test_targets_of_many_files_freeze_as_in_one_pass(spark):
    """A piece's rows lie in more files than a batch once held: those read first moved the clock past the others' rows."""
    close, rows = T0 + timedelta(hours=20), []
    for run in range(12):
        for i in range(60):
            rows.append((run, run, run, i, True, str(i % 100 / 100), T0 + timedelta(minutes=30 * i), T0 + timedelta(minutes=30 * i), close))
    s = spark.createDataFrame(rows, "run long, condition_id long, token_id long, seq long, changed boolean, midpoint string, book_event_time timestamp, received_time timestamp, close_at timestamp")
    s = s.withColumn("midpoint", F.col("midpoint").cast("decimal(13,11)"))
    want = {r.run: (r.seq, r.midpoint, r.previous_midpoint) for r in forecast.frozen(s.drop("close_at"), s.select("run", "condition_id", "token_id", "close_at").distinct()).collect()}
    tick = spark.createDataFrame([(-1, -1, -1, 1, False, None, None, T0 + timedelta(hours=40), T0 + timedelta(hours=40))], s.schema)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, x in held.items():
            spark.conf.set(k, x)
        found = played(spark, s.unionByName(tick), capture_stream.frozen, "received_time").where("run <> '-1'")
        got = {int(r.run): (r.seq, r.midpoint, r.previous_midpoint) for r in found.select("run", "seq", *[F.col(c).cast("decimal(13,11)").alias(c) for c in ("midpoint", "previous_midpoint")]).collect()}
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert got == want and len(want) == 12


def test_observed_counters_are_the_table_s(spark):
    frames = spark.createDataFrame([("r", i) for i in range(6)], "run string, frame_no long")
    decoded = spark.createDataFrame([("r", 0, 0), ("r", 1, 0), ("r", 1, 1), ("r", 2, None)], "run string, frame_no long, event_idx int")
    produced = spark.createDataFrame([("r", "accepted", None, None), ("r", "duplicate", None, None), ("r", "rejected", "malformed_payload", "not_json"), ("r", "rejected", "unknown_event_type", "unknown"), ("r", "not_applicable", None, None)], "run string, status string, reason string, detail string")
    happened = ledger.happened(frames, decoded, produced)
    want = {"frames_consumed": 6, "decode_failures": 1, "events_seen": 3, "accepted": 1, "duplicate": 1, "rejected": 2, "not_applicable": 1, "unknown_event_type": 1}
    assert ledger.capture_health(happened, capture_stream.COUNTERS).drop("run").first().asDict() == want
    assert capture_stream.totals(played(spark, happened.repartition(5), capture_stream.observed, None)) == want


def test_a_side_costs_the_same_at_any_depth():
    looked = {}
    for depth in (100, 20_000):
        rng = random.Random(depth)
        held = set(rng.sample(range(1, 1_000_000), depth))
        for sign in (1, -1):
            side, prices, asked = book_stream.Side(sign, len(held), sign * min(sign * p for p in held)), set(held), 0
            for _ in range(3000):
                best = sign * min(sign * p for p in prices)
                if rng.random() < 0.5:
                    p = best if rng.random() < 0.5 else rng.choice(list(prices)) if depth == 100 else best
                    prices.discard(p)
                    if side.remove(p):
                        asked += 1
                        side.fill(prices)
                        side.settle()
                else:
                    p = rng.randrange(1, 1_000_000)
                    if p not in prices:
                        prices.add(p)
                        side.add(p)
                if not prices:
                    prices.add(5)
                    side.add(5)
                if depth == 100 or _ % 50 == 0:
                    assert (side.best, side.n) == (sign * min(sign * p for p in prices), len(prices))
            assert asked <= 1
            looked[depth, sign] = side.popped
    assert max(looked.values()) <= 3000


class Kept:
    """A map state that counts what a call asks of it."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.asked += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value

    def removeKey(self, key):
        self.asked += 1
        self.held.pop(key, None)


def test_a_dictionary_in_chunks_reads_what_it_is_asked_for():
    rng, state, want = random.Random(4), Kept(), {}
    for call in range(60):
        held = Chunks(state, "a")
        assert len(held) == len(want)
        for _ in range(200 if call < 40 else 5):
            name = str(rng.randrange(9000))
            if rng.random() < 0.25 and name in held:
                del held[name], want[name]
            else:
                held[name] = want[name] = rng.random()
            assert held.get(name) == want.get(name) and (name in held) == (name in want)
        if call == 50:
            held.clear()
            want = {}
        held.flush()
        assert {n: Chunks(state, "a").get(n) for n in Chunks(state, "a")} == want
        state.asked = 0
    state.asked, held = 0, Chunks(state, "a")
    held["x"] = 1
    held.flush()
    assert state.asked <= 4 and (len(state.held) > 0)


def test_a_call_s_state_accesses_do_not_grow_with_its_tokens():
    """A group's tokens share them; deep books touch single chunks. Tops are those of a plain dictionary."""
    rng, state, books, made, n = random.Random(8), Kept(), {}, book_stream.BookProcessor(), 0
    made.init(state)
    for call in range(6):
        rows, want = [], {}
        for token in [*range(40)] + [7] * 200:
            n += 1
            first = token not in books
            levels = [{"side": rng.choice(["bid", "ask"]), "price": f"{rng.randrange(5000) / 10000:.10f}", "size": rng.choice(["0", "1", "2"])} for _ in range(20 if first else 3)]
            if token == 7 and first:
                levels = [{"side": "bid", "price": f"{i / 10000:.10f}", "size": "1"} for i in range(4000)]
            book = books.setdefault(token, {})
            for x in levels:
                book[x["side"], x["price"]] = x["size"]
            live = [(s, float(p)) for (s, p), size in book.items() if size != "0"]
            bid, ask = [p for s, p in live if s == "bid"], [p for s, p in live if s == "ask"]
            want[n] = (max(bid, default=None), min(ask, default=None), len(bid), len(ask))
            rows.append(("r", n, "c", str(token), f"o{n}", "snapshot" if first else "delta", levels, False))
        state.asked = 0
        out = pd.concat(made.handleInputRows(("r", 0), iter([pd.DataFrame(rows, columns=book_stream.INPUT)]), None))
        got = {r.seq: (*[None if pd.isna(x) else x for x in (r.best_bid, r.best_ask)], r.bid_levels, r.ask_levels) for r in out.itertuples()}
        assert got == want
        # The deep book's chunks, read and written, and a few for all tokens; the ids of 240 rows alone took two each before.
        assert state.asked <= 200, state.asked


def test_books_of_batch_and_stream_agree_on_long_histories(spark):
    arrivals, ops = history(5, n=1500)
    a, o = spark.createDataFrame(arrivals, ARRIVAL), spark.createDataFrame(ops, OPS)
    want, *_ = fold(arrivals, ops)
    got = {r.seq: r for r in played(spark, book_stream.book_inputs(a, o), book_stream.replay_stream, "seq").collect()}
    for seq, (name, _, top) in want.items():
        if top:
            r = got[seq]
            assert (r.status, r.best_bid, r.best_ask, r.bid_levels, r.ask_levels) == (name, *[None if x is None else float(x) for x in top[:2]], *top[2:])


def test_marks_from_a_clustered_ledger_without_a_shuffle(spark, tmp_path):
    rng = random.Random(9)
    rows = [(r, s, "applied_delta" if rng.random() < 0.7 else "unscoped", T0 + (s + rng.randrange(-9, 3)) * S) for r in (1, 2) for s in range(1, 9000, 3)]
    o = spark.createDataFrame(rows, "run long, seq long, outcome string, event_time timestamp").withColumn("applied", F.col("outcome").startswith("applied"))
    table = landing.write_clustered(o, "clustered_marks_test", f"file://{tmp_path}/ledger", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        marked = lateness.with_lateness(table, placed="block")
        plan = marked._jdf.queryExecution().executedPlan().toString()
        other = lateness.with_lateness(o)._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, marked.select("run", "seq", "lateness").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(map(tuple, lateness.with_lateness(o).select("run", "seq", "lateness").collect()))
    # The blocks' sums move, twice: to their window and to the rows. The rows don't.
    assert (plan.count("Exchange hashpartitioning"), other.count("Exchange hashpartitioning")) == (2, 4), plan
    spark.sql("drop table clustered_marks_test")
