"""Normalisation of wire shapes, settlements, markets, and column helpers."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bookreplay.functions import columns as c
from bookreplay.operators import normalise as n

T0 = datetime(2024, 1, 1)
COND = "0x" + "Ab" * 32


def frames(spark, *texts):
    return spark.createDataFrame([("r", i, T0, t) for i, t in enumerate(texts)], "run string, frame_no long, received_time timestamp, raw string")


def subs(spark, *tokens):
    return spark.createDataFrame([("r", t) for t in tokens], "run string, token_id string")


def entry(token="1", price="0.5", size="3", side="BUY", h="h", bid="0.4", ask="0.6"):
    return {"asset_id": token, "price": price, "size": size, "side": side, "hash": h, "best_bid": bid, "best_ask": ask}


def change(*entries, **more):
    return json.dumps({"event_type": "price_change", "market": COND, "timestamp": "1704067200000", "price_changes": list(entries)} | more)


def book(bids=(("0.1", "5"), ("0.2", "6")), asks=(("0.9", "1"), ("0.8", "2")), **more):
    level = lambda xs: [{"price": p, "size": s} for p, s in xs]
    return json.dumps({"event_type": "book", "market": COND, "asset_id": "1", "timestamp": "1", "hash": "h", "bids": level(bids), "asks": level(asks)} | more)


def trade(**more):
    return json.dumps({"event_type": "last_trade_price", "market": COND, "asset_id": "1", "price": "0.5", "size": "2", "fee_rate_bps": "0", "side": "BUY", "timestamp": "1", "transaction_hash": "0x" + "AB" * 32} | more)


def test_frames_are_accounted_for(spark):
    texts = ["nope", "3", "[1, {}]", "[]", "{}", '{"event_type": "tick_size_change"}', change(entry(), entry("2"), entry("9")), f"[{trade()}, {book()}]"]
    events = n.decoded_events(frames(spark, *texts))
    routed = n.routed(events, subs(spark, "1", "2")).collect()
    got = sorted((r.frame_no, r.event_idx if r.event_idx is not None else -1, r.token_id or "", r.status, r.reason or "", r.detail or "") for r in routed)
    assert got == sorted([
        (0, -1, "", "rejected", "malformed_payload", "not_json"), (1, -1, "", "rejected", "malformed_payload", "scalar_frame"), (2, 0, "", "rejected", "malformed_payload", "not_an_object"),
        (2, 1, "", "rejected", "unknown_event_type", "missing_event_type"), (4, 0, "", "rejected", "unknown_event_type", "missing_event_type"), (5, 0, "", "rejected", "unknown_event_type", "unknown"),
        (6, 0, "1", "pending", "", ""), (6, 0, "2", "pending", "", ""), (7, 0, "1", "pending", "", ""), (7, 0, "2", "not_applicable", "", ""), (7, 1, "1", "pending", "", ""), (7, 1, "2", "not_applicable", "", ""),
    ])
    seq = n.with_sequence(n.routed(events, subs(spark, "1", "2"))).select("seq", "frame_no").orderBy("seq").collect()
    assert [r.seq for r in seq] == list(range(1, 11)) and [r.frame_no for r in seq] == sorted(r.frame_no for r in seq)


CHANGES = [
    (change(entry(), entry(side="SELL", size="0"), entry("2", price="bad")), None), (change(entry(), entry(h="other", price="0.6")), "several_hashes"), (change(entry(), entry()), "duplicate_level"),
    (change(entry(price="1.1")), "bad_level"), (change(entry(size="-1")), "bad_level"), (change(entry(price="NaN")), "bad_level"), (change(entry(side="HOLD")), "bad_level"),
    (change(entry(), extra=1), "unexpected_keys"), (change(entry(), entry("")), "entry_without_token"), (change(entry(), entry(price="0.7", bid="0.1")), "several_tops"), (change(entry(price="5e-1")), None),
    (change(entry(size="0.12345678901")), "bad_level"),
]


def test_price_changes(spark):
    routed = n.routed(n.decoded_events(frames(spark, *[t for t, _ in CHANGES])), subs(spark, "1"))
    got = {r.frame_no: r for r in n.price_changes(routed).collect()}
    assert {i: r.detail for i, r in got.items()} == {i: d for i, (_, d) in enumerate(CHANGES)}
    assert [(x.side, str(x.price), x.kind) for x in got[0].levels] == [("ask", "0.5000000000", "remove"), ("bid", "0.5000000000", "set")]
    assert got[0].source_hash == "h" and str(got[0].asserted_ask) == "0.6000000000" and all(r.levels is None for r in got.values() if r.detail)


def test_books_streamed_and_polled(spark):
    texts = [book(), book(bids=[("0.1", "0")]), book(asks=[("0.8", "1"), ("0.80", "2")]), book(bids=[("0.1", "-2")]), book(tick_size="x"), book(odd=1), json.dumps({"event_type": "book", "asset_id": "1"})]
    pending = n.routed(n.decoded_events(frames(spark, *texts)), subs(spark, "1"))
    got = {r.frame_no: r for r in n.book_snapshots(pending).collect()}
    assert [got[i].detail for i in range(7)] == [None, "zero_level", "duplicate_level", "bad_level", "bad_scalar", "unexpected_keys", "no_levels"]
    assert [str(x.price)[:3] for x in got[0].levels] == ["0.2", "0.1", "0.8", "0.9"]
    polled = n.decoded_events(frames(spark, book(bids=[("0.1", "0"), ("0.95", "1")], tick_size="0.02"), book(asset_id="7"))).withColumn("token_id", F.lit("1"))
    snaps = n.book_snapshots(polled, polled=True)
    held = {r.frame_no: r for r in snaps.collect()}
    assert held[0].detail is None and held[0].zero_levels == 1 and held[1].detail == "token_mismatch"
    assert {(r.anomaly, r.n) for r in n.structure_anomalies(snaps).collect()} == {("off_tick", 1), ("crossed", 1), ("zero_size_dropped", 1)}


def test_trades(spark):
    texts = [trade(), trade(price="2"), trade(size="0"), trade(side="x"), trade(transaction_hash="0x1"), trade(more=1)]
    got = {r.frame_no: r for r in n.trades(n.routed(n.decoded_events(frames(spark, *texts)), subs(spark, "1"))).collect()}
    assert [got[i].detail for i in range(6)] == [None, "price", "size", "side", "transaction_hash", "keys"]
    assert got[0].transaction_hash == "0x" + "ab" * 32


def test_envelopes(spark):
    texts = [trade(timestamp="1704067202001"), trade(timestamp="1704067202000"), trade(timestamp=""), trade(timestamp="soon")]
    got = {r.frame_no: r for r in n.envelopes(n.trades(n.routed(n.decoded_events(frames(spark, *texts)), subs(spark, "1")))).collect()}
    assert [got[i].event_time_status for i in range(4)] == ["present", "present", "missing", "unparseable"]
    assert got[0].quality_flags == ["event_time_ahead_of_receipt"] and got[1].quality_flags == [] and got[3].event_time_raw == "soon"
    assert got[0].observation_id != got[1].observation_id and got[0].condition_id == COND.lower()
    # A time that says missing is not a missing time, and the ledger's audit reads the normalisers' rows.
    said = n.trades(n.routed(n.decoded_events(frames(spark, trade(timestamp="missing"), trade(timestamp=""))), subs(spark, "1")))
    assert len({r.observation_id for r in n.envelopes(said).collect()}) == 2
    from bookreplay.operators import ledger

    assert ledger.identity_disagreements(n.envelopes(said)).count() == 0
    assert ledger.rejection_disagreements(n.rejections(n.routed(n.decoded_events(frames(spark, "not json", "7")), subs(spark, "1")))).count() == 0


def market(**more):
    return {"id": "7", "conditionId": COND, "question": "Q?", "slug": "q", "active": True, "closed": False, "archived": False, "outcomes": '["Yes","No"]', "clobTokenIds": '["11","12"]', "liquidity": "5.5",
            "startDate": "2024-01-01T00:00:00Z", "endDate": "2024-02-01T00:00:00Z", "events": [{"id": "3"}]} | more


def test_markets(spark):
    page = [market(), market(id=None), market(endDate="2024-02-01T00:00:00"), market(clobTokenIds='["1"]'), market(outcomes="x"), market(liquidity="1e99"), market(conditionId="0x1")]
    got = {r.page_idx: r for r in n.markets(spark.createDataFrame([(json.dumps(page),)], "raw string")).collect()}
    assert [got[i].reason for i in range(7)] == [None, "malformed_payload", "invalid_timestamp", "quarantined_mapping", "quarantined_mapping", "malformed_payload", "malformed_payload"]
    assert got[0].outcome_token_map == {"Yes": "11", "No": "12"} and got[0].event_id == "3" and got[0].end_time == datetime(2024, 2, 1)


PAGES = [
    ({"outcomePrices": '["0","1"]', "umaResolutionStatuses": '["proposed","resolved"]'}, None, ("no", "12", "final")), ({"outcomePrices": '["1","0"]', "umaResolutionStatuses": '["proposed","disputed"]'}, None, ("yes", "11", "disputed")),
    ({"outcomePrices": '["0","0"]'}, "no_determinable_outcome", None), ({"outcomePrices": '["0.0000000000000000000000000000000000000000436","0.99999999999999999999999999999999999999999564"]'}, "prices_are_not_a_resolution", None),
    ({"outcomePrices": '["1","0"]', "closed": False}, "not_closed", None), ({"outcomePrices": '["1"]'}, "not_a_binary_market", None), ({}, "malformed_payload", None), ({"outcomePrices": '["1","0"]', "clobTokenIds": "[]", "umaResolutionStatuses": '["resolved"]'}, None, ("yes", None, "unknown")),
]


def test_page_settlements(spark):
    rows = [(i, json.dumps(market(closed=True) | p)) for i, (p, *_) in enumerate(PAGES)]
    for r in n.page_resolutions(spark.createDataFrame(rows, "i int, raw string")).collect():
        _, refusal, want = PAGES[r.i]
        assert r.refusal == refusal and (want is None or (r.winner, r.winning_token_id, r.status) == want), r.i
        assert (r.resolution_id is None) == (refusal is not None)


def test_token_settlements(spark):
    body = lambda *ts, closed=True: json.dumps({"condition_id": COND, "closed": closed, "tokens": [{"token_id": t, "outcome": o, "price": p, "winner": w} for t, o, p, w in ts]})
    yes, no = ("1", "Yes", 1, True), ("2", "No", 0, False)
    rows = [body(yes, no), body(yes, ("2", "No", 0, True)), body(("1", "Yes", 0.9, True), no), body(yes, no, closed=False), body(yes)]
    got = [r.refusal or r.winning_token_id for r in n.token_resolutions(spark.createDataFrame([(r,) for r in rows], "raw string")).collect()]
    assert got == ["1", "no_determinable_outcome", "prices_are_not_a_resolution", "not_closed", "not_a_binary_market"]


@pytest.mark.parametrize("text,want", [("0.50", "0.5"), ("1e-2", "0.01"), (".5", "0.5"), ("5.", "5"), ("+7", "7"), ("1e5", "100000"), ("NaN", None), ("", None), ("1,0", None), ("0.12345678901", None), ("0.1234567890123456789999", None), ("-0", "0")])
def test_wire_decimals(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(c.canonical_decimal(c.wire_decimal(F.col("t"), c.SIZE)).alias("d"))
    assert df.first().d == want


def test_digests_are_injective_and_text_is_neutralised(spark):
    df = spark.createDataFrame([("a|1:b", None), ("a", "1:b"), ("", None), (None, "")], "x string, y string")
    assert df.select(c.digest(F.col("x"), F.col("y")).alias("h")).distinct().count() == 4
    odd = "a‮b\x07c\nd​" + "z" * 3000
    r = spark.createDataFrame([(odd,)], "t string").select(c.neutralized(F.col("t")).alias("t"), c.neutralized(F.col("t"), identifier=True, limit=9).alias("i")).first()
    assert r.t.startswith("a�b�c\nd�z") and "3008 chars sha256=" in r.t and r.i.startswith("a�b�c�d�z...[")
    assert spark.createDataFrame([("007",), ("0",), ("x0",)], "t string").select(c.without_leading_zeros(F.col("t")).alias("t")).collect() == [("7",), ("0",), ("x0",)]


def test_levels_and_audits_decode_the_frames_once(spark):
    """What is left of the queries when they return reads stored rows, so no filter or branch decodes the frames again."""
    import duckdb

    from bookreplay.plans.ingest import identity_audit, price_change_levels
    from bookreplay.plans.queries import ORACLES

    d = "/root/testdata/sf0.001"
    for made_by in (price_change_levels, identity_audit):
        name, made = made_by.__name__, made_by(spark, d)
        assert not [f for f in made.inputFiles() if "events.parquet" in f], name
        asked = duckdb.connect()
        asked.execute(f"create view events as select * from '{d}/events.parquet'")
        want = asked.execute(f"select {', '.join(made.columns)} from ({ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want)) and want
