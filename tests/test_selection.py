"""Blocks in order, capacities and as-of values against plain folds."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from bookreplay.functions import windows
from bookreplay.operators import selection

T0 = datetime(2024, 1, 1)


def fold(rows, capacity, partial):
    """decision by market: the blocks of one experiment, one candidate after the other."""
    used, strata, counts, out, short = {}, {}, {}, {}, None
    order = lambda r: (r["block"], r["stratum"] if partial else "", -(r["liquidity"] or 0), int(r["market"]))
    for r in sorted(rows, key=order):
        own = {("market", r["market"]), ("event", r["event"]), ("condition", r["condition"]), *(("token", t) for t in r["tokens"])}
        hit = {k for k, x in own if x in used.get(k, set())}
        group_hit = partial and r["group"] in used.get("group", set())
        if partial:
            why = "identity_reused" if hit else "event_group_reused" if group_hit else "stratum_quota" if strata.get(r["stratum"], 0) >= r["most"] else "block_capacity" if counts.get(r["block"], 0) >= capacity[r["block"]] else "selected"
        else:
            why = "market_identity_reused" if "market" in hit else "event_id_reused" if "event" in hit else "market_identity_reused" if hit else "rank_below_cutoff" if counts.get(r["block"], 0) >= capacity[r["block"]] else "selected"
        out[r["market"]] = why
        if why == "selected":
            for k, x in own | ({("group", r["group"])} if partial else set()):
                used.setdefault(k, set()).add(x)
            strata[r["stratum"]] = strata.get(r["stratum"], 0) + 1
            counts[r["block"]] = counts.get(r["block"], 0) + 1
    if not partial:
        short = min((b for b, c in capacity.items() if counts.get(b, 0) < c), default=None)
        for r in rows:
            if short is not None and r["block"] >= short:
                w = out[r["market"]]
                out[r["market"]] = "predecessor_rejected" if r["block"] > short else "block_shortfall" if w == "selected" else w
    return out


def test_blocks_in_order_are_the_fold(spark):
    rng = random.Random(8)
    for partial in (True, False):
        rows, blocks, want = [], [], {}
        for e in ("a", "b", "c"):
            capacity = {1: 0 if e == "b" else 2, 2: 3, 3: 2}
            own = [dict(market=str(i), event=str(rng.randrange(12)), condition=str(rng.randrange(25)), tokens=sorted({str(rng.randrange(40)), str(rng.randrange(40))}), group=str(rng.randrange(9)),
                        stratum=rng.choice("xy"), most=3 if partial else None, liquidity=rng.choice([None, 0, 5, 10, rng.randrange(100)]), block=rng.choice([2, 3] if e == "c" else [1, 2, 3])) for i in range(30)]
            if e == "c" and not partial:
                capacity[1] = 1  # an empty first block: nothing after it is selected
            want |= {(e, m): d for m, d in fold(own, capacity, partial).items()}
            rows += [(e, r["block"], r["market"], r["event"], r["condition"], r["tokens"], r["liquidity"], None, r["stratum"], r["most"] or 99, r["group"]) for r in own]
            blocks += [(e, b, c) for b, c in capacity.items()]
        rows.append(("a", 1, "900", "1", "1", ["1"], 10**6, "closed", "x", 3, "1"))
        c = spark.createDataFrame(rows, "experiment_id string, block_no int, market_key string, event_key string, condition_key string, token_keys array<string>, liquidity long, exclusion string, stratum_id string, max_targets int, event_group string")
        got = selection.select_in_order(c.repartition(3), spark.createDataFrame(blocks, "experiment_id string, block_no int, capacity int"), partial, batch=4).collect()
        assert {(r.experiment_id, r.market_key): r.decision for r in got} == want | {("a", "900"): "closed"}


def test_identities_are_sets(spark):
    m = spark.createDataFrame([("p", "07", " 012", "0xA", {"Yes": "001", "No": "2"}), ("p", "8", "x1", "0xB", {"Yes": "3", "No": "1"}), ("p", "9", "x2", "0xC", None)], "page string, market_id string, event_id string, condition_id string, outcome_token_map map<string,string>")
    got = {r.market_key: (r.event_key, r.condition_key, r.token_keys) for r in selection.canonical_identities(m).collect()}
    assert got == {"7": ("12", "0xa", ["1", "2"]), "8": ("x1", "0xb", ["1", "3"]), "9": ("x2", "0xc", [])}
    assert [tuple(r) for r in selection.shared_tokens(m, "page").collect()] == [("p", "1", 2)]


def test_fresh_spread_and_capacity(spark):
    s = timedelta(seconds=1)
    c = spark.createDataFrame([(i, t, T0) for i, t in enumerate(["fresh", "stale", "failed", "crossed", "one", "none", "edge"])] + [(9, None, T0), (10, "fresh", None)], "i int, token_key string, selected_at timestamp")
    book = lambda t, at, bid, ask, failed=False: (t, T0 + at * s, bid and Decimal(bid), ask and Decimal(ask), failed)
    books = spark.createDataFrame([
        book("fresh", -90, "0.1", "0.9"), book("fresh", -9, "0.4", "0.5"), book("fresh", 5, "0.1", "0.2"), book("stale", -61, "0.4", "0.5"), book("failed", -9, "0.4", "0.5"), book("failed", -3, None, None, True),
        book("crossed", 0, "0.6", "0.5"), book("one", -1, "0.6", None), book("edge", -60, "0.4", "0.6"), (None, T0, Decimal("0.1"), Decimal("0.3"), False)], "token_key string, observed_at timestamp, best_bid decimal(12,10), best_ask decimal(12,10), failed boolean")
    got = {r.i: (r.book_exclusion, r.spread and float(r.spread)) for r in selection.with_fresh_spread(c, books, 60).collect()}
    none = ("book_unavailable", None)
    assert got == {0: (None, 0.1), 1: ("book_stale", None), 2: none, 3: ("book_invalid", None), 4: ("book_invalid", None), 5: none, 6: (None, 0.2), 9: (None, 0.2), 10: none}
    each = spark.createDataFrame([(5, 100), (5, 31), (5, 9), (5, -3)], "n int, left int").select("left", selection.capacity(F.col("n"), F.lit(T0) + F.make_interval(secs=F.col("left")), F.lit(T0), 10).alias("c"))
    assert {r.left: r.c for r in each.collect()} == {100: 5, 31: 3, 9: 0, -3: 0}


def test_running_values_by_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), i, rng.choice([None, rng.randrange(50)])) for i in rng.sample(range(400), 200)]
    d = spark.createDataFrame(rows, "k string, j int, seq int, v int")
    kinds = {f"_{k}": (k, F.col("v")) for k in ("max", "min", "sum", "last", "last_row")}
    for inclusive in (False, True):
        got = {r.seq: r for r in windows.running(d, kinds, by=["k", "j"], inclusive=inclusive, block=16).collect()}
        assert len(got) == len(rows)
        for k, j, seq, _ in rows:
            before = [x[3] for x in sorted(rows, key=lambda x: x[2]) if x[:2] == (k, j) and (x[2] < seq or inclusive and x[2] == seq)]
            known = [x for x in before if x is not None]
            want = (max(known, default=None), min(known, default=None), sum(known) if known else None, known[-1] if known else None, before[-1] if before else None)
            assert tuple(got[seq][n] for n in kinds) == want
