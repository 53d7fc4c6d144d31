"""Normalisation: landed JSON to typed rows, or to rejection rows with a reason. Nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.functions.columns import PRICE, SIZE, event_time, first_reason, micros, stable_id, wire_decimal
from bookreplay.functions.windows import BLOCK
from bookreplay.operators import ledger

# Fixed values of the wire format.
EVENT_TYPES = ["book", "last_trade_price", "price_change"]
KEYS = {
    "price_change": ["event_type", "market", "price_changes", "timestamp"],
    "book": ["asks", "asset_id", "bids", "event_type", "hash", "last_trade_price", "market", "tick_size", "timestamp"],
    "last_trade_price": ["asset_id", "event_type", "fee_rate_bps", "market", "price", "side", "size", "timestamp", "transaction_hash"],
}
REASONS = [
    "malformed_payload", "unknown_event_type", "schema_version_mismatch", "invalid_timestamp", "duplicate_event", "late_event", "out_of_order_event",
    "backpressure", "quarantined_mapping", "ambiguous_contract",
]
SOURCE = "clob_ws"
MAX_PAYLOAD = 1 << 20
AHEAD_SECONDS = 2

ENTRY = "struct<asset_id:string,price:string,size:string,side:string,hash:string,best_bid:string,best_ask:string>"
LEVEL = "struct<price:string,size:string>"


def shape(v: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; null for what isn't JSON."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def decoded_events(frames: DataFrame) -> DataFrame:
    """A row per event of each frame: event (variant), event_idx; or with ``reason`` where the frame is
    not JSON, is a scalar, or holds an element that is no object."""
    # What JSON begins with tells its kind; the schema of a whole value costs more than reading it.
    begins = F.substring(F.ltrim("raw", F.lit(" \t\r\n")), 1, 1)
    held = frames.withColumn("_v", F.try_parse_json("raw")).withColumn("_shape", F.when(F.col("_v").isNotNull(), F.when(begins == "[", "ARRAY").when(begins == "{", "OBJECT").otherwise("SCALAR")))
    one = F.when(F.col("_shape") == "ARRAY", F.try_variant_get("_v", "$", "array<variant>")).when(F.col("_shape") == "OBJECT", F.array("_v"))
    held = held.withColumn("_bad", F.coalesce(~F.col("_shape").isin("ARRAY", "OBJECT"), F.lit(True)))
    exploded = held.select("*", F.posexplode_outer(one).alias("event_idx", "event")).where("_bad or event_idx is not null")
    detail = F.when(F.col("_shape").isNull(), "not_json").when(F.col("_bad"), "scalar_frame").when(F.try_variant_get("event", "$", "map<string,variant>").isNull(), "not_an_object")
    return exploded.withColumn("detail", detail).withColumn("reason", F.when(detail.isNotNull(), "malformed_payload")).drop("_v", "_shape", "_bad")


def typed(events: DataFrame) -> DataFrame:
    """What routing asks of an event: event_type and ``named``, the tokens it names (empty text where an entry names
    none; null where it has no list of entries)."""
    kind = F.when(F.col("reason").isNull(), text_at(F.col("event"), "$.event_type"))
    held = events.withColumn("event_type", F.when(kind != "", kind))
    entries = F.try_variant_get("event", "$.price_changes", "array<variant>")
    named = F.transform(entries, lambda e: F.coalesce(F.try_variant_get(e, "$.asset_id", "string"), F.lit("")))
    own = text_at(F.col("event"), "$.asset_id")
    return held.withColumn("named", F.when(F.col("event_type") == "price_change", named).when(F.col("event_type").isin(EVENT_TYPES) & own.isNotNull(), F.array(own)))


def routed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events of known types, once for each token that the run subscribed to (token_id); the others
    once, as rejections. ``status``: pending, rejected or not_applicable."""
    return fanned(typed(events), subscriptions).drop("named")


def fanned(held: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``routed`` of typed events: it reads no event again."""
    known = F.col("event_type").isin(EVENT_TYPES) & F.col("reason").isNull()
    refused = held.where(~F.coalesce(known, F.lit(False))).withColumn("token_id", F.lit(None).cast("string")).withColumn("status", F.lit("rejected"))
    refused = refused.withColumn("detail", F.coalesce("detail", F.when(F.col("event_type").isNull(), "missing_event_type").otherwise("unknown"))).withColumn("reason", F.coalesce("reason", F.lit("unknown_event_type")))
    sent = held.where(known).join(subscriptions.select("run", "token_id"), "run")
    stray = (F.col("event_type") == "price_change") & F.array_contains("named", "")
    off = F.col("named").isNotNull() & ~F.array_contains("named", F.col("token_id")) & ~stray
    sent = sent.withColumn("status", F.when(off, "not_applicable").otherwise("pending"))
    return sent.unionByName(refused.select(*sent.columns))


def unexpected_keys(event: Column, kind: str) -> Column:
    keys = F.map_keys(F.try_variant_get(event, "$", "map<string,variant>"))
    return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS[kind]]))) > 0


def price_changes(pending: DataFrame) -> DataFrame:
    """``status`` accepted or rejected with levels (side, price, size, kind), hash, best_bid, best_ask.

    Only the token's entries are kept; they share one hash and one top of book; (side, price) pairs are
    unique; size zero removes the level; BUY is the bid side."""
    held = pending.where("event_type = 'price_change' and status = 'pending'")
    entries = F.try_variant_get("event", "$.price_changes", f"array<{ENTRY}>")
    held = held.withColumn("_own", F.filter(entries, lambda e: e["asset_id"] == F.col("token_id"))).withColumn("_all", entries)
    stray = F.exists("_all", lambda e: F.coalesce(e["asset_id"], F.lit("")) == "")
    side = lambda e: F.when(e["side"] == "BUY", "bid").when(e["side"] == "SELL", "ask")
    level = lambda e: F.struct(side(e).alias("side"), wire_decimal(e["price"], PRICE).alias("price"), wire_decimal(e["size"], SIZE).alias("size"))
    held = held.withColumn("_levels", F.transform("_own", level))
    same = lambda c: F.size(F.array_distinct(F.transform("_own", lambda e: e[c]))) == 1
    pairs = F.transform("_levels", lambda x: F.struct(x["side"], x["price"]))
    bad = F.exists("_levels", lambda x: x["side"].isNull() | x["price"].isNull() | x["size"].isNull() | (x["price"] > 1) | (x["price"] < 0) | (x["size"] < 0))
    detail = first_reason(
        (unexpected_keys(F.col("event"), "price_change"), "unexpected_keys"), (F.col("_all").isNull(), "no_entries"), (stray, "entry_without_token"), (bad, "bad_level"),
        (~same("hash"), "several_hashes"), (~same("best_bid") | ~same("best_ask"), "several_tops"), (F.size(F.array_distinct(pairs)) < F.size(pairs), "duplicate_level"),
    )
    levels = F.array_sort(F.transform("_levels", lambda x: F.struct(x["side"].alias("side"), x["price"].alias("price"), x["size"].alias("size"), F.when(x["size"] == 0, "remove").otherwise("set").alias("kind"))))
    first = F.get("_own", 0)
    return _finished(held.withColumn("detail", detail), levels, first["hash"], first["best_bid"], first["best_ask"]).drop("_own", "_all", "_levels")


def _finished(held: DataFrame, levels: Column, source_hash: Column, bid: Column, ask: Column) -> DataFrame:
    ok = F.col("detail").isNull()
    out = held.withColumn("status", F.when(ok, "accepted").otherwise("rejected")).withColumn("reason", F.when(~ok, "malformed_payload"))
    return out.withColumn("levels", F.when(ok, levels)).withColumn("source_hash", source_hash).withColumn("asserted_bid", wire_decimal(bid, PRICE)).withColumn("asserted_ask", wire_decimal(ask, PRICE))


def book_snapshots(held: DataFrame, polled: bool = False) -> DataFrame:
    """Books of the stream, or polled ones. Levels best first. A streamed book with a level of size
    zero or less is refused; of a polled one zero-size levels are dropped and counted."""
    bids, asks = (F.try_variant_get("event", f"$.{s}", f"array<{LEVEL}>") for s in ("bids", "asks"))
    held = (held if polled else held.where("event_type = 'book' and status = 'pending'")).withColumn("_b", bids).withColumn("_a", asks)
    level = lambda side: lambda e: F.struct(F.lit(side).alias("side"), wire_decimal(e["price"], PRICE).alias("price"), wire_decimal(e["size"], SIZE).alias("size"))
    held = held.withColumn("_all", F.concat(F.transform("_b", level("bid")), F.transform("_a", level("ask"))))
    kept = F.filter("_all", lambda x: x["size"] > 0) if polled else F.col("_all")
    held = held.withColumn("_kept", kept).withColumn("zero_levels", F.size(F.filter("_all", lambda x: x["size"] == 0)))
    bad = F.exists("_all", lambda x: x["price"].isNull() | x["size"].isNull() | (x["price"] > 1) | (x["price"] < 0) | (x["size"] < 0))
    zero = F.lit(False) if polled else F.col("zero_levels") > 0
    pairs = F.transform("_kept", lambda x: F.struct(x["side"], x["price"]))
    optional = lambda c: text_at(F.col("event"), f"$.{c}").isNotNull() & wire_decimal(text_at(F.col("event"), f"$.{c}"), PRICE).isNull()
    token = text_at(F.col("event"), "$.asset_id")
    detail = first_reason(
        (F.lit(False) if polled else unexpected_keys(F.col("event"), "book"), "unexpected_keys"), (F.col("_b").isNull() | F.col("_a").isNull(), "no_levels"), (bad, "bad_level"),
        (zero, "zero_level"), (F.size(F.array_distinct(pairs)) < F.size(pairs), "duplicate_level"), (optional("tick_size") | optional("last_trade_price"), "bad_scalar"),
        (~token.eqNullSafe(F.col("token_id")), "token_mismatch"),
    )
    best_first = F.concat(
        F.reverse(F.array_sort(F.filter("_kept", lambda x: x["side"] == "bid"))), F.array_sort(F.filter("_kept", lambda x: x["side"] == "ask")),
    )
    levels = F.transform(best_first, lambda x: F.struct(x["side"].alias("side"), x["price"].alias("price"), x["size"].alias("size"), F.lit("snapshot").alias("kind")))
    none = F.lit(None).cast("string")
    out = _finished(held.withColumn("detail", detail), levels, text_at(F.col("event"), "$.hash"), none, none)
    for c in ("tick_size", "last_trade_price"):
        out = out.withColumn(c, wire_decimal(text_at(F.col("event"), f"$.{c}"), PRICE))
    return out.drop("_b", "_a", "_all", "_kept")


def trades(pending: DataFrame) -> DataFrame:
    """Exact key set, price in [0, 1], size above zero, hex hash in lower case."""
    held = pending.where("event_type = 'last_trade_price' and status = 'pending'")
    at = lambda c: text_at(F.col("event"), f"$.{c}")
    keys = F.array_sort(F.map_keys(F.try_variant_get("event", "$", "map<string,variant>")))
    held = held.withColumn("price", wire_decimal(at("price"), PRICE)).withColumn("size", wire_decimal(at("size"), SIZE)).withColumn("side", at("side")).withColumn("transaction_hash", F.lower(at("transaction_hash")))
    detail = first_reason(
        (keys != F.array(*[F.lit(k) for k in KEYS["last_trade_price"]]), "keys"), (F.col("price").isNull() | (F.col("price") > 1) | (F.col("price") < 0), "price"),
        (F.col("size").isNull() | (F.col("size") <= 0), "size"), (~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)), "side"),
        (~F.coalesce(F.col("transaction_hash").rlike("^0x[0-9a-f]{64}$"), F.lit(False)), "transaction_hash"),
    )
    ok = detail.isNull()
    return held.withColumn("detail", detail).withColumn("status", F.when(ok, "accepted").otherwise("rejected")).withColumn("reason", F.when(~ok, "malformed_payload"))


def with_sequence(produced: DataFrame) -> DataFrame:
    """seq 1, 2, ... of each run, for produced records only: by frame, event and token. Blocks of frames are
    counted first and numbered apart, so a long run is many tasks."""
    held = produced.where("status <> 'not_applicable'").withColumn("_block", F.floor(F.col("frame_no") / BLOCK))
    sums = held.groupBy(F.col("run").alias("_run"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_run", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    order = Window.partitionBy("run", "_block").orderBy("frame_no", F.coalesce("event_idx", F.lit(-1)), F.col("token_id").asc_nulls_first())
    held = held.withColumn("_nth", F.row_number().over(order)).join(bases, (F.col("run") == F.col("_run")) & (F.col("_block") == F.col("_b")))
    return held.withColumn("seq", F.col("_base") + F.col("_nth")).drop("_block", "_run", "_b", "_base", "_nth")


def envelopes(accepted: DataFrame) -> DataFrame:
    """Event time with its status, quality flags, the payload's size against its cap, and the identity."""
    raw = text_at(F.col("event"), "$.timestamp")
    held = accepted.withColumn("event_time_raw", raw).withColumn("_t", event_time(raw)).select("*", "_t.*").drop("_t")
    ahead = micros(F.col("event_time"), F.col("received_time")) > AHEAD_SECONDS * 1_000_000
    held = held.withColumn("quality_flags", F.filter(F.array(F.when(ahead, F.lit("event_time_ahead_of_receipt"))), lambda x: x.isNotNull()))
    held = held.withColumn("payload", F.to_json("event")).withColumn("condition_id", F.lower(text_at(F.col("event"), "$.market")))
    large = F.octet_length("payload") > MAX_PAYLOAD
    held = held.withColumn("reason", F.when(large, "malformed_payload").otherwise(F.col("reason"))).withColumn("status", F.when(large, "rejected").otherwise(F.col("status")))
    none = F.lit(None).cast("string")
    held = held.withColumns({
        "source": F.lit(SOURCE), "source_event_type": F.col("event_type"), "market_id": none, "payload_schema_version": F.concat("event_type", F.lit(".v1")), "source_sequence": none, "source_hash": text_at(F.col("event"), "$.hash"),
    })
    return held.withColumn("observation_id", ledger.observation_id())


def rejections(produced: DataFrame) -> DataFrame:
    """Rejection rows with a grouping id: equal refusals of one frame share it."""
    gone = produced.where("status = 'rejected'")
    return gone.withColumns({"raw_sha256": F.sha2("raw", 256), "scope": F.col("token_id")}).withColumn("rejection_id", ledger.rejection_id())


def level_rows(accepted: DataFrame) -> DataFrame:
    return accepted.where("status = 'accepted'").select("run", "seq", "condition_id", "token_id", F.explode("levels").alias("_l")).select("run", "seq", "condition_id", "token_id", "_l.*")


def structure_anomalies(snapshots: DataFrame) -> DataFrame:
    """off_tick, crossed, locked and zero_size_dropped of accepted snapshots, one row each."""
    price = lambda side: F.transform(F.filter("levels", lambda x: x["side"] == side), lambda x: x["price"])
    bid, ask = F.array_max(price("bid")), F.array_min(price("ask"))
    off = F.size(F.filter("levels", lambda x: x["price"] % F.col("tick_size") != 0))
    found = F.array(
        F.when((F.col("tick_size") > 0) & (off > 0), F.struct(F.lit("off_tick").alias("anomaly"), off.cast("long").alias("n"))),
        F.when(bid > ask, F.struct(F.lit("crossed").alias("anomaly"), F.lit(1).cast("long").alias("n"))),
        F.when(bid == ask, F.struct(F.lit("locked").alias("anomaly"), F.lit(1).cast("long").alias("n"))),
        F.when(F.col("zero_levels") > 0, F.struct(F.lit("zero_size_dropped").alias("anomaly"), F.col("zero_levels").cast("long").alias("n"))),
    )
    held = snapshots.where("status = 'accepted'").withColumn("_a", F.explode(F.filter(found, lambda x: x.isNotNull())))
    return held.select("run", "frame_no", "event_idx", "token_id", "_a.*")


def string_list(v: Column, path: str) -> Column:
    """A list that may come as a JSON array or as one inside a string."""
    raw = F.try_variant_get(v, path, "variant")
    inner = F.when(shape(raw) == "STRING", F.try_parse_json(F.try_variant_get(v, path, "string"))).otherwise(raw)
    return F.try_variant_get(inner, "$", "array<string>")


def iso_time(text: Column) -> Column:
    """Timestamps must carry a zone; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def markets(pages: DataFrame) -> DataFrame:
    """A row per market of landed pages (column raw: a market or an array of them), with ``reason``
    and ``detail`` where it goes to quarantine."""
    held = pages.withColumn("_v", F.try_parse_json("raw"))
    each = F.when(shape(F.col("_v")) == "ARRAY", F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    m = held.select("*", F.posexplode(each).alias("page_idx", "event")).drop("_v")
    at = lambda c: text_at(F.col("event"), f"$.{c}")
    flag = lambda c: F.try_variant_get("event", f"$.{c}", "boolean")
    m = m.withColumn("market_id", at("id")).withColumn("condition_id", F.lower(at("conditionId"))).withColumn("question", at("question")).withColumn("slug", at("slug"))
    m = m.withColumn("description", F.coalesce(at("description"), F.lit(""))).withColumn("resolution_source", F.coalesce(at("resolutionSource"), F.lit("")))
    m = m.withColumn("outcomes", string_list(F.col("event"), "$.outcomes")).withColumn("token_ids", string_list(F.col("event"), "$.clobTokenIds"))
    for c in ("active", "closed", "archived"):
        m = m.withColumn(c, flag(c))
    for c in ("liquidity", "volume"):
        m = m.withColumn(c, wire_decimal(at(c), SIZE))
    for name, c in (("start_time", "startDate"), ("end_time", "endDate"), ("updated_at", "updatedAt")):
        m = m.withColumn(name, iso_time(at(c)))
    m = m.withColumn("event_id", F.try_variant_get("event", "$.events[0].id", "string"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    bad_time = lambda c, name: (F.coalesce(at(c), F.lit("")) != "") & F.col(name).isNull()
    bad_number = lambda c: at(c).isNotNull() & F.col(c).isNull()
    detail = first_reason(
        (shape(F.col("event")) != "OBJECT", "not_an_object"), (F.col("event").isNull(), "not_json"), (blank("market_id"), "id"), (blank("condition_id"), "conditionId"), (blank("question"), "question"),
        (~F.col("condition_id").rlike("^0x[0-9a-f]{64}$"), "condition_form"), (F.col("active").isNull() | F.col("closed").isNull(), "flags"),
        (bad_time("startDate", "start_time") | bad_time("endDate", "end_time"), "timestamp"), (bad_number("liquidity") | bad_number("volume"), "decimal"),
        (F.col("outcomes").isNull() | F.col("token_ids").isNull(), "outcomes"), (F.size("outcomes") != F.size("token_ids"), "outcome_tokens"),
        (F.exists("token_ids", lambda t: ~t.rlike("^[0-9]{1,120}$")), "token_form"),
    )
    reason = F.when(F.col("detail") == "timestamp", "invalid_timestamp").when(F.col("detail").isin("outcomes", "outcome_tokens", "token_form"), "quarantined_mapping").when(F.col("detail").isNotNull(), "malformed_payload")
    m = m.withColumn("detail", detail).withColumn("reason", reason)
    zipped = F.map_from_arrays("outcomes", "token_ids")
    unique = (F.size(F.array_distinct("outcomes")) == F.size("outcomes")) & ~F.exists("outcomes", lambda o: o.isNull())
    m = m.withColumn("archived", F.coalesce("archived", F.lit(False)))
    return m.withColumn("outcome_token_map", F.when(F.col("reason").isNull() & unique, zipped))


def quarantine_counts(markets_: DataFrame) -> DataFrame:
    return markets_.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def page_resolutions(pages: DataFrame) -> DataFrame:
    """Settlements of market pages: closed, and prices exactly one and zero as text. ``refusal`` says
    why a payload settles nothing."""
    v = F.try_parse_json("raw")
    held = pages.withColumn("event", v)
    at = lambda c: text_at(F.col("event"), f"$.{c}")
    held = held.withColumn("market_id", at("id")).withColumn("condition_id", F.lower(at("conditionId"))).withColumn("_p", string_list(F.col("event"), "$.outcomePrices"))
    held = held.withColumn("_t", string_list(F.col("event"), "$.clobTokenIds")).withColumn("_s", string_list(F.col("event"), "$.umaResolutionStatuses"))
    # On the text: a cast would round a price to a settlement.
    one, zero = (lambda i: F.get("_p", i).rlike(r"^\+?0*1(\.0*)?$")), (lambda i: F.get("_p", i).rlike(r"^[+-]?0*(0|\.0|0\.)0*$"))
    closed = F.try_variant_get("event", "$.closed", "boolean")
    refusal = first_reason(
        (F.coalesce(F.col("market_id"), F.lit("")) == "", "malformed_payload"), (F.coalesce(F.col("condition_id"), F.lit("")) == "", "malformed_payload"),
        (~F.coalesce(closed, F.lit(False)), "not_closed"), (F.col("_p").isNull(), "malformed_payload"), (F.size("_p") != 2, "not_a_binary_market"),
        (zero(0) & zero(1), "no_determinable_outcome"), (~((one(0) & zero(1)) | (zero(0) & one(1))), "prices_are_not_a_resolution"),
    )
    yes = one(0)
    token = F.when(F.size("_t") == 2, F.when(yes, F.get("_t", 0)).otherwise(F.get("_t", 1)))
    last = F.when(F.size("_s") > 0, F.element_at("_s", -1))
    status = F.when(last == "resolved", "final").when(last.isin("proposed", "disputed"), last).otherwise("unknown")
    held = held.withColumn("refusal", refusal).withColumn("winner", F.when(refusal.isNull(), F.when(yes, "yes").otherwise("no")))
    held = held.withColumn("winning_token_id", F.when(refusal.isNull(), token)).withColumn("status", F.when(refusal.isNull(), F.when((status == "final") & token.isNull(), "unknown").otherwise(status)))
    held = held.withColumn("resolved_at", iso_time(at("updatedAt"))).withColumn("raw_sha256", F.sha2("raw", 256))
    held = held.withColumn("resolution_id", F.when(refusal.isNull(), stable_id("resolution", *[F.col(c) for c in ("condition_id", "raw_sha256", "winner", "winning_token_id", "status")])))
    return held.drop("_p", "_t", "_s", "event")


def token_resolutions(bodies: DataFrame) -> DataFrame:
    """Settlements in token form: exactly one winner flag, and prices that agree with the flags. Always
    final; the source gives no time."""
    held = bodies.withColumn("event", F.try_parse_json("raw")).withColumn("condition_id", F.lower(text_at(F.col("event"), "$.condition_id")))
    held = held.withColumn("_t", F.try_variant_get("event", "$.tokens", "array<struct<token_id:string,outcome:string,price:double,winner:boolean>>"))
    won = F.filter("_t", lambda t: t["winner"])
    wrong = F.exists("_t", lambda t: t["price"].isNull() | (t["price"] != F.when(t["winner"], 1.0).otherwise(0.0)))
    closed = F.try_variant_get("event", "$.closed", "boolean")
    refusal = first_reason(
        (F.coalesce("condition_id", F.lit("")) == "", "malformed_payload"), (~F.coalesce(closed, F.lit(False)), "not_closed"), (F.col("_t").isNull(), "malformed_payload"),
        (F.size("_t") != 2, "not_a_binary_market"), (F.size(won) != 1, "no_determinable_outcome"), (wrong, "prices_are_not_a_resolution"),
    )
    held = held.withColumn("refusal", refusal).withColumn("winning_token_id", F.when(refusal.isNull(), F.get(won, 0)["token_id"])).withColumn("winner", F.when(refusal.isNull(), F.lower(F.get(won, 0)["outcome"])))
    return held.withColumn("status", F.when(refusal.isNull(), "final")).withColumn("resolved_at", F.lit(None).cast("timestamp")).drop("_t", "event")
