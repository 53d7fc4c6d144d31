"""Queries over landing, normalisation and identities.

Wire texts (JSON frames, market pages, settlements) are spelled from rows of the given tables by
expressions that both engines read; what the operators should make of them is worked out by the SQL
from the rows' numbers, without parsing any text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookreplay.functions.columns import PRICE, SIZE, canonical_decimal, event_time, neutralized, stable_id, wire_decimal
from bookreplay.functions.storage import fresh_dir, stored
from bookreplay.operators import ledger, normalise
from bookreplay.plans import views as v
from bookreplay.plans.queries import dbl, query
from bookreplay.plans.views import with_views
from bookreplay.sources import landing
from bookreplay.streaming import capture_stream


def for_spark(sql: str) -> str:
    return sql.replace("SHA<", "sha2(").replace(">SHA", ", 256)").replace("MILLIS(ts)", "unix_millis(CAST(ts AS TIMESTAMP))")


def for_duck(sql: str) -> str:
    return sql.replace("SHA<", "sha256(").replace(">SHA", ")").replace("MILLIS(ts)", "(epoch_us(ts) // 1000)")


def prefixed(*values: str) -> str:
    """SQL of the length-prefixed text of values."""
    return " || '|' || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for x in values)


def identity(prefix: str, *values: str) -> str:
    text = prefixed("'v1'", *values)
    return f"'{prefix}-' || left(sha256({text}), 32)"


# --- frames of events -----------------------------------------------------------------------------

#: Every event is a frame. e: its number, k: its property, u: its user; every 4 users share a token name.
TOKEN, OTHER = "CAST(100 + u % 4 AS STRING)", "CAST(100 + (u + 1) % 4 AS STRING)"
CONDITION = "'0x' || SHA<CAST(u % 4 AS STRING)>SHA"
STAMP = """CASE WHEN e % 11 = 0 THEN '' WHEN e % 7 = 0 THEN ',"timestamp":"soon"' ELSE ',"timestamp":"' || CAST(MILLIS(ts) + CASE WHEN e % 5 = 0 THEN 5000 ELSE 0 END AS STRING) || '"' END"""
CENTS = "'0.' || lpad(CAST({} AS STRING), 2, '0')"
SIDE = "CASE WHEN e % 29 = 0 THEN 'HOLD' WHEN e % 2 = 0 THEN 'BUY' ELSE 'SELL' END"
SIZE_1 = "CASE WHEN e % 23 = 0 THEN 'abc' WHEN e % 10 = 0 THEN '0' ELSE CAST(k + 1 AS STRING) || '.50' END"
ENTRY_1 = f"""'{{"asset_id":"' || {TOKEN} || '","price":"' || CASE WHEN e % 19 = 0 THEN '1.5' ELSE {CENTS.format('k')} END || '","size":"' || {SIZE_1} || '","side":"' || {SIDE} || '","hash":"h1","best_bid":"0.4","best_ask":"0.6"}}'"""
ENTRY_2 = f"""',{{"asset_id":"' || CASE WHEN e % 3 = 0 THEN {OTHER} ELSE {TOKEN} END || '","price":"' || CASE WHEN e % 13 = 0 THEN {CENTS.format('k')} ELSE {CENTS.format('(k + 1) % 100')} END || '","size":"7","side":"' || CASE WHEN e % 2 = 0 THEN 'BUY' ELSE 'SELL' END || '","hash":"' || CASE WHEN e % 17 = 0 THEN 'h2' ELSE 'h1' END || '","best_bid":"' || CASE WHEN e % 22 = 0 THEN '0.41' ELSE '0.4' END || '","best_ask":"0.6"}}'"""
CHANGE = f"""'{{"event_type":"price_change","market":"' || {CONDITION} || '","price_changes":' || CASE WHEN e % 59 = 0 THEN '"none"' ELSE '[' || {ENTRY_1} || {ENTRY_2} || ']' END || {STAMP} || CASE WHEN e % 31 = 0 THEN ',"extra":1' ELSE '' END || '}}'"""
BID_1, BID_2 = "CASE WHEN e % 19 = 0 THEN '1.5' ELSE " + CENTS.format("k % 40 + 3") + " END", "CASE WHEN e % 13 = 0 AND e % 19 <> 0 THEN " + CENTS.format("k % 40 + 3") + " ELSE " + CENTS.format("k % 40 + 1") + " END"
ASK_1 = f"CASE WHEN e % 5 = 0 THEN {CENTS.format('k % 40 + 2')} WHEN e % 9 = 0 THEN {CENTS.format('k % 40 + 3')} ELSE {CENTS.format('k % 40 + 6')} END"
LEVELS = f"""'"bids":[{{"price":"' || {BID_2} || '","size":"' || CASE WHEN e % 23 = 0 THEN '0' ELSE '2' END || '"}},{{"price":"' || {BID_1} || '","size":"1.25"}}],"asks":[{{"price":"' || {ASK_1} || '","size":"3"}}]'"""
BOOK = f"""'{{"event_type":"book","asset_id":"' || {TOKEN} || '","market":"' || {CONDITION} || '",' || {LEVELS} || {STAMP} || ',"hash":"h","tick_size":"' || CASE WHEN e % 3 = 0 THEN '0.03' ELSE '0.01' END || '","last_trade_price":"0.5"' || CASE WHEN e % 31 = 0 THEN ',"extra":1' ELSE '' END || '}}'"""
HASH = "CASE WHEN e % 17 = 0 THEN 'nothex' ELSE '0x' || SHA<CAST(e AS STRING)>SHA END"
TRADE = f"""'{{"asset_id":"' || {TOKEN} || '","event_type":"last_trade_price","fee_rate_bps":"0","market":"' || {CONDITION} || '","price":"' || CASE WHEN e % 19 = 0 THEN '1.5' ELSE {CENTS.format('k')} END || '","side":"' || {SIDE} || '","size":"' || {SIZE_1} || '"' || {STAMP} || ',"transaction_hash":"' || {HASH} || '"' || CASE WHEN e % 31 = 0 THEN ',"zeta":1' ELSE '' END || '}}'"""
EVENT = f"""CASE WHEN e % 47 = 0 THEN '{{"event_type":"tick_size_change","asset_id":"' || {TOKEN} || '"}}' WHEN e % 53 = 0 THEN '{{"asset_id":"' || {TOKEN} || '"}}' WHEN event_type = 'signup' THEN {BOOK} WHEN event_type = 'purchase' THEN {TRADE} ELSE {CHANGE} END"""
RAW = f"""CASE WHEN e % 37 = 0 THEN '{{"event_type":' WHEN e % 41 = 0 THEN '42' WHEN e % 43 = 0 THEN '[' || {EVENT} || ',7]' WHEN e % 2 = 0 THEN '[' || {EVENT} || ']' ELSE {EVENT} END"""

#: What the frames hold, for DuckDB.
WIRE = f"""WITH w AS (SELECT event_id AS e, event_id // 2500 AS run, user_id AS u, event_type, ts, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
f AS (SELECT *, CAST(100 + u % 4 AS VARCHAR) AS token, CAST(100 + (u + 1) % 4 AS VARCHAR) AS other, e % 37 <> 0 AND e % 41 <> 0 AS readable,
 CASE WHEN e % 47 = 0 THEN 'tick_size_change' WHEN e % 53 = 0 THEN NULL WHEN event_type = 'signup' THEN 'book' WHEN event_type = 'purchase' THEN 'last_trade_price' ELSE 'price_change' END AS kind FROM w),
decoded AS (SELECT run, e AS frame_no, 0 AS event_idx, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS detail FROM f WHERE readable UNION ALL SELECT run, e, 1, 'malformed_payload', 'not_an_object' FROM f WHERE readable AND e % 43 = 0
 UNION ALL SELECT run, e, NULL, 'malformed_payload', CASE WHEN e % 37 = 0 THEN 'not_json' ELSE 'scalar_frame' END FROM f WHERE NOT readable),
subs AS (SELECT DISTINCT run, token AS token_id FROM f WHERE token <> '103'),
fanned AS (SELECT f.*, token_id, CASE WHEN kind <> 'price_change' THEN token = token_id WHEN e % 59 = 0 THEN true WHEN e % 3 = 0 THEN token_id IN (token, other) ELSE token = token_id END AS own FROM f JOIN subs USING (run) WHERE readable AND kind IN ('book', 'last_trade_price', 'price_change')),
refused AS (SELECT d.run, d.frame_no, d.event_idx, CAST(NULL AS VARCHAR) AS token_id, CASE WHEN d.reason IS NULL THEN kind END AS event_type, coalesce(d.reason, 'unknown_event_type') AS reason, coalesce(d.detail, CASE WHEN kind IS NULL THEN 'missing_event_type' ELSE 'unknown' END) AS detail
 FROM decoded d JOIN f ON f.e = d.frame_no WHERE d.reason IS NOT NULL OR kind IS NULL OR kind = 'tick_size_change'),
judged AS (SELECT *, CASE WHEN NOT own THEN NULL
 WHEN kind = 'price_change' THEN CASE WHEN e % 31 = 0 THEN 'unexpected_keys' WHEN e % 59 = 0 THEN 'no_entries' WHEN token = token_id AND (e % 19 = 0 OR e % 23 = 0 OR e % 29 = 0) THEN 'bad_level'
   WHEN e % 3 <> 0 AND e % 17 = 0 THEN 'several_hashes' WHEN e % 3 <> 0 AND e % 22 = 0 THEN 'several_tops' WHEN e % 3 <> 0 AND e % 13 = 0 THEN 'duplicate_level' END
 WHEN kind = 'book' THEN CASE WHEN e % 31 = 0 THEN 'unexpected_keys' WHEN e % 19 = 0 THEN 'bad_level' WHEN e % 23 = 0 THEN 'zero_level' WHEN e % 13 = 0 THEN 'duplicate_level' END
 ELSE CASE WHEN e % 31 = 0 OR e % 11 = 0 THEN 'keys' WHEN e % 19 = 0 THEN 'price' WHEN e % 23 = 0 OR e % 10 = 0 THEN 'size' WHEN e % 29 = 0 THEN 'side' WHEN e % 17 = 0 THEN 'transaction_hash' END END AS detail FROM fanned),
produced AS (SELECT run, e AS frame_no, 0 AS event_idx, token_id, kind AS event_type, CASE WHEN NOT own THEN 'not_applicable' WHEN detail IS NULL THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN detail IS NOT NULL THEN 'malformed_payload' END AS reason, detail FROM judged
 UNION ALL SELECT run, frame_no, event_idx, token_id, event_type, 'rejected', reason, detail FROM refused),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY frame_no, coalesce(event_idx, -1), token_id NULLS FIRST) AS seq FROM produced WHERE status <> 'not_applicable')
"""


def wire(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("e"), F.floor(F.col("event_id") / v.RUN_ROWS).alias("run"), F.col("user_id").alias("u"), "event_type", "ts", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return wire(spark, d).select("run", F.col("e").alias("frame_no"), F.col("ts").cast("timestamp").alias("received_time"), F.expr(for_spark(RAW)).alias("raw"), F.lit("ws").alias("source"), F.lit("market").alias("endpoint"))


def routed(spark: SparkSession, d: str, landed: DataFrame | None = None) -> DataFrame:
    subscriptions = wire(spark, d).where("u % 4 <> 3").select("run", F.expr(TOKEN).alias("token_id")).distinct()
    return normalise.routed(normalise.decoded_events(frames(spark, d) if landed is None else landed), subscriptions)


def produced(spark: SparkSession, d: str, landed: DataFrame | None = None) -> DataFrame:
    """Every event of every subscribed token after its own normaliser, refusals included."""
    return normalised(routed(spark, d, landed), "run", "frame_no", "event_idx", "token_id", "event_type", "status", "reason", "detail", "raw", "received_time", "event")


def normalised(r: DataFrame, *names: str) -> DataFrame:
    """Routed events after their own normaliser."""
    parts = [normalise.price_changes(r), normalise.book_snapshots(r), normalise.trades(r), r.where("status <> 'pending'")]
    out = parts[0].select(*names)
    for p in parts[1:]:
        out = out.unionByName(p.select(*names))
    return out


def sequenced(spark: SparkSession, d: str) -> DataFrame:
    """Routed events with their numbers in the run, which normalising does not change. Events are decoded and typed once,
    and stored as text; routing and numbering read the types alone."""
    events = normalise.typed(normalise.decoded_events(frames(spark, d)))
    columns = ["run", "frame_no", "event_idx", "reason", "detail", "event_type", "named", "raw", "received_time"]
    events = stored(events.select(*columns, F.to_json("event").alias("event_json")), "events")
    subscriptions = stored(wire(spark, d).where("u % 4 <> 3").select("run", F.expr(TOKEN).alias("token_id")).distinct(), "subscriptions")
    return normalise.with_sequence(normalise.fanned(events, subscriptions).drop("named"))


def with_event(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event", F.try_parse_json("event_json"))


@query(WIRE + "SELECT * FROM decoded")
def decoded_frames(spark: SparkSession, d: str) -> DataFrame:
    return normalise.decoded_events(frames(spark, d)).select("run", "frame_no", "event_idx", "reason", "detail")


@query(WIRE + """SELECT run, e AS frame_no, 0 AS event_idx, token_id, kind AS event_type, CASE WHEN own THEN 'pending' ELSE 'not_applicable' END AS status, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS detail FROM fanned
 UNION ALL SELECT run, frame_no, event_idx, token_id, event_type, 'rejected', reason, detail FROM refused""")
def routed_events(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d).select("run", "frame_no", "event_idx", "token_id", "event_type", "status", "reason", "detail")


@query(WIRE + "SELECT run, frame_no, event_idx, token_id, seq FROM numbered")
def allocated_sequences(spark: SparkSession, d: str) -> DataFrame:
    return normalise.with_sequence(produced(spark, d)).select("run", "frame_no", "event_idx", "token_id", "seq")


@query(WIRE + """SELECT run, e AS frame_no, token_id, coalesce(detail, 'accepted') AS outcome, CASE WHEN detail IS NULL THEN CASE WHEN e % 3 = 0 THEN 1 ELSE 2 END ELSE -1 END AS levels FROM judged WHERE kind = 'price_change' AND own""")
def price_change_groups(spark: SparkSession, d: str) -> DataFrame:
    found = normalise.price_changes(routed(spark, d))
    return found.select("run", "frame_no", "token_id", F.coalesce("detail", F.lit("accepted")).alias("outcome"), F.coalesce(F.size("levels"), F.lit(-1)).alias("levels"))


@query(WIRE + """, entries AS (SELECT e, token AS asset, k / 100.0 AS price, CASE WHEN e % 10 = 0 THEN 0 ELSE k + 1.5 END AS size FROM f UNION ALL SELECT e, CASE WHEN e % 3 = 0 THEN other ELSE token END, CASE WHEN e % 13 = 0 THEN k ELSE (k + 1) % 100 END / 100.0, 7 FROM f)
SELECT n.run, n.seq, n.token_id, CASE WHEN x.e % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, round(CAST(price AS DOUBLE), 9) AS price, round(CAST(size AS DOUBLE), 9) AS size, CASE WHEN size = 0 THEN 'remove' ELSE 'set' END AS kind
 FROM numbered n JOIN entries x ON x.e = n.frame_no AND x.asset = n.token_id WHERE n.event_type = 'price_change' AND n.status = 'accepted'""")
def price_change_levels(spark: SparkSession, d: str) -> DataFrame:
    pending = sequenced(spark, d).where("event_type = 'price_change' and status = 'pending'")
    found = normalise.price_changes(with_event(pending)).select("run", "seq", "token_id", F.lit("").alias("condition_id"), "status", "levels")
    # Stored first: a filter on the status would be pushed below, and the whole normaliser worked out in it over and over.
    return normalise.level_rows(stored(found, "levels")).select("run", "seq", "token_id", "side", "kind", *dbl("price", "size"))


@query(WIRE + """SELECT run, e AS frame_no, token_id, coalesce(detail, 'accepted') AS outcome, CASE WHEN detail IS NULL THEN 'bid ' || (k % 40 + 3) || ', bid ' || (k % 40 + 1) || ', ask ' || CASE WHEN e % 5 = 0 THEN k % 40 + 2 WHEN e % 9 = 0 THEN k % 40 + 3 ELSE k % 40 + 6 END END AS best_first,
 round(CASE WHEN e % 3 = 0 THEN 0.03 ELSE 0.01 END, 9)::DOUBLE AS tick_size, 0.5::DOUBLE AS last_trade_price FROM judged WHERE kind = 'book' AND own""")
def stream_books(spark: SparkSession, d: str) -> DataFrame:
    shown = F.array_join(F.transform("levels", lambda x: F.concat(x["side"], F.lit(" "), (x["price"] * 100).cast("int").cast("string"))), ", ")
    found = normalise.book_snapshots(routed(spark, d))
    return found.select("run", "frame_no", "token_id", F.coalesce("detail", F.lit("accepted")).alias("outcome"), shown.alias("best_first"), *dbl("tick_size", "last_trade_price"))


POLLED = f"""'{{"asset_id":"' || {TOKEN} || '",' || {LEVELS} || '}}'"""


def polled(spark: SparkSession, d: str) -> DataFrame:
    """Book polls: every event of a user's sign-up, asked for under the token or, now and then, another."""
    asked = F.expr(f"CASE WHEN e % 27 = 0 THEN {OTHER} ELSE {TOKEN} END")
    raw = wire(spark, d).where("event_type = 'signup'").select("run", F.col("e").alias("frame_no"), F.lit(0).alias("event_idx"), asked.alias("token_id"), F.expr(for_spark(POLLED)).alias("raw"))
    return normalise.book_snapshots(raw.withColumn("event", F.try_parse_json("raw")), polled=True)


@query(WIRE + """SELECT run, e AS frame_no, CASE WHEN e % 19 = 0 THEN 'bad_level' WHEN e % 13 = 0 AND e % 23 <> 0 THEN 'duplicate_level' WHEN e % 27 = 0 THEN 'token_mismatch' ELSE 'accepted' END AS outcome, CASE WHEN e % 23 = 0 THEN 1 ELSE 0 END AS zero_levels FROM f WHERE event_type = 'signup'""")
def polled_books(spark: SparkSession, d: str) -> DataFrame:
    return polled(spark, d).select("run", "frame_no", F.coalesce("detail", F.lit("accepted")).alias("outcome"), "zero_levels")


@query(WIRE + """, books AS (SELECT *, k % 40 + 3 AS bid, CASE WHEN e % 5 = 0 THEN k % 40 + 2 WHEN e % 9 = 0 THEN k % 40 + 3 ELSE k % 40 + 6 END AS ask, CASE WHEN e % 3 = 0 THEN 3 ELSE 1 END AS tick FROM judged WHERE kind = 'book' AND own AND detail IS NULL),
off AS (SELECT run, e, CASE WHEN bid % tick <> 0 THEN 1 ELSE 0 END + CASE WHEN (bid - 2) % tick <> 0 THEN 1 ELSE 0 END + CASE WHEN ask % tick <> 0 THEN 1 ELSE 0 END AS n FROM books)
SELECT run, e AS frame_no, 'off_tick' AS anomaly, n::BIGINT AS n FROM off WHERE n > 0 UNION ALL SELECT run, e, 'crossed', 1 FROM books WHERE bid > ask UNION ALL SELECT run, e, 'locked', 1 FROM books WHERE bid = ask
 UNION ALL SELECT run, e, 'polled_zero_size_dropped', 1 FROM f WHERE event_type = 'signup' AND e % 19 <> 0 AND e % 23 = 0 AND e % 27 <> 0""")
def structure_anomalies(spark: SparkSession, d: str) -> DataFrame:
    streamed = normalise.structure_anomalies(normalise.book_snapshots(routed(spark, d)))
    dropped = normalise.structure_anomalies(polled(spark, d)).where("anomaly = 'zero_size_dropped'").withColumn("anomaly", F.lit("polled_zero_size_dropped"))
    return streamed.unionByName(dropped).select("run", "frame_no", "anomaly", "n")


@query(WIRE + """SELECT run, e AS frame_no, coalesce(detail, 'accepted') AS outcome, CASE WHEN detail IS NULL THEN round(k / 100.0, 9)::DOUBLE END AS price, CASE WHEN detail IS NULL THEN round(k + 1.5, 9)::DOUBLE END AS size, CASE WHEN detail IS NULL THEN '0x' || sha256(CAST(e AS VARCHAR)) END AS transaction_hash
 FROM judged WHERE kind = 'last_trade_price' AND own""")
def normalised_trades(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("detail").isNull()
    found = normalise.trades(routed(spark, d)).select("run", "frame_no", "detail", *[F.when(ok, F.col(c)).alias(c) for c in ("price", "size", "transaction_hash")])
    return found.select("run", "frame_no", F.coalesce("detail", F.lit("accepted")).alias("outcome"), "transaction_hash", *dbl("price", "size"))


ENVELOPES = """, stamped AS (SELECT n.run, n.seq, n.event_type, f.token, n.token_id, e, u, k, ts, CASE WHEN e % 11 = 0 THEN 'missing' WHEN e % 7 = 0 THEN 'unparseable' ELSE 'present' END AS event_time_status, epoch_us(ts) // 1000 + CASE WHEN e % 5 = 0 THEN 5000 ELSE 0 END AS ms
 FROM numbered n JOIN f ON f.e = n.frame_no WHERE n.status = 'accepted')
"""


@query(WIRE + ENVELOPES + """SELECT run, seq, token_id, event_time_status, CASE WHEN event_time_status = 'present' THEN make_timestamp(ms * 1000) END AS event_time,
 CASE WHEN event_time_status = 'present' AND e % 5 = 0 THEN 'event_time_ahead_of_receipt' ELSE '' END AS quality_flags, '0x' || sha256(CAST(u % 4 AS VARCHAR)) AS condition_id FROM stamped""")
def envelopes(spark: SparkSession, d: str) -> DataFrame:
    found = normalise.envelopes(normalise.with_sequence(produced(spark, d)).where("status = 'accepted'"))
    return found.select("run", "seq", "token_id", "event_time_status", "event_time", F.array_join("quality_flags", "|").alias("quality_flags"), "condition_id")


MARKER = "CASE event_time_status WHEN 'missing' THEN 'missing' WHEN 'unparseable' THEN 'unparseable:soon' ELSE 'present:' || CAST(ms * 1000 AS VARCHAR) END"
TRADE_TEXT = for_duck(TRADE)


@query(WIRE + ENVELOPES + f", ids AS (SELECT run, seq, event_type, '0x' || sha256(CAST(u % 4 AS VARCHAR)) AS condition_id, token_id, {MARKER} AS marker, {TRADE_TEXT} AS payload FROM stamped WHERE event_type = 'last_trade_price')\nSELECT run, seq, " + identity("obs", "'clob_ws'", "event_type", "CAST(NULL AS VARCHAR)", "condition_id", "token_id", "event_type || '.v1'", "marker", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "payload") + " AS observation_id FROM ids")
def trade_observation_ids(spark: SparkSession, d: str) -> DataFrame:
    numbered = normalise.with_sequence(produced(spark, d)).where("status = 'accepted' and event_type = 'last_trade_price'")
    return normalise.envelopes(numbered).select("run", "seq", "observation_id")


@query(WIRE + f", texts AS (SELECT e, sha256({for_duck(RAW)}) AS raw_sha256 FROM f), gone AS (SELECT n.*, raw_sha256 FROM numbered n JOIN texts ON e = n.frame_no WHERE n.status = 'rejected')\nSELECT run, seq, token_id, reason, detail, raw_sha256, " + identity("rej", "raw_sha256", "reason", "detail", "token_id") + " AS rejection_id FROM gone")
def rejection_rows(spark: SparkSession, d: str) -> DataFrame:
    return normalise.rejections(normalise.with_sequence(produced(spark, d))).select("run", "seq", "token_id", "reason", "detail", "raw_sha256", "rejection_id")


def sent_again(spark: SparkSession, d: str) -> DataFrame:
    """The frames, every seventeenth sent a second time a minute later: its records are duplicates."""
    f = frames(spark, d)
    return f.unionByName(f.where("frame_no % 17 = 0").withColumns({"frame_no": F.col("frame_no") + AGAIN, "received_time": F.col("received_time") + F.expr("INTERVAL 1 MINUTE")}))


AGAIN = 10_000_000


def happened(spark: SparkSession, d: str) -> DataFrame:
    f = stored(sent_again(spark, d), "frames")
    made = stored(normalise.with_sequence(produced(spark, d, f)).withColumn("event_json", F.to_json("event")).drop("event"), "records")
    known = normalise.envelopes(made.where("status = 'accepted'").withColumn("event", F.parse_json("event_json")))
    judged = ledger.with_disposition(known.select("run", "seq", "observation_id", "received_time"))
    twice = judged.where("disposition = 'duplicate'").select("run", "seq", F.lit(True).alias("_twice"))
    records = made.select("run", "seq", "status", "reason", "detail").join(twice, ["run", "seq"], "left").withColumn("status", F.when(F.col("_twice"), "duplicate").otherwise(F.col("status")))
    # What no token of the run applied to has no number.
    skipped = routed(spark, d, f).where("status = 'not_applicable'")
    return ledger.happened(f, normalise.decoded_events(f), records.unionByName(skipped.select("run", "status", "reason", "detail"), allowMissingColumns=True))


HEALTH = WIRE + f""", taken AS (SELECT p.run, p.frame_no, p.token_id, raw, received, 0 AS again FROM produced p JOIN (SELECT e, {for_duck(EVENT)} AS raw, ts AS received FROM f) ON e = frame_no WHERE status = 'accepted'),
copies AS (SELECT run, count(*) FILTER (nth > 1) AS duplicate FROM (SELECT run, row_number() OVER (PARTITION BY token_id, raw ORDER BY received, run, again, frame_no) AS nth FROM (SELECT * FROM taken UNION ALL SELECT run, frame_no, token_id, raw, received + INTERVAL 1 MINUTE, 1 FROM taken WHERE frame_no % 17 = 0)) GROUP BY run)""" + """, counted AS (SELECT run, sum(w) AS frames_consumed FROM (SELECT run, CASE WHEN e % 17 = 0 THEN 2 ELSE 1 END AS w FROM f) GROUP BY run),
events_of AS (SELECT run, sum(w) AS events_seen FROM (SELECT run, CASE WHEN frame_no % 17 = 0 THEN 2 ELSE 1 END AS w FROM decoded WHERE event_idx IS NOT NULL) GROUP BY run),
records AS (SELECT run, coalesce(sum(w) FILTER (detail IN ('not_json', 'scalar_frame')), 0) AS decode_failures, sum(w) FILTER (status = 'accepted') AS taken, coalesce(sum(w) FILTER (status = 'rejected'), 0) AS rejected,
 coalesce(sum(w) FILTER (status = 'not_applicable'), 0) AS not_applicable, coalesce(sum(w) FILTER (reason = 'unknown_event_type'), 0) AS unknown_event_type FROM (SELECT *, CASE WHEN frame_no % 17 = 0 THEN 2 ELSE 1 END AS w FROM produced) GROUP BY run),
health AS (SELECT run, frames_consumed::BIGINT AS frames_consumed, decode_failures::BIGINT AS decode_failures, events_seen::BIGINT AS events_seen, (taken - duplicate)::BIGINT AS accepted, duplicate, rejected::BIGINT AS rejected, not_applicable::BIGINT AS not_applicable, unknown_event_type::BIGINT AS unknown_event_type FROM counted JOIN events_of USING (run) JOIN records USING (run) JOIN copies USING (run))
"""


@query(HEALTH + "SELECT * FROM health")
def capture_health(spark: SparkSession, d: str) -> DataFrame:
    """The eight counters of a capture, by their names."""
    return ledger.capture_health(happened(spark, d), capture_stream.COUNTERS)


@query(HEALTH + "SELECT " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in capture_stream.COUNTERS) + " FROM health")
def observed_health(spark: SparkSession, d: str) -> DataFrame:
    """The same counters as a stream observes them batch by batch, summed over its batches."""
    from bookreplay.plans.streams import played

    query_ = played(spark, stored(happened(spark, d).repartition(3), "happened"), capture_stream.observed, None)
    found = capture_stream.totals(query_)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} long" for c in found))


# --- text columns ---------------------------------------------------------------------------------

DECIMALS = """CASE e % 12 WHEN 0 THEN '0.' || lpad(CAST(k AS STRING), 2, '0') || '00' WHEN 1 THEN '1e-2' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN '+.5' WHEN 5 THEN '1.' WHEN 6 THEN '0.00000000001' WHEN 7 THEN '-0.10' WHEN 8 THEN '000.25' WHEN 9 THEN '1,5' WHEN 10 THEN CAST(k AS STRING) || '00' ELSE '-0' END"""


@query("""WITH w AS (SELECT event_id AS e, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)
SELECT e, CASE e % 12 WHEN 0 THEN k / 100.0 WHEN 1 THEN 0.01 WHEN 4 THEN 0.5 WHEN 5 THEN 1 WHEN 7 THEN -0.1 WHEN 8 THEN 0.25 WHEN 10 THEN CASE WHEN k = 0 THEN 0 END WHEN 11 THEN 0 END::DOUBLE AS price, CASE e % 12 WHEN 0 THEN k / 100.0 WHEN 1 THEN 0.01 WHEN 4 THEN 0.5 WHEN 5 THEN 1 WHEN 7 THEN -0.1 WHEN 8 THEN 0.25 WHEN 10 THEN k * 100 WHEN 11 THEN 0 END::DOUBLE AS size,
 CASE e % 12 WHEN 0 THEN CASE WHEN k = 0 THEN '0' WHEN k % 10 = 0 THEN '0.' || (k // 10) ELSE '0.' || lpad(CAST(k AS VARCHAR), 2, '0') END WHEN 1 THEN '0.01' WHEN 4 THEN '0.5' WHEN 5 THEN '1' WHEN 7 THEN '-0.1' WHEN 8 THEN '0.25' WHEN 10 THEN CAST(k * 100 AS VARCHAR) WHEN 11 THEN '0' END AS canonical FROM w""")
def wire_decimals(spark: SparkSession, d: str) -> DataFrame:
    held = wire(spark, d).select("e", F.expr(DECIMALS).alias("raw")).select("e", wire_decimal(F.col("raw"), PRICE).alias("price"), wire_decimal(F.col("raw"), SIZE).alias("size"))
    return held.withColumn("canonical", canonical_decimal(F.col("size"))).select("e", "canonical", *dbl("price", "size"))


@query("""SELECT event_id AS e, CASE event_id % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'missing' WHEN 2 THEN 'unparseable' WHEN 3 THEN 'unparseable' ELSE 'present' END AS event_time_status,
 CASE event_id % 6 WHEN 4 THEN make_timestamp((epoch_us(ts) // 1000) * 1000) WHEN 5 THEN make_timestamp(-(epoch_us(ts) // 1000) * 1000) END AS event_time FROM events""")
def event_times(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE e % 6 WHEN 1 THEN '' WHEN 2 THEN '12a' WHEN 3 THEN '1.5' WHEN 4 THEN CAST(unix_millis(ts) AS STRING) WHEN 5 THEN '-' || CAST(unix_millis(ts) AS STRING) END")
    held = wire(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select("e", event_time(raw).alias("t"))
    return held.select("e", "t.event_time_status", "t.event_time")


CONTROLS = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{61C}\x{200B}\x{200E}\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}]"
BOUNDED = "CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '...[' || length({c}) || ' chars sha256=' || left(sha256({c}), 16) || ']' ELSE {c} END"


@query(f"""WITH t AS (SELECT doc_id, 'a' || chr(7) || chr(8238) || chr(9) || text || chr(65279) AS t FROM documents), s AS (SELECT doc_id, regexp_replace(t, '{CONTROLS}', chr(65533), 'g') AS c FROM t), i AS (SELECT doc_id, c AS s, regexp_replace(c, '[\\t\\n]', chr(65533), 'g') AS i FROM s)
SELECT doc_id, {BOUNDED.format(c='s', n=2000)} AS shown, {BOUNDED.format(c='i', n=60)} AS identifier FROM i""")
def neutralized_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("a\x07‮\t"), F.col("text"), F.lit("﻿"))
    return v.table(spark, d, "documents").select("doc_id", neutralized(text).alias("shown"), neutralized(text, identifier=True, limit=60).alias("identifier"))


# --- market pages and settlements -----------------------------------------------------------------

MARKET = """CASE WHEN k % 43 = 0 THEN '{"id"' WHEN k % 41 = 0 THEN '[3]' ELSE CASE WHEN k % 2 = 0 THEN '[' ELSE '' END || '{' || CASE WHEN k % 7 = 0 THEN '' ELSE '"id":"' || CAST(k AS STRING) || '",' END || '"conditionId":"' || CASE WHEN k % 11 = 0 THEN 'zz' ELSE '0x' || upper(SHA<CAST(k AS STRING)>SHA) END || '","question":"'
 || CASE WHEN k % 13 = 0 THEN '  ' ELSE 'Will it ship?' END || '","slug":"s","outcomes":' || CASE WHEN k % 29 = 0 THEN '5' WHEN k % 3 = 0 THEN '["Yes","No"]' ELSE '"[' || chr(92) || '"Yes' || chr(92) || '",' || chr(92) || '"No' || chr(92) || '"]"' END || ',"clobTokenIds":["' || CAST(k AS STRING) || '1"' || CASE WHEN k % 31 = 0 THEN '' WHEN k % 37 = 0 THEN ',"abc"' ELSE ',"' || CAST(k AS STRING) || '2"' END
 || '],' || CASE WHEN k % 17 = 0 THEN '' ELSE '"active":true,' END || '"closed":false,"liquidity":"' || CASE WHEN k % 23 = 0 THEN 'lots' ELSE CAST(k AS STRING) || '.5' END || '","endDate":"' || CASE WHEN k % 19 = 0 THEN '2020-01-02 00:00:00' ELSE '2020-01-02T00:00:00+01:00' END || '","events":[{"id":"' || CAST(c AS STRING) || '"}]}' || CASE WHEN k % 2 = 0 THEN ']' ELSE '' END END"""
MARKETS = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), m AS (SELECT *, CASE WHEN k % 43 = 0 THEN 'not_json' WHEN k % 41 = 0 THEN 'not_an_object' WHEN k % 7 = 0 THEN 'id' WHEN k % 13 = 0 THEN 'question' WHEN k % 11 = 0 THEN 'condition_form' WHEN k % 17 = 0 THEN 'flags'
 WHEN k % 19 = 0 THEN 'timestamp' WHEN k % 23 = 0 THEN 'decimal' WHEN k % 29 = 0 THEN 'outcomes' WHEN k % 31 = 0 THEN 'outcome_tokens' WHEN k % 37 = 0 THEN 'token_form' END AS detail FROM o),
r AS (SELECT *, CASE WHEN detail = 'timestamp' THEN 'invalid_timestamp' WHEN detail IN ('outcomes', 'outcome_tokens', 'token_form') THEN 'quarantined_mapping' WHEN detail IS NOT NULL THEN 'malformed_payload' END AS reason FROM m)
"""


def market_pages(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return normalise.markets(o.select(F.col("k").alias("page_no"), F.expr(for_spark(MARKET)).alias("raw")))


@query(MARKETS + """SELECT k AS page_no, reason, detail, CASE WHEN reason IS NULL THEN '0x' || sha256(CAST(k AS VARCHAR)) END AS condition_id, CASE WHEN reason IS NULL THEN k || '1' END AS yes_token, CASE WHEN reason IS NULL THEN CAST(k + 0.5 AS DOUBLE) END AS liquidity,
 CASE WHEN reason IS NULL THEN TIMESTAMP '2020-01-01 23:00:00' END AS end_time, CASE WHEN reason IS NULL THEN CAST(c AS VARCHAR) END AS event_id FROM r""")
def normalised_markets(spark: SparkSession, d: str) -> DataFrame:
    m, ok = market_pages(spark, d), F.col("reason").isNull()
    return m.select("page_no", "reason", "detail", *[F.when(ok, c).alias(n) for n, c in (
        ("condition_id", F.col("condition_id")), ("yes_token", F.try_element_at("outcome_token_map", F.lit("Yes"))), ("liquidity", F.col("liquidity").cast("double")), ("end_time", F.col("end_time")), ("event_id", F.col("event_id")))])


@query(MARKETS + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS count FROM r GROUP BY ALL")
def quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    return normalise.quarantine_counts(market_pages(spark, d))


QUOTED = "'\"[' || chr(92) || '\"' || {} || chr(92) || '\",' || chr(92) || '\"' || {} || chr(92) || '\"' || {} || ']\"'"
PRICES = "CASE WHEN k % 17 = 0 THEN '[\"1\",\"0\",\"0\"]' WHEN k % 11 = 0 THEN '[\"0\",\"0\"]' WHEN k % 13 = 0 THEN '[\"0.5\",\"0.5\"]' WHEN k % 2 = 0 THEN " + QUOTED.format("'1'", "'0'", "''") + " ELSE '[\"0.0\",\"1.00\"]' END"
SETTLED = f"""'{{' || CASE WHEN k % 29 = 0 THEN '' ELSE '"id":"' || CAST(k AS STRING) || '",' END || '"conditionId":"0x' || SHA<CAST(k AS STRING)>SHA || '","closed":' || CASE WHEN k % 7 = 0 THEN 'false' ELSE 'true' END || CASE WHEN k % 19 = 0 THEN '' ELSE ',"outcomePrices":' || {PRICES} END
 || CASE WHEN k % 23 = 0 THEN '' ELSE ',"clobTokenIds":["' || CAST(k AS STRING) || '1","' || CAST(k AS STRING) || '2"]' END || ',"umaResolutionStatuses":' || CASE WHEN k % 5 = 0 THEN '[]' WHEN k % 3 = 0 THEN '["proposed","resolved"]' WHEN k % 3 = 1 THEN '["proposed"]' ELSE '["resolved","disputed"]' END || ',"updatedAt":"2024-01-01T00:00:00Z"}}'"""


@query(f"""WITH o AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT k, {for_duck(SETTLED)} AS raw, CASE WHEN k % 29 = 0 THEN 'malformed_payload' WHEN k % 7 = 0 THEN 'not_closed' WHEN k % 19 = 0 THEN 'malformed_payload' WHEN k % 17 = 0 THEN 'not_a_binary_market' WHEN k % 11 = 0 THEN 'no_determinable_outcome' WHEN k % 13 = 0 THEN 'prices_are_not_a_resolution' END AS refusal FROM o),
t AS (SELECT *, CASE WHEN refusal IS NULL THEN CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END END AS winner, CASE WHEN refusal IS NULL AND k % 23 <> 0 THEN k || CASE WHEN k % 2 = 0 THEN '1' ELSE '2' END END AS winning_token_id,
 CASE WHEN refusal IS NULL THEN CASE WHEN k % 5 = 0 THEN 'unknown' WHEN k % 3 = 1 THEN 'proposed' WHEN k % 3 = 2 THEN 'disputed' WHEN k % 23 = 0 THEN 'unknown' ELSE 'final' END END AS status, '0x' || sha256(CAST(k AS VARCHAR)) AS condition_id, sha256(raw) AS raw_sha256 FROM s)
SELECT k, refusal, winner, winning_token_id, status, CASE WHEN refusal IS NULL THEN {identity('resolution', 'condition_id', 'raw_sha256', 'winner', 'winning_token_id', 'status')} END AS resolution_id FROM t""")
def page_settlements(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return normalise.page_resolutions(o.select("k", F.expr(for_spark(SETTLED)).alias("raw"))).select("k", "refusal", "winner", "winning_token_id", "status", "resolution_id")


SETTLED_TOKENS = """'{"condition_id":"0x' || SHA<CAST(k AS STRING)>SHA || '","closed":' || CASE WHEN k % 7 = 0 THEN 'false' ELSE 'true' END || CASE WHEN k % 19 = 0 THEN '' ELSE ',"tokens":[{"token_id":"' || CAST(k AS STRING) || '1","outcome":"Yes","price":' || CASE WHEN k % 13 = 0 THEN '0.5' WHEN k % 2 = 0 AND k % 11 <> 0 THEN '1' ELSE '0' END || ',"winner":' || CASE WHEN k % 2 = 0 AND k % 11 <> 0 THEN 'true' ELSE 'false' END || '}'
 || CASE WHEN k % 17 = 0 THEN '' ELSE ',{"token_id":"' || CAST(k AS STRING) || '2","outcome":"No","price":' || CASE WHEN k % 2 = 1 AND k % 11 <> 0 THEN '1' ELSE '0' END || ',"winner":' || CASE WHEN k % 2 = 1 AND k % 11 <> 0 THEN 'true' ELSE 'false' END || '}' END || ']' END || '}'"""


@query("""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'not_closed' WHEN o_orderkey % 19 = 0 THEN 'malformed_payload' WHEN o_orderkey % 17 = 0 THEN 'not_a_binary_market' WHEN o_orderkey % 11 = 0 THEN 'no_determinable_outcome' WHEN o_orderkey % 13 = 0 THEN 'prices_are_not_a_resolution' END AS refusal FROM orders)
SELECT k, refusal, CASE WHEN refusal IS NULL THEN CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END END AS winner, CASE WHEN refusal IS NULL THEN k || CASE WHEN k % 2 = 0 THEN '1' ELSE '2' END END AS winning_token_id, CASE WHEN refusal IS NULL THEN 'final' END AS status FROM s""")
def token_settlements(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return normalise.token_resolutions(o.select("k", F.expr(for_spark(SETTLED_TOKENS)).alias("raw"))).select("k", "refusal", "winner", "winning_token_id", "status")


# --- identities -----------------------------------------------------------------------------------

OBSERVATION = {"source": "'clob_ws'", "source_event_type": "event_type", "market_id": "NULL", "condition_id": "CAST(user_id % 7 AS STRING)", "token_id": "CAST(user_id AS STRING)", "payload_schema_version": "'v1'", "event_time_marker": "CASE WHEN event_id % 29 = 0 THEN 'missing' WHEN event_id % 31 = 0 THEN 'unparseable:missing' ELSE 'present:' || event_id * 1000000 END",
               "source_sequence": "NULL", "source_hash": "CASE WHEN event_id % 3 = 0 THEN 'é' || event_id END", "payload": "props"}


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Some event times are missing, and some are the text missing."""
    e = F.col("event_id")
    status = F.when(e % 29 == 0, "missing").when(e % 31 == 0, "unparseable").otherwise("present")
    held = v.table(spark, d, "events").withColumns({"event_time_status": status, "event_time": F.when(status == "present", F.timestamp_seconds("event_id")), "event_time_raw": F.when(status == "unparseable", "missing")})
    given = {n: x for n, x in OBSERVATION.items() if n != "event_time_marker"}
    held = held.select("event_id", "event_time_status", "event_time", "event_time_raw", *[F.expr(x).cast("string").alias(n) for n, x in given.items()])
    return held.withColumn("observation_id", ledger.observation_id())


OWN_IDS = "WITH o AS (SELECT event_id, " + ", ".join(f"CAST({x} AS VARCHAR) AS {n}" for n, x in OBSERVATION.items()) + " FROM events)\n"


@query(OWN_IDS + "SELECT event_id, " + identity("obs", *OBSERVATION) + " AS observation_id FROM o")
def observation_ids(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", "observation_id")


#: The stored columns that an observation's identity is made of.
AUDITED = [*[n for n in ledger.OBSERVATION if n != "event_time_marker"], "event_time_status", "event_time", "event_time_raw"]


@query(WIRE + "SELECT run, seq, CASE status WHEN 'accepted' THEN 'observation' ELSE 'rejection' END AS kind FROM numbered WHERE seq % 101 = 0")
def identity_audit(spark: SparkSession, d: str) -> DataFrame:
    """The normalisers' own rows, accepted and refused, whose stored ids their fields don't give: of every run
    each 101st is damaged here."""
    rows = stored(sequenced(spark, d), "records")
    made = stored(normalised(with_event(rows), *rows.columns), "normalised")
    damaged = lambda c: F.when(F.col("seq") % 101 == 0, F.reverse(c)).otherwise(F.col(c))
    kept = normalise.envelopes(with_event(made.where("status = 'accepted'"))).withColumn("observation_id", damaged("observation_id"))
    # The audit reads what was stored, so its filter does not make the identities again from the events.
    kept = stored(kept.select("run", "seq", "observation_id", *AUDITED), "observations")
    gone = normalise.rejections(made).withColumn("rejection_id", damaged("rejection_id"))
    found = ledger.identity_disagreements(kept).select("run", "seq", F.lit("observation").alias("kind"))
    return found.unionByName(ledger.rejection_disagreements(gone).select("run", "seq", F.lit("rejection").alias("kind")))


@query("WITH g AS (SELECT event_id, sha256(props) AS raw_sha256, event_type AS reason, CASE WHEN event_id % 2 = 0 THEN 'late' END AS detail, CAST(user_id % 5 AS VARCHAR) AS scope FROM events)\nSELECT rejection_id, count(*) AS refusals FROM (SELECT " + identity("rej", "raw_sha256", "reason", "detail", "scope") + " AS rejection_id FROM g) GROUP BY ALL")
def rejection_groups(spark: SparkSession, d: str) -> DataFrame:
    """Equal refusals of one raw text share an id."""
    gone = v.table(spark, d, "events").select(F.sha2("props", 256).alias("raw_sha256"), F.col("event_type").alias("reason"), F.when(F.col("event_id") % 2 == 0, "late").alias("detail"), (F.col("user_id") % 5).cast("string").alias("scope"))
    return gone.groupBy(ledger.rejection_id().alias("rejection_id")).agg(F.count(F.lit(1)).alias("refusals"))


@query("SELECT event_id, " + identity("target", "CAST(event_id // 2500 AS VARCHAR)", "CAST(user_id AS VARCHAR)", "CASE WHEN event_id % 2 = 0 THEN event_type END") + " AS target_id FROM events")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    run = F.floor(F.col("event_id") / v.RUN_ROWS)
    return v.table(spark, d, "events").select("event_id", stable_id("target", run, F.col("user_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("target_id"))


# --- landing and ledgers ----------------------------------------------------------------------------


@query(f"SELECT run, e AS frame_no, sha256(raw) AS raw_sha256, octet_length(encode(raw))::BIGINT AS byte_length FROM (SELECT *, {for_duck(RAW)} AS raw FROM (SELECT event_id AS e, CAST(event_id // 2500 AS VARCHAR) AS run, user_id AS u, event_type, ts, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events))")
def landed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames written to a landing folder as JSON lines, and read back."""
    folder = fresh_dir(spark, "frames")
    frames(spark, d).withColumn("run", F.col("run").cast("string")).write.json(folder)
    return landing.frames(spark, folder).select("run", "frame_no", "raw_sha256", "byte_length")


@query("SELECT run, sha256(string_agg(line, chr(10) ORDER BY event_id)) AS raw_sha256, count(*) AS lines FROM (SELECT event_id, event_id // 250 AS run, '{\"id\":' || event_id || '}' AS line FROM events) GROUP BY run")
def landed_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Whole bodies, a file for every 250 events, written to a folder and read back one by one."""
    folder = fresh_dir(spark, "bodies")
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}"))
    rows = v.table(spark, d, "events").select(F.floor(F.col("event_id") / 250).alias("run"), F.struct("event_id", line.alias("line")).alias("x"))
    bodies = rows.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("value"))
    bodies.write.partitionBy("run").text(folder)
    body = F.rtrim(F.col("raw"), F.lit("\n"))
    return landing.bodies(spark, folder).select(F.regexp_extract("path", "run=(\\d+)", 1).cast("long").alias("run"), F.sha2(body, 256).alias("raw_sha256"), F.size(F.split(body, "\n")).cast("long").alias("lines"))


@query(with_views("numbered", "arrivals") + "SELECT run, seq, kind, observation_id FROM arrivals")
def ledger_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries and rejections appended to one ledger folder, and read back as one sequence."""
    folder, a = fresh_dir(spark, "ledger"), v.arrivals(spark, d)
    columns = ["run", "seq", "observation_id"]
    for name in ("delivery", "rejection"):
        landing.append(a.where(F.col("kind") == name).select(*columns), f"{folder}/{name}")
    both = [spark.read.parquet(f"{folder}/{name}") for name in ("delivery", "rejection")]
    return ledger.arrivals(*both).select(F.col("run").cast("long").alias("run"), "seq", "kind", "observation_id")


@query(with_views("numbered", "arrivals") + "SELECT seq, observation_id FROM arrivals WHERE run = (SELECT max(run) FROM arrivals)")
def run_scan(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of a ledger in order."""
    folder, a = fresh_dir(spark, "ledger"), v.arrivals(spark, d)
    landing.append(a.select("run", "seq", "observation_id"), folder)
    last = spark.read.parquet(folder).agg(F.max("run")).first()[0]
    return landing.scan_run(spark, folder, last).select("seq", "observation_id")


@query(with_views("numbered", "arrivals") + "SELECT run, reason, count(*) AS count, min(seq) AS first_seq, max(seq) AS last_seq FROM arrivals WHERE kind = 'rejection' GROUP BY ALL")
def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from bookreplay.operators import lateness

    folder, found = fresh_dir(spark, "report"), lateness.rejection_histogram(v.arrivals(spark, d))
    landing.write_report(found, folder)
    return spark.read.schema(found.schema).json(folder)
