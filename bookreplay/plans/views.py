"""The operators' inputs, derived from the driver's tables, and the same views as SQL.

Disorder, duplicates, gaps and lateness are planted by the arithmetic of event ids; so are payloads of
kinds that no handler takes and payloads of another token than their envelope's. Every fourth run is
clean: nothing is lost or delivered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_ROWS = 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with some delivered twice, in arrival order per run, some arrivals lost."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))
    once, again = e.withColumn("copy", F.lit(0)).withColumn("akey", F.col("event_id")), e.where("event_id % 17 = 0").withColumn("copy", F.lit(1)).withColumn("akey", F.col("event_id") + 5)
    run = F.floor(F.col("event_id") / RUN_ROWS)
    seq = F.row_number().over(Window.partitionBy("run").orderBy("akey", "copy", "event_id")).cast("long")
    held = once.unionByName(again).withColumn("run", run).where("run % 4 <> 0 or copy = 0")
    return held.withColumn("seq", seq).where("event_id % 53 <> 0 or run % 4 = 0")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered(spark, sf_dir)
    e = F.col("event_id")
    return n.select(
        "run", "seq", F.when(e % 31 == 0, "rejection").otherwise("delivery").alias("kind"), F.sha2(e.cast("string"), 256).alias("observation_id"),
        F.floor(F.col("user_id") / 2).alias("condition_id"), F.when(e % 41 != 0, F.col("user_id")).alias("token_id"),
        F.when((e % 61 == 0) & (F.col("run") % 4 != 0), "tick_size_change").when(F.col("event_type") == "signup", "snapshot").when(F.col("event_type") == "purchase", "trade").otherwise("delta").alias("payload_type"),
        F.when(e % 59 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("payload_token_id"),
        F.when(e % 29 == 0, F.lit(None)).when(e % 13 == 0, F.col("ts") - F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts")).alias("event_time"),
        (F.col("ts") + F.expr("INTERVAL 1 SECOND") * (60 * F.col("copy"))).alias("received_time"),
        F.when(e % 31 == 0, F.element_at(F.array(F.lit("malformed_payload"), F.lit("unknown_event_type"), F.lit("invalid_timestamp")), (e % 3 + 1).cast("int"))).alias("reason"),
    )


def level_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered(spark, sf_dir).where("event_id % 31 <> 0 and event_id % 41 <> 0")
    base = F.col("k") % 20
    level = lambda side, slot, plus: F.struct(
        F.lit(side).alias("side"), (slot / 100 + (0.20 if side == "bid" else 0.45)).cast("decimal(12,10)").alias("price"), (F.col("value") + plus).cast("decimal(28,10)").alias("size"))
    snapshot = F.array(*[level(s, (F.col("k") + 3 * i) % 20, i) for s in ("bid", "ask") for i in range(4)])
    single = F.array(F.when(F.col("event_id") % 2 == 0, level("bid", base, 0)).otherwise(level("ask", base, 0)))
    kind = F.when(F.col("event_type") == "signup", "snapshot").when(F.col("event_type") == "error", "remove").otherwise("set")
    held = n.where("event_type <> 'purchase'").withColumn("_l", F.explode(F.when(F.col("event_type") == "signup", snapshot).otherwise(single)))
    return held.select("run", "seq", F.floor(F.col("user_id") / 2).alias("condition_id"), F.col("user_id").alias("token_id"), kind.alias("kind"), "_l.side", "_l.price",
                       F.when(kind == "remove", F.lit(0).cast("decimal(28,10)")).otherwise(F.col("_l.size")).alias("size"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade events, and the trades that every third snapshot carries."""
    n = numbered(spark, sf_dir).where("(event_type = 'purchase' or event_type = 'signup' and event_id % 3 = 0) and event_id % 31 <> 0 and event_id % 41 <> 0")
    price = F.when(F.col("event_type") == "signup", F.col("k") * 7 % 100).otherwise(F.col("k")) / 100
    return n.select("run", "seq", F.floor(F.col("user_id") / 2).alias("condition_id"), F.col("user_id").alias("token_id"), price.cast("decimal(12,10)").alias("price"))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 2).alias("condition_id")).distinct()
    cid = F.col("condition_id")
    return c.select(
        "condition_id", (2 * cid + cid % 2).alias("winning_token_id"), F.when(cid % 5 != 0, "final").otherwise("proposed").alias("status"),
        F.when(cid % 7 != 0, F.lit("2024-01-25 00:00:00").cast("timestamp")).alias("resolved_at"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    return met.select(F.col("doc_id").alias("target_id"), F.lit("midpoint").alias("method"), (F.col("n_chars") % 101 / 100).cast("decimal(13,11)").alias("score"), F.col("quality").alias("outcome"), "lang", "source", "toxic")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    yes = lambda n: F.col("o_orderkey") % n == 0
    outcomes = F.when(yes(23), F.array(F.lit("Yes"), F.lit("No"), F.lit("Other"))).when(yes(19), F.array(F.lit("Up"), F.lit("Down"))).otherwise(F.array(F.lit("Yes"), F.lit("No")))
    key = F.col("o_orderkey").cast("string")
    return o.select(
        key.alias("market_id"), F.col("o_custkey").cast("string").alias("event_id"), F.concat(F.lit("0x"), F.sha2(key, 256)).alias("condition_id"), outcomes.alias("outcomes"),
        F.when(~yes(37), F.map_from_arrays(F.array(F.lit("Yes"), F.lit("No")), F.array(F.concat(key, F.lit("1")), F.concat(key, F.lit("2"))))).alias("outcome_token_map"),
        (F.col("o_orderstatus") != "P").alias("active"), ((F.col("o_orderstatus") == "F") & yes(2)).alias("closed"), yes(29).alias("archived"),
        F.when(~yes(31), F.col("o_totalprice").cast("decimal(28,10)")).alias("liquidity"), F.col("o_totalprice").cast("decimal(28,10)").alias("volume"),
        (F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("start_time"), F.when(~yes(17), F.col("o_orderdate")).alias("end_time"),
        F.concat(F.lit("Will order "), key, F.lit(" ship?")).alias("question"), F.when(yes(11), "").otherwise("rules").alias("description"),
        F.when(yes(7), "").otherwise("registry").alias("resolution_source"), F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("custkey"),
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ordinal = F.row_number().over(w).cast("long")
    final = (F.col("event_type") == "purchase") & (F.col("k") > 90)
    poll = F.sha2(F.col("event_id").cast("string"), 256)
    held = e.select(F.col("user_id").alias("target_id"), ordinal.alias("ordinal"), F.when(F.col("event_id") % 97 != 0, F.lag(poll).over(w)).alias("previous_id"), poll.alias("poll_id"),
                    F.col("ts").alias("retrieved_at"), F.when(final, "final").otherwise("open").alias("finality"))
    return held.withColumn("source_time", F.col("retrieved_at")).withColumn("resolution_id", F.when(F.col("finality") == "final", F.col("poll_id")))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as hash chains; the ids of every eleventh conversation's odd turns are broken."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    own = F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")), 256)
    held = c.withColumn("id", F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") % 2 == 1), F.sha2(F.lit("broken"), 256)).otherwise(own)).withColumn("expected", own)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return held.withColumn("previous_id", F.when(F.col("conv_id") % 13 != 0, F.lag("id").over(w)))


#: The same views for DuckDB; each query's SQL begins with the ones it needs.
SQL = {
    "numbered": """src AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
del AS (SELECT *, 0 AS copy, event_id AS akey FROM src UNION ALL SELECT *, 1, event_id + 5 FROM src WHERE event_id % 17 = 0),
numbered AS (SELECT * FROM (SELECT *, event_id // 2500 AS run, row_number() OVER (PARTITION BY event_id // 2500 ORDER BY akey, copy, event_id) AS seq FROM del WHERE (event_id // 2500) % 4 <> 0 OR copy = 0) WHERE event_id % 53 <> 0 OR run % 4 = 0)""",
    "arrivals": """arrivals AS (SELECT run, seq, CASE WHEN event_id % 31 = 0 THEN 'rejection' ELSE 'delivery' END AS kind, sha256(CAST(event_id AS VARCHAR)) AS observation_id,
 user_id // 2 AS condition_id, CASE WHEN event_id % 41 <> 0 THEN user_id END AS token_id,
 CASE WHEN event_id % 61 = 0 AND run % 4 <> 0 THEN 'tick_size_change' WHEN event_type = 'signup' THEN 'snapshot' WHEN event_type = 'purchase' THEN 'trade' ELSE 'delta' END AS payload_type,
 CASE WHEN event_id % 59 = 0 THEN user_id + 1 ELSE user_id END AS payload_token_id,
 CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS event_time,
 ts + to_seconds(60 * copy) AS received_time,
 CASE WHEN event_id % 31 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'malformed_payload' WHEN 1 THEN 'unknown_event_type' ELSE 'invalid_timestamp' END END AS reason FROM numbered)""",
    "dispatched": """able AS (SELECT *, kind = 'delivery' AND token_id IS NOT NULL AND payload_type <> 'tick_size_change' AS ok FROM arrivals),
outcomes AS (SELECT *, outcome LIKE 'applied%' AS applied FROM (SELECT *, CASE WHEN kind <> 'delivery' THEN 'rejected' WHEN payload_type = 'tick_size_change' THEN 'unhandled_payload' WHEN token_id IS NULL THEN 'unscoped'
 WHEN row_number() OVER (PARTITION BY run, observation_id, ok ORDER BY seq) > 1 THEN 'skipped_duplicate'
 WHEN payload_type = 'snapshot' THEN 'applied_snapshot' WHEN payload_type = 'delta' THEN 'applied_delta' ELSE 'applied_auxiliary' END AS outcome FROM able))""",
    "level_ops": """one AS (SELECT * FROM numbered WHERE event_id % 31 <> 0 AND event_id % 41 <> 0 AND event_type <> 'purchase'),
level_ops AS (SELECT run, seq, user_id // 2 AS condition_id, user_id AS token_id, 'snapshot' AS kind, s.side,
  CAST(((k + 3 * i) % 20) / 100.0 + s.base AS DECIMAL(12,10)) AS price, CAST(value + i AS DECIMAL(28,10)) AS size
 FROM one, (VALUES ('bid', 0.20), ('ask', 0.45)) s(side, base), range(4) r(i) WHERE event_type = 'signup'
 UNION ALL SELECT run, seq, user_id // 2, user_id, CASE event_type WHEN 'error' THEN 'remove' ELSE 'set' END, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END,
  CAST((k % 20) / 100.0 + CASE WHEN event_id % 2 = 0 THEN 0.20 ELSE 0.45 END AS DECIMAL(12,10)), CASE event_type WHEN 'error' THEN 0 ELSE CAST(value AS DECIMAL(28,10)) END
 FROM one WHERE event_type <> 'signup')""",
    "segments": """inputs AS (SELECT *, sum(CASE WHEN outcome = 'applied_snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY run, token_id ORDER BY seq) AS segment
 FROM outcomes WHERE outcome IN ('applied_snapshot', 'applied_delta') AND payload_token_id = token_id),
writes AS (SELECT l.*, i.segment, i.outcome, lag(l.size) OVER w AS before, lead(l.seq) OVER w AS until FROM level_ops l JOIN inputs i USING (run, token_id, seq) WHERE i.segment > 0
 WINDOW w AS (PARTITION BY l.run, l.token_id, i.segment, l.side, l.price ORDER BY l.seq))""",
    "final": """last_segment AS (SELECT run, token_id, max(segment) AS segment FROM writes GROUP BY ALL),
final_levels AS (SELECT w.run, w.condition_id, w.token_id, w.side, w.price, w.size FROM writes w JOIN last_segment USING (run, token_id, segment) WHERE w.until IS NULL AND w.size > 0)""",
    "trades": """trades AS (SELECT t.run, t.seq, t.user_id AS token_id, CAST(CASE WHEN t.event_type = 'signup' THEN t.k * 7 % 100 ELSE t.k END / 100.0 AS DECIMAL(12,10)) AS price FROM numbered t JOIN outcomes o USING (run, seq)
 WHERE o.outcome = 'applied_auxiliary' OR (o.outcome = 'applied_snapshot' AND t.event_id % 3 = 0))""",
    "late": """marked AS (SELECT *, CASE WHEN event_time IS NULL THEN 'undatable' WHEN event_time < high THEN 'late' ELSE 'on_time' END AS lateness FROM
 (SELECT *, max(CASE WHEN applied THEN event_time END) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM outcomes))""",
    "top": """spans AS (SELECT w.run, w.token_id, w.segment, w.side, w.price, w.size, w.seq AS lo, coalesce(w.until, 1000000000) AS hi FROM writes w WHERE w.size > 0),
tops AS (SELECT i.run, i.condition_id, i.token_id, i.seq, i.segment, i.event_time, i.outcome,
 max(CASE WHEN s.side = 'bid' THEN s.price END) AS best_bid, min(CASE WHEN s.side = 'ask' THEN s.price END) AS best_ask,
 count(CASE WHEN s.side = 'bid' THEN 1 END) AS bid_levels, count(CASE WHEN s.side = 'ask' THEN 1 END) AS ask_levels
 FROM inputs i LEFT JOIN spans s ON i.run = s.run AND i.token_id = s.token_id AND i.segment = s.segment AND i.seq >= s.lo AND i.seq < s.hi WHERE i.segment > 0 GROUP BY ALL)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
