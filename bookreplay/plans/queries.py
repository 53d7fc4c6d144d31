"""Queries over the driver's tables: one or more for each group of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookreplay.functions import windows
from bookreplay.functions.columns import micros, unix_micros
from bookreplay.functions.storage import stored
from bookreplay.operators import audit, book, evaluate, forecast, lateness, ledger, lifecycle, scoring, selection
from bookreplay.plans import views as v
from bookreplay.plans.views import with_views

DEADLINE = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def dbl(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 9).alias(n) for n in names]


class Replay:
    """The operators' common inputs, built when they are asked for. What several of a query's operators read is
    stored once rather than planned again for each: ``keep`` names those parts, ``shared`` means all. Outcomes are
    stored in any case, since segments and marks read them twice."""

    def __init__(self, spark: SparkSession, d: str, shared: bool = False, keep: tuple[str, ...] = ()):
        self.spark, self.d = spark, d
        self.keep = ("arrivals", "outcomes", "inputs", "writes", "trades") if shared else ("outcomes", *keep)
        self.ops = v.level_ops(spark, d)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name) if name in self.keep else df

    @cached_property
    def arrivals(self) -> DataFrame:
        return self._kept(v.arrivals(self.spark, self.d), "arrivals")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self._kept(book.dispatched(self.arrivals), "outcomes")

    @cached_property
    def inputs(self) -> DataFrame:
        return self._kept(book.segmented(self.outcomes), "inputs")

    @cached_property
    def writes(self) -> DataFrame:
        return self._kept(book.level_writes(self.inputs, self.ops), "writes")

    @cached_property
    def trades(self) -> DataFrame:
        return self._kept(book.applied_trades(self.outcomes, v.trades(self.spark, self.d)), "trades")

    def states(self) -> DataFrame:
        return forecast.states(self.changes(), book.with_midpoint(book.top_of_book(self.inputs, self.writes)), self.trades)

    def changes(self) -> DataFrame:
        return forecast.information_changes(self.outcomes, self.inputs, self.writes, book.snapshot_divergence(self.inputs, self.writes), self.trades)

    def counters(self) -> DataFrame:
        """Per run: completion, sequence gaps, receive regressions and unhandled payloads."""
        state = ledger.run_states(marks(self.arrivals)).select("run", "completion_status")
        counts = lateness.dispatch_counts(lateness.with_lateness(self.outcomes)).select("run", "unhandled_payload")
        return state.join(lateness.sequence_gaps(self.arrivals), "run").join(lateness.receive_regressions(self.arrivals), "run").join(counts, "run")

    def summary(self) -> DataFrame:
        counts = lateness.run_counts(self.arrivals, ledger.with_disposition(self.arrivals.where("kind = 'delivery'")))
        hashes = book.state_hashes(book.book_digests(book.final_levels(self.writes)))
        return lateness.replay_summary(counts, lateness.sequence_gaps(self.arrivals), lateness.receive_regressions(self.arrivals), lateness.dispatch_counts(lateness.with_lateness(self.outcomes)), hashes, marks(self.arrivals))


def marks(arrivals: DataFrame) -> DataFrame:
    """Runs open with their first arrival and close with their last, but for every third run."""
    ends = arrivals.groupBy("run").agg(F.min("received_time").alias("started_at"), F.max("received_time").alias("ended_at"))
    opened = ends.select("run", "started_at", F.lit(None).cast("timestamp").alias("ended_at"), F.lit(None).cast("string").alias("completion_status"))
    closed = ends.where("run % 3 <> 2").select("run", F.lit(None).cast("timestamp").alias("started_at"), "ended_at", F.lit("completed").alias("completion_status"))
    return opened.unionByName(closed)


BOOK = with_views("numbered", "arrivals", "dispatched", "level_ops", "segments", "final", "trades")
REPLAY = with_views("numbered", "arrivals", "dispatched", "late")


@query(BOOK + """, top AS (SELECT run, token_id, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask,
 arg_max(size, price) FILTER (side = 'bid') AS bid_size, arg_min(size, price) FILTER (side = 'ask') AS ask_size,
 count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels FROM final_levels GROUP BY ALL),
sold AS (SELECT run, token_id, arg_max(price, seq) AS last_trade FROM trades GROUP BY ALL)
SELECT run, token_id, round(CAST(best_bid AS DOUBLE), 9) AS best_bid, round(CAST(best_ask AS DOUBLE), 9) AS best_ask, round(CAST(bid_size AS DOUBLE), 9) AS bid_size,
 round(CAST(ask_size AS DOUBLE), 9) AS ask_size, bid_levels, ask_levels, round(CAST((best_bid + best_ask) / 2 AS DOUBLE), 9) AS midpoint, round(CAST(best_ask - best_bid AS DOUBLE), 9) AS spread,
 round(CAST(last_trade AS DOUBLE), 9) AS last_trade FROM top LEFT JOIN sold USING (run, token_id)""")
def final_quotes(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d)
    q = book.final_quotes(book.final_levels(r.writes), r.trades)
    return q.select("run", "token_id", "bid_levels", "ask_levels", *dbl("best_bid", "best_ask", "bid_size", "ask_size", "midpoint", "spread", "last_trade"))


@query(BOOK + "SELECT run, token_id, side, round(CAST(price AS DOUBLE), 9) AS price, round(CAST(size AS DOUBLE), 9) AS size FROM final_levels")
def final_levels(spark: SparkSession, d: str) -> DataFrame:
    return book.final_levels(Replay(spark, d).writes).select("run", "token_id", "side", *dbl("price", "size"))


@query(BOOK + """, cut AS (SELECT * FROM writes WHERE seq <= 1500), seg AS (SELECT run, token_id, max(segment) AS segment FROM cut GROUP BY ALL),
held AS (SELECT c.run, c.token_id, c.side, c.price, arg_max(c.size, c.seq) AS size FROM cut c JOIN seg USING (run, token_id, segment) GROUP BY ALL)
SELECT run, token_id, side, round(CAST(price AS DOUBLE), 9) AS price, round(CAST(size AS DOUBLE), 9) AS size FROM held WHERE size > 0""")
def levels_as_of(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d)
    return book.levels_as_of(r.inputs, r.writes, 1500).select("run", "token_id", "side", *dbl("price", "size"))


@query(with_views("numbered", "arrivals", "dispatched", "level_ops", "segments", "top") + """SELECT run, token_id, seq, bid_levels, ask_levels, round(CAST(best_bid AS DOUBLE), 9) AS best_bid,
 round(CAST(best_ask AS DOUBLE), 9) AS best_ask, round(CAST((best_bid + best_ask) / 2 AS DOUBLE), 9) AS midpoint, round(CAST(best_ask - best_bid AS DOUBLE), 9) AS spread FROM tops""")
def top_of_book(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d, keep=("inputs", "writes"))
    top = book.with_midpoint(book.top_of_book(r.inputs, r.writes))
    return top.select("run", "token_id", "seq", "bid_levels", "ask_levels", *dbl("best_bid", "best_ask", "midpoint", "spread"))


@query(with_views("numbered", "arrivals", "dispatched", "level_ops", "segments", "top") + """, probes AS (SELECT run, token_id, n, TIMESTAMP '2024-01-04 00:00:00' + to_seconds(86400 * (token_id % 9 + 3 * n)) AS cutoff FROM (SELECT DISTINCT run, token_id FROM inputs), range(4) r(n)),
seen AS (SELECT t.*, o.received_time FROM tops t JOIN outcomes o USING (run, seq)), met AS (SELECT p.run, p.token_id, n, max((s.received_time, s.seq, s.best_bid, s.best_ask)) AS b FROM probes p LEFT JOIN seen s ON s.run = p.run AND s.token_id = p.token_id AND s.received_time <= p.cutoff GROUP BY ALL)
SELECT run, token_id, n::INTEGER AS probe, b[2] AS seq, round(CAST(b[3] AS DOUBLE), 9) AS best_bid, round(CAST(b[4] AS DOUBLE), 9) AS best_ask FROM met""")
def tops_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The top of each token's book as of four cutoffs of its own, by time of receipt."""
    r = Replay(spark, d, keep=("inputs", "writes"))
    top = book.top_of_book(r.inputs, r.writes).join(r.inputs.select("run", "seq", unix_micros(F.col("received_time")).alias("us")), ["run", "seq"])
    probes = r.inputs.select("run", "condition_id", "token_id").distinct().withColumn("probe", F.explode(F.array(*[F.lit(n) for n in range(4)])))
    start = F.lit("2024-01-04 00:00:00").cast("timestamp")
    probes = probes.withColumn("us", unix_micros(start + F.make_interval(days=(F.col("token_id") % 9 + 3 * F.col("probe")).cast("int"))))
    found = windows.as_of(probes, top, list(book.KEY), "us", F.struct("seq", "best_bid", "best_ask"), "state")
    return found.select("run", "token_id", "probe", "state.seq", *[F.round(F.col(f"state.{c}").cast("double"), 9).alias(c) for c in ("best_bid", "best_ask")])


@query(REPLAY + "SELECT run, seq, outcome, lateness FROM marked")
def arrival_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return lateness.with_lateness(Replay(spark, d).outcomes).select("run", "seq", "outcome", "lateness")


@query(REPLAY + """SELECT run, count(*) FILTER (outcome = 'applied_snapshot') AS applied_snapshot, count(*) FILTER (outcome = 'applied_delta') AS applied_delta,
 count(*) FILTER (outcome = 'applied_auxiliary') AS applied_auxiliary, count(*) FILTER (outcome = 'skipped_duplicate') AS skipped_duplicate, count(*) FILTER (outcome = 'unhandled_payload') AS unhandled_payload,
 count(*) FILTER (outcome = 'unscoped') AS unscoped, count(*) FILTER (applied AND lateness = 'on_time') AS on_time, count(*) FILTER (applied AND lateness = 'late') AS late,
 count(*) FILTER (applied AND lateness = 'undatable') AS undatable FROM marked GROUP BY run""")
def dispatch_counts(spark: SparkSession, d: str) -> DataFrame:
    return lateness.dispatch_counts(lateness.with_lateness(Replay(spark, d).outcomes))


@query(with_views("numbered", "arrivals") + "SELECT run, CAST(sum(gap) AS BIGINT) AS sequence_gaps FROM (SELECT run, coalesce(greatest(seq - lag(seq) OVER (PARTITION BY run ORDER BY seq) - 1, 0), 0) AS gap FROM arrivals) GROUP BY run")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return lateness.sequence_gaps(v.arrivals(spark, d))


@query(with_views("numbered", "arrivals") + """SELECT run, count(*) FILTER (received_time < high) AS received_time_regressions FROM
 (SELECT *, max(received_time) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM arrivals) GROUP BY run""")
def receive_regressions(spark: SparkSession, d: str) -> DataFrame:
    return lateness.receive_regressions(v.arrivals(spark, d))


@query(with_views("numbered", "arrivals") + "SELECT run, reason, count(*) AS count, min(seq) AS first_seq, max(seq) AS last_seq FROM arrivals WHERE kind = 'rejection' GROUP BY ALL")
def rejection_histogram(spark: SparkSession, d: str) -> DataFrame:
    return lateness.rejection_histogram(v.arrivals(spark, d))


LEDGER = """, ledger AS (SELECT run, seq, CASE WHEN row_number() OVER (PARTITION BY observation_id ORDER BY received_time, run, seq) = 1 THEN 'accepted_new' ELSE 'duplicate' END AS disposition FROM arrivals WHERE kind = 'delivery')
"""


@query(with_views("numbered", "arrivals") + LEDGER + "SELECT * FROM ledger")
def ledger_disposition(spark: SparkSession, d: str) -> DataFrame:
    return ledger.with_disposition(v.arrivals(spark, d).where("kind = 'delivery'")).select("run", "seq", "disposition")


@query(with_views("numbered", "arrivals") + LEDGER + """SELECT a.run, count(*) AS arrivals, count(*) FILTER (disposition = 'accepted_new') AS accepted, count(*) FILTER (disposition = 'duplicate') AS duplicates,
 count(*) FILTER (a.kind = 'rejection') AS rejected FROM arrivals a LEFT JOIN ledger USING (run, seq) GROUP BY a.run""")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    a = v.arrivals(spark, d)
    return lateness.run_counts(a, ledger.with_disposition(a.where("kind = 'delivery'")))


@query(with_views("numbered", "arrivals") + "SELECT run, seq, count(*) AS uses FROM (SELECT run, seq FROM arrivals UNION ALL SELECT run, seq FROM arrivals WHERE kind = 'rejection') GROUP BY ALL HAVING count(*) > 1")
def sequence_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rejections that were also booked as deliveries: planted by booking every arrival as one."""
    a = v.arrivals(spark, d)
    return ledger.sequence_violations(a, a.where("kind = 'rejection'"))


@query(with_views("numbered", "arrivals") + "SELECT run, min(received_time) AS started_at FROM arrivals WHERE run % 3 = 2 GROUP BY run")
def open_runs(spark: SparkSession, d: str) -> DataFrame:
    return ledger.open_runs(marks(v.arrivals(spark, d)))


@query(with_views("numbered", "arrivals") + "SELECT run, seq, observation_id FROM arrivals WHERE kind = 'delivery' AND token_id IS NULL")
def missing_observations(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries without an observation: the store here lacks the unscoped ones."""
    a = v.arrivals(spark, d).where("kind = 'delivery'")
    return ledger.missing_observations(a, a.where("token_id is not null").select("observation_id").distinct()).select("run", "seq", "observation_id")


@query(BOOK + """, found AS (
 SELECT run, token_id, 'delta_before_snapshot' AS anomaly, CAST(1 AS BIGINT) AS n FROM inputs WHERE segment = 0
 UNION ALL SELECT run, token_id, 'removal_of_absent_level', 1 FROM writes WHERE kind = 'remove' AND (before IS NULL OR before = 0)
 UNION ALL SELECT run, token_id, 'event_time_regression', 1 FROM (SELECT *, last_value(event_time IGNORE NULLS) OVER (PARTITION BY run, token_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM inputs WHERE segment > 0) WHERE event_time < b
 UNION ALL SELECT DISTINCT run, token_id, 'snapshot_disagrees:' || segment, 1 FROM (
   SELECT coalesce(p.run, s.run) AS run, coalesce(p.token_id, s.token_id) AS token_id, coalesce(p.segment, s.segment) AS segment, p.size AS had, s.size AS sent
   FROM (SELECT run, token_id, segment + 1 AS segment, side, price, size FROM writes WHERE until IS NULL AND size > 0) p
   FULL JOIN (SELECT run, token_id, segment, side, price, size FROM writes WHERE outcome = 'applied_snapshot' AND size > 0) s USING (run, token_id, segment, side, price))
   JOIN (SELECT run, token_id, segment FROM inputs WHERE outcome = 'applied_snapshot' AND segment > 1) USING (run, token_id, segment) WHERE had IS DISTINCT FROM sent
 UNION ALL SELECT run, token_id, 'scope_mismatch', 1 FROM outcomes WHERE outcome IN ('applied_snapshot', 'applied_delta') AND payload_token_id <> token_id)
SELECT run, token_id, k.anomaly, coalesce(sum(n), 0)::BIGINT AS count FROM (SELECT DISTINCT run, token_id FROM outcomes WHERE outcome IN ('applied_snapshot', 'applied_delta')) CROSS JOIN (VALUES ('delta_before_snapshot'), ('event_time_regression'), ('removal_of_absent_level'), ('scope_mismatch'), ('snapshot_disagrees')) k(anomaly)
 LEFT JOIN (SELECT run, token_id, split_part(anomaly, ':', 1) AS anomaly, n FROM found) USING (run, token_id, anomaly) GROUP BY ALL""")
def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d, shared=True)
    return book.anomaly_counts(book.anomalies(r.inputs, r.writes, r.outcomes), r.outcomes).select("run", "token_id", "anomaly", "count")


@query(BOOK + """SELECT o.run, o.token_id, count(*) FILTER (o.outcome = 'applied_snapshot' AND segment > 0) AS snapshots, count(*) FILTER (o.outcome = 'applied_delta' AND segment > 0) AS deltas, count(*) FILTER (coalesce(segment, 0) = 0) AS refused
 FROM outcomes o LEFT JOIN inputs i ON i.run = o.run AND i.seq = o.seq WHERE o.outcome IN ('applied_snapshot', 'applied_delta') GROUP BY ALL""")
def applied_counts(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d)
    return book.applied_counts(r.inputs, r.outcomes).select("run", "token_id", "snapshots", "deltas", "refused")


DIGESTS = """, lines AS (SELECT run, condition_id, token_id, string_agg(line, '|' ORDER BY line) AS l FROM (SELECT *, side || ':' || CAST(price AS VARCHAR) || ':' || CAST(size AS VARCHAR) AS line FROM final_levels) GROUP BY ALL),
digests AS (SELECT run, condition_id, token_id, sha256('7:book.v1|' || length(l) || ':' || l) AS book_digest FROM lines)
"""


@query(BOOK + DIGESTS + "SELECT run, token_id, book_digest FROM digests")
def book_digests(spark: SparkSession, d: str) -> DataFrame:
    return book.book_digests(book.final_levels(Replay(spark, d).writes)).select("run", "token_id", "book_digest")


STATES = """, parts AS (SELECT run, CAST('0x' || left(sha256(condition_id || ':' || token_id), 8) AS BIGINT) % 64 AS g, condition_id || ':' || token_id || ':' || book_digest AS line FROM digests),
hashed AS (SELECT run, g, count(*) AS n, g || ':' || sha256(string_agg(line, '|' ORDER BY line)) AS line FROM parts GROUP BY run, g), runs AS (SELECT run, sum(n)::BIGINT AS books, string_agg(line, '|' ORDER BY g) AS l FROM hashed GROUP BY run),
states_of AS (SELECT run, books, sha256('8:state.v2|' || length(l) || ':' || l) AS state_hash FROM runs)
"""


@query(BOOK + DIGESTS + STATES + "SELECT * FROM states_of")
def state_hashes(spark: SparkSession, d: str) -> DataFrame:
    return book.state_hashes(book.book_digests(book.final_levels(Replay(spark, d).writes)))


@query(BOOK + "SELECT run, token_id, arg_max(event_time, seq) FILTER (event_time IS NOT NULL) AS last_event_time FROM inputs WHERE segment > 0 GROUP BY ALL")
def last_event_times(spark: SparkSession, d: str) -> DataFrame:
    return book.last_seen(Replay(spark, d).inputs).select("run", "token_id", "last_event_time")


COUNTERS = """, gaps AS (SELECT run, CAST(sum(gap) AS BIGINT) AS sequence_gaps FROM (SELECT run, coalesce(greatest(seq - lag(seq) OVER (PARTITION BY run ORDER BY seq) - 1, 0), 0) AS gap FROM arrivals) GROUP BY run),
back AS (SELECT run, count(*) FILTER (received_time < high) AS received_time_regressions FROM (SELECT *, max(received_time) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM arrivals) GROUP BY run)
"""


@query(with_views("numbered", "arrivals", "dispatched", "level_ops", "segments", "final", "late") + DIGESTS + STATES + COUNTERS + """, ledger AS (SELECT run, seq, CASE WHEN row_number() OVER (PARTITION BY observation_id ORDER BY received_time, run, seq) = 1 THEN 'accepted_new' ELSE 'duplicate' END AS disposition FROM arrivals WHERE kind = 'delivery'),
counts AS (SELECT a.run, count(*) AS arrivals, count(*) FILTER (disposition = 'accepted_new') AS accepted, count(*) FILTER (disposition = 'duplicate') AS duplicates, count(*) FILTER (a.kind = 'rejection') AS rejected FROM arrivals a LEFT JOIN ledger USING (run, seq) GROUP BY a.run),
dispatch AS (SELECT run, count(*) FILTER (outcome = 'applied_snapshot') AS applied_snapshot, count(*) FILTER (outcome = 'applied_delta') AS applied_delta, count(*) FILTER (outcome = 'applied_auxiliary') AS applied_auxiliary, count(*) FILTER (outcome = 'skipped_duplicate') AS skipped_duplicate,
 count(*) FILTER (outcome = 'unhandled_payload') AS unhandled_payload, count(*) FILTER (outcome = 'unscoped') AS unscoped, count(*) FILTER (applied AND lateness = 'on_time') AS on_time, count(*) FILTER (applied AND lateness = 'late') AS late, count(*) FILTER (applied AND lateness = 'undatable') AS undatable FROM marked GROUP BY run)
SELECT *, CASE WHEN run % 3 = 2 THEN 'incomplete' ELSE 'completed' END AS completion_status FROM counts JOIN gaps USING (run) JOIN back USING (run) JOIN dispatch USING (run) JOIN states_of USING (run)""")
def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    return Replay(spark, d, shared=True).summary()


@query(BOOK + "SELECT run, count(*) AS levels, count(*) AS merged_levels, CAST(0 AS BIGINT) AS differing FROM final_levels GROUP BY run")
def replay_determinism(spark: SparkSession, d: str) -> DataFrame:
    """Per run: final levels of the fold by segments, of the merge of last writes in two batches, and
    those on which they differ."""
    from bookreplay.streaming.book_stream import merge_levels

    r = Replay(spark, d, shared=True)
    key = ["run", "condition_id", "token_id"]
    accepted = r.ops.join(r.inputs.where("segment > 0").select(*key, "seq"), [*key, "seq"], "left_semi")
    resets = r.inputs.where("outcome = 'applied_snapshot'").select(*key, "seq")
    nothing = accepted.limit(0).withColumn("reset_seq", F.lit(None).cast("long"))
    half = merge_levels(nothing, accepted.where("seq < 1200"), resets.where("seq < 1200"))
    other = merge_levels(half, accepted.where("seq >= 1200"), resets.where("seq >= 1200")).where("size > 0").select(*key, "side", "price", "size")
    ours, other = stored(book.final_levels(r.writes), "levels"), stored(other, "levels")
    n = lambda df, name: df.groupBy("run").agg(F.count(F.lit(1)).alias(name))
    off = n(book.level_differences(ours, other), "differing")
    return n(ours, "levels").join(n(other, "merged_levels"), "run", "full_outer").join(off, "run", "left").fillna(0, ["levels", "merged_levels", "differing"])


@query(with_views("numbered") + """, f AS (SELECT run, seq, ts, k, row_number() OVER w AS n, sum(k + 100) OVER w AS bytes, epoch_us(ts) - epoch_us(first_value(ts) OVER w) AS us FROM numbered WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT *, CASE WHEN us > 3600000000 * 24 THEN 'duration' WHEN n > 2000 THEN 'frames' WHEN bytes > 250000 THEN 'bytes' END AS why FROM f), b AS (SELECT *, min(CASE WHEN why IS NOT NULL THEN seq END) OVER (PARTITION BY run) AS stop FROM o)
SELECT run, seq AS frame_no, (stop IS NULL OR seq < stop) AS kept, CASE WHEN seq = stop THEN why END AS stop_reason FROM b""")
def bounded_prefix(spark: SparkSession, d: str) -> DataFrame:
    f = v.numbered(spark, d).select("run", F.col("seq").alias("frame_no"), F.col("ts").alias("received_time"), (F.col("k") + 100).alias("byte_length"))
    return lateness.bounded_prefix(f, 86_400, 2000, 250_000).select("run", "frame_no", "kept", "stop_reason")


CHANGES = with_views("numbered", "arrivals", "dispatched", "level_ops", "segments", "top", "trades") + """, moved AS (SELECT DISTINCT run, seq FROM writes WHERE outcome = 'applied_delta' AND coalesce(before, 0) IS DISTINCT FROM size),
differs AS (SELECT DISTINCT i.run, i.seq FROM (SELECT coalesce(p.run, s.run) AS run, coalesce(p.token_id, s.token_id) AS token_id, coalesce(p.segment, s.segment) AS segment, p.size AS had, s.size AS sent
   FROM (SELECT run, token_id, segment + 1 AS segment, side, price, size FROM writes WHERE until IS NULL AND size > 0) p
   FULL JOIN (SELECT run, token_id, segment, side, price, size FROM writes WHERE outcome = 'applied_snapshot' AND size > 0) s USING (run, token_id, segment, side, price)) x
   JOIN inputs i ON i.outcome = 'applied_snapshot' AND i.segment > 1 AND i.run = x.run AND i.token_id = x.token_id AND i.segment = x.segment WHERE had IS DISTINCT FROM sent),
seg AS (SELECT o.run, o.seq, o.condition_id, o.token_id, o.outcome, o.event_time, o.received_time, coalesce(last_value(i.segment IGNORE NULLS) OVER (PARTITION BY o.run, o.token_id ORDER BY o.seq), 0) AS segment FROM outcomes o LEFT JOIN inputs i ON i.run = o.run AND i.seq = o.seq WHERE o.applied),
changes AS (SELECT s.*, CASE WHEN segment = 0 THEN false WHEN outcome = 'applied_auxiliary' OR (run, seq) IN (SELECT (run, seq) FROM trades) THEN true WHEN row_number() OVER (PARTITION BY run, token_id, segment > 0 ORDER BY seq) = 1 THEN true
  WHEN outcome = 'applied_snapshot' THEN (run, seq) IN (SELECT (run, seq) FROM differs) ELSE (run, seq) IN (SELECT (run, seq) FROM moved) END AS changed FROM seg s),
quotes AS (SELECT * FROM (SELECT c.*, last_value(CASE WHEN c.outcome <> 'applied_auxiliary' THEN t.seq END IGNORE NULLS) OVER (PARTITION BY c.run, c.token_id ORDER BY c.seq) AS book_seq,
  last_value(r.price IGNORE NULLS) OVER (PARTITION BY c.run, c.token_id ORDER BY c.seq) AS last_trade FROM changes c LEFT JOIN tops t ON t.run = c.run AND t.seq = c.seq LEFT JOIN trades r ON r.run = c.run AND r.seq = c.seq) WHERE segment > 0),
states AS (SELECT q.*, (t.best_bid + t.best_ask) / 2 AS midpoint, t.best_ask - t.best_bid AS spread, t.event_time AS book_event_time FROM quotes q LEFT JOIN tops t ON t.run = q.run AND t.seq = q.book_seq AND t.token_id = q.token_id),
emitted AS (SELECT *, last_value(midpoint IGNORE NULLS) OVER (PARTITION BY run, token_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_midpoint FROM states WHERE changed),
forecasts AS (SELECT run, seq, token_id, condition_id, received_time, method, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, 'midpoint' AS method, CAST(midpoint AS DOUBLE) AS score FROM emitted UNION ALL SELECT *, 'last_trade', CAST(last_trade AS DOUBLE) FROM emitted
  UNION ALL SELECT *, 'displayed_price', CASE WHEN spread > 0.10 THEN CAST(last_trade AS DOUBLE) ELSE CAST(midpoint AS DOUBLE) END FROM emitted UNION ALL SELECT *, 'persistence', CAST(previous_midpoint AS DOUBLE) FROM emitted))
"""


@query(CHANGES + "SELECT run, seq, changed FROM changes")
def information_changes(spark: SparkSession, d: str) -> DataFrame:
    return Replay(spark, d, shared=True).changes().select("run", "seq", "changed")


@query(CHANGES + "SELECT run, seq, method, round(score, 9) AS score, score IS NULL AS abstained FROM forecasts")
def forecasts(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecasts(forecast.emitted(Replay(spark, d, shared=True).states())).select("run", "seq", "method", "abstained", *dbl("score"))


@query(CHANGES + """SELECT method, CASE method WHEN 'midpoint' THEN 'no_two_sided_book' WHEN 'last_trade' THEN 'no_last_trade' WHEN 'displayed_price' THEN 'no_displayed_price' ELSE 'no_prior_forecast' END AS abstention_reason,
 count(*) AS count FROM forecasts WHERE score IS NULL GROUP BY ALL""")
def abstention_counts(spark: SparkSession, d: str) -> DataFrame:
    return forecast.abstention_counts(forecast.forecasts(forecast.emitted(Replay(spark, d, shared=True).states())))


@query(CHANGES + """SELECT o.run, CASE WHEN o.kind <> 'delivery' THEN 'rejected_arrival' WHEN o.outcome = 'skipped_duplicate' THEN 'duplicate_observation' WHEN o.outcome = 'unhandled_payload' THEN 'unhandled_payload' WHEN o.outcome = 'unscoped' THEN 'unscoped_observation'
 WHEN o.token_id % 3 <> 0 THEN 'irrelevant_scope' WHEN coalesce(c.segment, 0) = 0 THEN 'target_not_seeded' WHEN NOT c.changed THEN 'target_state_unchanged' ELSE 'included_information_change' END AS decision, count(*) AS count
 FROM outcomes o LEFT JOIN changes c ON c.run = o.run AND c.seq = o.seq GROUP BY ALL""")
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d, shared=True)
    found = forecast.decisions(r.outcomes, r.changes(), F.col("token_id") % 3 == 0)
    return found.groupBy("run", "decision").agg(F.count(F.lit(1)).alias("count"))


@query(CHANGES + """, times AS (SELECT *, NOT (lag(book_event_time) OVER w IS NOT DISTINCT FROM book_event_time) AS fresh, last_value(CASE WHEN changed THEN midpoint END IGNORE NULLS) OVER (PARTITION BY run, token_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_midpoint FROM states WINDOW w AS (PARTITION BY run, token_id ORDER BY seq))
SELECT run, token_id, max(seq) AS seq, round(CAST(arg_max(midpoint, seq) FILTER (midpoint IS NOT NULL AND seq = top) AS DOUBLE), 9) AS midpoint FROM
 (SELECT *, max(seq) OVER (PARTITION BY run, token_id) AS top FROM times WHERE (changed OR fresh) AND received_time < TIMESTAMP '2024-01-20 00:00:00') GROUP BY ALL""")
def frozen_states(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d, shared=True)
    closes = r.inputs.select(*book.KEY).distinct().withColumn("close_at", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return forecast.frozen(r.states(), closes).select("run", "token_id", "seq", *dbl("midpoint"))


EVALUATED = """, resolutions AS (SELECT DISTINCT user_id // 2 AS condition_id FROM events), res AS (SELECT condition_id, 2 * condition_id + condition_id % 2 AS winner, CASE WHEN condition_id % 7 <> 0 THEN TIMESTAMP '2024-01-25 00:00:00' END AS resolved_at FROM resolutions),
seen AS (SELECT run, coalesce(seq - lag(seq) OVER (PARTITION BY run ORDER BY seq) - 1, 0) > 0 OR received_time < max(received_time) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR outcome = 'unhandled_payload' AS odd FROM outcomes),
broken AS (SELECT run, bool_or(coalesce(odd, false)) AS broken FROM seen GROUP BY run),
evaluated AS (SELECT f.*, CASE WHEN winner = token_id THEN 1 ELSE 0 END AS outcome, CASE WHEN score IS NULL THEN 'abstained' WHEN run % 3 = 2 THEN 'capture_incomplete' WHEN condition_id % 4 = 0 THEN 'contract_identity_missing'
 WHEN resolved_at IS NULL THEN 'resolution_time_unknown' WHEN broken THEN 'replay_integrity' WHEN received_time >= resolved_at THEN 'post_resolution' END AS exclusion FROM forecasts f JOIN res USING (condition_id) JOIN broken USING (run))
"""


def contracts(r: Replay) -> DataFrame:
    res = v.resolutions(r.spark, r.d)
    return res.where("condition_id % 4 <> 0").select("condition_id", F.concat(F.lit("contract-"), F.col("condition_id").cast("string")).alias("contract_id"))


def evaluated(r: Replay) -> DataFrame:
    f = forecast.forecasts(forecast.emitted(r.states()))
    return evaluate.evaluated(f, v.resolutions(r.spark, r.d), contracts(r), r.counters())


@query(CHANGES + EVALUATED + "SELECT method, coalesce(exclusion, 'scored') AS exclusion, count(*) AS count FROM evaluated GROUP BY ALL")
def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(Replay(spark, d, shared=True)).groupBy("method", F.coalesce("exclusion", F.lit("scored")).alias("exclusion")).agg(F.count(F.lit(1)).alias("count"))


@query(CHANGES + EVALUATED + """SELECT run, method, count(*) AS forecasts, count(*) FILTER (exclusion IS NULL) AS scored, round(avg((score - outcome) ** 2) FILTER (exclusion IS NULL), 9) AS mean_brier,
 round(avg(-ln(CASE WHEN outcome = 1 THEN greatest(least(score, 1 - 1e-6), 1e-6) ELSE 1 - greatest(least(score, 1 - 1e-6), 1e-6) END)) FILTER (exclusion IS NULL), 9) AS mean_log_loss FROM evaluated GROUP BY ALL""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.run_report(evaluated(Replay(spark, d, shared=True))).select("run", "method", "forecasts", "scored", *dbl("mean_brier", "mean_log_loss"))


@query(CHANGES + EVALUATED + """SELECT run, token_id, method, arg_max(seq, (received_time, seq)) AS seq, round(arg_max(score, (received_time, seq)), 9) AS score FROM evaluated WHERE exclusion IS NULL GROUP BY ALL""")
def target_contributions(spark: SparkSession, d: str) -> DataFrame:
    e = evaluated(Replay(spark, d, shared=True)).where("exclusion is null").withColumn("target_id", F.struct("run", "token_id"))
    return scoring.target_contributions(e).select("run", "token_id", "method", "seq", *dbl("score"))


@query(CHANGES + EVALUATED + """SELECT 'unaccounted' AS violation, count(*) AS count FROM evaluated WHERE exclusion IS NULL AND seq % 97 = 0 HAVING count(*) > 0
 UNION ALL SELECT unnest(['scored_and_excluded', 'more_than_once']), count(*) FROM evaluated WHERE exclusion IS NOT NULL AND seq % 89 = 0 HAVING count(*) > 0
 UNION ALL SELECT 'unknown_forecast', count(*) FROM evaluated WHERE exclusion IS NOT NULL AND seq % 83 = 0 HAVING count(*) > 0""")
def forecast_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts that aren't accounted for exactly once. Damage is planted: of the scored ones every 97th
    is lost, of the excluded ones every 89th is listed as scored too and every 83rd under a strange id."""
    e = stored(evaluated(Replay(spark, d, shared=True)).select("forecast_id", "exclusion", "seq"), "evaluated")
    out, kept = e.where("exclusion is not null"), e.where("exclusion is null and seq % 97 <> 0")
    scored = kept.unionByName(out.where("seq % 89 = 0"))
    strange = out.where("seq % 83 = 0").withColumn("forecast_id", F.concat(F.lit("x"), "forecast_id"))
    return scoring.accounting_violations(e, scored, out.unionByName(strange)).groupBy("violation").agg(F.count(F.lit(1)).alias("count"))


SCORED = "WITH s AS (SELECT doc_id, (n_chars % 101) / 100.0 AS score, quality AS outcome, lang, source FROM labels JOIN documents USING (doc_id)), b AS (SELECT *, least(floor((n_chars % 101) * 10 / 100.0), 9)::INTEGER AS bin FROM (SELECT doc_id, n_chars, (n_chars % 101) / 100.0 AS score, quality AS outcome, lang, source FROM labels JOIN documents USING (doc_id)))\n"


@query(SCORED + """SELECT doc_id AS target_id, round((score - outcome) ** 2, 9) AS brier, round(abs(score - outcome), 9) AS absolute_error, round(-ln(CASE WHEN outcome = 1 THEN greatest(least(score, 1 - 1e-6), 1e-6) ELSE 1 - greatest(least(score, 1 - 1e-6), 1e-6) END), 9) AS log_loss,
 (score < 1e-6 OR score > 1 - 1e-6) AS clipped FROM s""")
def forecast_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_scores(v.scored(spark, d)).select("target_id", "clipped", *dbl("brier", "absolute_error", "log_loss"))


@query(SCORED + """, bins AS (SELECT lang, bin, count(*) AS count, round(avg(score), 9) AS mean_score, round(avg(outcome), 9) AS observed_rate FROM b GROUP BY ALL)
SELECT l.lang, r.bin::INTEGER AS bin, coalesce(count, 0) AS count, mean_score, observed_rate FROM (SELECT DISTINCT lang FROM b) l CROSS JOIN range(10) r(bin) LEFT JOIN bins ON bins.lang = l.lang AND bins.bin = r.bin""")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.calibration_bins(v.scored(spark, d), ["lang"])
    return found.select("lang", "bin", "count", *dbl("mean_score", "observed_rate"))


REPORT = """SELECT dimension, slice, count(*) AS sample_count, round(avg((score - outcome) ** 2), 9) AS mean_brier FROM (SELECT *, 'lang' AS dimension, coalesce(lang, 'unknown') AS slice FROM b UNION ALL SELECT *, 'source', coalesce(source, 'unknown') FROM b) GROUP BY ALL"""


@query(SCORED + ", means AS (" + REPORT + """), gaps AS (SELECT dimension, slice, sum(n * abs(m - o)) / sum(n) AS ece FROM (SELECT dimension, slice, bin, count(*) AS n, avg(score) AS m, avg(outcome) AS o FROM
 (SELECT *, 'lang' AS dimension, coalesce(lang, 'unknown') AS slice FROM b UNION ALL SELECT *, 'source', coalesce(source, 'unknown') FROM b) GROUP BY ALL) GROUP BY ALL)
SELECT dimension, slice, sample_count, mean_brier, round(ece, 9) AS ece FROM means JOIN gaps USING (dimension, slice)""")
def calibration_slices(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.slices(scoring.with_scores(v.scored(spark, d)), ["lang", "source"])
    return found.select("dimension", "slice", "sample_count", *dbl("mean_brier", "ece"))


@query(with_views("numbered", "arrivals", "dispatched", "level_ops", "segments", "top") + """SELECT CASE WHEN s IS NULL THEN 'unknown' WHEN s <= 0.01 THEN '0-1c' WHEN s <= 0.05 THEN '1-5c' WHEN s <= 0.10 THEN '5-10c' ELSE 'over-10c' END AS bucket,
 CASE WHEN h <= 0 THEN 'after-resolution' WHEN h < 1 THEN 'under-1h' WHEN h < 24 THEN '1h-1d' WHEN h < 168 THEN '1d-7d' WHEN h IS NULL THEN 'unknown' ELSE 'over-7d' END AS lead, count(*) AS count
 FROM (SELECT CAST(best_ask - best_bid AS DOUBLE) AS s, (epoch_us(TIMESTAMP '2024-01-25 00:00:00') - epoch_us(event_time)) / 3600000000.0 AS h FROM tops) GROUP BY ALL""")
def quote_buckets(spark: SparkSession, d: str) -> DataFrame:
    r = Replay(spark, d, keep=("inputs", "writes"))
    top = book.with_midpoint(book.top_of_book(r.inputs, r.writes)).join(r.inputs.select("run", "seq", "event_time"), ["run", "seq"])
    lead = scoring.lead_bucket(F.col("event_time"), F.lit("2024-01-25 00:00:00").cast("timestamp"))
    return top.groupBy(scoring.spread_bucket(F.col("spread")).alias("bucket"), lead.alias("lead")).agg(F.count(F.lit(1)).alias("count"))


MARKETS = """WITH m AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority AS category, o_totalprice AS volume, CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice END AS liquidity, o_orderstatus <> 'P' AS active,
 o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS closed, o_orderkey % 29 = 0 AS archived, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS end_time, o_orderkey % 23 = 0 AS three, o_orderkey % 23 <> 0 AND o_orderkey % 19 = 0 AS odd FROM orders),
j AS (SELECT *, CASE WHEN three THEN 'not_binary' WHEN odd THEN 'nonstandard_outcomes' WHEN NOT active THEN 'not_active' WHEN closed THEN 'closed' WHEN archived THEN 'archived' WHEN coalesce(liquidity, 0) < 20000 THEN 'below_min_liquidity'
 WHEN volume < 30000 THEN 'below_min_volume' WHEN end_time IS NULL THEN 'no_end_time' WHEN end_time <= TIMESTAMP '1995-06-01 00:00:00' THEN 'already_ended' WHEN (epoch_us(end_time) - epoch_us(TIMESTAMP '1995-06-01 00:00:00')) / 3600000000.0 < 48 THEN 'ends_too_soon' END AS exclusion FROM m)
"""
POLICY = selection.Policy(min_liquidity=20_000, min_volume=30_000, min_hours_to_end=48)
AS_OF = "1995-06-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query(MARKETS + "SELECT CAST(k AS VARCHAR) AS market_id, coalesce(exclusion, 'selected') AS decision FROM j")
def market_selection(spark: SparkSession, d: str) -> DataFrame:
    return selection.with_exclusion(v.markets(spark, d), POLICY, as_of()).select("market_id", F.coalesce("exclusion", F.lit("selected")).alias("decision"))


@query(MARKETS + "SELECT coalesce(exclusion, 'selected') AS reason, count(*) AS count FROM j GROUP BY ALL")
def selection_counts(spark: SparkSession, d: str) -> DataFrame:
    return selection.exclusion_counts(selection.with_exclusion(v.markets(spark, d), POLICY, as_of()))


@query(MARKETS + """SELECT CAST(k AS VARCHAR) AS market_id, concat_ws('|', CASE WHEN k % 7 = 0 THEN 'resolution_source_missing' END, CASE WHEN k % 11 = 0 THEN 'description_missing' END, CASE WHEN end_time IS NULL THEN 'end_boundary_missing' END,
 CASE WHEN three THEN 'non_binary_outcomes' END, CASE WHEN odd THEN 'nonstandard_outcome_labels' END, CASE WHEN closed THEN 'already_closed' END, 'conditions_not_extracted') AS flags FROM j""")
def contract_flags(spark: SparkSession, d: str) -> DataFrame:
    return selection.contracts(v.markets(spark, d)).select("market_id", F.array_join("ambiguity_flags", "|").alias("flags"))


@query(MARKETS + """SELECT CAST(k AS VARCHAR) AS market_id, exclusion IS NULL AS in_scope, concat_ws('|', CASE WHEN closed THEN 'closed' END, CASE WHEN NOT active THEN 'not_active' END, CASE WHEN k % 37 = 0 THEN 'no_tokens' END,
 CASE WHEN end_time IS NULL THEN 'no_end_time' END, CASE WHEN k % 77 = 0 THEN 'unverifiable' END) AS blockers FROM j""")
def market_audits(spark: SparkSession, d: str) -> DataFrame:
    return selection.market_audit(v.markets(spark, d), POLICY, as_of()).select("market_id", "in_scope", F.array_join("capture_blockers", "|").alias("blockers"))


def strata(spark: SparkSession) -> DataFrame:
    """Bands of the protocol: two liquidity bands per category."""
    rows = [(f"{c[0]}-{i}", c, float(lo), hi, 0.0, None, 0, None, 5) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM") for i, (lo, hi) in enumerate(((20_000, 150_000.0), (120_000, None)))]
    names = "stratum_id string, category string, min_liquidity double, max_liquidity double, min_spread double, max_spread double, min_horizon_s long, max_horizon_s long, max_targets int"
    return spark.createDataFrame(rows, names)


@query(MARKETS + """SELECT CAST(k AS VARCHAR) AS market_id, CASE WHEN category IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND end_time IS NOT NULL THEN CASE WHEN liquidity >= 20000 AND liquidity < 150000 THEN left(category, 1) || '-0' WHEN liquidity >= 120000 THEN left(category, 1) || '-1' END END AS stratum_id FROM m
 WHERE end_time IS NULL OR epoch_us(end_time) >= epoch_us(TIMESTAMP '1990-01-01 00:00:00')""")
def stratum_matches(spark: SparkSession, d: str) -> DataFrame:
    m = v.markets(spark, d).select("market_id", "category", F.col("liquidity").cast("double").alias("liquidity"), F.lit(0.0).alias("spread"), "end_time")
    horizon = micros(F.col("end_time"), F.lit("1990-01-01 00:00:00").cast("timestamp")) / 1_000_000
    return selection.matching_strata(m.withColumn("horizon_s", horizon).drop("end_time"), strata(spark)).select("market_id", "stratum_id")


@query(MARKETS + """, used AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 101 = 0) SELECT CAST(k AS VARCHAR) AS market_id, CASE WHEN o_custkey IN (SELECT o_custkey FROM used) THEN 'custkey_already_used' END AS already_used FROM m""")
def used_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = v.markets(spark, d)
    return selection.with_used(m, m.where("cast(market_id as long) % 101 = 0"), ["custkey"]).select("market_id", "already_used")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    held = selection.canonical_identities(selection.with_exclusion(v.markets(spark, d), POLICY, as_of()))
    return held.select("market_key", "category", "liquidity", "exclusion", "custkey", "condition_key")


#: Greedy choice as a recursion: each step takes the next candidate in order that nothing chosen forbids.
GREEDY = """, ranked AS (SELECT k, category, o_custkey, stratum, row_number() OVER (PARTITION BY category ORDER BY coalesce(liquidity, 0) DESC, length(CAST(k AS VARCHAR)), CAST(k AS VARCHAR)) AS pref FROM eligible WHERE exclusion IS NULL),
pick(category, n, keys, strata, pref) AS (SELECT category, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM ranked GROUP BY category
 UNION ALL SELECT p.category, n + 1, list_append(any_value(keys), arg_min(o_custkey, r.pref)), list_append(any_value(strata), arg_min(stratum, r.pref)), min(r.pref) FROM pick p JOIN ranked r ON r.category = p.category AND r.pref > p.pref
  AND NOT list_contains(keys, r.o_custkey) AND len(list_filter(strata, lambda x: x = r.stratum)) < {most} WHERE n < {quota} GROUP BY p.category, n),
ends AS (SELECT category, max(n) AS n, max(pref) AS last FROM pick GROUP BY category),
told AS (SELECT r.*, ends.n, last, EXISTS (SELECT 1 FROM pick p WHERE p.category = r.category AND p.pref = r.pref) AS chosen, (SELECT count(*) FROM pick p JOIN ranked q ON q.category = p.category AND q.pref = p.pref WHERE p.category = r.category AND q.stratum = r.stratum AND p.pref < r.pref) AS of_stratum FROM ranked r JOIN ends USING (category))
"""
BLOCKS = "WITH RECURSIVE" + MARKETS.removeprefix("WITH")


@query(BLOCKS + ", eligible AS (SELECT *, '' AS stratum FROM j)" + GREEDY.format(quota=12, most=1000) + """SELECT CAST(j.k AS VARCHAR) AS market_key, j.category, coalesce(j.exclusion, CASE WHEN chosen THEN CASE WHEN n < 12 THEN 'block_shortfall' ELSE 'selected' END WHEN n = 12 AND pref > last THEN 'quota_full' ELSE 'identity_conflict' END) AS decision FROM j LEFT JOIN told ON told.k = j.k""")
def block_selection(spark: SparkSession, d: str) -> DataFrame:
    found = selection.select_blocks(candidates(spark, d), "category", 12, ["custkey", "condition_key"])
    return found.select("market_key", "category", "decision")


BLOCK_SECONDS, SLOT_SECONDS = 5 * 86_400, 18 * 3600


def cohort(spark: SparkSession, d: str) -> DataFrame:
    """Markets as candidates of five experiments of three blocks each: a market's tokens stand in either
    place and are spelled with leading zeros or without; one experiment's first block has no candidate."""
    m = selection.with_exclusion(v.markets(spark, d), POLICY, as_of())
    k = F.col("market_id").cast("long")
    tokens = F.map_from_arrays(F.array(F.lit("Yes"), F.lit("No")), F.array(F.concat(F.lit("00"), (k % 700).cast("string")), ((k * 7 + 3) % 700).cast("string")))
    m = m.withColumns({"outcome_token_map": tokens, "condition_id": F.concat(F.lit("C"), (k % 900).cast("string")), "experiment_id": F.col("category"), "block_no": (k % 3 + 1).cast("int")})
    m = m.withColumn("exclusion", F.coalesce("exclusion", F.when((F.col("category") == "5-LOW") & (F.col("block_no") == 1), "not_listed")))
    held = selection.canonical_identities(m)
    return held.select("market_key", "event_key", "condition_key", "token_keys", "experiment_id", "category", "block_no", "liquidity", "exclusion", "end_time", "custkey", (k % 700).cast("string").alias("token_key"))


def cohort_blocks(spark: SparkSession, candidates_: DataFrame) -> DataFrame:
    """Five days a block, four targets each; selection takes place later in the second and third block."""
    at = F.lit("2024-01-05 00:00:00").cast("timestamp") + F.make_interval(secs=(F.col("block_no") - 1) * BLOCK_SECONDS + F.when(F.col("block_no") == 1, 0).when(F.col("block_no") == 2, 3 * 86_400).otherwise(86_400))
    ends = F.lit("2024-01-05 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("block_no") * BLOCK_SECONDS)
    held = candidates_.select("experiment_id").distinct().withColumn("block_no", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumns({"selected_at": at, "ends_at": ends})
    return held.withColumn("capacity", selection.capacity(F.lit(4), F.col("ends_at"), F.col("selected_at"), SLOT_SECONDS))


COHORT = BLOCKS + """, pool AS (SELECT k, category, o_custkey, k % 3 + 1 AS block_no, coalesce(liquidity, 0) AS liquid, liquidity, end_time, coalesce(exclusion, CASE WHEN category = '5-LOW' AND k % 3 = 0 THEN 'not_listed' END) AS exclusion,
 list_distinct(['market:' || k, 'event:' || o_custkey, 'condition:c' || (k % 900), 'token:' || (k % 700), 'token:' || ((k * 7 + 3) % 700)]) AS own FROM j)"""
#: The fold as a recursion: the next candidate, in order of block, that no identity and no limit forbids.
FOLD = """, pick(category, n, keys, lims, pref) AS (SELECT category, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM ranked GROUP BY category
 UNION ALL SELECT p.category, n + 1, list_concat(any_value(keys), arg_min(r.ids, r.pref)), list_concat(any_value(lims), ['block:' || arg_min(r.block_no, r.pref), 'stratum:' || arg_min(r.stratum, r.pref)]), min(r.pref) FROM pick p JOIN ranked r ON r.category = p.category AND r.pref > p.pref
  AND NOT list_has_any(keys, r.ids) AND len(list_filter(lims, lambda x: x = 'block:' || r.block_no)) < r.capacity AND len(list_filter(lims, lambda x: x = 'stratum:' || r.stratum)) < r.most GROUP BY p.category, n),
told AS (SELECT r.k, any_value(r.ids) AS ids, any_value(r.stratum) AS stratum, any_value(r.most) AS most, any_value(r.block_no) AS block_no, arg_max(p.keys, p.pref) AS used, arg_max(p.lims, p.pref) AS lims FROM ranked r LEFT JOIN pick p ON p.category = r.category AND p.pref < r.pref GROUP BY r.k),
chosen AS (SELECT r.k, r.category, r.block_no FROM ranked r JOIN pick p ON p.category = r.category AND p.pref = r.pref)
"""


@query(COHORT + """, ranked AS (SELECT k, category, block_no, own AS ids, CASE block_no WHEN 2 THEN 2 ELSE 4 END AS capacity, '' AS stratum, 1000000 AS most, row_number() OVER (PARTITION BY category ORDER BY block_no, liquid DESC, length(CAST(k AS VARCHAR)), CAST(k AS VARCHAR)) AS pref FROM pool WHERE exclusion IS NULL)""" + FOLD + """,
short AS (SELECT b.category, min(b.block_no) AS first FROM (SELECT DISTINCT category, unnest([1, 2, 3]) AS block_no FROM pool) b LEFT JOIN (SELECT category, block_no, count(*) AS n FROM chosen GROUP BY ALL) c USING (category, block_no) WHERE coalesce(n, 0) < CASE b.block_no WHEN 2 THEN 2 ELSE 4 END GROUP BY b.category)
SELECT CAST(p.k AS VARCHAR) AS market_key, p.category AS experiment_id, p.block_no::INTEGER AS block_no, coalesce(exclusion, CASE WHEN p.block_no > first THEN 'predecessor_rejected' WHEN p.k IN (SELECT k FROM chosen) THEN CASE WHEN p.block_no = first THEN 'block_shortfall' ELSE 'selected' END
 WHEN list_has_any(list_filter(ids, lambda x: x LIKE 'event:%'), used) THEN 'event_id_reused' WHEN list_has_any(ids, used) THEN 'market_identity_reused' ELSE 'rank_below_cutoff' END) AS decision FROM pool p LEFT JOIN told USING (k) LEFT JOIN short USING (category)""")
def ordered_block_selection(spark: SparkSession, d: str) -> DataFrame:
    """Blocks all or nothing, in order: what an admitted block took is used up for the next ones."""
    c = cohort(spark, d)
    return selection.select_in_order(c, cohort_blocks(spark, c), partial=False).select("market_key", "experiment_id", "block_no", "decision")


def protocol_strata(spark: SparkSession) -> DataFrame:
    """Bands of the protocol: two for each of four categories, by liquidity, spread and horizon."""
    low, high = (20_000.0, 150_000.0, 0.0, 0.15, 0, None, 4), (120_000.0, None, 0.05, None, 30 * 86_400, None, 5)
    rows = [(f"{c[0]}-{i}", c, *x) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW") for i, x in enumerate((low, high))]
    names = "stratum_id string, category string, min_liquidity double, max_liquidity double, min_spread double, max_spread double, min_horizon_s long, max_horizon_s long, max_targets int"
    return spark.createDataFrame(rows, names)


#: Days from an order's date to when its market's outcome may be known.
KNOWABLE_DAYS = 11_000


@query(COHORT + """, timed AS (SELECT *, TIMESTAMP '2024-01-05 00:00:00' + to_seconds((block_no - 1) * 432000 + CASE block_no WHEN 1 THEN 0 WHEN 2 THEN 259200 ELSE 86400 END) AS chosen_at FROM pool),
books AS (SELECT user_id AS token, ts, event_type = 'error' AS failed, CAST((k % 20) / 100.0 + 0.2 AS DECIMAL(12,10)) AS bid, CAST((k * 3 % 20) / 100.0 + 0.3 AS DECIMAL(12,10)) AS ask, k FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)),
seen AS (SELECT t.k, max((epoch_us(b.ts), b.failed, b.bid, b.ask)) AS b FROM timed t JOIN books b ON b.token = t.k % 700 AND b.ts <= t.chosen_at GROUP BY t.k),
priced AS (SELECT t.*, CASE WHEN b IS NULL THEN 'book_unavailable' WHEN epoch_us(chosen_at) - b[1] > 21600000000 THEN 'book_stale' WHEN b[2] THEN 'book_unavailable' WHEN b[4] - b[3] <= 0 THEN 'book_invalid' END AS unpriced, b[4] - b[3] AS gap, (epoch_us(end_time + INTERVAL 11000 DAY) - epoch_us(chosen_at)) / 1000000 AS horizon FROM timed t LEFT JOIN seen USING (k)),
banded AS (SELECT * REPLACE (coalesce(exclusion, unpriced, CASE WHEN stratum_id IS NULL THEN 'no_stratum' END) AS exclusion) FROM (SELECT *, CASE WHEN category IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AND unpriced IS NULL THEN CASE WHEN liquidity >= 20000 AND liquidity < 150000 AND gap < 0.15 AND horizon >= 0 THEN left(category, 1) || '-0' WHEN liquidity >= 120000 AND gap >= 0.05 AND horizon >= 2592000 THEN left(category, 1) || '-1' END END AS stratum_id FROM priced)),
ranked AS (SELECT k, category, block_no, list_append(own, 'group:' || (o_custkey % 200)) AS ids, CASE block_no WHEN 2 THEN 2 ELSE 4 END AS capacity, stratum_id AS stratum, CASE WHEN stratum_id LIKE '%-0' THEN 4 ELSE 5 END AS most,
 row_number() OVER (PARTITION BY category ORDER BY block_no, stratum_id, liquid DESC, length(CAST(k AS VARCHAR)), CAST(k AS VARCHAR)) AS pref FROM banded WHERE exclusion IS NULL)""" + FOLD + """
SELECT CAST(p.k AS VARCHAR) AS market_key, p.category AS experiment_id, p.block_no::INTEGER AS block_no, p.stratum_id, coalesce(exclusion, CASE WHEN p.k IN (SELECT k FROM chosen) THEN 'selected' WHEN list_has_any(list_filter(ids, lambda x: x NOT LIKE 'group:%'), used) THEN 'identity_reused'
 WHEN list_has_any(ids, used) THEN 'event_group_reused' WHEN len(list_filter(lims, lambda x: x = 'stratum:' || stratum)) >= most THEN 'stratum_quota' ELSE 'block_capacity' END) AS decision FROM banded p LEFT JOIN told USING (k)""")
def stratified_block_selection(spark: SparkSession, d: str) -> DataFrame:
    """Partial blocks with quotas: spread from the token's latest book, no older than six hours at selection,
    horizon from the outcome's date, and a capacity from the time that is left of a block."""
    c = cohort(spark, d)
    blocks = stored(cohort_blocks(spark, c), "blocks")
    e = v.table(spark, d, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("long"))
    price = lambda x, plus: (x / 100 + plus).cast("decimal(12,10)")
    books = e.select(F.col("user_id").cast("string").alias("token_key"), F.col("ts").alias("observed_at"), price(F.col("k") % 20, 0.2).alias("best_bid"), price(F.col("k") * 3 % 20, 0.3).alias("best_ask"), (F.col("event_type") == "error").alias("failed"))
    held = selection.with_fresh_spread(c.join(blocks.select("experiment_id", "block_no", "selected_at"), ["experiment_id", "block_no"]), books, 6 * 3600)
    horizon = micros(F.col("end_time") + F.make_interval(days=F.lit(KNOWABLE_DAYS)), F.col("selected_at")) / 1_000_000
    held = held.withColumns({"horizon_s": horizon, "liquidity": F.col("liquidity").cast("double"), "spread": F.col("spread").cast("double")})
    rules = protocol_strata(spark)
    held = selection.matching_strata(held, rules).join(rules.select("stratum_id", "max_targets"), "stratum_id", "left")
    held = held.withColumns({"exclusion": F.coalesce("exclusion", "book_exclusion", F.when(F.col("stratum_id").isNull(), "no_stratum")), "event_group": (F.col("custkey") % 200).cast("string")})
    return selection.select_in_order(held, blocks, partial=True).select("market_key", "experiment_id", "block_no", "stratum_id", "decision")


@query("""WITH t AS (SELECT o_orderpriority AS category, o_orderkey AS k, unnest(list_distinct([o_orderkey % 700, (o_orderkey * 7 + 3) % 700])) AS token FROM orders)
SELECT category, CAST(token AS VARCHAR) AS token_key, count(DISTINCT k) AS markets FROM t GROUP BY ALL HAVING count(DISTINCT k) > 1""")
def shared_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of several markets of a page, whatever their place and their leading zeros."""
    k = F.col("market_id").cast("long")
    tokens = F.map_from_arrays(F.array(F.lit("Yes"), F.lit("No")), F.array(F.concat(F.lit("00"), (k % 700).cast("string")), ((k * 7 + 3) % 700).cast("string")))
    return selection.shared_tokens(v.markets(spark, d).withColumn("outcome_token_map", tokens), "category")


POLLS = """WITH e AS (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events),
polls AS (SELECT user_id AS target_id, ordinal, CASE WHEN event_id % 97 <> 0 THEN lag(sha256(CAST(event_id AS VARCHAR))) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS previous_id, sha256(CAST(event_id AS VARCHAR)) AS poll_id, ts AS retrieved_at,
 CASE WHEN event_type = 'purchase' AND k > 90 THEN 'final' ELSE 'open' END AS finality FROM e)
"""


@query(POLLS + f""", g AS (SELECT target_id, ordinal, epoch_us(coalesce(lead(retrieved_at) OVER (PARTITION BY target_id ORDER BY ordinal), TIMESTAMP '{DEADLINE}')) - epoch_us(retrieved_at) AS gap FROM polls)
SELECT target_id, count(*) AS polls, arg_max(gap, ordinal) AS final_gap_us, max(gap) AS max_gap_us, CASE WHEN max(gap) <= 86400000000 THEN 'complete' ELSE 'incomplete' END AS continuity FROM g GROUP BY target_id""")
def poll_continuity(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.continuity(v.polls(spark, d), F.lit(DEADLINE).cast("timestamp"), 43_200)


@query(POLLS + """, c AS (SELECT *, lag(poll_id) OVER w AS before, max(CASE WHEN finality = 'final' THEN 1 ELSE 0 END) OVER (PARTITION BY target_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM polls WINDOW w AS (PARTITION BY target_id ORDER BY ordinal))
SELECT target_id, ordinal, concat_ws('|', CASE WHEN previous_id IS DISTINCT FROM before THEN 'predecessor' END, CASE WHEN ended = 1 THEN 'after_final' END) AS violations FROM c WHERE previous_id IS DISTINCT FROM before OR ended = 1""")
def poll_chain(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.chain_violations(v.polls(spark, d)).select("target_id", "ordinal", F.array_join("violations", "|").alias("violations"))


@query(POLLS + "SELECT target_id, arg_min(retrieved_at, ordinal) AS cutoff_at, min(ordinal) AS cutoff_ordinal, arg_min(poll_id, ordinal) AS resolution_id FROM polls WHERE finality = 'final' GROUP BY target_id")
def poll_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cutoffs(v.polls(spark, d))


@query(POLLS + """, c AS (SELECT target_id, min(retrieved_at) FILTER (finality = 'final') AS cutoff_at, arg_max(finality, ordinal) AS finality, arg_max(retrieved_at, ordinal) AS last_seen, max(ordinal) AS polls FROM polls GROUP BY target_id)
SELECT *, CASE WHEN cutoff_at IS NULL THEN last_seen + INTERVAL 12 HOUR END AS next_due FROM c""")
def poll_progress(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.progress(v.polls(spark, d), 43_200)


@query("""WITH b AS (SELECT user_id AS target_id, TIMESTAMP '2024-01-01 00:00:00' AS s, TIMESTAMP '2024-01-31 00:00:00' AS e FROM events GROUP BY user_id), g AS (SELECT user_id AS target_id, ts, value, epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts), TIMESTAMP '2024-01-01 00:00:00')) AS gap FROM events)
SELECT target_id, count(*) AS samples, greatest(max(gap), max(epoch_us(TIMESTAMP '2024-01-31 00:00:00')) - epoch_us(max(ts))) AS max_gap_us, round(max(value), 9) AS max_value FROM g GROUP BY target_id""")
def sample_cadence(spark: SparkSession, d: str) -> DataFrame:
    samples = v.table(spark, d, "events").select(F.col("user_id").alias("target_id"), "ts", "value")
    bounds = samples.select("target_id").distinct().withColumn("started_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn("ended_at", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    found = lifecycle.cadence(samples, "target_id", "ts", bounds, 86_400, value=100.0)
    return found.select("target_id", "samples", "max_gap_us", *dbl("max_value"))


@query("""WITH c AS (SELECT conv_id, turn, sha256(conv_id || '|' || turn || '|' || text) AS own FROM conversations), i AS (SELECT *, CASE WHEN conv_id % 11 = 0 AND turn % 2 = 1 THEN sha256('broken') ELSE own END AS id FROM c),
p AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM i)
SELECT conv_id, turn, concat_ws('|', CASE WHEN id <> own THEN 'id' END, CASE WHEN conv_id % 13 = 0 AND before IS NOT NULL THEN 'predecessor' END) AS violations FROM p WHERE id <> own OR (conv_id % 13 = 0 AND before IS NOT NULL)""")
def arrival_chain(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = v.chain(spark, d)
    found = c.withColumn("violations", F.filter(F.array(
        F.when(F.col("id") != F.col("expected"), F.lit("id")), F.when(~F.col("previous_id").eqNullSafe(F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))), F.lit("predecessor")),
    ), lambda x: x.isNotNull())).where(F.size("violations") > 0)
    return found.select("conv_id", "turn", F.array_join("violations", "|").alias("violations"))


@query("SELECT sha256(text) AS raw_sha256, octet_length(encode(text))::BIGINT AS byte_length, count(*) AS copies, arg_min(source, (doc_id, source)) AS source FROM documents WHERE text IS NOT NULL GROUP BY text")
def raw_archive(spark: SparkSession, d: str) -> DataFrame:
    raw = v.table(spark, d, "documents").where("text is not null").select(F.col("text").alias("raw"), "source", F.lit("documents").alias("endpoint"), F.timestamp_seconds("doc_id").alias("retrieved_at"))
    return ledger.archived(raw).select("raw_sha256", "byte_length", "copies", "source")


@query("""SELECT sha256(text) AS raw_sha256, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'hash' END AS damage FROM (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text) WHERE doc_id % 3 = 0 OR doc_id % 50 = 1""")
def archive_damage(spark: SparkSession, d: str) -> DataFrame:
    """The texts whose smallest doc_id is divisible by three are not in the archive, and some are there
    with other bytes."""
    docs = v.table(spark, d, "documents").where("text is not null").withColumn("raw_sha256", F.sha2("text", 256))
    once = docs.groupBy("raw_sha256").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    held = once.where("doc_id % 3 <> 0").select("raw_sha256", F.when(F.col("doc_id") % 50 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("raw"))
    archive = held.withColumn("byte_length", F.octet_length("raw"))
    return ledger.archive_damage(archive, docs.select("raw_sha256").distinct()).select("raw_sha256", "damage")


@query(with_views("numbered", "arrivals") + """, rows_of AS (SELECT run, seq, seq // 10000 AS r, sha256(""" + " || '|' || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for x in ("CAST(seq AS VARCHAR)", "kind", "observation_id", "reason")) + """) AS h FROM arrivals),
ranges AS (SELECT run, r, count(*) AS n, sha256(string_agg(h, '' ORDER BY seq)) AS h FROM rows_of GROUP BY run, r) SELECT run, sum(n)::BIGINT AS arrivals, sha256('trajectory.v1:' || string_agg(h, '' ORDER BY r)) AS trajectory_sha256 FROM ranges GROUP BY run""")
def trajectory_digests(spark: SparkSession, d: str) -> DataFrame:
    return audit.trajectory_digests(v.arrivals(spark, d), ["seq", "kind", "observation_id", "reason"])


@query(with_views("numbered", "arrivals") + """SELECT run, count(*) AS arrivals, count(*) FILTER (payload_type = 'snapshot' AND kind = 'delivery') AS snapshots, count(*) FILTER (kind = 'rejection' AND reason = 'malformed_payload') AS malformed, true AS reconciles FROM arrivals GROUP BY run""")
def capture_summary(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.capture_summary(v.arrivals(spark, d))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select("run", "arrivals", zero(F.col("schema_counts")["snapshot"]).alias("snapshots"), zero(F.col("reason_counts")["malformed_payload"]).alias("malformed"), "reconciles")
