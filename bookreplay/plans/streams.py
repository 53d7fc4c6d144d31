"""Queries that play the tables through the streaming forms: their SQL is that of one pass over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookreplay.functions.columns import unix_micros
from bookreplay.functions.storage import fresh_dir, stored
from bookreplay.operators import book, lateness
from bookreplay.plans import ingest
from bookreplay.plans import views as v
from bookreplay.plans.queries import CHANGES, LEDGER, ORACLES, REPLAY, Replay, dbl, query
from bookreplay.plans.views import with_views
from bookreplay.sources import landing
from bookreplay.streaming import book_stream, capture_stream

#: Files of a micro-batch where rows have no order; pieces of rows that have one, each a micro-batch.
FILES, PIECES = 3, 3


def pieces(rows: DataFrame, order: str) -> list[DataFrame]:
    """Rows in pieces that follow each other by ``order``."""
    at = unix_micros(F.col(order)) if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order)
    ends = rows.agg(F.min(at.cast("double")).alias("lo"), F.max(at.cast("double")).alias("hi")).first()
    lo, hi = ends["lo"] or 0.0, ends["hi"] or 0.0
    piece = F.least(F.floor((at.cast("double") - lo) / max(hi - lo, 1.0) * PIECES), F.lit(PIECES - 1))
    return [rows.where(F.coalesce(piece, F.lit(0)) == i) for i in range(PIECES)]


def played(spark: SparkSession, rows: DataFrame, form: Callable[[DataFrame], DataFrame], order: str | None, each: Callable | None = None):
    """Plays ``rows`` through ``form``: what comes out as a table, or the finished query where there is no order or the
    batches go to ``each``. The query is stopped and taken up again between pieces, and a piece is one batch in whatever
    number of files it lies: a batch of some of them would move the clock past the rows of the others."""
    folder = fresh_dir(spark, "landed")
    parts = pieces(rows, order) if order else [rows]
    parts[0].write.parquet(f"{folder}/0")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True)
    stream = form((source if order else source.option("maxFilesPerTrigger", FILES)).parquet(folder))
    out, state = fresh_dir(spark, "played"), fresh_dir(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode("append")
    if each is not None:
        writer = writer.foreachBatch(each)
    elif order is None:
        writer = writer.format("noop")
    else:
        writer = writer.format("parquet").option("path", out)
    for i, part in enumerate(parts):
        if i:
            part.write.parquet(f"{folder}/{i}")
        done = capture_stream.started(writer, spark)
        done.awaitTermination()
    return done if each is not None or order is None else spark.read.schema(stream.schema).parquet(out)


@query(REPLAY + ", gaps AS (SELECT run, seq, seq - lag(seq, 1, seq - 1) OVER w - 1 AS gap, coalesce(received_time < max(received_time) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS regressed FROM outcomes WINDOW w AS (PARTITION BY run ORDER BY seq))\nSELECT run, seq, outcome, lateness, gap, regressed FROM marked JOIN gaps USING (run, seq)")
def streamed_marks(spark: SparkSession, d: str) -> DataFrame:
    """Lateness marks, gaps and receive regressions of every arrival, by a processor for each run."""
    outcomes = Replay(spark, d).outcomes.select("run", "seq", "outcome", "applied", "event_time", "received_time")
    found = played(spark, outcomes, capture_stream.marked, "seq")
    return found.select(F.col("run").cast("long").alias("run"), "seq", "outcome", "lateness", "gap", "regressed")


@query(ingest.WIRE + "SELECT run, frame_no, event_idx, token_id, seq FROM numbered")
def streamed_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of allocated_sequences, handed out batch by batch."""
    made = stored(ingest.produced(spark, d).select("run", "frame_no", "event_idx", "token_id", "status"), "produced")
    return played(spark, made, capture_stream.numbered, "frame_no").select(F.col("run").cast("long").alias("run"), "frame_no", "event_idx", "token_id", "seq")


@query(with_views("numbered", "arrivals") + LEDGER + "SELECT * FROM ledger")
def streamed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger by batches, the first and the last of which are played twice: that adds nothing."""
    rows = stored(v.arrivals(spark, d).where("kind = 'delivery'").select("run", "seq", "observation_id", "received_time"), "deliveries")
    folder = fresh_dir(spark, "ledger")
    capture_stream.open_ledger(spark, folder)
    write = capture_stream.append_batch(folder)

    def twice(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)

    played(spark, rows, lambda s: s, "received_time", twice)
    return capture_stream.deliveries(spark, folder).select("run", "seq", "disposition")


@query(CHANGES + """, times AS (SELECT *, NOT (lag(book_event_time) OVER w IS NOT DISTINCT FROM book_event_time) AS fresh, last_value(CASE WHEN changed THEN midpoint END IGNORE NULLS) OVER (PARTITION BY run, token_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_midpoint FROM states WINDOW w AS (PARTITION BY run, token_id ORDER BY seq))
SELECT run, token_id, seq, round(CAST(midpoint AS DOUBLE), 9) AS midpoint, round(CAST(previous_midpoint AS DOUBLE), 9) AS previous_midpoint FROM
 (SELECT *, max(seq) OVER (PARTITION BY run, token_id) AS top FROM times WHERE (changed OR fresh) AND received_time < TIMESTAMP '2024-01-20 00:00:00') WHERE seq = top""")
def streamed_frozen(spark: SparkSession, d: str) -> DataFrame:
    """Targets that freeze at their close by a timer, with the persistence value they had."""
    r = Replay(spark, d, shared=True)
    states = r.states().select(*book.KEY, "seq", "changed", "midpoint", "book_event_time", "received_time").withColumn("close_at", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    # The clock passes the close with a row of no target that was asked for.
    end = stored(states, "states")
    last = end.agg(F.max("received_time").alias("received_time"), F.max("close_at").alias("close_at")).select(F.expr("greatest(received_time, close_at) + INTERVAL 1 HOUR").alias("received_time"))
    tick = last.select(F.lit(-1).cast("long").alias("run"), F.lit(-1).cast("long").alias("condition_id"), F.lit(-1).cast("long").alias("token_id"), F.lit(1).cast("long").alias("seq"), F.lit(False).alias("changed"), "received_time", F.col("received_time").alias("close_at"))
    rows = stored(end.unionByName(tick, allowMissingColumns=True), "states")
    found = played(spark, rows, capture_stream.frozen, "received_time").where("run <> '-1'")
    return found.select(F.col("run").cast("long").alias("run"), F.col("token_id").cast("long").alias("token_id"), "seq", *dbl("midpoint", "previous_midpoint"))


@query(with_views("numbered", "arrivals", "dispatched", "level_ops", "segments", "top") + """SELECT run, token_id, seq, bid_levels, ask_levels, round(CAST(best_bid AS DOUBLE), 9) AS best_bid, round(CAST(best_ask AS DOUBLE), 9) AS best_ask FROM tops""")
def streamed_tops(spark: SparkSession, d: str) -> DataFrame:
    """The tops of top_of_book from the keyed book, over micro-batches that follow each other."""
    r = Replay(spark, d, keep=("arrivals",))
    rows = stored(book_stream.book_inputs(r.arrivals, r.ops), "book-inputs")
    found = played(spark, rows, book_stream.replay_stream, "seq").where("status in ('applied_snapshot', 'applied_delta')")
    return found.select(F.col("run").cast("long").alias("run"), F.col("token_id").cast("long").alias("token_id"), "seq", "bid_levels", "ask_levels", *dbl("best_bid", "best_ask"))


@query(ORACLES["arrival_outcomes"])
def clustered_marks(spark: SparkSession, d: str) -> DataFrame:
    """The marks of arrival_outcomes from a ledger table that is bucketed by run and block: its rows aren't shuffled again."""
    outcomes = Replay(spark, d).outcomes.select("run", "seq", "outcome", "applied", "event_time")
    folder = fresh_dir(spark, "ledger")
    table = landing.write_clustered(outcomes, "ledger_" + folder.rsplit("-", 1)[1], folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lateness.with_lateness(table, placed="block").select("run", "seq", "outcome", "lateness")
