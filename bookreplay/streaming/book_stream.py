"""Order books under Structured Streaming: a keyed processor whose state is the books of a group of a run's tokens.

A run's tokens fall into groups by hash, so that a call and its few state accesses serve many of them. Rows are applied in
seq order inside each call. A token's best prices and numbers of levels are kept beside its levels; a small book is one
entry with them, of a deep one a call reads and writes the chunks of the levels it touches, and the whole book at most once, when a best price goes.
From then on each side is a heap that drops removed prices when they come to its top, so a write costs the
logarithm of the depth, whatever the depth. A row at or below its token's last seq came out
of order: it is reported, not folded in. Applied observation ids are remembered, for good or with a time to live.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bookreplay.operators.book import off_scope
from bookreplay.streaming import chunks
from bookreplay.streaming.chunks import Chunks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run string, condition_id string, token_id string, seq long, status string, best_bid double, best_ask double, bid_levels long, ask_levels long"
INPUT = ["run", "seq", "condition_id", "token_id", "observation_id", "payload_type", "levels", "refused"]


#: Output rows that are handed on at once; levels of a book that is kept in one piece.
PIECE, SMALL = 10_000, 256


class Side:
    """The number of prices of one side and the best of them (``sign`` 1: the lowest, -1: the highest)."""

    def __init__(self, sign: int, n: int = 0, best: float | None = None):
        self.sign, self.n, self.best = sign, n, best
        self.heap: list[float] | None = None
        self.alive: set[float] = set()
        self.queued: set[float] = set()
        self.popped = 0

    def fill(self, prices: Iterable[float]) -> None:
        self.alive = {self.sign * p for p in prices}
        self.queued, self.heap = set(self.alive), list(self.alive)
        heapify(self.heap)

    def add(self, price: float) -> None:
        """A price that wasn't there."""
        at = self.sign * price
        self.n += 1
        if self.best is None or at < self.sign * self.best:
            self.best = price
        if self.heap is not None:
            self.alive.add(at)
            if at not in self.queued:
                self.queued.add(at)
                heappush(self.heap, at)

    def remove(self, price: float) -> bool:
        """A price that was there; whether the side must be filled to know its best one."""
        self.n -= 1
        self.alive.discard(self.sign * price)
        if self.n == 0:
            self.best = None
        elif price == self.best:
            if self.heap is None:
                return True
            self.settle()
        return False

    def settle(self) -> None:
        while self.heap[0] not in self.alive:
            self.queued.discard(heappop(self.heap))
            self.popped += 1
        self.best = self.sign * self.heap[0]


class Book:
    """One token's book in a call. Up to SMALL levels it is part of the token's own entry; a deeper one has chunks of its own."""

    def __init__(self, state, name: str, held: list | None):
        self.state, self.name = state, name
        self.seq, self.seeded, bid, ask, bids, asks, levels = held or (-1, False, None, None, 0, 0, {})
        self.sides = {"bid": Side(-1, bids, bid), "ask": Side(1, asks, ask)}
        self.levels = Chunks(state, f"levels {name}") if levels is None else levels

    def reset(self) -> None:
        self.levels.clear()
        self.seeded, self.levels = True, {}
        self.sides = {"bid": Side(-1), "ask": Side(1)}
        for side in self.sides.values():
            side.fill(())

    def apply(self, levels) -> None:
        for x in levels:
            at, side = f"{x['side']} {x['price']}", self.sides[x["side"]]
            had, gone = at in self.levels, x["size"] is None or float(x["size"]) == 0
            if not gone:
                self.levels[at] = x["size"]
                if not had:
                    side.add(float(x["price"]))
            elif had:
                del self.levels[at]
                if side.remove(float(x["price"])):
                    self._fill()

    def _fill(self) -> None:
        """Both sides' prices, from the whole book."""
        held = [at.split(" ") for at in self.levels]
        for name, side in self.sides.items():
            side.fill(float(p) for s, p in held if s == name)
            if side.n:
                side.settle()

    def top(self) -> tuple:
        bid, ask = self.sides["bid"], self.sides["ask"]
        return bid.best, ask.best, bid.n, ask.n

    def entry(self) -> list:
        """What the token's entry keeps; the levels of a deep book go to their chunks."""
        if isinstance(self.levels, dict) and len(self.levels) > SMALL:
            small, self.levels = self.levels, Chunks(self.state, f"levels {self.name}")
            for at, size in small.items():
                self.levels[at] = size
        deep = isinstance(self.levels, Chunks)
        if deep:
            self.levels.flush()
        return [self.seq, self.seeded, *self.top(), None if deep else self.levels]


class BookProcessor(StatefulProcessor):
    """One output row per input row: what became of it, and the top of the token's book after it. A key is a group of a
    run's tokens (``chunks.shard``); each token's rows, book and seen ids are its own."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", chunks.KEY, chunks.VALUE)
        # Ids that lapse are entries of their own.
        self.lapsing = handle.getMapState("seen", "name string", "seq long", self.ttl_ms) if self.ttl_ms else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        todo = pd.concat(list(rows)).sort_values("seq")
        entries, books, out = Chunks(self.chunks, "books"), {}, []
        seen = Chunks(self.chunks, "seen") if self.lapsing is None else None
        for r in todo.itertuples(index=False):
            name = chunks.named(r.condition_id, r.token_id)
            book = books.get(name)
            if book is None:
                book = books[name] = Book(self.chunks, name, entries.get(name))
            if r.seq <= book.seq:
                status = "out_of_order"
            else:
                book.seq = int(r.seq)
                status = "skipped_duplicate" if self._known(seen, f"{name} {r.observation_id}", book.seq) else self._taken(book, r)
            out.append((key[0], r.condition_id, r.token_id, int(r.seq), status, *book.top()))
            if len(out) == PIECE:
                yield self._frame(out)
                out = []
        for name, book in books.items():
            entries[name] = book.entry()
        entries.flush()
        if seen is not None:
            seen.flush()
        if out:
            yield self._frame(out)

    def _known(self, seen: Chunks | None, name: str, seq: int) -> bool:
        """Whether an id was seen; from now on it is."""
        if name in seen if seen is not None else self.lapsing.containsKey((name,)):
            return True
        if seen is not None:
            seen[name] = seq
        else:
            self.lapsing.updateValue((name,), (seq,))
        return False

    @staticmethod
    def _taken(book: Book, r) -> str:
        status = f"applied_{r.payload_type}"
        if r.payload_type in ("snapshot", "delta"):
            if r.refused:
                return "scope_mismatch"
            if r.payload_type == "snapshot":
                book.reset()
            elif not book.seeded:
                return "delta_before_snapshot"
            book.apply(() if r.levels is None else r.levels)
        return status

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def book_inputs(arrivals: DataFrame, level_ops: DataFrame) -> DataFrame:
    """Handled, scoped deliveries with their levels as one array: the rows that the processor reads. A payload that
    names another token or condition than its envelope is ``refused``: seen, but kept out of the book."""
    size = F.when(F.col("kind") == "remove", F.lit("0")).otherwise(F.col("size").cast("string"))
    ops = level_ops.groupBy("run", "seq").agg(F.sort_array(F.collect_list(F.struct("side", F.col("price").cast("string").alias("price"), size.alias("size")))).alias("levels"))
    own = arrivals.where("kind = 'delivery' and token_id is not null and condition_id is not null and payload_type in ('snapshot', 'delta', 'trade')")
    held = own.withColumn("refused", off_scope(arrivals)).join(ops, ["run", "seq"], "left")
    return held.select(*[F.col(c).cast("string") if c in ("run", "condition_id", "token_id", "observation_id") else F.col(c) for c in INPUT])


def replay_stream(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The streaming form of the fold; needs the RocksDB state store provider (ROCKSDB). With a time to
    live the query runs on processing time and keeps running batches, so it suits open-ended triggers."""
    return rows.withColumn("shard", chunks.shard("condition_id", "token_id")).groupBy("run", "shard").transformWithStateInPandas(
        statefulProcessor=BookProcessor(ttl_ms), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def merge_levels(known: DataFrame, batch: DataFrame, resets: DataFrame) -> DataFrame:
    """The same books without Python state: the per-level last-write table after one more batch.

    ``known``: run, condition_id, token_id, side, price, size, seq, reset_seq (the token's last snapshot).
    A row whose side is null stands for a snapshot alone, so that an empty book is known as one. ``batch``
    has the level writes of the batch (kind: snapshot, set or remove); ``resets`` its snapshots (run,
    condition_id, token_id, seq), those without levels too. The merge is associative: a later snapshot
    replaces what was before it, anything else overlays it."""
    key = ["run", "condition_id", "token_id"]
    columns = [*key, "side", "price", "size", "seq", "reset_seq"]
    fresh = batch.withColumn("size", F.when(F.col("kind") == "remove", F.lit(0).cast("decimal(28,10)")).otherwise(F.col("size"))).withColumn("reset_seq", F.lit(None).cast("long"))
    none = lambda kind: F.lit(None).cast(kind)
    marks = resets.select(*key, none("string").alias("side"), none("decimal(12,10)").alias("price"), none("decimal(28,10)").alias("size"), F.col("seq"), F.col("seq").alias("reset_seq"))
    both = known.select(*columns).unionByName(fresh.select(*columns)).unionByName(marks)
    last = both.groupBy(*key).agg(F.max("reset_seq").alias("reset_seq"))
    held = both.drop("reset_seq").join(last, key).where("reset_seq is not null and seq >= reset_seq")
    return held.groupBy(*key, "side", "price").agg(F.max_by("size", "seq").alias("size"), F.max("seq").alias("seq"), F.max("reset_seq").alias("reset_seq"))
