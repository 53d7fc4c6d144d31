"""Best-fit packing of tokenized documents into sequences, by exact-complement hashing.

Documents become pieces of at most ``size`` tokens. Only the number of pieces of each length decides
a packing, and there are at most ``size`` lengths, so the plan is made on that histogram: whatever
the corpus, it has at most ``size`` numbers. Spark then deals the planned places out to the pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.llm import tokens
from bookreplay.llm.common import cut, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its ids and the end id, cut into ``size``-token pieces
    where longer; the first piece takes the remainder. A null text is empty, and a null doc_id stays.
    ``keep_ids`` adds the ids themselves (array of int). Repeated rows give repeated pieces."""
    end = np.asarray([end_id], "<u4").tobytes()

    columns = [c.split()[0] for c in PIECES.split(", ")] + (["ids"] if keep_ids else [])

    def cut_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        ids_of = tokens.load(tokenizer).ids
        for doc_id, text in slices(batches, "doc_id", "text"):
            rows: list[tuple] = []
            for doc, t in zip(doc_id, text):
                ids = ids_of(t) + end
                n = len(ids) // 4
                at, until = 0, (n - 1) % size + 1
                piece = 0
                while at < n:
                    part = ids[4 * at : 4 * until]
                    row = (doc, piece, at, until - at, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("i4")) if keep_ids else row)
                    at, until, piece = until, until + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=columns)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut_up, PIECES + (", ids array<int>" if keep_ids else ""))


class Sums:
    """An index of the sums of one, two and three lengths at hand: ``pairs[s]`` holds the longer members of
    the pairs with sum s, longest first, ``triples[s]`` the longest members of the triples. Lengths only
    run out, so a combination that has lost a member is dropped for good when it is met."""

    def __init__(self, left: list[int]):
        self.left, self.size = left, len(left) - 1
        have = np.flatnonzero(left)
        self.pairs = self._longest([(a + have[have <= a], a) for a in have])
        # A triple is its longest member and a pair whose longer member is no longer than that.
        reach = np.full(self.size + 1, self.size + 1)
        for s, longer in enumerate(self.pairs):
            if longer:
                reach[s] = longer[-1]  # the least longer member of a pair with this sum
        two = np.arange(self.size + 1)
        self.triples = self._longest([(a + two[reach <= a], a) for a in have])

    def _longest(self, found: list[tuple[np.ndarray, int]]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.size + 1)]
        for sums, a in reversed(found):
            for s in sums[sums <= self.size].tolist():
                out[s].append(int(a))
        return out

    def free(self, v: int, used: dict[int, int]) -> int:
        return self.left[v] - used.get(v, 0)

    def pair(self, gap: int, used: dict[int, int], most: int) -> tuple[int, ...] | None:
        """Two lengths with this sum, the longer as long as it can be but at most ``most``."""
        lost = 0
        for a in self.pairs[gap]:
            b = gap - a
            if not self.left[a] or not self.left[b]:
                lost += 1
            elif a <= most and self.free(b, used) > (a == b) and self.free(a, used) > 0:
                return a, b
        if lost > 8:
            self.pairs[gap] = [a for a in self.pairs[gap] if self.left[a] and self.left[gap - a]]
        return None

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, else two, else three lengths at hand that fill the gap."""
        if self.free(gap, used) > 0:
            return (gap,)
        if two := self.pair(gap, used, gap):
            return two
        lost = 0
        for a in self.triples[gap]:
            if not self.left[a]:
                lost += 1
            elif self.free(a, used) > 0 and (two := self.pair(gap - a, used | {a: used.get(a, 0) + 1}, a)):
                return a, *two
        if lost > 8:
            self.triples[gap] = [a for a in self.triples[gap] if self.left[a]]
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of the pieces in a sequence, longest first) and how many sequences take each.

    From the longest length down, the rest of a sequence is closed exactly where lengths at hand do
    it: by one piece, else two, else three, looked up by their sums. Each combination is taken as often
    as the counts allow. Where no exact close exists the largest piece that fits is added, and the
    exact close is tried again for what then remains."""
    left = [0] * (size + 1)
    for length, n in counts.items():
        left[length] += n
    have = [v for v in range(1, size + 1) if left[v]]  # ascending, kept exact
    sums = Sums(left)
    patterns = []
    while have:
        top = have[-1]
        taken, used, gap = [top], {top: 1}, size - top
        while gap:
            if close := sums.exact(gap, used):
                taken += close
                break
            k = bisect_right(have, gap)
            while k and not sums.free(have[k - 1], used):
                k -= 1
            if not k:
                break
            v = have[k - 1]
            taken.append(v)
            used[v] = used.get(v, 0) + 1
            gap -= v
        need = {v: taken.count(v) for v in taken}
        times = min(left[v] // n for v, n in need.items())
        for v, n in need.items():
            left[v] -= n * times
            if not left[v]:
                have.pop(bisect_right(have, v) - 1)
        patterns.append((tuple(taken), times))
    return patterns


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, until, sequence, offset): of the pieces of a length, numbered from 0, those
    in [first, until) go to consecutive sequences from ``sequence`` on, at ``offset``."""
    out, dealt, sequence = [], {}, 0
    for lengths, times in patterns:
        at = 0
        for v in lengths:
            n = dealt.get(v, 0)
            out.append((v, n, n + times, sequence, at))
            dealt[v] = n + times
            at += v
        sequence += times
    return out


def numbered(pieces: DataFrame, rows_each: int = 10_000) -> DataFrame:
    """Adds ``nth``: 0, 1, ... among the pieces of the same length. Blocks of pieces are numbered
    apart and each block starts where the blocks before it end, so a length that most pieces share
    is spread over as many tasks as there are blocks."""
    n = pieces.count()
    blocks = max(1, -(-n // rows_each))
    held = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    per = held.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "start", "ids_crc32")
    held = held.withColumn("_in", F.row_number().over(own) - 1)
    return held.join(bases, ["length", "_block"]).withColumn("nth", F.col("_base") + F.col("_in")).drop("_block", "_base", "_in")


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (length between 1 and ``size``). Which of several equal
    pieces takes which of the equal places follows from doc_id and piece. ``pieces`` must be stored
    (its rows are read three times). The broadcast table of places has a bounded size: each pattern
    uses up a length, or leaves less of it than one pattern takes, so their number follows ``size``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = places(plan(counts, size))
    schema = "length long, _first long, _until long, _sequence long, offset long"
    where = F.broadcast(spark.createDataFrame(dealt, schema))
    inside = (F.col("nth") >= F.col("_first")) & (F.col("nth") < F.col("_until"))
    joined = numbered(pieces).join(where, "length").where(inside)
    return joined.withColumn("sequence_id", F.col("_sequence") + F.col("nth") - F.col("_first")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack documents. Empty tables give no rows; empty and null texts a piece that
    holds the end id alone."""
    return pack(cut(tokenized_pieces(docs, tokenizer, size, end_id, keep_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids themselves, from pieces that kept theirs: sequence_id, ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
