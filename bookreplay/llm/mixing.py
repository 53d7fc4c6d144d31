"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

A document's place is a hash of its row; rows that are copies of each other are numbered among themselves
and have a place each. Each source takes its documents below a threshold of that
hash, so nothing is sorted and a larger budget takes a superset of a smaller one. The threshold is
found by nested histograms: sizes summed by source and the top 12 bits of the hash name the bucket
in which the budget runs out; only that bucket's documents are summed again by their next 12 bits,
and so on. A histogram has at most 4096 rows for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.llm.common import cut, free_name, numbered, whole_row

BITS, LEVELS = 12, 3
#: Sources are joined by broadcast up to this many, else by a shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def place(unit: Column, nth: Column, seed: int) -> Column:
    """The top LEVELS * BITS bits of the hash of a row and its number among its copies."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), unit, nth.cast("long")), 64 - BITS * LEVELS)


def targets(totals: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """source, source_size -> adds ``target``.

    Weights go round by the rank of the source's code points, null last. A source takes
    min(most * size, level * weight), where the level uses up the budget: what capped sources leave
    is thereby shared by weight among the others until none is above its cap. Windows here run over
    one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    held = totals.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "source")
    earlier, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    open_w = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    held = held.withColumn("_level", left / open_w)
    # Levels fall from the first that fits on, so the largest fitting one is it.
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(whole)
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return held.select("source", "source_size", target.alias("target"))


def _boundary(hist: DataFrame, need: DataFrame, few: bool) -> DataFrame:
    """source, bucket where the running sum passes the need, and what is still needed there; no row
    for a source whose need is not passed."""
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    joined = _by_source(hist, need, few).withColumn("_to", F.sum("n").over(run))
    inside = (F.col("_to") > F.col("need")) & (F.col("_to") - F.col("n") <= F.col("need"))
    return joined.where(inside).groupBy("source").agg(
        F.min("bucket").alias("bucket"), F.max_by(F.col("need") - F.col("_to") + F.col("n"), -F.col("bucket")).alias("need")
    )


def _by_source(left: DataFrame, right: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Join on source, null matching null."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, seed: int = 42, size: Column | None = None
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= copies * size).

    A source whose target exceeds its size takes every document once and those below its threshold
    once more. Rows that are copies of each other have places of their own, so that some of them may be taken
    once more than others, which are the same rows. Sources without words have target 0 and take nothing. An empty table gives no
    rows. Sizes are words unless given."""
    return _mixed(docs, weights, budget, most, seed, size).drop("_unit")


def _mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, seed: int = 42, size: Column | None = None) -> DataFrame:
    """As mix, with ``_unit``, the hash of the whole row."""
    n = n_words(F.col("text").cast("string")) if size is None else size
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"), whole_row(docs).alias("_unit"))
    kept = numbered(kept, "_unit", "_nth", "mix-units")
    rows = cut(kept.withColumn("_place", place(F.col("_unit"), F.col("_nth"), seed)).drop("_nth"), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = cut(targets(totals, weights, budget, most), "mix-targets")
    few = aims.count() <= BROADCAST_SOURCES
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("_times", times).withColumn("_need", F.col("target") - F.col("_times") * F.col("source_size"))
    need = aims.select("source", F.col("_need").alias("need"))
    inside, prefix = rows.select("source", "size", "_place"), None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        top = F.shiftright("_place", shift)
        if prefix is not None:
            inside = _by_source(rows, prefix, few).where(F.shiftright("_place", shift + BITS) == F.col("_prefix")).select("source", "size", "_place")
        hist = inside.groupBy("source", top.alias("bucket")).agg(F.sum("size").alias("n"))
        edge = cut(_boundary(hist, need, few), "mix-edge")
        prefix, need = edge.select("source", F.col("bucket").alias("_prefix")), edge.select("source", "need")
    ends = prefix.withColumnRenamed("_prefix", "_end")
    # Without a boundary the need covers every document that is left.
    aims = _by_source(aims, ends, few, "left")
    found = _by_source(rows, aims, few)
    more = F.when(F.col("_need") <= 0, False).otherwise(F.col("_place") < F.coalesce("_end", F.lit(1 << BITS * LEVELS)))
    copies = F.when(F.col("source_size") > 0, F.col("_times") + more.cast("long")).otherwise(0)
    copies = F.least(copies, F.lit(int(most)))
    return found.select("doc_id", "_unit", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each row as many times as the mix takes it."""
    found = _mixed(docs, **options)
    own, unit, n, low, more = (free_name(docs, x) for x in ("_own", "_of", "_n", "_low", "_more"))
    per_unit = found.groupBy(F.col("_unit").alias(unit)).agg(F.count(F.lit(1)).alias(n), F.min("copies").alias(low), F.sum("copies").alias(more)).where(F.col(more) > 0)
    held = docs.withColumn(own, whole_row(docs)).join(per_unit.withColumn(more, F.col(more) - F.col(n) * F.col(low)), F.col(own) == F.col(unit))
    # Copies of a row: as many of them as the mix took once more are taken once more, whichever.
    nth, times = free_name(held, "_nth"), free_name(held, "_times")
    alone = held.where(F.col(n) == 1).withColumn(nth, F.lit(1))
    many = numbered(held.where(F.col(n) > 1), unit, nth, "mix-copies")
    both = alone.unionByName(many).withColumn(times, F.col(low) + (F.col(nth) <= F.col(more)).cast("long")).where(F.col(times) > 0)
    turn = free_name(both, "_turn")
    return both.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
