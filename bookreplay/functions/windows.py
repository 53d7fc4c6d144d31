"""Running values over long sequences, in two levels.

A window over a whole run is one task. Here a run is cut into blocks of its order column: each block is
summed up by itself, a window over those few rows carries the values from block to block, and a window
inside each block does the rest. So a run of any length spreads over its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def running(
    df: DataFrame, columns: dict[str, tuple[str, Column]], by: str | list[str] = "run", order: str = "seq", inclusive: bool = False, block: int = BLOCK, ties: tuple[Column, ...] = (),
    nulls: bool = True, placed: str | None = None,
) -> DataFrame:
    """Adds each of ``columns`` (name: ("max", "min", "sum", "last", "last_row" or "total", value)): the value over the rows of
    ``by`` before this one in ``order``, or up to it if ``inclusive``. Nulls are passed over (but by "last_row",
    the value of the row before, null or not); null where there is no value yet. "total" is the sum over all rows
    of ``by``. ``order`` is a whole number, ``ties`` order rows that are equal in it and tell them apart.

    ``nulls=False`` says that ``by`` and ``order`` are never null: then the blocks' sums are met by plain
    equality, and one shuffle of the rows by (by, block) serves that join and the window. ``placed`` names a
    column that has the block's number already (order / block, rounded down), as tables of
    ``landing.write_clustered`` do: rows that are bucketed by it aren't shuffled at all."""
    by = [by] if isinstance(by, str) else list(by)
    rank = F.struct(F.col(order), *ties)
    fold = {
        "max": F.max, "min": F.min, "sum": F.sum, "total": F.sum, "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), rank)), "last_row": lambda v: F.max_by(F.struct(v), rank),
    }
    over = {"max": F.max, "min": F.min, "sum": F.sum, "total": F.sum, "last": lambda v: F.last(v, ignorenulls=True), "last_row": lambda v: F.last(F.struct(v))}
    join = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a + b, a, b), "total": lambda a, b: a, "last": lambda a, b: F.coalesce(b, a), "last_row": lambda a, b: F.coalesce(b, a)}
    held = df.withColumns({f"_v_{n}": v for n, (_, v) in columns.items()}).withColumn("_block", F.col(placed) if placed else F.floor(F.col(order) / block))
    sums = held.groupBy(*by, "_block").agg(*[fold[k](f"_v_{n}").alias(f"_p_{n}") for n, (k, _) in columns.items()])
    carried = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    before = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_b"), *[_carry(k, over, f"_p_{n}").over(whole if k == "total" else carried).alias(f"_p_{n}") for n, (k, _) in columns.items()])
    same = Column.eqNullSafe if nulls else Column.__eq__
    meet = same(F.col("_block"), F.col("_b"))
    for c in by:
        meet = meet & same(F.col(c), F.col(f"_by_{c}"))
    held = held.join(before, meet)
    inside = Window.partitionBy(*by, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    made = {n: join[k](F.col(f"_p_{n}"), over[k](f"_v_{n}").over(inside)) for n, (k, _) in columns.items()}
    made = {n: c[f"_v_{n}"] if columns[n][0] == "last_row" else c for n, c in made.items()}
    return held.withColumns(made).drop("_block", "_b", *[f"_by_{c}" for c in by], *[f"_{x}_{n}" for n in columns for x in "vp"])


def _carry(kind: str, over: dict, name: str) -> Column:
    """From block to block: the last block's value is there already, whatever the rows' kind of last."""
    return F.last(name, ignorenulls=True) if kind in ("last", "last_row") else over[kind](name)


def as_of(probes: DataFrame, facts: DataFrame, by: list[str], at: str, value: Column, name: str, block: int = 3_600_000_000) -> DataFrame:
    """``probes`` with ``name``: the ``value`` (a column over ``facts``) of the last fact of the same ``by`` at or
    before the probe. Both have ``at``, a whole number (microseconds or a sequence); of facts at the same
    moment the largest value counts. Any number of probes, each with its own moment, meets any number of facts
    in blocks of ``at``, so neither a hot key nor many probes make one task. A null moment finds nothing."""
    own = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    left = probes.select(*[F.col(c) for c in by], F.col(at).alias("_at"), F.lit(1).alias("_kind"), own.alias("_probe"), F.monotonically_increasing_id().alias("_nth"))
    right = facts.where(F.col(at).isNotNull()).groupBy(*by, F.col(at).alias("_at")).agg(F.max(value).alias("_fact")).withColumn("_kind", F.lit(0))
    both = left.where("_at is not null").unionByName(right, allowMissingColumns=True)
    met = running(both, {"_found": ("last", F.col("_fact"))}, by=by, order="_at", block=block, ties=(F.col("_kind"), F.col("_nth"))).where("_kind = 1")
    return met.select("_probe.*", F.col("_found").alias(name)).unionByName(left.where("_at is null").select("_probe.*", F.lit(None).cast(met.schema["_found"].dataType).alias(name)))
