"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookreplay.functions.storage import fresh_dir, stored  # noqa: F401

#: The word of the contracts: a run of anything but space and \t \n \v \f \r.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lineage is cut by tables in the folder that driver and executors share.
cut = stored


def slices(batches: Iterator, *names: str, rows: int = 500) -> Iterator[list[list]]:
    """The named columns of Arrow batches as Python values, ``rows`` rows at a time, so that a worker
    holds few texts at once beside the batch itself."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            yield [part.column(n).to_pylist() for n in names]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of a text as an array; null and empty texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def text_bytes(df: DataFrame, column: str) -> int:
    """Total octets of a column, from one aggregate over its scan."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text, which tells rows apart whose ids are null or repeat."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def whole_row(df: DataFrame) -> Column:
    """A hash of all columns of a row: rows that agree in it are copies of each other. Maps go as JSON."""
    return F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes])


def numbered(rows: DataFrame, unit: str, nth: str, name: str = "numbered") -> DataFrame:
    """Adds ``nth``: 1 to n among the n rows of each ``unit``. Rows are numbered inside blocks of the order in
    which they are stored, at most 4,096 in each, so a unit with most of all rows is many tasks."""
    pos, block, before = free_name(rows, "_pos"), free_name(rows, "_block"), free_name(rows, "_before")
    held = cut(rows.withColumn(pos, F.monotonically_increasing_id()), name).withColumn(block, F.shiftright(pos, 12))
    sums = held.groupBy(unit, block).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(unit).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.withColumn(before, F.sum("n").over(earlier)).where(F.col(before).isNotNull()).select(unit, block, before)
    inside = Window.partitionBy(unit, block).orderBy(pos)
    found = held.join(later, [unit, block], "left").withColumn(nth, F.row_number().over(inside) + F.coalesce(before, F.lit(0)))
    return found.drop(pos, block, before)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
