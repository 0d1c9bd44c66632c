"""Positions over a whole table without a task that holds it: sorted ranges, a count of each, numbers within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

_LOCAL = 33  # bits of a row's place within its partition in monotonically_increasing_id


def numbered(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """``df`` with its 0-based position in the order of ``order``, nulls first.

    Rows are range-sorted, each range counted (the driver sees one row a range), and the sum of the
    ranges before is added to a row's place in its own. Rows that are equal in ``order`` are numbered by their
    other columns; rows equal in all are interchangeable, and are dealt to several ranges if there are many.
    """
    rest = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = df.withColumn("_row", F.monotonically_increasing_id())
    by = [*keys, *rest, F.col("_row")]
    placed = stored(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOCAL)
    counts, before, offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect(), 0, []
    for row in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((row["_part"], before))
        before += row.n
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    met = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_at").bitwiseAND((1 << _LOCAL) - 1)
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + place).alias(name))


def sequential_ids(df: DataFrame, order: list[str | Column], pattern: str, name: str, start: int = 0) -> DataFrame:
    """``df`` with ids such as ``PRED-%06d`` in the order of ``order``, from ``start``."""
    return numbered(df, order, "_pos").withColumn(name, F.format_string(pattern, F.col("_pos") + start)).drop("_pos")


def cycled(df: DataFrame, order: list[str | Column], contexts: DataFrame, context_order: list[str | Column], most_broadcast: int = 100_000) -> DataFrame:
    """Row i of ``df`` with context ``i mod n`` of the ``n`` contexts, as ``pos`` and the contexts' columns; no contexts leave them null."""
    own, other = numbered(df, order, "pos"), numbered(contexts, context_order, "_slot")
    n = other.count()
    if n <= most_broadcast:
        other = F.broadcast(other)
    return own.withColumn("_slot", F.col("pos") % n if n else F.lit(None).cast("long")).join(other, "_slot", "left").drop("_slot")


def zipped(left: DataFrame, left_order: list[str | Column], right: DataFrame, right_order: list[str | Column]) -> DataFrame:
    """Rows of both tables at the same position, with ``pos``; the longer one's rest is left out."""
    return numbered(left, left_order, "pos").join(numbered(right, right_order, "pos"), "pos")
