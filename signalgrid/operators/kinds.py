"""Which kinds of rows every unit has, and whether one comes twice, without a row per unit and kind.

A kind is a value of some key columns that have few values together (method, fold, fraction).
Kinds are counted first; then a unit (a point of a run) becomes one row with the number of
its rows and a bit per kind that it has, combined before the shuffle. It has a kind twice
where its rows outnumber its bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.operators.percentiles import null_safe_join
from signalgrid.session import materialise

#: Bits in a word, and most words of a unit; where a group has more kinds, each kind of a unit is a row.
BITS, WORDS = 63, 8


@dataclass(frozen=True)
class Kinds:
    """`table` has a row per group and kind with `_c` rows, `_place` and the given sums; `units` a row per group and
    unit with `_unique` and the words `_w0` ..., or, without words, a row per group, unit and kind."""

    table: DataFrame
    units: DataFrame
    words: int


def bits(words: int) -> list[Column]:
    """The words of the kinds of a group of rows, from their `_place`."""
    bit = F.expr(f"shiftleft(1L, CAST(_place % {BITS} AS INT))")
    return [F.bit_or(F.when(F.floor(F.col("_place") / BITS) == i, bit).otherwise(F.lit(0).cast("bigint"))) for i in range(words)]


def unit_kinds(rows: DataFrame, group: Sequence[str], unit: Sequence[str], kind: Sequence[str], sums: Sequence[Column] = (), words: int = WORDS) -> Kinds:
    """The kinds of every group and the units of every group; null keys are keys like any other."""
    group, unit, kind = list(group), list(unit), list(kind)
    numbered = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*kind)
    table = materialise(rows.groupBy(*group, *kind).agg(F.count(F.lit(1)).alias("_c"), *sums).withColumn("_place", F.row_number().over(numbered) - 1), "kinds")
    needed = (table.agg(F.max("_place")).first()[0] or 0) // BITS + 1
    if needed > words:
        each = rows.groupBy(*group, *unit, *kind).agg(F.count(F.lit(1)).alias("_c"))
        return Kinds(table, each.withColumn("_unique", F.col("_c") == 1), 0)
    keys = [*group, *kind]
    placed = null_safe_join(rows.select(*dict.fromkeys([*unit, *keys])), F.broadcast(table.select(*keys, "_place")), keys)  # words x BITS rows a group at most
    units = placed.groupBy(*group, *unit).agg(F.count(F.lit(1)).alias("_c"), *[b.alias(f"_w{i}") for i, b in enumerate(bits(needed))])
    have = sum((F.bit_count(f"_w{i}") for i in range(needed)), F.lit(0))
    return Kinds(table, units.withColumn("_unique", F.col("_c") == have), needed)
