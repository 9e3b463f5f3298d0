"""Rules that rows must keep before they are compared: as frames of violations, and as stops inside a plan.

A strict call adds its rule to the plan that uses the rows, so nothing is read twice: the
first row that breaks it ends the job with the rule and the row's keys. The frame of
violations of the same rule lists all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(rows: DataFrame, holds: Column, rule: str, keys: Sequence[str]) -> DataFrame:
    """`rows`; a row for which `holds` is not true ends the job."""
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    stop = F.raise_error(F.concat(F.lit(f"{rule}: "), shown)).cast("boolean")
    return rows.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(stop))


def pair_problems(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that do not stand exactly once on both sides, with the rows of each: one grouped pass over both, no join."""
    both = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counted = both.groupBy(*keys).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))
    return counted.where("left_rows <> 1 OR right_rows <> 1").withColumn(
        "problem", F.when(F.col("left_rows") == 0, "missing_left").when(F.col("right_rows") == 0, "missing_right").otherwise("repeated"))


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Both sides joined on `keys`; a key that is missing on one side ends the job. Null keys are keys like any other."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumn("_right", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    out = left.withColumn("_left", F.lit(True)).join(other, on, "full_outer")
    named = out.withColumns({k: F.when(F.col("_left"), F.col(k)).otherwise(F.col(f"_r_{k}")) for k in keys})
    return require(named, F.col("_left") & F.col("_right"), rule, keys).drop("_left", "_right", *[f"_r_{k}" for k in keys])
