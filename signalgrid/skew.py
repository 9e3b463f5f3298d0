"""One rule for hot groups, shared by every operator that needs a whole group.

Sorts and exact percentiles inside a group are done by one task. That is fine while
the group is known to be small, and wrong when one key holds a third of a huge table.
Operators therefore take `rows_bound`, a proven upper bound on the rows of any group
(usually a footer row count), and use the one-task plan only below the limit. Without
such a proof they take the distributed plan, which gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.session import materialise

MAX_GROUP_ROWS = 4_000_000


def fits_one_task(rows_bound: int | None, limit: int = MAX_GROUP_ROWS) -> bool:
    return rows_bound is not None and rows_bound <= limit


def split_hot(df: DataFrame, keys: Sequence[str], rows_bound: int | None, limit: int = MAX_GROUP_ROWS
              ) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of groups within the limit, and rows of the groups beyond it (None when there are none).

    Without a proven bound the groups are counted first, which reads only the key columns
    and combines on the map side. At most total/limit groups can be hot, so their key
    table stays short. Null keys are groups like any other.
    """
    if fits_one_task(rows_bound, limit):
        return df, None
    hot = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(
        F.struct(*keys).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return df, None
    tagged = df.withColumn("_hot", F.struct(*keys))
    # At most total/limit keys, so they are sent to the rows; a shuffle by key would put each hot group into one task.
    return tagged.join(F.broadcast(hot), "_hot", "left_anti").drop("_hot"), tagged.join(F.broadcast(hot), "_hot", "left_semi").drop("_hot")
