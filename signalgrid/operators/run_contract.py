"""Contract of a set of evaluation runs: summaries, fold rows, predictions and pooled rows of each run against what was planned.

Every table carries the place it was read from as (`run_split`, `run_seed`) beside its own
columns, so a table lying under the wrong run is found. All runs are checked in one pass
per table. Kinds of predictions (method, fold) are counted first, and a point is one row with a bit for
each kind it has, so neither a prediction nor a large run is shuffled as such.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgrid.operators.contracts import require
from signalgrid.operators.kinds import bits, unit_kinds
from signalgrid.operators.metrics import finite

RUN = ["run_split", "run_seed"]

# Names of the checks (fixed values).
CHECKS = (
    "summary_split", "summary_seed", "rows_after_cleaning", "rows_removed_total", "methods_complete", "folds_complete",
    "fold_result_row_count", "sample_row_count", "pooled_row_count", "fold_seed_column", "sample_seed_column",
    "fold_split_column", "sample_split_column", "pooled_split_column", "pooled_methods_complete", "finite_fold_metrics",
    "finite_sample_values", "finite_pooled_metrics", "unique_predictions", "all_points_once_per_method", "test_counts_correct",
    "dataset_fingerprints_match", "features_match_within_protocol",
)


def _all(condition: Column) -> Column:
    """True when it holds for every row; null counts as broken."""
    return F.min(F.coalesce(condition, F.lit(False)))


def _all_finite(columns: Sequence[str]) -> Column:
    return _all(F.array_min(F.array(*[finite(c) for c in columns])))


def _summaries(runs: DataFrame) -> DataFrame:
    """Each run with the fingerprint of the first run of all and the features of the first run of its protocol."""
    first = F.struct("run_split", "run_seed")
    features = runs.groupBy("run_split").agg(F.min_by("features", "run_seed").alias("_features"))
    overall = runs.agg(F.min_by("fingerprint", first).alias("_fingerprint"))  # one row
    return runs.join(features, "run_split").join(F.broadcast(overall)).withColumns({
        "_same_files": F.col("fingerprint").eqNullSafe(F.col("_fingerprint")), "_same_features": F.col("features").eqNullSafe(F.col("_features"))})


def _folds(folds: DataFrame, expected_folds: DataFrame, methods: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    plan = expected_folds.select("run_split", "run_seed", "fold", F.col("test_count").alias("_tests"), F.lit(True).alias("_planned"))
    known = F.col("method").isin(*methods)
    return folds.join(plan, [*RUN, "fold"], "left").groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("fold_rows"), _all(known).alias("_f_methods"), F.countDistinct("method").alias("_f_method_count"),
        _all(F.col("_planned")).alias("_f_planned"), F.countDistinct("fold").alias("_f_folds"), _all(F.col("test_count") == F.col("_tests")).alias("_f_tests"),
        _all(F.col("random_seed") == F.col("run_seed")).alias("_f_seed"), _all(F.col("split") == F.col("run_split")).alias("_f_split"),
        _all_finite(metrics).alias("_f_finite"))


def _samples(samples: DataFrame, uid: str, values: Sequence[str]) -> DataFrame:
    flags = [_all(F.col("random_seed") == F.col("run_seed")).alias("_s_seed"), _all(F.col("split") == F.col("run_split")).alias("_s_split"),
             _all_finite(values).alias("_s_finite")]
    known = unit_kinds(samples, RUN, [uid], ["method", "fold"], flags)
    # A point without an id is no point.
    named = F.col(uid).isNotNull()
    if known.words:
        # A point adds to the methods of its run of which it has a fold.
        masks = known.table.groupBy(*RUN, "method").agg(F.array(*bits(known.words)).alias("_words"))
        listed = masks.groupBy(*RUN).agg(F.collect_list("_words").alias("_methods"))
        most = listed.agg(F.max(F.size("_methods"))).first()[0] or 0

        def has(i: int) -> Column:
            own = F.get("_methods", F.lit(i))
            return reduce(or_, [F.col(f"_w{w}").bitwiseAND(F.get(own, F.lit(w))) != 0 for w in range(known.words)])

        points = known.units.withColumn("_unique", F.col("_unique").cast("int")).join(F.broadcast(listed), RUN)
        counted = points.groupBy(*RUN).agg(
            F.min("_unique").cast("boolean").alias("_s_unique"), F.count(F.when(named, 1)).alias("unique_test_points"), F.first(F.size("_methods")).alias("_n"),
            *[F.count(F.when(named & has(i), 1)).alias(f"_m{i}") for i in range(most)])
        each = F.slice(F.array(*[f"_m{i}" for i in range(most)]), F.lit(1), F.col("_n")) if most else F.array().cast("array<bigint>")
        points = counted.select(*RUN, "_s_unique", "unique_test_points", F.array_min(each).alias("_fewest"), F.array_max(each).alias("_most"))
    else:
        by_method = known.units.groupBy(*RUN, uid, "method").agg(F.min("_unique").alias("_s_unique")).groupBy(*RUN, "method").agg(
            F.count(uid).alias("_points"), F.min("_s_unique").alias("_s_unique"))
        distinct = known.units.where(named).select(*RUN, uid).distinct().groupBy(*RUN).agg(F.count(F.lit(1)).alias("unique_test_points"))
        points = by_method.groupBy(*RUN).agg(F.min("_s_unique").alias("_s_unique"), F.min("_points").alias("_fewest"), F.max("_points").alias("_most")).join(distinct, RUN, "left")
    rows = known.table.groupBy(*RUN).agg(F.sum("_c").alias("sample_rows"), *[F.min(c).alias(c) for c in ("_s_seed", "_s_split", "_s_finite")])
    return rows.join(points, RUN)


def _pooled(pooled: DataFrame, methods: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return pooled.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("pooled_rows"), _all(F.col("method").isin(*methods)).alias("_p_methods"), F.countDistinct("method").alias("_p_method_count"),
        _all(F.col("split") == F.col("run_split")).alias("_p_split"), _all_finite(metrics).alias("_p_finite"))


def run_contract(expected: DataFrame, expected_folds: DataFrame, runs: DataFrame, folds: DataFrame, samples: DataFrame, pooled: DataFrame,
                 methods: Sequence[str], metrics: Sequence[str], values: Sequence[str], uid: str = "row_uid", strict: bool = False) -> DataFrame:
    """One row per planned run: row counts, `check_<name>` for every name in CHECKS, `failed` (their names) and `status`.

    `expected` has the runs with `points` and `removed`; `expected_folds` their folds with
    `test_count`. A run without a table fails that table's checks; a run that was not
    planned is no row here (`unplanned_runs`). A strict call ends at the first failing run.
    """
    planned = expected.join(expected_folds.groupBy(*RUN).agg(F.countDistinct("fold").alias("_folds")), RUN, "left")
    parts = (_summaries(runs), _folds(folds, expected_folds, methods, metrics), _samples(samples, uid, values), _pooled(pooled, methods, metrics))
    for part in parts:
        planned = planned.join(part, RUN, "left")
    n = len(methods)
    rules = (
        F.col("stated_split") == F.col("run_split"), F.col("stated_seed") == F.col("run_seed"),
        F.col("rows_after_cleaning") == F.col("points"), F.col("rows_removed_total") == F.col("removed"),
        F.col("_f_methods") & (F.col("_f_method_count") == n), F.col("_f_planned") & (F.col("_f_folds") == F.col("_folds")),
        F.col("fold_rows") == F.col("_folds") * n, F.col("sample_rows") == F.col("points") * n, F.col("pooled_rows") == n,
        F.col("_f_seed"), F.col("_s_seed"), F.col("_f_split"), F.col("_s_split"), F.col("_p_split"),
        F.col("_p_methods") & (F.col("_p_method_count") == n), F.col("_f_finite"), F.col("_s_finite"), F.col("_p_finite"), F.col("_s_unique"),
        (F.col("_fewest") == F.col("points")) & (F.col("_most") == F.col("points")),
        F.col("_f_tests") & F.col("_f_planned") & (F.col("_f_folds") == F.col("_folds")), F.col("_same_files"), F.col("_same_features"),
    )
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("fold_rows", "sample_rows", "pooled_rows", "unique_test_points")]
    out = planned.select(*RUN, *counts, *[F.coalesce(rule, F.lit(False)).alias(f"check_{name}") for name, rule in zip(CHECKS, rules, strict=True)])
    out = out.withColumn("failed", F.concat_ws(",", *[F.when(~F.col(f"check_{name}"), F.lit(name)) for name in CHECKS]))
    out = out.withColumn("status", F.when(F.col("failed") == "", "PASS").otherwise("FAIL"))
    return require(out, F.col("status") == "PASS", "run breaks its contract", [*RUN, "failed"]) if strict else out


def unplanned_runs(expected: DataFrame, *tables: DataFrame) -> DataFrame:
    """Runs that some table holds although they were not planned."""
    found = tables[0].select(*RUN)
    for table in tables[1:]:
        found = found.unionByName(table.select(*RUN))
    return found.distinct().join(expected.select(*RUN), RUN, "left_anti")
