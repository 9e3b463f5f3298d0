"""Paired comparisons, win rates, bootstrap intervals and rankings over metric tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.functions.pathloss import improvement_percent
from signalgrid.operators.bootstrap import BLOCK_ROWS, replicate_sums
from signalgrid.operators.contracts import pair_problems, paired, require
from signalgrid.operators.percentiles import exact_percentiles, null_safe_join
from signalgrid.operators.sampling import dense_positions
from signalgrid.session import materialise
from signalgrid.skew import MAX_GROUP_ROWS, split_hot

MAP_KEYS = ("task", "sample_id", "building", "antenna", "frequency", "transfer_condition")
TIE = 1e-12

# Condition labels (fixed values).
SOURCE_LIKE = "Ant1-f1 source-like"
FREQUENCY_SHIFT = "Ant1-f2-f3 frequency shift"
MORE_ANTENNAS = "Ant2-Ant5 additional antennas across frequencies"


def parse_metadata(df: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Building, antenna and frequency numbers read from the sample name; null when absent."""
    def number(tag):
        return F.regexp_extract(sample, rf"(?:^|_){tag}(\d+)(?:_|$)", 1).try_cast("int")
    return df.withColumns({"building": number("B"), "antenna": number("Ant"), "frequency": number("f")})


def transfer_condition(antenna: str = "antenna", frequency: str = "frequency") -> Column:
    a, f = F.col(antenna), F.col(frequency)
    return (F.when((a == 1) & (f == 1), SOURCE_LIKE).when((a == 1) & f.isin(2, 3), FREQUENCY_SHIFT)
            .when(a.isin(2, 3, 4, 5), MORE_ANTENNAS).otherwise("unexpected"))


def with_condition(df: DataFrame) -> DataFrame:
    return parse_metadata(df).withColumn("transfer_condition", transfer_condition())


def unparsable(df: DataFrame) -> DataFrame:
    """Sample names without a full metadata triple, and unexpected conditions; must be empty."""
    return with_condition(df).where(
        "building IS NULL OR antenna IS NULL OR frequency IS NULL OR transfer_condition = 'unexpected'")


def winner(difference: Column, primary: str) -> Column:
    """Positive differences favour the primary method."""
    return (F.when(difference.isNull(), "missing").when(difference > TIE, primary)
            .when(difference < -TIE, "baseline").otherwise("tie"))


def seed_averaged(metrics: DataFrame, methods: Sequence[str], columns: Sequence[str], keys: Sequence[str] = MAP_KEYS,
                  seed: str = "sparse_seed", expected_seeds: int | None = None) -> DataFrame:
    """Per-map means over seeds, with the number of distinct seeds; another number than expected ends the job."""
    out = metrics.where(F.col("method").isin(*methods)).groupBy(*keys, "method").agg(
        *[F.avg(c).alias(c) for c in columns], F.countDistinct(seed).alias("num_seeds"))
    return out if expected_seeds is None else require(out, F.col("num_seeds") == expected_seeds, f"not {expected_seeds} seeds", [*keys, "method"])


def incomplete_seeds(averaged: DataFrame, expected: int = 3) -> DataFrame:
    """Map and method pairs that miss a seed; must be empty before pairing."""
    return averaged.where(F.col("num_seeds") != expected)


def unpivot_metrics(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot([*keys], [*columns], "metric", "value")


def paired_comparisons(averaged: DataFrame, primary: str, baselines: Sequence[str], columns: Sequence[str],
                       keys: Sequence[str] = MAP_KEYS, strict: bool = False) -> DataFrame:
    """Primary against each baseline on the maps both have, one row per map, baseline and metric.

    A strict call ends at a map that only one of the two has, instead of leaving it out."""
    long = unpivot_metrics(averaged.where(F.col("method").isin(primary, *baselines)), [*keys, "method"], columns)
    left = long.where(F.col("method") == primary).select(*keys, "metric", F.col("value").alias("primary_value"))
    right = long.where(F.col("method").isin(*baselines)).select(
        *keys, "metric", F.col("method").alias("baseline_method"), F.col("value").alias("baseline_value"))
    diff = F.col("baseline_value") - F.col("primary_value")
    if strict:
        wanted = left.withColumn("baseline_method", F.explode(F.array(*[F.lit(b) for b in baselines])))
        both = paired(wanted, right, [*keys, "metric", "baseline_method"], "maps of both methods differ")
    else:
        both = left.join(right, [*keys, "metric"])
    return both.withColumn("paired_difference", diff).withColumn(
        "improvement_percent", improvement_percent("baseline_value", "primary_value")).withColumn(
        "valid_pair", F.col("paired_difference").isNotNull()).withColumn("winner", winner(F.col("paired_difference"), primary))


def unmatched_maps(averaged: DataFrame, primary: str, baselines: Sequence[str], keys: Sequence[str] = MAP_KEYS) -> DataFrame:
    """Maps that do not stand exactly once under the primary method and each baseline, by baseline."""
    left = averaged.where(F.col("method") == primary).withColumn("baseline_method", F.explode(F.array(*[F.lit(b) for b in baselines])))
    right = averaged.where(F.col("method").isin(*baselines)).withColumn("baseline_method", F.col("method"))
    return pair_problems(left, right, [*keys, "baseline_method"])


def _with_medians(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column], value: str, name: str, rows_bound: int | None,
                  max_group_rows: int) -> DataFrame:
    """Grouped aggregation plus the exact median of one column, in one pass while groups are small."""
    cold, hot = split_hot(rows, keys, rows_bound, max_group_rows)
    out = cold.groupBy(*keys).agg(*aggs, F.median(value).alias(name))
    if hot is None:
        return out
    medians = exact_percentiles(hot, keys, value, {name: 0.5}, max_group_rows)
    return out.unionByName(null_safe_join(hot.groupBy(*keys).agg(*aggs), medians, keys))


def _scopes(paired: DataFrame) -> DataFrame:
    return paired.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("transfer_condition"))))


def win_rates(paired: DataFrame, primary: str, rows_bound: int | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Wins, ties and mean effects overall and per condition, in one pass over both scopes."""
    ok = F.col("valid_pair")
    out = _with_medians(_scopes(paired), ["task", "scope", "baseline_method", "metric"], [
        F.count(F.lit(1)).alias("num_candidate_maps"), F.count(F.when(ok, 1)).alias("num_valid_maps"),
        F.count(F.when(~ok, 1)).alias("num_missing_pairs"),
        F.count(F.when(F.col("winner") == primary, 1)).alias("primary_map_wins"),
        F.count(F.when(F.col("winner") == "baseline", 1)).alias("baseline_map_wins"),
        F.count(F.when(F.col("winner") == "tie", 1)).alias("ties"),
        F.avg(F.when(ok, F.col("primary_value"))).alias("mean_primary_value"),
        F.avg(F.when(ok, F.col("baseline_value"))).alias("mean_baseline_value"),
        F.avg("paired_difference").alias("mean_paired_difference"),
    ], "paired_difference", "median_paired_difference", rows_bound, max_group_rows).where("num_valid_maps > 0")
    return out.withColumn("primary_map_win_rate", F.col("primary_map_wins") / F.col("num_valid_maps")).withColumn(
        "baseline_map_win_rate", F.col("baseline_map_wins") / F.col("num_valid_maps")).withColumn(
        "mean_improvement_percent", improvement_percent("mean_baseline_value", "mean_primary_value"))


def building_summary(paired: DataFrame, primary: str, rows_bound: int | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per-building effects and winner for every scope."""
    out = _with_medians(_scopes(paired.where("valid_pair")), ["task", "scope", "building", "baseline_method", "metric"], [
        F.countDistinct("sample_id").alias("num_valid_maps"), F.avg("primary_value").alias("mean_primary_value"),
        F.avg("baseline_value").alias("mean_baseline_value"), F.avg("paired_difference").alias("mean_paired_difference"),
        F.avg((F.col("winner") == primary).cast("double")).alias("primary_map_win_rate"),
    ], "paired_difference", "median_paired_difference", rows_bound, max_group_rows)
    return out.withColumn("improvement_percent", improvement_percent("mean_baseline_value", "mean_primary_value")).withColumn(
        "building_winner", winner(F.col("mean_paired_difference"), primary))


def sign_test(positive: Column, negative: Column) -> Column:
    """Exact two-sided sign test without ties; null when nothing was decided.

    Beyond 1,000 pairs binomial numbers and powers of two leave the range of doubles, so
    terms are then carried as logarithms."""
    n = positive + negative
    steps = F.sequence(F.lit(0), F.least(positive, negative).cast("int"))
    tail = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda a, i: F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["total"] + a["term"]).alias("total")),
        lambda a: a["total"])
    share = F.aggregate(
        steps, F.struct((n * F.lit(-math.log(2.0))).alias("term"), F.lit(0.0).alias("total")),
        lambda a, i: F.struct((a["term"] + F.coalesce(F.ln((n - i) / (i + 1)), F.lit(0.0))).alias("term"), (a["total"] + F.exp(a["term"])).alias("total")),
        lambda a: a["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * F.when(n <= 1000, tail / F.pow(F.lit(2.0), n)).otherwise(share)))


def cluster_bootstrap(buildings: DataFrame, keys: Sequence[str], iterations: int = 20_000, confidence: float = 0.95,
                      seed: int = 20260, cluster: str = "building") -> DataFrame:
    """Percentile intervals from resampling whole clusters with replacement.

    Input has one row per cluster; the result lists a group's clusters, so a group is a
    handful of values. Clusters stand in order at positions 0 to n-1 (`bootstrap.py` tells
    how draws fall on them); per replicate only two means are kept.
    """
    if iterations < 1000:
        raise ValueError("use at least 1000 bootstrap iterations")
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must lie strictly between 0 and 1")
    keys = list(keys)
    usable = buildings.where((F.abs("mean_paired_difference") < float("inf")) & (F.abs("improvement_percent") < float("inf")))
    # One row per group, read twice below: written once, so that the plan under it runs once.
    packed = materialise(usable.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(cluster, "mean_paired_difference", "improvement_percent"))).alias("c"),
        F.avg("mean_paired_difference").alias("cluster_mean_paired_difference"),
        F.median("mean_paired_difference").alias("cluster_median_paired_difference"),
        F.avg("improvement_percent").alias("cluster_mean_improvement_percent"),
        F.count(F.when(F.col("mean_paired_difference") > 0, 1)).alias("primary_building_wins"),
        F.count(F.when(F.col("mean_paired_difference") < 0, 1)).alias("baseline_building_wins"),
        F.count(F.when(F.col("mean_paired_difference") == 0, 1)).alias("building_ties"),
    ).withColumn("num_buildings", F.size("c")), "clusters")
    units = packed.select(*keys, "num_buildings", F.posexplode("c").alias("_pos", "_c")).select(
        *keys, "num_buildings", "_pos", F.col("_c.mean_paired_difference").alias("diff"), F.col("_c.improvement_percent").alias("pct"))
    sums = replicate_sums(units, keys, "_pos", "num_buildings", ["diff", "pct"], iterations, seed)
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    replicates = sums.withColumns({c: F.col(c) / F.col("num_buildings") for c in ("diff", "pct")})
    interval = replicates.groupBy(*keys).agg(
        F.percentile("diff", low).alias("difference_ci_low"), F.percentile("diff", high).alias("difference_ci_high"),
        F.percentile("pct", low).alias("improvement_percent_ci_low"), F.percentile("pct", high).alias("improvement_percent_ci_high"),
        F.avg((F.col("diff") > 0).cast("double")).alias("probability_primary_better"))
    return null_safe_join(packed, interval, keys).select(
        *keys, "num_buildings", F.array_join(F.transform("c", lambda s: F.concat(F.lit("B"), s[cluster].cast("string"))), ",").alias("buildings"),
        "cluster_mean_paired_difference", "cluster_median_paired_difference", "cluster_mean_improvement_percent",
        "difference_ci_low", "difference_ci_high", "improvement_percent_ci_low", "improvement_percent_ci_high",
        "probability_primary_better", "primary_building_wins", "baseline_building_wins", "building_ties",
        sign_test(F.col("primary_building_wins"), F.col("baseline_building_wins")).alias("sign_test_p_two_sided"),
        ((F.col("difference_ci_low") > 0) | (F.col("difference_ci_high") < 0)).alias("difference_ci_excludes_zero"))


def bootstrap_mean_ci(df: DataFrame, keys: Sequence[str], value: str, uid: Sequence[str], iterations: int = 1000,
                      confidence: float = 0.95, seed: int = 42, rows_bound: int | None = None,
                      max_group_rows: int = MAX_GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bootstrap interval of a mean where every row with a finite value is a unit.

    Rows get a dense position inside their group and are packed into blocks; draws never
    become rows (`bootstrap.py`).
    """
    keys = list(keys)
    order = [u for u in uid if u not in keys]
    rows = df.where(F.abs(value) < float("inf")).select(*keys, *order, F.col(value).cast("double").alias("_v"))
    placed = dense_positions(rows, keys, order, "_pos", rows_bound, max_group_rows)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    units = null_safe_join(placed.select(*keys, "_pos", "_v"), sizes.drop("mean"), keys)
    means = replicate_sums(units, keys, "_pos", "n", ["_v"], iterations, seed, block_rows).withColumn("m", F.col("_v") / F.col("n"))
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    ci = means.groupBy(*keys).agg(
        F.avg("m").alias("bootstrap_mean"), F.percentile("m", low).alias("ci_low"), F.percentile("m", high).alias("ci_high"))
    return null_safe_join(sizes, ci, keys)


def per_seed_consistency(metrics: DataFrame, primary: str, baselines: Sequence[str], columns: Sequence[str],
                         keys: Sequence[str] = (*MAP_KEYS, "sparse_seed")) -> DataFrame:
    """Pairing inside every seed, summarised per seed, baseline and metric."""
    pairs = paired_comparisons(metrics, primary, baselines, columns, keys).where("valid_pair")
    out = pairs.groupBy("task", "sparse_seed", "baseline_method", "metric").agg(
        F.count(F.lit(1)).alias("num_valid_maps"), F.avg("primary_value").alias("mean_primary_value"),
        F.avg("baseline_value").alias("mean_baseline_value"), F.avg("paired_difference").alias("mean_paired_difference"),
        F.avg((F.col("winner") == primary).cast("double")).alias("primary_map_win_rate"))
    return out.withColumn("improvement_percent", improvement_percent("mean_baseline_value", "mean_primary_value")).withColumn(
        "seed_winner", winner(F.col("mean_paired_difference"), primary))


def ranked(df: DataFrame, keys: Sequence[str], metric: str, name: str = "rank") -> DataFrame:
    """Minimum rank by a metric inside each key (ties share the better rank)."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(F.col(metric).asc_nulls_last())))


def unique_winner(df: DataFrame, column_keys: Sequence[str], label: str, value: str) -> DataFrame:
    """Rows closest to the column minimum; `winners` above one is a tie to report."""
    low = Window.partitionBy(*column_keys)
    near = df.withColumn("_low", F.min(value).over(low)).where(F.abs(F.col(value) - F.col("_low")) <= TIE)
    return near.groupBy(*column_keys).agg(F.min(label).alias("winner"), F.count(F.lit(1)).alias("winners"), F.min(value).alias("best_value"))


def wide_table(df: DataFrame, row: str, column: str, names: Sequence[str], mean: str, std: str) -> DataFrame:
    """Report table: one row per method, mean / std / is_best columns per named column."""
    best = df.groupBy(column).agg(F.min(mean).alias("_best"))
    marked = df.join(best, column).withColumn("is_best", F.abs(F.col(mean) - F.col("_best")) <= TIE)
    return marked.groupBy(row).pivot(column, list(names)).agg(
        F.first(mean).alias("mean"), F.first(std).alias("std"), F.first("is_best").alias("is_best"))
