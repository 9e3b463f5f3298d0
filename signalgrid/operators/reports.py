"""Comparison reports over fold, seed and point tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.functions.pathloss import improvement_percent
from signalgrid.operators.contracts import pair_problems, require
from signalgrid.operators.paired import ranked, winner
from signalgrid.operators.percentiles import exact_percentiles, null_safe_join
from signalgrid.session import materialise
from signalgrid.skew import MAX_GROUP_ROWS, fits_one_task, split_hot


def _sides(df: DataFrame, keys: Sequence[str], columns: Sequence[str], baselines: Sequence[str], methods: Sequence[str] | None) -> DataFrame:
    """Each method beside each baseline on the same keys (1:1 on keys)."""
    left = df if methods is None else df.where(F.col("method").isin(*methods))
    left = left.select(*keys, "method", *[F.col(c).alias(f"method_{c}") for c in columns])
    right = df.where(F.col("method").isin(*baselines)).select(
        *keys, F.col("method").alias("baseline"), *[F.col(c).alias(f"baseline_{c}") for c in columns])
    return left.join(right, list(keys)).where("method <> baseline")


def side_problems(df: DataFrame, keys: Sequence[str], baselines: Sequence[str]) -> DataFrame:
    """Keys that do not stand exactly once under a method and under a baseline, for every pair of the two."""
    names = df.select("method").distinct()
    left = df.select(*keys, "method").withColumn("baseline", F.explode(F.array(*[F.lit(b) for b in baselines])))
    right = df.where(F.col("method").isin(*baselines)).select(*keys, F.col("method").alias("baseline")).join(F.broadcast(names))  # a handful of names
    own = F.col("method") != F.col("baseline")
    return pair_problems(left.where(own), right.where(own), [*keys, "method", "baseline"])


def rankings(pooled: DataFrame, macro: DataFrame, group: str, metric: str = "rmse") -> DataFrame:
    """Pooled and macro rankings stacked with a type tag."""
    parts = [ranked(df, [group], metric).select(F.lit(tag).alias("ranking_type"), group, "method", metric, "rank")
             for tag, df in (("pooled", pooled), ("macro", macro))]
    return parts[0].unionByName(parts[1])


def per_seed_improvement(pooled: DataFrame, macro: DataFrame, group: str, baselines: Sequence[str],
                         methods: Sequence[str] | None = None, seed: str = "random_seed") -> DataFrame:
    """Pooled and macro RMSE of each method against each baseline for every seed."""
    keys = [group, seed]
    p = _sides(pooled, keys, ["rmse", "mae"], baselines, methods)
    m = _sides(macro, keys, ["rmse"], baselines, methods).withColumnsRenamed(
        {"method_rmse": "macro_method_rmse", "baseline_rmse": "macro_baseline_rmse"})
    return p.join(m, [*keys, "method", "baseline"]).select(
        *keys, "method", "baseline", F.col("method_rmse").alias("pooled_method_rmse"), F.col("baseline_rmse").alias("pooled_baseline_rmse"),
        improvement_percent("baseline_rmse", "method_rmse").alias("pooled_rmse_improvement_percent"),
        improvement_percent("baseline_mae", "method_mae").alias("pooled_mae_improvement_percent"),
        "macro_method_rmse", "macro_baseline_rmse",
        improvement_percent("macro_baseline_rmse", "macro_method_rmse").alias("macro_rmse_improvement_percent"))


def fold_comparison(folds: DataFrame, group: str, baselines: Sequence[str], methods: Sequence[str] | None = None,
                    seed: str = "random_seed") -> DataFrame:
    """Fold by fold difference, gain and winner."""
    pairs = _sides(folds, [group, seed, "fold"], ["rmse"], baselines, methods)
    diff = F.col("baseline_rmse") - F.col("method_rmse")
    return pairs.withColumn("rmse_difference", diff).withColumn(
        "rmse_improvement_percent", improvement_percent("baseline_rmse", "method_rmse")).withColumn(
        "winner", winner(diff, "method"))


def paired_points(points: DataFrame, keys: Sequence[str], baselines: Sequence[str], methods: Sequence[str] | None = None,
                  uid: str = "row_uid") -> DataFrame:
    """Both predictions of every common point and fold."""
    return _sides(points, [*keys, "fold", uid], ["target_pl_db", "pred_pl_db"], baselines, methods)


def target_mismatches(pairs: DataFrame) -> DataFrame:
    """Pairs whose two sides disagree on the target; must be empty."""
    return pairs.where(~F.col("method_target_pl_db").eqNullSafe(F.col("baseline_target_pl_db")))


def point_comparison(pairs: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Errors and point wins of each method against each baseline. A strict call ends at a pair with two targets."""
    if strict:
        same = F.col("method_target_pl_db").eqNullSafe(F.col("baseline_target_pl_db"))
        pairs = require(pairs, same, "both sides of a pair have the same target", [*keys, "method", "baseline"])
    em = F.col("method_pred_pl_db") - F.col("method_target_pl_db")
    eb = F.col("baseline_pred_pl_db") - F.col("method_target_pl_db")
    out = pairs.groupBy(*keys, "method", "baseline").agg(
        F.count(F.lit(1)).alias("paired_points"), F.sqrt(F.avg(em * em)).alias("method_rmse"), F.sqrt(F.avg(eb * eb)).alias("baseline_rmse"),
        F.avg(F.abs(em)).alias("method_mae"), F.avg(F.abs(eb)).alias("baseline_mae"),
        F.count(F.when(F.abs(em) < F.abs(eb), 1)).alias("method_point_wins"),
        F.count(F.when(F.abs(eb) < F.abs(em), 1)).alias("baseline_point_wins"))
    return out.withColumn("ties", F.col("paired_points") - F.col("method_point_wins") - F.col("baseline_point_wins")).withColumn(
        "rmse_improvement_percent", improvement_percent("baseline_rmse", "method_rmse")).withColumn(
        "mae_improvement_percent", improvement_percent("baseline_mae", "method_mae")).withColumn(
        "method_point_win_percent", 100.0 * F.col("method_point_wins") / F.col("paired_points"))


def comparison_summary(per_seed: DataFrame, folds: DataFrame, points: DataFrame, group: str) -> DataFrame:
    """Seed means and spreads, seed wins, fold wins after seed averaging, mean point win rate."""
    keys = [group, "method", "baseline"]
    seeds = per_seed.groupBy(*keys).agg(
        F.countDistinct("random_seed").alias("num_seeds"),
        F.avg("pooled_method_rmse").alias("pooled_method_rmse_mean"), F.stddev_samp("pooled_method_rmse").alias("pooled_method_rmse_std"),
        F.avg("pooled_rmse_improvement_percent").alias("pooled_improvement_mean"),
        F.stddev_samp("pooled_rmse_improvement_percent").alias("pooled_improvement_std"),
        F.avg("macro_rmse_improvement_percent").alias("macro_improvement_mean"),
        F.count(F.when(F.col("pooled_method_rmse") < F.col("pooled_baseline_rmse"), 1)).alias("seed_wins"))
    fold_means = folds.groupBy(*keys, "fold").agg(F.avg("method_rmse").alias("m"), F.avg("baseline_rmse").alias("b"))
    wins = fold_means.groupBy(*keys).agg(F.count(F.when(F.col("m") < F.col("b"), 1)).alias("fold_wins"), F.count(F.lit(1)).alias("num_folds"))
    rate = points.groupBy(*keys).agg(F.avg("method_point_win_percent").alias("mean_point_win_percent"))
    return seeds.join(wins, keys).join(rate, keys)


def adaptation_pairs(adapted: DataFrame, zero_shot: DataFrame, uid: str = "row_uid", strict: bool = False) -> DataFrame:
    """Every few-shot prediction with its zero-shot match (left join, null when missing). A strict call ends at a
    prediction without a match or with another target."""
    base = zero_shot.select(uid, "fold", F.col("pred_pl_db").alias("baseline_pred_pl_db"), F.col("target_pl_db").alias("baseline_target_pl_db"))
    out = adapted.join(base, [uid, "fold"], "left")
    matched = F.col("baseline_pred_pl_db").isNotNull() & F.col("target_pl_db").eqNullSafe(F.col("baseline_target_pl_db"))
    return require(out, matched, "a few-shot prediction has a zero-shot match with its target", [uid, "fold"]) if strict else out


def unmatched_adaptations(pairs: DataFrame) -> DataFrame:
    """Few-shot rows without a zero-shot match or with another target; must be empty."""
    return pairs.where(F.col("baseline_pred_pl_db").isNull() | ~F.col("target_pl_db").eqNullSafe(F.col("baseline_target_pl_db")))


def adaptation_gains(pairs: DataFrame, keys: Sequence[str], rows_bound: int | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Metrics of both sides, gains and point wins per key, from one aggregation while groups are small.

    Without a proof of that the errors are written once, as percentiles of large groups read them several times."""
    rows = pairs.withColumn("_a", F.abs(F.col("pred_pl_db") - F.col("target_pl_db"))).withColumn(
        "_b", F.abs(F.col("baseline_pred_pl_db") - F.col("target_pl_db")))
    aggs = [
        F.count(F.lit(1)).alias("test_count"), F.count(F.when(F.col("_a") < F.col("_b"), 1)).alias("adapted_point_wins"),
        F.count(F.when(F.col("_b") < F.col("_a"), 1)).alias("baseline_point_wins")]
    sides = (("_a", "adapted"), ("_b", "baseline"))
    if not fits_one_task(rows_bound, max_group_rows):
        rows = materialise(rows.select(*keys, "_a", "_b"), "adaptation-errors")
    for c, tag in sides:
        aggs += [F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"{tag}_rmse"), F.avg(c).alias(f"{tag}_mae")]
    cold, hot = split_hot(rows, keys, rows_bound, max_group_rows)
    out = cold.groupBy(*keys).agg(*aggs, *[F.percentile(c, 0.9).alias(f"{tag}_p90_ae") for c, tag in sides])
    if hot is not None:
        big = hot.groupBy(*keys).agg(*aggs)
        for c, tag in sides:
            big = null_safe_join(big, exact_percentiles(hot, keys, c, {f"{tag}_p90_ae": 0.9}, max_group_rows), keys)
        out = out.unionByName(big)
    for m in ("rmse", "mae", "p90_ae"):
        out = out.withColumn(f"{m}_improvement_percent", improvement_percent(f"baseline_{m}", f"adapted_{m}"))
    return out.withColumn("ties", F.col("test_count") - F.col("adapted_point_wins") - F.col("baseline_point_wins")).withColumn(
        "adapted_point_win_percent", 100.0 * F.col("adapted_point_wins") / F.col("test_count"))


def adaptation_summary(pairs: DataFrame, fraction: str = "anchor_fraction", seed: str = "anchor_seed") -> DataFrame:
    """Pooled per anchor seed, then mean and spread per fraction, with seed and scenario wins."""
    sides = [("pred_pl_db", "adapted"), ("baseline_pred_pl_db", "baseline")]
    error = {t: F.col(p) - F.col("target_pl_db") for p, t in sides}
    # One pass over the pairs; the folds' sums are then added up for the seeds.
    sums = materialise(pairs.groupBy(fraction, seed, "fold").agg(*[c for t, e in error.items() for c in (
        F.sum(e * e).alias(f"{t}_q"), F.sum(F.abs(e)).alias(f"{t}_s"), F.count(e).alias(f"{t}_n"))]), "fold-sums")

    def mean(t, c):
        return F.try_divide(F.sum(f"{t}_{c}"), F.sum(f"{t}_n"))
    per_seed = sums.groupBy(fraction, seed).agg(*[c for t in error for c in (F.sqrt(mean(t, "q")).alias(f"{t}_rmse"), mean(t, "s").alias(f"{t}_mae"))])
    gains = per_seed.groupBy(fraction).agg(
        F.avg("adapted_rmse").alias("adapted_rmse_mean"), F.stddev_samp("adapted_rmse").alias("adapted_rmse_std"),
        F.avg("baseline_rmse").alias("baseline_rmse_mean"), F.avg("adapted_mae").alias("adapted_mae_mean"),
        F.avg(improvement_percent("baseline_rmse", "adapted_rmse")).alias("rmse_improvement_mean_percent"),
        F.stddev_samp(improvement_percent("baseline_rmse", "adapted_rmse")).alias("rmse_improvement_std_percent"),
        F.count(F.when(F.col("adapted_rmse") < F.col("baseline_rmse"), 1)).alias("anchor_seed_rmse_wins"))
    per_fold = sums.select(fraction, "fold", *[F.sqrt(F.try_divide(f"{t}_q", f"{t}_n")).alias(t) for t in error]).groupBy(fraction, "fold").agg(
        F.avg("adapted").alias("a"), F.avg("baseline").alias("b"))
    wins = per_fold.groupBy(fraction).agg(
        F.count(F.when(F.col("a") < F.col("b"), 1)).alias("scenario_rmse_wins"), F.count(F.lit(1)).alias("num_scenarios"))
    return gains.join(wins, fraction)


def headline(rates: DataFrame, bootstrap: DataFrame, per_seed: DataFrame, primary: str) -> DataFrame:
    """Overall map rates with the building bootstrap and the number of seeds won."""
    keys = ["task", "baseline_method", "metric"]
    seeds = per_seed.groupBy(*keys).agg(
        F.count(F.when(F.col("seed_winner") == primary, 1)).alias("primary_seed_wins"), F.count(F.lit(1)).alias("num_seeds"))
    a = rates.where("scope = 'overall'").select(
        *keys, "mean_primary_value", "mean_baseline_value", "mean_improvement_percent", "primary_map_win_rate")
    b = bootstrap.where("scope = 'overall'").select(
        *keys, "cluster_mean_paired_difference", "difference_ci_low", "difference_ci_high", "primary_building_wins", "num_buildings",
        "sign_test_p_two_sided")
    return a.join(b, keys).join(seeds, keys, "left")


def stack_sources(sources: dict[str, DataFrame], tag: str = "condition_id") -> DataFrame:
    """Stack result tables under condition ids."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def headline_best(ranks: DataFrame, comparison: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank-one row of every group joined with its primary comparison row."""
    return ranks.where("rank = 1").withColumnRenamed("method", "best_method").join(comparison, list(keys), "left")


def seed_winners(per_seed: DataFrame, primary: str, keys: Sequence[str] = ("task",), seed: str = "sparse_seed") -> DataFrame:
    """Seeds the primary method wins against every other method, with the mean gain."""
    pairs = _sides(per_seed, [*keys, seed], ["rmse"], [primary], None).select(
        *keys, F.col("method").alias("other"), F.col("baseline_rmse").alias("p"), F.col("method_rmse").alias("o"))
    return pairs.groupBy(*keys, F.col("other").alias("baseline")).agg(
        F.count(F.lit(1)).alias("seeds"), F.count(F.when(F.col("p") < F.col("o"), 1)).alias("seed_wins"),
        F.avg(improvement_percent("o", "p")).alias("mean_gain_percent"))
