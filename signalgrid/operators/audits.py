"""Data-quality and leakage checks as DataFrames of results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgrid.functions.hashing import stable_hash
from signalgrid.operators.kinds import BITS, bits, unit_kinds
from signalgrid.operators.metrics import finite

RESULT = "check_id int, name string, status string, severity string, detail string, metrics map<string,string>"


def result(check_id: int, name: str, offenders: DataFrame, detail: str, warn: bool = False) -> DataFrame:
    """One result row from a frame of offending rows: PASS when it is empty, else FAIL (or WARN)."""
    bad = "WARN" if warn else "FAIL"
    count = offenders.agg(F.count(F.lit(1)).alias("n"))
    return count.select(
        F.lit(check_id).alias("check_id"), F.lit(name).alias("name"), F.when(F.col("n") == 0, "PASS").otherwise(bad).alias("status"),
        F.lit("warn" if warn else "error").alias("severity"),
        F.concat(F.col("n").cast("string"), F.lit(f" {detail}")).alias("detail"),
        F.create_map(F.lit("offenders"), F.col("n").cast("string")).alias("metrics"))


def shared_groups(train: DataFrame, val: DataFrame, group: str) -> DataFrame:
    """Groups present on both sides."""
    return train.select(F.col(group).cast("string")).intersect(val.select(F.col(group).cast("string")))


def perturbed(base_maps: DataFrame, anchors: DataFrame, target: str = "path_loss", low: float = 25.0, spread: int = 50) -> DataFrame:
    """The same maps with hash noise on every target that is not an anchor."""
    keep = anchors.select("sample_id", "y", "x").distinct().withColumn("_anchor", F.lit(True))
    noise = F.lit(float(low)) + stable_hash(F.lit("noise"), "sample_id", "y", "x") % spread
    return base_maps.join(keep, ["sample_id", "y", "x"], "left").withColumn(
        target, F.when(F.col("_anchor"), F.col(target)).otherwise(F.col(target) + noise)).drop("_anchor")


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows whose values differ between two computations, or that one of them lacks."""
    a = before.select(*keys, F.struct(*columns).alias("a"))
    b = after.select(*keys, F.struct(*columns).alias("b"))
    moved = F.col("a").isNull() | F.col("b").isNull()
    for c in columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        moved = moved | ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x)), F.lit(False)))
    return a.join(b, list(keys), "full").where(moved)


def non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a missing, NaN or infinite value, with the names of the columns at fault."""
    names = F.concat_ws(",", *[F.when(~finite(c), F.lit(c)) for c in columns])
    return df.withColumn("columns", names).where("columns <> ''")


def anchor_count_status(anchors: DataFrame, valid_cells: DataFrame, min_anchors: int) -> DataFrame:
    """Per (sample, rate, seed): FAIL below the achievable minimum, WARN on tiny maps, else PASS."""
    cells = valid_cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("valid"))
    taken = anchors.groupBy("sample_id", "rate", "seed").agg(F.count(F.lit(1)).alias("anchors"))
    return taken.join(cells, "sample_id").withColumn(
        "status", F.when(F.col("anchors") < F.least(F.lit(min_anchors), "valid"), "FAIL")
        .when(F.col("valid") < min_anchors, "WARN").otherwise("PASS"))


def bounds_rows(samples: DataFrame, overflow: dict[str, Column]) -> DataFrame:
    """Transmitters outside their raster, worst first."""
    return samples.withColumns(overflow).where("out_of_bounds").orderBy(F.desc("max_clip_px"), "sample_id")


def bounds_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of out-of-bounds transmitters by attribute, edge and rounded-up distance."""
    edge = F.explode(F.filter(F.array(*[
        F.when(F.col(f"over_{e}_px") > 0, F.lit(e)) for e in ("left", "right", "top", "bottom")]), lambda e: e.isNotNull()))
    return rows.withColumn("edge", edge).groupBy(*by, "edge", F.ceil("max_clip_px").alias("clip_px")).agg(F.count(F.lit(1)).alias("samples"))


def run_audit(metrics: DataFrame, expectations: DataFrame, methods: Sequence[str], run_keys: Sequence[str],
              uid: Sequence[str] = ("sample_id", "method", "sparse_seed")) -> DataFrame:
    """Each run against its expected seed, rate and map count; one aggregation for all runs."""
    wanted = F.col("method").isin(*methods)
    dup = metrics.groupBy(*dict.fromkeys([*run_keys, *uid])).agg(
        F.count(F.lit(1)).alias("c"), F.min("sparse_rate").alias("r0"), F.max("sparse_rate").alias("r1"))
    per_method = dup.groupBy(*dict.fromkeys([*run_keys, "method"])).agg(
        F.countDistinct("sample_id").alias("maps"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("dup_rows"),
        F.sum("c").alias("rows"), F.min("r0").alias("r0"), F.max("r1").alias("r1"))
    runs = per_method.groupBy(*run_keys).agg(
        F.sum("rows").alias("rows"), F.sum("dup_rows").alias("duplicate_rows"), F.min("r0").alias("r0"), F.max("r1").alias("r1"),
        F.count(F.when(wanted, 1)).alias("methods_found"), F.min(F.when(wanted, F.col("maps"))).alias("fewest_maps"),
        F.max(F.when(wanted, F.col("maps"))).alias("most_maps"))
    joined = expectations.join(runs, list(run_keys), "left")
    checks = {
        "run_present": F.col("rows").isNotNull(),
        "rate_correct": (F.col("r0") == F.col("expected_rate")) & (F.col("r1") == F.col("expected_rate")),
        "methods_present": F.col("methods_found") == len(methods),
        "maps_expected": (F.col("fewest_maps") == F.col("expected_maps")) & (F.col("most_maps") == F.col("expected_maps")),
        "no_duplicates": F.col("duplicate_rows") == 0,
    }
    out = joined.select(*run_keys, F.coalesce("rows", F.lit(0)).alias("rows"),
                        *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return out.withColumn("audit_pass", passed)


def prediction_audit(points: DataFrame, keys: Sequence[str], uid: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per run: rows, repeated predictions, non-finite values, points without every method."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~finite(c)
    per_point = points.groupBy(*dict.fromkeys([*keys, *uid, "method"])).agg(
        F.count(F.lit(1)).alias("c"), F.count(F.when(bad, 1)).alias("bad"))
    by_uid = per_point.groupBy(*dict.fromkeys([*keys, *uid])).agg(
        F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("repeats"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("methods"))
    return by_uid.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("repeats").alias("repeated_predictions"), F.sum("bad").alias("non_finite"),
        F.count(F.lit(1)).alias("points"), F.min("methods").alias("fewest_methods"), F.max("methods").alias("most_methods"))


def boolean_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named aggregate conditions as rows (name, passed)."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return row.unpivot([], list(checks), "name", "passed")


@dataclass(frozen=True)
class Planned:
    """Predictions against the planned values of their key columns.

    `units` has a row per point: the number of its rows and a bit per planned kind (a value of every column). Rows of any other kind are in
    rows of their own, with that kind in `_other`."""

    units: DataFrame
    values: dict[str, tuple]
    words: int

    def unique(self) -> Column:
        """No point has a kind twice."""
        have = sum((F.bit_count(f"_w{i}") for i in range(self.words)), F.lit(0))
        return F.min(F.col("_c") == F.when(F.col("_other").isNull(), have).otherwise(1))

    def whole(self, column: str, bounded=lambda c: c) -> Column:
        """The column's values are exactly the planned ones; a null is a foreign value."""
        own, known = bounded(F.col(f"_other.{column}")), F.col("_other").isNull()
        inside = F.min(F.coalesce(known | own.isin(*self.values[column]), F.lit(False)))
        place = list(self.values).index(column)
        masks: dict = {v: [0] * self.words for v in self.values[column]}
        for i, kind in enumerate(product(*self.values.values())):
            masks[kind[place]][i // BITS] |= 1 << i % BITS
        for v, words in masks.items():
            among = reduce(or_, [F.col(f"_w{i}").bitwiseAND(F.lit(m).cast("bigint")) != 0 for i, m in enumerate(words)])
            inside = inside & F.max(F.coalesce(F.when(known, among).otherwise(own == v), F.lit(False)))
        return inside


def planned_units(rows: DataFrame, unit: Sequence[str], values: dict[str, tuple], aggs: Sequence[Column] = ()) -> Planned:
    """`rows` read once: one row per unit, combined before the shuffle; only rows of a kind that was not planned stay by kind."""
    place, known, total = F.lit(0), F.lit(True), 1
    for column, expected in values.items():
        at = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in expected]), F.col(column)), F.lit(0)).cast("int")
        place, known, total = place * len(expected) + at - 1, known & (at > 0), total * len(expected)
    words = -(-total // BITS)
    placed = rows.withColumns({"_place": F.when(known, place).otherwise(-1), "_other": F.when(~known, F.struct(*values))})
    units = placed.groupBy(*unit, "_other").agg(F.count(F.lit(1)).alias("_c"), *aggs, *[b.alias(f"_w{i}") for i, b in enumerate(bits(words))])
    return Planned(units, values, words)


def fewshot_audit(fewshot: DataFrame, zero: DataFrame, summaries: DataFrame, methods: Sequence[str], folds: Sequence[str],
                  fractions: Sequence[float], anchor_seeds: Sequence[int], model_seed: int = 11) -> DataFrame:
    """The twelve conditions on few-shot predictions and the run they adapt, as rows (name, passed).

    `summaries` has one row per kind (fewshot, zero) with the split and seed it states.
    A point of the planned predictions is one row, so no group is large and no prediction is shuffled.
    """
    few = planned_units(fewshot, ["row_uid"], {"fold": tuple(folds), "method": tuple(methods), "anchor_fraction": tuple(fractions),
                                               "anchor_seed": tuple(anchor_seeds), "model_seed": (model_seed,)}, [_worst_anchor().alias("anchor")])
    base = unit_kinds(zero, [], ["row_uid"], ["fold", "method"]).units

    def stated(kind, column, value):
        return F.min(F.when(F.col("kind") == kind, F.col(column).eqNullSafe(F.lit(value))))
    parts = (
        boolean_checks(summaries, {
            "fewshot_split": stated("fewshot", "split", "leave_scenario_fewshot"), "zero_shot_split": stated("zero", "split", "leave_scenario_out"),
            f"fewshot_model_seed_{model_seed}": stated("fewshot", "seed", model_seed), f"zero_shot_seed_{model_seed}": stated("zero", "seed", model_seed)}),
        boolean_checks(few.units, {
            "fewshot_methods_complete": few.whole("method"), "folds_complete": few.whole("fold"),
            "fractions_complete": few.whole("anchor_fraction", lambda c: F.round(c, 2)),
            "anchor_seeds_complete": few.whole("anchor_seed"), "model_seed_constant": few.whole("model_seed"),
            "anchors_excluded": ~F.max("anchor"), "fewshot_predictions_unique": few.unique()}),
        boolean_checks(base, {"zero_shot_predictions_unique": F.min("_unique")}))
    return reduce(DataFrame.unionByName, parts)


def _worst_anchor() -> Column:
    """True when some row is an anchor or does not say."""
    return F.max(F.coalesce(F.col("is_anchor"), F.lit(True)))


def grid_mismatches(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys missing from, foreign to, or repeated in a result table."""
    have = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
    want = expected.select(*keys).distinct().withColumn("want", F.lit(1))
    return have.join(want, list(keys), "full").select(
        *keys, F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected")
        .when(F.col("have") > 1, "duplicate").alias("problem")).where("problem IS NOT NULL")


def unresolved_paths(manifest: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Manifest rows whose file is not in the listing."""
    return manifest.join(listing.select(F.col(path)).distinct(), path, "left_anti")


def readiness(checks: dict[str, DataFrame], warn: Sequence[str] = ()) -> DataFrame:
    """A numbered table of results from named offender frames."""
    rows = [result(i + 1, name, bad, "offending row(s)", name in warn) for i, (name, bad) in enumerate(checks.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
