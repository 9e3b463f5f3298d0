"""A point is one row with a bit per kind of prediction; many kinds give the same answers."""

import pytest
from pyspark.sql import functions as F

from signalgrid.operators import kinds, run_contract as RC

ROWS = [(r, u, f"m{m}", f) for r in (1, 2) for u in ("a", "b", None) for m in range(3) for f in ("x", None) if (r, u, m) != (2, "b", 1)]


def frame(spark, extra=()):
    return spark.createDataFrame([*ROWS, *extra], "run int, uid string, method string, fold string")


@pytest.mark.parametrize("words,width", [(8, 63), (8, 2), (0, 63)])
def test_repeats_are_found_per_unit(spark, monkeypatch, words, width):
    monkeypatch.setattr(kinds, "BITS", width)
    extra = [(2, "a", "m0", None), (1, None, "m2", "x")]
    found = kinds.unit_kinds(frame(spark, extra), ["run"], ["uid"], ["method", "fold"], [F.max("uid").alias("u")], words)
    assert sorted(map(str, {(r.run, r.uid) for r in found.units.where("NOT _unique").collect()})) == ["(1, None)", "(2, 'a')"]
    assert sum(r["_c"] for r in found.table.collect()) == len(ROWS) + 2 and found.table.count() == 12
    assert found.units.count() == (6 if words else len(ROWS))


@pytest.mark.parametrize("words,width", [(8, 63), (8, 2), (0, 63)])
def test_points_per_method(spark, monkeypatch, words, width):
    monkeypatch.setattr(kinds, "BITS", width)
    monkeypatch.setattr(kinds, "WORDS", words)
    monkeypatch.setattr(kinds.unit_kinds, "__defaults__", ((), words))
    rows = frame(spark).select(F.lit("s").alias("run_split"), F.col("run").alias("run_seed"), "uid", "method", "fold",
                               F.lit("s").alias("split"), F.col("run").alias("random_seed"), F.lit(1.0).alias("pred"))
    got = {r.run_seed: r for r in RC._samples(rows, "uid", ["pred"]).collect()}
    assert {s: (r.sample_rows, r.unique_test_points, r["_fewest"], r["_most"], r["_s_unique"], r["_s_seed"]) for s, r in got.items()} == {
        1: (18, 2, 2, 2, True, True), 2: (16, 2, 1, 2, True, True)}


def test_a_point_of_many_predictions_is_shuffled_once(spark):
    rows = spark.range(1000).select(F.lit("s").alias("run_split"), F.lit(1).alias("run_seed"), F.col("id").cast("string").alias("uid"), F.explode(F.array(*[F.lit(f"m{i}") for i in range(5)])).alias("method"),
                                    F.lit("x").alias("fold"), F.lit("s").alias("split"), F.lit(1).alias("random_seed"), F.lit(1.0).alias("pred"))
    plan = RC._samples(rows, "uid", ["pred"])._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning" in line and "uid" in line for line in plan.splitlines()) == 1


def test_planned_kinds_are_told_from_one_row_per_point(spark):
    from signalgrid.operators.audits import planned_units

    names = "uid string, method string, fraction double, seed int"
    plan = {"method": tuple(f"m{i}" for i in range(40)), "fraction": (0.01, 0.05), "seed": (1,)}
    whole = [(u, m, f, 1) for u in ("a", None) for m in plan["method"] for f in plan["fraction"]]

    def told(rows):
        found = planned_units(spark.createDataFrame(rows, names), ["uid"], plan)
        row = found.units.agg(found.unique().alias("unique"), *[found.whole(c).alias(c) for c in ("method", "seed")], found.whole("fraction", lambda c: F.round(c, 2)).alias("fraction")).first()
        return found, [c for c in ("unique", "method", "fraction", "seed") if not row[c]]

    found, broken = told(whole)
    assert (found.words, found.units.count(), broken) == (2, 2, [])
    assert told([*whole, whole[3]])[1] == ["unique"]
    assert told([r for r in whole if r[1] != "m39"])[1] == ["method"]
    assert told([*whole, ("a", "m1", 0.050001, 1)])[1] == []
    assert told([*whole, *[("b", "other", 0.01, None)] * 2])[1] == ["unique", "method", "seed"]
    assert told([r for r in whole if r[2] < 0.02] + [("a", "m1", 0.050001, 1)])[1] == []
