"""Every check of a run's contract fails for its own fault, and only the checks that the fault breaks."""

import pytest

from signalgrid.operators import run_contract as RC

METHODS = ("a", "b")
SEED, OTHER = "wrong seed", "wrong split"

#: What is changed in a whole run, and the checks that must then fail.
FAULTS = {
    1: ("nothing", set()),
    2: ("summary split", {"summary_split"}),
    3: ("summary seed", {"summary_seed"}),
    4: ("cleaned", {"rows_after_cleaning"}),
    5: ("removed", {"rows_removed_total"}),
    6: ("fold method missing", {"methods_complete", "fold_result_row_count"}),
    7: ("foreign fold", {"folds_complete", "fold_result_row_count", "test_counts_correct"}),
    8: ("point missing in one method", {"sample_row_count", "all_points_once_per_method"}),
    9: ("prediction repeated", {"sample_row_count", "unique_predictions"}),
    10: ("pooled row repeated", {"pooled_row_count"}),
    11: ("fold seed", {"fold_seed_column"}),
    12: ("sample seed", {"sample_seed_column"}),
    13: ("fold split", {"fold_split_column"}),
    14: ("sample split", {"sample_split_column"}),
    15: ("pooled split", {"pooled_split_column"}),
    16: ("foreign pooled method", {"pooled_methods_complete"}),
    17: ("fold metric infinite", {"finite_fold_metrics"}),
    18: ("prediction null", {"finite_sample_values"}),
    19: ("pooled metric NaN", {"finite_pooled_metrics"}),
    20: ("test count", {"test_counts_correct"}),
    21: ("files", {"dataset_fingerprints_match"}),
    22: ("features", {"features_match_within_protocol"}),
    23: ("no tables", set(RC.CHECKS)),
    24: ("point without id", {"all_points_once_per_method"}),
}


def tables(spark, runs):
    """Two folds of two points each, two methods, for every run; each run carries its fault."""
    summaries, folds, samples, pooled = [], [], [], []
    for r in runs:
        fault = FAULTS[r][0]
        if fault == "no tables":
            continue
        summaries.append(("p", r, OTHER if fault == "summary split" else "p", 0 if fault == "summary seed" else r, 3 if fault == "cleaned" else 4,
                          1 if fault == "removed" else 0, "f2" if fault == "files" else "f1", "x" if fault == "features" else "x,y"))
        for m in METHODS:
            for f in ("f", "g"):
                if not (fault == "fold method missing" and m == "b"):
                    folds.append(("p", r, OTHER if fault == "fold split" else "p", 0 if fault == "fold seed" else r, f, m,
                                  float("inf") if fault == "fold metric infinite" and f == "g" else 1.0, 1 if fault == "test count" and f == "g" else 2))
                for u in (f + "1", f + "2"):
                    if not (fault == "point missing in one method" and m == "b" and u == "g2"):
                        samples.append(("p", r, OTHER if fault == "sample split" else "p", 0 if fault == "sample seed" else r, f, m,
                                        None if fault == "point without id" and u == "f1" else u, None if fault == "prediction null" and u == "f1" else 1.0))
            pooled.append(("p", r, OTHER if fault == "pooled split" else "p", "c" if fault == "foreign pooled method" and m == "b" else m,
                           float("nan") if fault == "pooled metric NaN" else 1.0))
        if fault == "foreign fold":
            folds.append(("p", r, "p", r, "h", "a", 1.0, 2))
        if fault == "prediction repeated":
            samples.append(samples[-1])
        if fault == "pooled row repeated":
            pooled.append(pooled[-1])
    key = "run_split string, run_seed int, "
    make = spark.createDataFrame
    return (make([("p", r, 4, 0) for r in runs], key + "points bigint, removed int"),
            make([("p", r, f, 2) for r in runs for f in ("f", "g")], key + "fold string, test_count bigint"),
            make(summaries, key + "stated_split string, stated_seed int, rows_after_cleaning bigint, rows_removed_total bigint, fingerprint string, features string"),
            make(folds, key + "split string, random_seed int, fold string, method string, rmse double, test_count bigint"),
            make(samples, key + "split string, random_seed int, fold string, method string, row_uid string, pred double"),
            make(pooled, key + "split string, method string, rmse double"))


def test_each_fault_breaks_its_checks(spark):
    out = RC.run_contract(*tables(spark, list(FAULTS)), METHODS, ["rmse"], ["pred"])
    got = {r["run_seed"]: set(r["failed"].split(",")) - {""} for r in out.collect()}
    assert got == {r: names for r, (_, names) in FAULTS.items()}
    assert set().union(*(names for r, (_, names) in FAULTS.items() if r != 23)) == set(RC.CHECKS)


def test_strict_call_names_run_and_checks(spark):
    good = tables(spark, [1])
    assert [r["status"] for r in RC.run_contract(*good, METHODS, ["rmse"], ["pred"], strict=True).collect()] == ["PASS"]
    with pytest.raises(Exception, match="run breaks its contract.*run_seed=9, failed=sample_row_count,unique_predictions"):
        RC.run_contract(*tables(spark, [1, 9]), METHODS, ["rmse"], ["pred"], strict=True).collect()


def test_runs_nobody_planned(spark):
    _, _, runs, folds, samples, pooled = tables(spark, [1, 2])
    planned = spark.createDataFrame([("p", 1)], "run_split string, run_seed int")
    assert [tuple(r) for r in RC.unplanned_runs(planned, runs, folds, samples, pooled).collect()] == [("p", 2)]


def test_fewshot_audit_counts_nulls_and_repeats_as_faults(spark):
    from signalgrid.operators.audits import fewshot_audit

    few = "row_uid string, fold string, method string, anchor_fraction double, anchor_seed int, model_seed int, is_anchor boolean"
    zero = spark.createDataFrame([("u", "f", "m", 11)], "row_uid string, fold string, method string, random_seed int")
    stated = spark.createDataFrame([("fewshot", "leave_scenario_fewshot", 11), ("zero", "leave_scenario_out", None)], "kind string, split string, seed int")

    def failed(*rows):
        out = fewshot_audit(spark.createDataFrame(list(rows), few), zero, stated, ["m"], ["f"], [0.01], [1])
        return {r["name"] for r in out.collect() if not r["passed"]} - {"zero_shot_seed_11"}
    good = ("u", "f", "m", 0.0100001, 1, 11, False)
    assert failed(good, ("v", *good[1:])) == set()
    assert failed(good, good) == {"fewshot_predictions_unique"}
    assert failed(good, ("v", None, None, 0.01, None, 12, None)) == {
        "folds_complete", "fewshot_methods_complete", "anchor_seeds_complete", "model_seed_constant", "anchors_excluded"}
    assert len(failed()) == 7
