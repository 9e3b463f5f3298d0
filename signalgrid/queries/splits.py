"""Splits and folds over the manifest and point views."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalgrid.operators import splits as X
from signalgrid.plans import views
from signalgrid.queries import sql_parts as sq
from signalgrid.queries.registry import query, scan_rows, tidy

GROUPS = f"""WITH g AS (SELECT DISTINCT scene_id AS grp FROM manifest),
ranked AS (SELECT grp, row_number() OVER (ORDER BY {sq.hash_sql("'split'", "'42'", "grp")}, grp) AS rn, count(*) OVER () AS n FROM g)"""


def manifest(spark, sf_dir):
    return views.manifest(spark, sf_dir)


@query("spl1_group_disjoint_split", GROUPS + """
SELECT sample_id, scene_id, CASE WHEN rn <= least(greatest(1, CAST(round_even(n * 25e-2, 0) AS BIGINT)), n - 1) THEN 'val' ELSE 'train' END AS side
FROM manifest JOIN ranked ON grp = scene_id""", ["manifest"])
def spl1(spark, sf_dir):
    return X.group_split(manifest(spark, sf_dir), "scene_id", 0.25, 42, rows_bound=scan_rows(spark, sf_dir, "customer")).select(
        "sample_id", "scene_id", "side")


def assignment(spark, sf_dir):
    """A fixed list from the nation table with deliberate faults: one group twice, one on both sides."""
    nations = views.read_table(spark, sf_dir, "nation").selectExpr(
        "concat('N', CAST(n_nationkey AS STRING)) AS scene_id", "n_nationkey AS k")
    base = nations.where("k <> 3").selectExpr("scene_id", "CASE WHEN k % 4 = 0 THEN 'val' ELSE 'train' END AS side")
    extra = nations.where("k IN (5, 8)").selectExpr("scene_id", "'train' AS side")
    unknown = nations.where("k = 1").selectExpr("'N99' AS scene_id", "'val' AS side")
    return base.unionByName(extra).unionByName(unknown)


@query("spl2_fixed_lists", """
WITH n AS (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS scene_id, n_nationkey AS k FROM nation),
a AS (SELECT scene_id, CASE WHEN k % 4 = 0 THEN 'val' ELSE 'train' END AS side FROM n WHERE k <> 3 UNION ALL SELECT scene_id, 'train' FROM n WHERE k IN (5, 8) UNION ALL SELECT 'N99', 'val'),
l AS (SELECT scene_id, count(*) AS c, count(DISTINCT side) AS s FROM a GROUP BY 1), m AS (SELECT DISTINCT scene_id FROM manifest)
SELECT 'on_both_sides' AS problem, scene_id FROM l WHERE s > 1 UNION ALL SELECT 'listed_twice', scene_id FROM l WHERE c > 1 AND s = 1
UNION ALL SELECT 'not_in_manifest', scene_id FROM l WHERE scene_id NOT IN (SELECT scene_id FROM m) UNION ALL SELECT 'not_listed', scene_id FROM m WHERE scene_id NOT IN (SELECT scene_id FROM l)""", ["manifest"])
def spl2(spark, sf_dir):
    return X.fixed_split_problems(manifest(spark, sf_dir), "scene_id", assignment(spark, sf_dir))


@query("spl3_three_way_split", GROUPS + """, t AS (SELECT *, rn <= least(greatest(1, CAST(round_even(n * 2e-1, 0) AS BIGINT)), n - 2) AS test FROM ranked),
r AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY rn) AS rr, count(*) OVER (PARTITION BY test) AS nr FROM t)
SELECT sample_id, CASE WHEN test THEN 'test' WHEN rr <= least(greatest(1, CAST(round_even(n * 2e-1, 0) AS BIGINT)), nr - 1) THEN 'val' ELSE 'train' END AS side
FROM manifest JOIN r ON grp = scene_id""", ["manifest"])
def spl3(spark, sf_dir):
    return X.three_way_split(manifest(spark, sf_dir), "scene_id", 0.2, 0.2, 42, scan_rows(spark, sf_dir, "customer")).select("sample_id", "side")


@query("spl4_split_summary", GROUPS + """, s AS (SELECT scene_id, CASE WHEN rn <= least(greatest(1, CAST(round_even(n * 25e-2, 0) AS BIGINT)), n - 1) THEN 'val' ELSE 'train' END AS side
FROM manifest JOIN ranked ON grp = scene_id) SELECT side, count(*) AS "rows", count(DISTINCT scene_id) AS "groups" FROM s GROUP BY 1""", ["manifest"])
def spl4(spark, sf_dir):
    return tidy(X.split_summary(X.group_split(manifest(spark, sf_dir), "scene_id", 0.25, 42, rows_bound=scan_rows(spark, sf_dir, "customer")), "scene_id"))


@query("spl5_folds", f"""
WITH r AS (SELECT row_uid, row_number() OVER (ORDER BY {sq.hash_sql("'fold'", "'11'", "row_uid")}, row_uid) AS rn, count(*) OVER () AS n FROM points)
SELECT row_uid, 'random' AS fold, rn <= greatest(1, CAST(round_even(n * 2e-1, 0) AS BIGINT)) AS is_test FROM r
UNION ALL SELECT row_uid, concat('holdout_', v), scenario = v FROM points, (VALUES ('Annex'), ('North'), ('River')) s(v)
UNION ALL SELECT row_uid, concat('holdout_', v), config = v FROM points, (VALUES ('C1'), ('C2')) s(v)""", ["points"])
def spl5(spark, sf_dir):
    rows = views.points(spark, sf_dir).select("row_uid", "scenario", "config")
    parts = [X.random_fold(rows, "row_uid", 0.2, 11, scan_rows(spark, sf_dir, "lineitem")),
             X.leave_out_folds(rows, "scenario", views.SCENARIOS), X.leave_out_folds(rows, "config", views.CONFIGS)]
    out = [p.select("row_uid", "fold", "is_test") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("spl6_grouped_kfold", """
WITH RECURSIVE g AS (SELECT scene_id, count(*) AS n FROM manifest GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, scene_id) AS i FROM g),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(NULL AS VARCHAR) AS scene_id, CAST(NULL AS BIGINT) AS fold
  UNION ALL SELECT o.i, a + CASE WHEN a <= b AND a <= c THEN n ELSE 0 END, b + CASE WHEN b < a AND b <= c THEN n ELSE 0 END, c + CASE WHEN c < a AND c < b THEN n ELSE 0 END, o.scene_id,
  CAST(CASE WHEN a <= b AND a <= c THEN 0 WHEN b < a AND b <= c THEN 1 ELSE 2 END AS BIGINT) FROM walk JOIN o ON o.i = walk.i + 1)
SELECT m.sample_id, w.fold FROM manifest_rows m JOIN walk w USING (scene_id)""".replace("manifest_rows", "(SELECT * FROM manifest)").replace("WITH RECURSIVE g", "WITH g"), ["manifest"], recursive=True)
def spl6(spark, sf_dir):
    return tidy(X.group_kfold(manifest(spark, sf_dir), "scene_id", 3).select("sample_id", "fold"))


@query("spl7_group_column", """SELECT 'scenario' AS group_column FROM points HAVING count(DISTINCT scenario) >= 2
UNION ALL SELECT 'config' FROM points HAVING count(DISTINCT scenario) < 2""", ["points"])
def spl7(spark, sf_dir):
    return X.group_column_choice(views.points(spark, sf_dir), "scenario", "config")
