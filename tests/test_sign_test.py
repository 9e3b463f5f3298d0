import math

from pyspark.sql import functions as F

from signalgrid.operators import paired


def test_sign_test_of_many_pairs(spark):
    cases = [(1200, 1100), (1100, 1200), (4000, 4100), (1500, 0), (30_000, 30_000), (5, 3), (0, 0)]
    frame = spark.createDataFrame(cases, "p bigint, n bigint")
    for p, n, got in frame.select("p", "n", paired.sign_test(F.col("p"), F.col("n"))).collect():
        if p + n == 0:
            assert got is None
            continue
        tail = 0
        term = 1
        for i in range(min(p, n) + 1):
            tail += term
            term = term * (p + n - i) // (i + 1)
        assert math.isclose(got, min(1.0, 2 * tail / 2 ** (p + n)), rel_tol=1e-7, abs_tol=1e-300)
