import math
from statistics import NormalDist

from pyspark.sql import functions as F

from lectio.operators import metrics, normal

UNIT = NormalDist()


def test_columns_are_the_normal_distribution(spark):
    shares = [k / 1000 for k in range(1, 1000)] + [10.0**-k for k in range(4, 300, 7)] + [1 - 10.0**-k for k in range(4, 16)]
    points = [k / 37 for k in range(-300, 300)] + [0.0, -9.5, 9.5, -20.0, 20.0, 0.66, -0.663, 5.65, 5.66]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", normal.inverse(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - UNIT.inv_cdf(r.x)) <= 1e-12 * max(1, abs(r.y)) for r in got)
    got = spark.createDataFrame([(x,) for x in points], "x double").select("x", normal.distribution(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - UNIT.cdf(r.x)) <= 1e-12 for r in got)
    assert all(math.isclose(r.y, 0.5 * math.erfc(-r.x / math.sqrt(2)), rel_tol=1e-11) for r in got)


def test_ends_and_nulls(spark):
    rows = [(0.0,), (1.0,), (-0.1,), (1.5,), (float("nan"),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").coalesce(1).select(normal.inverse(F.col("x"))).collect()]
    assert got[:2] == [float("-inf"), float("inf")] and all(math.isnan(x) for x in got[2:5]) and got[5] is None
    rows = [(float("-inf"),), (float("inf"),), (float("nan"),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").coalesce(1).select(normal.distribution(F.col("x"))).collect()]
    assert got[:2] == [0.0, 1.0] and math.isnan(got[2]) and got[3] is None


def test_adjusted_shares(spark):
    cases = [(0, 10, 0.0), (3, 10, 0.1), (10, 10, -0.2), (500, 1000, 0.05), (990, 1000, 0.9), (0, 0, 0.0)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, below long, n long, a double")
    share = lambda s: normal.adjusted(F.lit(s), F.col("below"), F.col("n"), F.col("a"))
    for r in d.select("i", share(0.025).alias("lo"), share(0.975).alias("hi")).collect():
        want = metrics._adjusted(*cases[r.i])
        assert abs(r.lo - want[0]) < 1e-12 and abs(r.hi - want[1]) < 1e-12
