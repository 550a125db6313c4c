import math

import numpy as np
import pytest

from lectio.operators import free
from lectio.operators import metrics as m


def made():
    """Statistics that are sent by value, as workers don't have this module."""

    def median(units, w):
        import numpy as np

        return float(np.median(np.repeat(units["rate"].to_numpy(), w)))

    def heaviest(units, w):
        """Length of the name of the unit with the greatest rate that was drawn."""
        own = units[w > 0]
        return float(len(own.loc[own["rate"].idxmax(), "name"]))

    return median, heaviest


median, heaviest = made()


def table(spark, n, seed=1):
    r = np.random.default_rng(seed)
    rates = r.lognormal(0, 1, n)
    return rates, spark.createDataFrame([(i, float(x), "n" * (i % 7)) for i, x in enumerate(rates)], "i int, rate double, name string").repartition(3)


def test_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(free, "BLOCK_ROWS", 500)  # several blocks
    rates, units = table(spark, 41)
    plan = m.plan(spark, 41, 60, 5)
    got = {r.metric: r for r in free.intervals(units, ["rate", "name"], {"median": median, "heaviest": heaviest}, plan).collect()}
    w = np.zeros((60, 41), int)
    for r in plan.collect():
        w[r.b, r.i] += r.w
    values = [np.median(np.repeat(rates, x)) for x in w]
    assert got["median"].point == pytest.approx(np.median(rates)) and got["median"].ci_method == "percentile_bootstrap"
    assert (got["median"].lo, got["median"].hi) == pytest.approx(tuple(np.percentile(values, (2.5, 97.5))))
    most = [max((i for i in range(41) if x[i]), key=lambda i: rates[i]) % 7 for x in w]
    assert (got["heaviest"].lo, got["heaviest"].hi) == pytest.approx(tuple(np.percentile(most, (2.5, 97.5))))


def test_no_units_nan_values_and_missing_units(spark):
    rates, units = table(spark, 9)
    plan = m.plan(spark, 9, 20, 5)
    none = free.intervals(units.where("false"), ["rate"], {"median": median}, plan).first()
    assert all(math.isnan(x) for x in (none.point, none.lo, none.hi))
    nan = free.intervals(units, ["rate"], {"nan": lambda u, w: math.nan, "some": lambda u, w: math.nan if w[0] else 1.0}, plan)
    nan = {r.metric: r for r in nan.collect()}
    assert all(math.isnan(x) for x in (nan["nan"].point, nan["nan"].lo, nan["nan"].hi))
    assert math.isnan(nan["some"].point) and (nan["some"].lo, nan["some"].hi) == (1.0, 1.0)
    with pytest.raises(Exception, match="isn't there"):
        free.intervals(units.where("i < 8"), ["rate"], {"median": median}, plan).collect()


def test_bags_come_near_the_whole_plan(spark, monkeypatch):
    rates, units = table(spark, 4000, 3)
    want = free.intervals(units, ["rate"], {"median": median}, m.plan(spark, 4000, 200, 7)).first()
    monkeypatch.setattr(free, "MOST_BYTES", 40_000)
    n, size = free.measured(units, ["rate"])
    bags = free.bagged(units, ["rate"], {"median": median}, n, size, 100, 7).collect()
    got = free.intervals(units, ["rate"], {"median": median}, m.plan(spark, 4000, 200, 7), seed=7).first()
    assert len(bags) > 5 and got.ci_method == "bag_of_little_bootstraps"
    assert got.lo == pytest.approx(np.mean([r.lo for r in bags]))  # the same draws each time
    width = want.hi - want.lo
    assert abs(got.point - want.point) < width / 2 and abs((got.hi - got.lo) / width - 1) < 0.35
