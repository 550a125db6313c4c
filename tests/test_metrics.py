import math
import random
from statistics import NormalDist

import pytest

from lectio.operators import metrics as m

CODES = ["none", "circellus", "rafe", "both"]


def values(spark, units, metric):
    rows = [(a, b, n) for (a, b), n in units.items()]
    d = spark.createDataFrame(rows, "a string, b string, n long")
    return m.evaluate(m.alpha_stats(d, [], CODES, "u_"), [metric]).first()[0]


def plain_alpha(units):
    flat = [p for p, n in units.items() for _ in range(n)]
    if not flat:
        return math.nan
    labels = [x for p in flat for x in p]
    n = len(labels)
    observed = 2 * sum(a != b for a, b in flat)
    expected = sum(labels.count(x) * labels.count(y) for x in CODES for y in CODES if x != y) / (n - 1)
    return (1.0 if observed == 0 else math.nan) if expected == 0 else 1 - observed / expected


def test_alpha(spark):
    cases = [{("none", "none"): 5}, {("none", "rafe"): 1}, {("rafe", "rafe"): 3, ("circellus", "rafe"): 1, ("none", "circellus"): 2}, {("none", "none"): 90, ("rafe", "rafe"): 5, ("rafe", "none"): 3, ("both", "circellus"): 2}]
    for c in cases:
        got, want = values(spark, c, m.alpha("x", CODES)), plain_alpha(c)
        assert got == pytest.approx(want, nan_ok=True)
        rest = {k: n for k, n in c.items() if k != ("none", "none")}
        assert values(spark, c, m.alpha("x", CODES, positive=True)) == pytest.approx(plain_alpha(rest), nan_ok=True)
    # ten units of two coders, eight alike, half marked: D_o = 4, D_e = (400 - 200) / 19
    half = {("none", "none"): 4, ("rafe", "rafe"): 4, ("none", "rafe"): 1, ("rafe", "none"): 1}
    assert values(spark, half, m.alpha("x", CODES)) == pytest.approx(1 - 4 / (200 / 19))


def test_two_by_two(spark):
    ms = [m.kappa("k"), m.pabak("p"), m.ac1("a")]
    one = lambda *c: m.evaluate(spark.createDataFrame([c], "pp long, pn long, np long, nn long"), ms).first()
    r = one(20, 5, 10, 15)
    assert (r.k, r.p) == (pytest.approx(0.4), pytest.approx(0.4))
    pi = (25 / 50 + 30 / 50) / 2
    assert r.a == pytest.approx((0.7 - 2 * pi * (1 - pi)) / (1 - 2 * pi * (1 - pi)))
    assert all(math.isnan(x) for x in one(0, 0, 0, 0))
    r = one(0, 0, 0, 7)
    assert math.isnan(r.k) and r.p == 1.0 and r.a == 1.0


def loop(stats, value, b, seed, clusters=None):
    """The resampling as nested loops, statistic by statistic."""
    rng, out, n = random.Random(seed), [], len(stats)
    groups = {}
    for i, c in enumerate(clusters or range(n)):
        groups.setdefault(c, []).append(i)
    for _ in range(b):
        if clusters:
            order = list(groups)
            picked = []
            for _ in order:
                own = groups[order[rng.randrange(len(order))]]
                picked += [own[rng.randrange(len(own))] for _ in own]
        else:
            picked = [rng.randrange(n) for _ in range(n)]
        out.append(value([stats[i] for i in picked]))
    return sorted(x for x in out if x == x)


def pct(xs, q):
    r = q * (len(xs) - 1)
    lo = int(r)
    return xs[lo] + (r - lo) * (xs[min(lo + 1, len(xs) - 1)] - xs[lo])


def score(rows):
    tp, fp, fn = (sum(r[k] for r in rows) for k in range(3))
    if not tp:
        return 1.0 if fp + fn == 0 else 0.0
    p, r = tp / (tp + fp), tp / (tp + fn)
    return 2 * p * r / (p + r)


STATS = [(random.Random(7 + i).randrange(9), random.Random(90 + i).randrange(4), random.Random(50 + i).randrange(4)) for i in range(12)]


def frame(spark, **more):
    return spark.createDataFrame([(i, *s, *[v[i] for v in more.values()]) for i, s in enumerate(STATS)], "i int, tp long, fp long, fn long" + "".join(f", {k} int" for k in more))


def test_percentile_interval_is_the_loop_s(spark):
    xs = loop(STATS, score, 200, 11)
    r = m.intervals(frame(spark), [m.f1("f1")], m.plan(spark, 12, 200, 11)).first()
    assert (r.point, r.lo, r.hi) == (pytest.approx(score(STATS)), pytest.approx(pct(xs, 0.025)), pytest.approx(pct(xs, 0.975)))
    assert r.ci_method == "percentile_bootstrap"


def test_clustered_bca_is_the_loop_s(spark):
    folio = [i // 3 for i in range(12)]
    xs, point = loop(STATS, score, 300, 5, folio), score(STATS)
    jk = [score([s for s, f in zip(STATS, folio) if f != k]) for k in range(4)]
    d = [sum(jk) / 4 - x for x in jk]
    a = sum(x**3 for x in d) / (6 * sum(x * x for x in d) ** 1.5)
    n = NormalDist()
    z0 = n.inv_cdf(min(max(sum(x < point for x in xs) / len(xs), 0.5 / len(xs)), 1 - 0.5 / len(xs)))
    q = [n.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (n.inv_cdf(0.025), n.inv_cdf(0.975))]
    r = m.intervals(frame(spark, folio=folio), [m.f1("f1")], m.plan(spark, 12, 300, 5, folio), clusters="folio").first()
    assert (r.lo, r.hi) == (pytest.approx(pct(xs, q[0])), pytest.approx(pct(xs, q[1])))
    assert r.ci_method == "bca_bootstrap_clustered"


def test_degenerate_intervals(spark):
    r = m.intervals(frame(spark), [m.f1("f1")], None).first()
    assert r.point == pytest.approx(score(STATS)) and math.isnan(r.lo)
    none = frame(spark).where("i < 0")
    assert m.intervals(none, [m.f1("f1")], None).first().point == 1.0
    with pytest.raises(ValueError):
        m.intervals(frame(spark), [m.f1("f1")], None, method="other")


def test_plan_is_determined_by_its_seed(spark):
    rows = lambda s: sorted(map(tuple, m.plan(spark, 5, 20, s).collect()))
    assert rows(1) == rows(1) != rows(2)
    assert all(sum(w for b, _, w in rows(1) if b == k) == 5 for k in range(20))


def test_jackknife_is_the_total_less_its_own(spark):
    got = {r.i: r.f1 for r in m.jackknife(frame(spark), [m.f1("f1")]).collect()}
    assert got == {i: pytest.approx(score(STATS[:i] + STATS[i + 1 :])) for i in range(12)}
    assert m.jackknife(frame(spark).where("i = 0"), [m.f1("f1")]).count() == 0


def plain_plan(n, b, seed):
    import random
    from collections import Counter

    rng = random.Random(seed)
    return [(k, i, w) for k in range(b) for i, w in sorted(Counter(rng.randrange(n) for _ in range(n)).items())]


@pytest.mark.parametrize(("n", "b", "seed", "words"), [(96, 300, 0xBEEF, 1_000), (200, 64, 7, 250), (1, 40, 3, 7), (64, 50, -5, 61), (100_003, 3, 11, 7_000), (5, 0, 1, 9)])
def test_the_parallel_plan_is_the_sequential_one(spark, n, b, seed, words):
    from lectio.operators.draws import seeded_plan

    got = seeded_plan(spark, n, b, seed, words)
    assert sorted(map(tuple, got.collect())) == plain_plan(n, b, seed)
    if words * 20 < n * b:
        assert got.rdd.getNumPartitions() >= 20


def test_the_plan_of_no_units_is_empty(spark):
    assert m.plan(spark, 0, 10, 1).count() == 0
