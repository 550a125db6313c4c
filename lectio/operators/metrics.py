"""Metrics as sums of per-unit statistics with a finalizer, and seeded resampling of them.

A metric names the columns it sums and how the sums become a value. Its point estimate, its value in a stratum, in a
resample (sums weighted by multiplicity) and without a unit (total minus own) are then one groupBy each, and no
statistic is ever computed twice.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.functions.scalars import f1 as _f1
from lectio.operators.draws import seeded_plan

NAN = float("nan")
#: Names of the interval methods by (method, clustered).
LABELS = {("percentile", False): "percentile_bootstrap", ("percentile", True): "percentile_bootstrap_clustered", ("bca", False): "bca_bootstrap", ("bca", True): "bca_bootstrap_clustered"}


@dataclass(frozen=True)
class Metric:
    name: str
    stats: tuple[str, ...]
    value: Callable[..., Column]

    def of(self, prefix: str = "") -> Column:
        return self.value(*[F.col(prefix + s) for s in self.stats]).alias(self.name)


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(NAN)).otherwise(numerator / denominator)


def f1(name: str, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> Metric:
    return Metric(name, (tp, fp, fn), _f1)


def mean(name: str, total: str, count: str) -> Metric:
    """A macro average; NaN over nothing."""
    return Metric(name, (total, count), _safe)


def _agreement(pp, pn, np, nn):
    n = (pp + pn + np + nn).cast("double")
    return n, F.try_divide(pp + nn, n), F.try_divide(pp + pn, n), F.try_divide(pp + np, n)


def _kappa(pp, pn, np, nn):
    n, po, pa, pb = _agreement(pp, pn, np, nn)
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when((n == 0) | (pe >= 1), F.lit(NAN)).otherwise(F.try_divide(po - pe, 1 - pe))


def _pabak(pp, pn, np, nn):
    n, po, _, _ = _agreement(pp, pn, np, nn)
    return F.when(n == 0, F.lit(NAN)).otherwise(2 * po - 1)


def _ac1(pp, pn, np, nn):
    n, po, pa, pb = _agreement(pp, pn, np, nn)
    pi = (pa + pb) / 2
    pg = 2 * pi * (1 - pi)
    return F.when((n == 0) | (pg >= 1), F.lit(NAN)).otherwise(F.try_divide(po - pg, 1 - pg))


CELLS = ("pp", "pn", "np", "nn")


def kappa(name: str, prefix: str = "") -> Metric:
    return Metric(name, tuple(prefix + c for c in CELLS), _kappa)


def pabak(name: str, prefix: str = "") -> Metric:
    return Metric(name, tuple(prefix + c for c in CELLS), _pabak)


def ac1(name: str, prefix: str = "") -> Metric:
    return Metric(name, tuple(prefix + c for c in CELLS), _ac1)


def alpha(name: str, codes: list[str], prefix: str = "u_", positive: bool = False) -> Metric:
    """Krippendorff's nominal alpha of two coders from the counts of code pairs (columns prefix + x + "_" + y).

    positive: units that both leave unmarked don't count. NaN for no units; no expected disagreement gives 1 if none
    was observed, else NaN.
    """
    pairs = [(x, y) for x in codes for y in codes if not (positive and x == y == "none")]

    def value(*m: Column) -> Column:
        n = dict(zip(pairs, m, strict=True))
        total = 2.0 * sum(m, F.lit(0))
        own = {c: sum((v * ((x == c) + (y == c)) for (x, y), v in n.items()), F.lit(0.0)) for c in codes}
        observed = sum((2.0 * v for (x, y), v in n.items() if x != y), F.lit(0.0))
        expected = (total * total - sum((v * v for v in own.values()), F.lit(0.0))) / (total - 1)
        return F.when(total == 0, F.lit(NAN)).when(expected == 0, F.when(observed == 0, F.lit(1.0)).otherwise(F.lit(NAN))).otherwise(1 - observed / expected)

    return Metric(name, tuple(f"{prefix}{x}_{y}" for x, y in pairs), value)


def alpha_stats(units: DataFrame, keys: list[str], codes: list[str], prefix: str = "u_") -> DataFrame:
    """Counts of code pairs, a column each, from (keys…, a, b, n)."""
    cells = [F.sum(F.when((F.col("a") == x) & (F.col("b") == y), F.col("n")).otherwise(0)).alias(f"{prefix}{x}_{y}") for x in codes for y in codes]
    return units.groupBy(*keys).agg(*cells)


def evaluate(stats: DataFrame, metrics: list[Metric], by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by…, metric values…) of sums over the rows of stats, which need not hold every unit."""
    names = list(dict.fromkeys(s for m in metrics for s in m.stats))
    w = F.lit(1) if weight is None else weight
    sums = stats.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(F.col(s) * w), F.lit(0)).alias(s) for s in names])
    return sums.select(*(by or []), *[m.of() for m in metrics])


def _cluster_draws(members: list[list[int]], b: int, seed: int) -> Iterator[tuple[int, Counter]]:
    rng = random.Random(seed)
    for k in range(b):
        drawn: Counter = Counter()
        for _ in members:
            own = members[rng.randrange(len(members))]
            for _ in own:
                drawn[own[rng.randrange(len(own))]] += 1
        yield k, drawn


def plan(spark: SparkSession, n: int, b: int = cp.RESAMPLES, seed: int = cp.SEED, clusters: list | None = None) -> DataFrame:
    """The resample plan (b, i, w): how often unit i is drawn in resample b.

    Drawn by one seeded generator, ranges of whose stream are drawn in parallel (draws.py); shared by every metric over
    the same n units. With clusters (a label a unit), whole clusters are drawn first and then their members: how many
    words a draw takes goes by what was drawn before, so that this stream is one task's.
    """
    if not clusters:
        return seeded_plan(spark, n, b, seed)
    groups = list({c: [i for i, x in enumerate(clusters) if x == c] for c in dict.fromkeys(clusters)}.values())

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in it:
            rows: list[tuple[int, int, int]] = []
            for k, drawn in _cluster_draws(groups, b, seed):
                rows.extend((k, i, w) for i, w in drawn.items())
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["b", "i", "w"])
                    rows = []
            yield pd.DataFrame(rows, columns=["b", "i", "w"])

    return spark.range(1, numPartitions=1).mapInPandas(draw, "b int, i int, w int")


def resampled(stats: DataFrame, metrics: list[Metric], drawn: DataFrame) -> DataFrame:
    """(b, metric values…). stats: one row a unit, numbered by i; Spark broadcasts it to the plan where it measures it as small."""
    return evaluate(drawn.join(stats, "i"), metrics, ["b"], F.col("w"))


def jackknife(stats: DataFrame, metrics: list[Metric], unit: str = "i") -> DataFrame:
    """(unit, metric values…) without each unit: totals less its own sums; a single unit gives no rows."""
    names = list(dict.fromkeys(s for m in metrics for s in m.stats))
    own = stats.groupBy(unit).agg(*[F.sum(s).alias(s) for s in names])
    total = own.agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"t_{s}") for s in names])
    rest = own.join(F.broadcast(total)).where("_n > 1").select(unit, *[(F.col(f"t_{s}") - F.col(s)).alias(s) for s in names])
    return rest.select(unit, *[m.of() for m in metrics])


def intervals(stats: DataFrame, metrics: list[Metric], drawn: DataFrame | None, method: str = "auto", clusters: str | None = None) -> DataFrame:
    """(metric, point, lo, hi, ci_method): one row a metric, all from one pass over the plan.

    method: percentile, bca, or auto (bca where clusters names a column of stats). NaN resamples are dropped before the
    percentiles; without a plan, without units, or with nothing but NaN, the bounds are NaN.
    """
    method = ("bca" if clusters else "percentile") if method == "auto" else method
    if method not in ("percentile", "bca"):
        raise ValueError(f"no such interval method: {method}")
    spark, label = stats.sparkSession, LABELS[method, clusters is not None]
    one = evaluate(stats, metrics).first()
    point = {m.name: one[m.name] for m in metrics}
    bounds = {m.name: (NAN, NAN) for m in metrics}
    if drawn is not None:
        values = resampled(stats, metrics, drawn).persist()
        real = {m.name: F.when(~F.isnan(m.name), F.col(m.name)) for m in metrics}
        if method == "percentile":
            shares = {m.name: (cp.BOUNDS[0] / 100, cp.BOUNDS[1] / 100) for m in metrics}
        else:
            below = values.agg(*[F.count(c).alias(f"n_{k}") for k, c in real.items()], *[F.sum((c < F.lit(point[k])).cast("int")).alias(f"b_{k}") for k, c in real.items()]).first()
            left = jackknife(stats, metrics, clusters or "i")
            a = _acceleration(left, metrics)
            shares = {k: _adjusted(below[f"b_{k}"] or 0, below[f"n_{k}"], a[k]) for k in point}
        found = values.agg(*[F.percentile(c, F.array(*[F.lit(float(x)) for x in shares[k]])).alias(k) for k, c in real.items()]).first()
        bounds = {k: tuple(found[k]) if found[k] is not None else (NAN, NAN) for k in point}
        values.unpersist()
    rows = [(k, float(v) if v is not None else NAN, float(bounds[k][0]), float(bounds[k][1]), label) for k, v in point.items()]
    return spark.createDataFrame(rows, "metric string, point double, lo double, hi double, ci_method string")


def _acceleration(left: DataFrame, metrics: list[Metric]) -> dict[str, float]:
    real = {m.name: F.when(~F.isnan(m.name), F.col(m.name)) for m in metrics}
    means = left.agg(*[F.avg(c).alias(k) for k, c in real.items()], *[F.count(c).alias(f"n_{k}") for k, c in real.items()]).first()
    d = {k: F.lit(means[k] if means[k] is not None else 0.0) - c for k, c in real.items()}
    sums = left.agg(*[F.sum(x * x).alias(f"s_{k}") for k, x in d.items()], *[F.sum(x * x * x).alias(f"c_{k}") for k, x in d.items()]).first()
    return {k: sums[f"c_{k}"] / (6 * sums[f"s_{k}"] ** 1.5) if means[f"n_{k}"] >= 2 and sums[f"s_{k}"] > 0 else 0.0 for k in d}


def _adjusted(below: int, n: int, a: float) -> tuple[float, float]:
    """The shares at which a bias-corrected and accelerated interval reads its percentiles."""
    if not n:
        return 0.025, 0.975
    unit = NormalDist()
    z0 = unit.inv_cdf(min(max(below / n, 0.5 / n), 1 - 0.5 / n))

    def share(z: float) -> float:
        scale = 1 - a * (z0 + z)
        return unit.cdf(z0 + z) if scale <= 0 else unit.cdf(z0 + (z0 + z) / scale)

    return share(unit.inv_cdf(cp.BOUNDS[0] / 100)), share(unit.inv_cdf(cp.BOUNDS[1] / 100))


def numbered(units: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds i, a unit's place from 0 in the order that the resampling indexes, among all units or those alike in `within`.

    Units are dealt by ranges of the order; each range is numbered by itself, from where those before it end. Rows of
    equal order are numbered in any order, and lie in one range. Units null in `within` are numbered as one group.
    """
    parts, keys = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), within or []
    dealt = units.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()).persist()
    sizes = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", *keys, (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range and group
    place = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    if not keys:
        return dealt.join(F.broadcast(before), "_part").withColumn("i", (F.col("_before") + place - 1).cast("int")).drop("_part", "_before")
    mine, theirs = dealt.withColumn("_place", place), before.toDF("_p", *[f"_k{j}" for j in range(len(keys))], "_before")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    return mine.join(theirs, same).withColumn("i", (F.col("_before") + F.col("_place") - 1).cast("int")).drop("_part", "_place", *theirs.columns)


def stratum_intervals(stats: DataFrame, metrics: list[Metric], plans: DataFrame | None, by: str) -> DataFrame:
    """(by, metric, point, lo, hi, ci_method): percentile intervals of all strata in one pass.

    stats: (by, n, i, …), a row a unit, i its place among the n units of its stratum; plans: (n, b, i, w) for every such
    n. NaN resamples are dropped; without plans, or with nothing but NaN, the bounds are NaN. Units of a null stratum have no row.
    """
    known, nan = stats.where(F.col(by).isNotNull()), F.lit(NAN)
    melted = lambda d, *keys: d.select(*keys, F.explode(F.array(*[F.struct(F.lit(m.name).alias("metric"), F.col(m.name).cast("double").alias("value")) for m in metrics])).alias("x")).select(*keys, "x.*")
    points = melted(evaluate(known, metrics, [by]), by).select(by, "metric", F.coalesce("value", nan).alias("point"))
    if plans is None:
        return points.select("*", nan.alias("lo"), nan.alias("hi"), F.lit(LABELS["percentile", False]).alias("ci_method"))
    values = melted(evaluate(plans.join(known, ["n", "i"]), metrics, [by, "b"], F.col("w")), by)
    ends = values.where(~F.isnan("value")).groupBy(by, "metric").agg(F.percentile("value", F.array(*[F.lit(x / 100) for x in cp.BOUNDS])).alias("ends"))
    bound = lambda k: F.coalesce(F.get("ends", F.lit(k)), nan)
    return points.join(ends, [by, "metric"], "left").select(by, "metric", "point", bound(0).alias("lo"), bound(1).alias("hi"), F.lit(LABELS["percentile", False]).alias("ci_method"))
