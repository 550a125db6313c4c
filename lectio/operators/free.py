"""Resampling of any statistic of units: a function of their payload and of how often each unit was drawn.

A payload of a bounded measured size goes to every task, and blocks of resamples are evaluated side by side. A larger one is
dealt to bags of little bootstraps: each bag is resampled to the size of the whole, and the bags' bounds are averaged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio import codepoints as cp

#: Payload bytes, as JSON, up to which it goes to every task; rows of the plan in a block of resamples; a bag's size as a power of all units.
MOST_BYTES, BLOCK_ROWS, POWER = 32 << 20, 100_000, 0.7
LABELS = ("percentile_bootstrap", "bag_of_little_bootstraps")
#: (payload, multiplicity of each of its rows) -> value.
Statistic = Callable[[pd.DataFrame, np.ndarray], float]


def measured(units: DataFrame, payload: list[str]) -> tuple[int, int]:
    """(units, payload bytes as JSON and eight more a unit)."""
    r = units.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*payload))) + 8).alias("size")).first()
    return r.n, r.size or 0


def resampled(units: DataFrame, payload: list[str], statistics: dict[str, Statistic], drawn: DataFrame, n: int) -> DataFrame:
    """(b, values…) of a plan (b, i, w) over n units, whose payload is broadcast; a unit that the plan draws but isn't there raises."""
    spark = units.sparkSession
    table = units.select("i", *payload).orderBy("i").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def evaluated(plan: pd.DataFrame) -> pd.DataFrame:
        own = pa.ipc.open_stream(sent.value).read_all().to_pandas()
        at, own = own["i"].to_numpy(), own.drop(columns="i")
        rows = []
        for b, part in plan.groupby("b"):
            i = part["i"].to_numpy()
            place = np.minimum(np.searchsorted(at, i), max(len(at) - 1, 0))
            if len(at) == 0 or (at[place] != i).any():
                raise ValueError("the plan draws a unit that isn't there")
            w = np.bincount(place, part["w"].to_numpy(), len(at)).astype(np.int64)
            rows.append((b, *[float(s(own, w)) for s in statistics.values()]))
        return pd.DataFrame(rows, columns=["b", *statistics])

    block = F.floor(F.col("b") / max(1, BLOCK_ROWS // max(n, 1)))
    values = ", ".join(f"`{k}` double" for k in statistics)
    return drawn.select(F.col("b").cast("long").alias("b"), F.col("i").cast("long").alias("i"), F.col("w").cast("long").alias("w"), block.alias("_block")).groupBy("_block").applyInPandas(lambda p: evaluated(p.drop(columns="_block")), f"b long, {values}")


def bagged(units: DataFrame, payload: list[str], statistics: dict[str, Statistic], n: int, size: int, b: int, seed: int) -> DataFrame:
    """(bag, metric, point, lo, hi): every unit lies in one bag, of about n ** POWER units or fewer if their payload is large.

    A bag's point is the statistic of its units, its bounds are the percentiles of b resamples of n units each.
    """
    bags = max(1, -(-n // max(1, int(min(n**POWER, MOST_BYTES / max(size / max(n, 1), 1))))))

    def evaluated(own: pd.DataFrame) -> pd.DataFrame:
        bag, own = int(own["_bag"].iloc[0]), own.sort_values("i").drop(columns=["_bag", "i"]).reset_index(drop=True)
        rng, k = np.random.default_rng([seed, bag]), len(own)
        values = np.empty((b, len(statistics)))
        for r in range(b):
            w = rng.multinomial(n, np.full(k, 1 / k))
            values[r] = [s(own, w) for s in statistics.values()]
        out = []
        for name, s, v in zip(statistics, statistics.values(), values.T, strict=True):
            v = v[~np.isnan(v)]
            lo, hi = np.percentile(v, cp.BOUNDS) if len(v) else (np.nan, np.nan)
            out.append((bag, name, float(s(own, np.ones(k, np.int64))), lo, hi))
        return pd.DataFrame(out, columns=["bag", "metric", "point", "lo", "hi"])

    dealt = units.select("i", *payload, F.pmod(F.xxhash64(F.col("i").cast("long"), F.lit(seed).cast("long")), F.lit(bags).cast("long")).alias("_bag"))
    return dealt.groupBy("_bag").applyInPandas(evaluated, "bag long, metric string, point double, lo double, hi double")


def intervals(units: DataFrame, payload: list[str], statistics: dict[str, Statistic], drawn: DataFrame, b: int = 100, seed: int = cp.SEED) -> DataFrame:
    """(metric, point, lo, hi, ci_method) of statistics of units (i, payload…), i from 0 and unique.

    drawn: a plan (b, i, w), for payloads of up to MOST_BYTES; beyond, b resamples of each bag, drawn by seed, and points and
    bounds averaged over bags. NaN values are dropped before percentiles and averages; without units all is NaN.
    """
    n, size = measured(units, payload)
    nan = F.lit(float("nan"))
    if n and size <= MOST_BYTES:
        whole = units.select(F.lit(-1).alias("b"), "i", F.lit(1).alias("w"))
        got = resampled(units, payload, statistics, drawn.select("b", "i", "w").unionByName(whole), n)
        rows = got.select("b", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in statistics])).alias("x")).select("b", "x.*")
        real = F.when((F.col("b") >= 0) & ~F.isnan("value"), F.col("value"))
        ends = F.percentile(real, F.array(*[F.lit(x / 100) for x in cp.BOUNDS]))
        found = rows.groupBy("metric").agg(F.coalesce(F.max(F.when(F.col("b") < 0, F.col("value"))), nan).alias("point"), ends.alias("ends"))
        return found.select("metric", "point", *[F.coalesce(F.get("ends", F.lit(k)), nan).alias(c) for k, c in enumerate(("lo", "hi"))], F.lit(LABELS[0]).alias("ci_method"))
    if not n:
        empty = [(k, float("nan"), float("nan"), float("nan"), LABELS[0]) for k in statistics]
        return units.sparkSession.createDataFrame(empty, "metric string, point double, lo double, hi double, ci_method string")
    real = lambda c: F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), nan).alias(c)
    return bagged(units, payload, statistics, n, size, b, seed).groupBy("metric").agg(*[real(c) for c in ("point", "lo", "hi")]).withColumn("ci_method", F.lit(LABELS[1]))
