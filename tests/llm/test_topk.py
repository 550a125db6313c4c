import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.llm import topk


def brute(rows, is_query, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in ok:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v)
    for i, q in asked.items():
        s = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


def check(spark, rows, k=10, block=37, **more):
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(d, F.col("vec_id") % 10 == 0, k, block=block, **more)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, k)


def test_against_all_pairs(spark):
    r = random.Random(0)
    some = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    check(spark, some)
    check(spark, some, query_bytes=500)  # queries in several groups
    # ties everywhere, on blocks of any size; few candidates; vectors that take no part
    check(spark, [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(220)], block=13)
    check(spark, [(i, [1.0, 2.0]) for i in range(60)], block=4)
    odd = [(0, [1.0, 2.0]), (10, [0.0, 0.0]), (20, None), (30, [1.0, None]), (40, [math.nan, 1.0]), (50, [math.inf, 1.0]), (60, []), (70, [1.0]), (None, [1.0, 1.0]), (1, [0.5, -0.5]), (1, [0.5, -0.5]), (80, [2.0, 1.0]), (80, [1.0, 1.0])]
    check(spark, odd)
    check(spark, [])


def test_values_past_doubles(spark):
    check(spark, [(0, [1e15, -1e15]), (1, [1e15, 3.0]), (2, [-1e15, 1.0]), (10, [5.0, 1e14])])
    r = random.Random(1)
    mixed = [(i, [r.gauss(0, 1) * r.choice([1, 1, 1e12]) for _ in range(4)]) for i in range(150)]
    check(spark, mixed, block=9)


@pytest.mark.parametrize("dims", [3, 16])
def test_stops_before_the_end(dims):
    """Rows in clusters: most blocks are passed over or read in part, and results stay exact."""
    r = np.random.default_rng(0)
    centre = r.standard_normal((40, dims))
    x = np.floor((centre[r.integers(0, 40, 20_000)] + 0.05 * r.standard_normal((20_000, dims))) * 1024).astype(np.int64)
    ids = r.permutation(20_000)
    own = ids[:50]
    best = topk.Best(x[:50], own, topk.first_scores(x[:50], own, 10), 10)
    best.see(ids, x, 512)
    for j in range(50):
        full = [i for i in np.lexsort((ids, -(x @ x[j]))) if ids[i] != own[j]][:10]
        assert best.id[best.query == j].tolist() == ids[full].tolist()
    assert best.looked < 0.3 * 50 * 20_000


def test_first_scores_are_reached():
    r = np.random.default_rng(1)
    q = r.integers(-50, 50, (200, 5))
    own = np.arange(200)
    low = topk.first_scores(q, own, 7)
    for j in range(200):
        assert np.sort(np.delete(q @ q[j], j))[-7] >= low[j] > -np.inf
    assert (topk.first_scores(q[:5], own[:5], 7) == -np.inf).all()


def test_floats_and_big_blocks(spark):
    d = spark.createDataFrame([(i, [0.1 * i, -0.3]) for i in range(25)], "vec_id long, embedding array<float>")
    assert topk.top_k(d, F.col("vec_id") % 10 == 0).count() == 30
