import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.operators import alignment as al
from lectio.operators import banded


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def plain_alignment(g, p):
    """The whole score table and its traceback, tie by tie."""
    n, m = len(g), len(p)
    s = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                moves = []
                if i and j:
                    moves.append(s[i - 1][j - 1] + plain_distance(g[i - 1], p[j - 1]))
                if i:
                    moves.append(s[i - 1][j] + len(g[i - 1]))
                if j:
                    moves.append(s[i][j - 1] + len(p[j - 1]))
                s[i][j] = min(moves)
    out, i, j = [], n, m
    while i or j:
        if i and j and s[i][j] == s[i - 1][j - 1] + plain_distance(g[i - 1], p[j - 1]):
            i, j = i - 1, j - 1
            out.append((g[i], p[j]))
        elif i and s[i][j] == s[i - 1][j] + len(g[i - 1]):
            i -= 1
            out.append((g[i], None))
        else:
            j -= 1
            out.append((None, p[j]))
    return out[::-1], s[n][m]


CASES = [("", ""), ("", "ab"), ("ab", ""), ("abc", "abd"), ("kitten", "sitting")]


def some(seed, n=40):
    r = random.Random(seed)
    return [([r.choice(["a", "b", "ca", "cb", "d"]) for _ in range(r.randrange(14))], [r.choice(["a", "b", "ca", "cb", "d"]) for _ in range(r.randrange(14))]) for _ in range(n)]


@pytest.mark.parametrize(("cells", "band"), [(4, 1), (40, 2), (1 << 24, 8)])
def test_clusters_align_as_the_whole_table_says(monkeypatch, cells, band):
    """In bands of any width, and in halves where a table has more than `cells` cells."""
    monkeypatch.setattr(banded, "CELLS", cells)
    monkeypatch.setattr(banded, "BAND", band)
    monkeypatch.setattr(banded, "BITS", 0)
    r = random.Random(band)
    likes = [(x, [c for c in x if r.random() > 0.1]) for x in ([r.choice(["a", "b", "ca"]) for _ in range(60)] for _ in range(20))]
    cases = [(list(a), list(b)) for a, b in CASES] + some(1) + likes + [(["", "a", ""], ["a", "", "b"])]
    for g, p in cases:
        want, cost = plain_alignment(g, p)
        assert al.align_clusters(g, p) == want
        assert al.cluster_cost(g, p) == cost
    al_ = banded.Aligner()
    number = dict(zip(names := sorted({x for g, p in cases for x in (*g, *p)}), al_.numbers(names).tolist(), strict=True))
    sides = [[np.asarray([number[x] for x in side], np.int64) for side in pair] for pair in zip(*cases, strict=True)]
    for (g, p), total, (i, j) in zip(cases, al_.totals(*sides), al_.ways(*sides), strict=True):
        want, cost = plain_alignment(g, p)
        assert total == cost and [(None if a < 0 else g[a], None if b < 0 else p[b]) for a, b in zip(i, j, strict=True)] == want


def test_long_texts_take_memory_in_proportion(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(banded, "CELLS", 1 << 18)
    monkeypatch.setattr(banded, "BITS", 0)
    r = np.random.default_rng(0)
    a, used = banded.Aligner(), []
    a.numbers(["a", "b", "cd", "e"])
    for n in (2_000, 8_000):
        g = r.integers(0, 4, n)
        p = g[r.random(n) > 0.02]
        tracemalloc.start()
        i, j = a.ways([g], [p])[0]
        used.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert i[i >= 0].tolist() == list(range(n)) and j[j >= 0].tolist() == list(range(len(p)))
    assert used[1] < 8 * used[0]


def test_costs_are_edit_distances():
    names = ["", "a", "ab", "ba", "abc", "é", "éa", "xyz", "aaaa"]
    costs = banded.Costs()
    costs.numbers(names[1:4])
    costs.numbers(names)
    for x in names:
        assert banded.distances(x, names).tolist() == [plain_distance(x, y) for y in names]
        assert [costs.table[costs.names[x], costs.names[y]] for y in names] == [plain_distance(x, y) for y in names]


def plain_letters(side, backbone):
    n, m = len(side), len(backbone)
    s = [[i + j if not (i and j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i][j] = min(s[i - 1][j - 1] + (side[i - 1] != backbone[j - 1]), s[i - 1][j] + 1, s[i][j - 1] + 1)
    out, i, j = [None] * n, n, m
    while i and j:
        d, u, left = s[i - 1][j - 1] + (side[i - 1] != backbone[j - 1]), s[i - 1][j] + 1, s[i][j - 1] + 1
        if d <= u and d <= left:
            i, j = i - 1, j - 1
            out[i] = j + 1
        elif u <= left:
            i -= 1
        else:
            j -= 1
    return out, s


@pytest.mark.parametrize("bits", [0, 1 << 26])
def test_bit_vectors_give_the_whole_table(monkeypatch, bits):
    monkeypatch.setattr(banded, "BITS", bits)
    r = random.Random(bits)
    for _ in range(60):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randrange(70))) for _ in range(2))
        want, table = plain_letters(a, b)
        codes = [np.asarray([ord(c) for c in x], np.int64) for x in (a, b)]
        assert all(banded.bit_vectors(codes[0][:i], codes[1][:j], False)[0] == table[i][j] for i in range(0, len(a) + 1, 9) for j in range(0, len(b) + 1, 5))
        assert al.align_letters(a, b) == want
        assert al.align_clusters(list(a), list(b)) == plain_alignment(list(a), list(b))[0]
        assert al.cluster_cost(list(a), list(b)) == table[-1][-1]


def test_native_and_arrow_totals_agree(spark):
    rows = [(i, g, p, plain_alignment(g, p)[1]) for i, (g, p) in enumerate([(list(a), list(b)) for a, b in CASES] + some(2))]
    d = spark.createDataFrame(rows, "i int, g array<string>, p array<string>, want int").repartition(3)
    got = d.select("want", al.native_edit_total(F.col("g"), F.col("p")).alias("n"), al.edit_total("g", "p").alias("a"), al.alignment_cost(al.aligned("g", "p")).alias("x")).collect()
    assert all(r.want == r.n == r.a == r.x for r in got)
    assert len(got) == len(rows)


def test_cer_of_little_and_of_nothing(spark):
    d = spark.createDataFrame([("qamatz", ["בָ"], ["בַ"]), ("lost", ["בָ", "רָ"], ["בָ"]), ("none", [], []), ("all", [], ["ב"]), ("null", None, ["ב"])], "k string, g array<string>, p array<string>")
    whole = spark.createDataFrame([(i, list(a), list(b), plain_distance(a, b)) for i, (a, b) in enumerate([("kitten" * 20, "sitting" * 20), ("a" * 40, ""), ("é" * 50, "ée" * 30)])], "i int, g array<string>, p array<string>, want int")
    for native in (True, False):
        assert all(r.edits == r.want for r in al.cer(whole, "g", "p", native=native).collect())
        got = {r.k: (r.edits, r.denominator, r.cer) for r in al.cer(d, "g", "p", native=native).collect()}
        assert got == {"qamatz": (1, 2, 0.5), "lost": (2, 4, 0.5), "none": (0, 0, 0.0), "all": (1, 0, 1.0), "null": (None, None, None)}


def test_letters_align_with_ties_in_order():
    assert al.align_letters("abc", "abc") == [1, 2, 3]
    assert al.align_letters("axbc", "abc") == [1, None, 2, 3]
    assert al.align_letters("ac", "abc") == [1, 3]
    assert al.align_letters("", "abc") == [] and al.align_letters("ab", "") == [None, None]
    r = random.Random(3)
    for _ in range(30):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        got = al.align_letters(a, b)
        used = [x for x in got if x]
        assert used == sorted(set(used))
        subs = sum(a[i] != b[x - 1] for i, x in enumerate(got) if x)
        assert subs + got.count(None) + len(b) - len(used) == plain_distance(a, b)


def test_reprojection_drops_what_has_no_place(spark):
    marks = spark.createDataFrame([("v", "rafe", 1), ("v", "rafe", 2), ("v", "rafe", 9), ("v", "rafe", 0), ("w", "rafe", 1)], "verse_ref string, type string, ordinal int")
    axes = spark.createDataFrame([("v", "axb", "ab")], "verse_ref string, side string, backbone string")
    got = {(r.verse_ref, r.ordinal): (r.new_ordinal, r.kept) for r in al.reproject(marks, axes).collect()}
    assert got == {("v", 1): (1, True), ("v", 2): (None, False), ("v", 9): (None, False), ("v", 0): (None, False), ("w", 1): (None, False)}


def plain_match(a, b, tol):
    a, b = sorted(set(a)), sorted(set(b))
    both = sorted(set(a) & set(b))
    pairs = [(x, x) for x in both]
    if tol:
        rest = [y for y in b if y not in both]
        for x in (x for x in a if x not in both):
            rest = [y for y in rest if y >= x - tol]
            if rest and rest[0] <= x + tol:
                pairs.append((x, rest.pop(0)))
    return sorted(pairs)


def test_matcher_is_greedy_and_exact_first(spark):
    r = random.Random(4)
    cases = [([1, 2], [2, 3]), ([], []), ([1], []), ([5], [6]), ([5], [7])] + [([r.randrange(12) for _ in range(r.randrange(8))], [r.randrange(12) for _ in range(r.randrange(8))]) for _ in range(40)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<int>, b array<int>")
    for tol in (0, 1, 2):
        for row in d.select("i", al.matched(F.col("a"), F.col("b"), tol).alias("m")).collect():
            assert [tuple(p) for p in row.m] == plain_match(*cases[row.i], tol)
    assert plain_match([1, 2], [2, 3], 1) == [(2, 2)]


def greatest(a, b, tol):
    """Size of a greatest matching by augmenting paths."""
    a, b, of = sorted(set(a)), sorted(set(b)), {}

    def placed(x, seen):
        for y in b:
            if abs(x - y) <= tol and y not in seen:
                seen.add(y)
                if y not in of or placed(of[y], seen):
                    of[y] = x
                    return True
        return False

    return sum(placed(x, set()) for x in a)


def test_greatest_matchings_are_as_great_as_any(spark):
    r = random.Random(6)
    side = lambda: [r.choice([r.randrange(14), r.randrange(-2000, 2000)]) for _ in range(r.randrange(10))]
    cases = [([1, 2], [2, 3]), ([], []), ([1], [])] + [(side(), side()) for _ in range(60)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)] + [(-1, None, [1])], "i int, a array<int>, b array<int>").repartition(3)
    for tol in (1, 2, 5):
        for row in d.select("i", al.most_matched(F.col("a"), F.col("b"), tol).alias("m"), al.matched(F.col("a"), F.col("b"), tol).alias("g")).collect():
            if row.i < 0:
                assert row.m is None and row.g is None
                continue
            a, b = cases[row.i]
            assert [tuple(p) for p in row.g] == plain_match(a, b, tol)
            assert len(row.m) == greatest(a, b, tol) >= len(row.g)
            assert len({p.a for p in row.m}) == len({p.b for p in row.m}) == len(row.m)
            assert all(p.a in a and p.b in b and abs(p.a - p.b) <= tol for p in row.m)


def test_a_bucket_of_a_million_ordinals_takes_seconds(spark):
    import time

    d = spark.range(1).select(F.sequence(F.lit(0), F.lit(2_000_000), F.lit(2)).alias("a"), F.sequence(F.lit(1), F.lit(2_000_001), F.lit(2)).alias("b"))
    began = time.time()
    got = d.select(F.size(al.matched(F.col("a"), F.col("b"), 1)).alias("g"), F.size(al.most_matched(F.col("a"), F.col("b"), 1)).alias("m")).first()
    assert (got.g, got.m) == (1_000_001, 1_000_001) and time.time() - began < 60
