import random
import re

import pytest
from pyspark.sql import functions as F

from lectio.llm import ngram_join as nj
from lectio.llm.common import components, evenly


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["The", "a", "of", "ünï", "x."]) if r.random() < 0.5 else f"w{r.randrange(300)}"
    base = [[word() for _ in range(r.randrange(20, 120))] for _ in range(12)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(r.randrange(7)):
            c = list(b)
            for _ in range(r.randrange(4)):
                c[r.randrange(len(c))] = word()
            out.append("\n".join(c) if r.random() < 0.3 else " ".join(c))
    # one large group of near copies and one of exact ones
    big = [word() for _ in range(150)]
    for i in range(40):
        c = list(big)
        c[r.randrange(150)] = f"edit{i}"
        out.append(" ".join(c))
    out += [" ".join(base[0])] * 15 + [None, "", " \t\n", "one", "ONE", "two words", "Two  words", "three little words", "four words are here"]
    r.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("seed,n,num", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_classes_are_those_of_all_pairs(spark, seed, n, num):
    rows = corpus(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clash = d.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("key", "n", "token", "component", "tag", "a", "c")])
    got = nj.ngram_join(clash, n, num, 100, buckets=1 << 12)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows, n, num, 100)


@pytest.mark.parametrize("hubs,few", [(0, 64), (0, 2), (1, 2)])
def test_small_holds_deal_often_and_large_classes_are_met_as_such(spark, monkeypatch, hubs, few):
    monkeypatch.setattr(nj, "HELD", 300)
    monkeypatch.setattr(nj, "HUBS", hubs)
    monkeypatch.setattr(nj, "FEW", few)
    rows = corpus(4 + few)
    got = nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), buckets=1 << 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 85, 100)


def test_empty_table_repeated_rows_and_long_text(spark):
    schema = "doc_id long, text string"
    assert nj.ngram_join(spark.createDataFrame([], schema), buckets=1 << 10).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, "lorem " * 30_000)]
    got = sorted(map(tuple, nj.ngram_join(spark.createDataFrame(rows, schema), buckets=1 << 10).collect()))
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 1, 4)]


def test_suffix_bound_is_a_bound():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 200, r.integers(1, 90)).astype(np.uint64)) for _ in range(2))
        assert nj.suffix_bound(a, b) >= len(np.intersect1d(a, b))


def test_components_of_a_chain_and_a_hub(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, 2000)]
    r.shuffle(edges)
    got = {x.node: x.component for x in components(spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in edges], "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(50)) and got[2000] == got[-5] == -5


def test_rows_of_a_null_doc_id_link_with_none(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (None, None), (None, "g h")]
    got = nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), buckets=1 << 10).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 3, 1), (2, 3, 1), (None, 0, None), (None, 1, None), (None, 3, None), (None, 3, None)]


def test_other_texts_under_a_doc_id_are_classed_as_themselves(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for i in range(12):  # doc_id i has three unlike texts, each with near copies under other doc_ids
        for k in range(3):
            base = [word() for _ in range(60)]
            rows.append((i, " ".join(base)))
            for c in range(2):
                near = list(base)
                near[r.randrange(60)] = word()
                rows.append((1000 + 100 * i + 10 * k + c, " ".join(near)))
    rows.append(rows[0])
    want = brute(rows, 4, 85, 100)
    for parts in (1, 5):
        got = nj.classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), buckets=1 << 10).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == want
        assert len({x["class"] for x in got}) == 36


def test_links_connect_the_classes(spark):
    rows = corpus(11)
    sets = {d: shingles(t, 4) for d, t in rows}
    classes, links = nj.classes_and_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), buckets=1 << 10)
    pairs = sorted(map(tuple, links.collect()))
    assert pairs and len(set(pairs)) == len(pairs)
    assert all(a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in pairs)
    up = {d: min(x for x, s in sets.items() if s and s == sets[d]) if sets[d] else d for d in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert {d: root(d) for d in sets} == {x.doc_id: x.component_id for x in classes.collect()}


@pytest.mark.parametrize("share", [3, 1000])
def test_a_hot_key_is_dealt_and_gives_the_same_join(spark, share):
    many = [(k, i) for i, k in enumerate([1] * 200 + [2] * 90 + [3, 4, 5, None, None])]
    one = [(1, "a", None), (2, "b", 1), (3, "c", 2), (9, "d", 3)]
    m, o = spark.createDataFrame(many, "k long, i long"), spark.createDataFrame(one, "k long, x string, y long")
    for how in ("inner", "left"):
        got = evenly(m, o, "k", how, share)
        assert got.columns == ["k", "i", "x", "y"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, m.join(o, "k", how).collect()), key=repr)
