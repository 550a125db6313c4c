import random

import pytest

from lectio.llm import substrings as ss


def brute(rows, depth):
    first, out = {}, []
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - depth + 1):
            k = tuple(w[i : i + depth])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    for d, w in words:
        gone = set()
        for i in range(len(w) - depth + 1):
            if d is not None and first[tuple(w[i : i + depth])] < d:
                gone.update(range(i, i + depth))
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(n))
    shared = [some(n) for n in (5, 13, 14, 60)]
    rows = []
    for i in range(90):
        parts = [some(r.randrange(30)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(shared))
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(200, None), (201, ""), (202, "the " * 400), (203, "the " * 300), (5, "only here"), (6, rows[6][1]), (300, "ü " + shared[3] + " ñ"), (-7, shared[3]), (None, shared[3])]


@pytest.mark.parametrize("held", [10**9, 900])
def test_against_all_windows(spark, monkeypatch, held):
    monkeypatch.setattr(ss, "HELD", held)
    rows = corpus(held % 97)
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string").repartition(5)
    for more in ({}, {"bits": 3}, {"prefix": 1}):  # word hashes of three bits collide everywhere and change nothing
        found = ss.remove_repeats(d, **more).collect()
        assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in found), key=repr) == brute(rows, 13)
        assert all(sum(x.end - x.first for x in r.spans) == r.n_removed for r in found)


def test_many_groups_and_parts(spark, monkeypatch):
    """Groups and parts far beyond the tasks, as in a large corpus; word codes alone settle what is shared."""
    monkeypatch.setattr(ss, "GROUP", 40)
    monkeypatch.setattr(ss, "MARKED", 300)
    monkeypatch.setattr(ss, "TASKS", 6)
    rows = corpus(5)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in ss.remove_repeats(d).collect()), key=repr) == brute(rows, 13)


@pytest.mark.parametrize("held", [10**9, 500])
def test_prefixes_that_more_suffixes_have_than_a_group_holds(spark, monkeypatch, held):
    """Four words that begin most passages; with groups of three suffixes all runs of frequent prefixes go apart."""
    monkeypatch.setattr(ss, "GROUP", 3)
    monkeypatch.setattr(ss, "HELD", held)
    r = random.Random(8)
    rows = corpus(8)
    for i in range(60):
        passage = [f"p{r.randrange(3)}" for _ in range(r.randrange(12))]
        rows.append((400 + i, " ".join([f"u{r.randrange(10**6)}", *passage, "to be or not", *(f"q{r.randrange(3)}" for _ in range(r.randrange(12))), *["x y"] * (i % 9)] * 2)))
    rows += [(500, rows[-1][1]), (499, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((x.doc_id, x.text, x.n_words, x.n_removed) for x in ss.remove_repeats(d).collect()), key=repr) == brute(rows, 13)


def test_trees():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.integers(1, 3, (200, 6)).astype(np.uint32)
    by, common = ss._tree(x)
    assert [tuple(v) for v in x[by]] == sorted(tuple(v) for v in x)
    for deep in range(7):
        node = ss._nodes(by, common, deep)
        assert len({(n, tuple(v[:deep])) for n, v in zip(node, x)}) == len(set(node)) == len({tuple(v[:deep]) for v in x})


def test_other_depth_and_no_rows(spark):
    rows = [(1, "a b c d"), (2, "x b c y"), (3, "c d")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in ss.remove_repeats(d, 2).collect()), key=repr) == brute(rows, 2)
    assert ss.remove_repeats(d.where("false")).count() == 0


def test_words_are_those_of_split():
    from lectio.llm.common import split_words

    r = random.Random(0)
    pieces = [" ", "\t", "\n\x0b", "\r\x0c  ", "a", "bc", "ü", "\x1c", "\xa0", "日本", "x" * 7, "y" * 8, "z" * 9, "w" * 40, "v" * 300]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(40))).encode() for _ in range(300)] + [None, b"", b" "]
    plain, counts, sizes, h = split_words(texts)
    want = [(t or b"").split() for t in texts]
    flat = [w for ws in want for w in ws]
    assert counts.tolist() == list(map(len, want)) and sizes.tolist() == list(map(len, flat))
    assert plain == b"".join(w + b" " for w in flat)
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
