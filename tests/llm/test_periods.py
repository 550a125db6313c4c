import hashlib
import random
import zlib

import numpy as np
import pytest

from lectio.llm import periods, queries


def brute(words):
    """(start, length, period) of all runs, each period's equal stretches one after the other."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_texts(r, n):
    out = []
    for _ in range(n):
        size, letters = r.choice([0, 1, 3, 5, 6, 7, 8, 20, 60, 150]), r.choice([1, 2, 3, 10])
        words = [f"w{r.randrange(letters)}" for _ in range(size)]
        if size and r.random() < 0.6:
            a = r.randrange(size)
            p = 1 + (size - a) // (3 + r.randrange(8))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        out.append(words)
    return out


@pytest.mark.parametrize("pairs", [7, 50, 2_000_000])
def test_runs_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periods, "PAIRS", pairs)
    r = random.Random(pairs)
    for _ in range(100):
        texts = some_texts(r, r.randint(1, 6))
        codes = periods._Codes()
        got = periods.runs(np.asarray([codes[w] for t in texts for w in t], np.int64), np.asarray([len(t) for t in texts]))
        assert [tuple(x) for x in got.tolist()] == [(i, *x) for i, t in enumerate(texts) for x in brute(t)]


def test_long_repetitive_texts_take_n_log_n():
    one = periods.runs(np.zeros(300_000, np.int64), np.asarray([300_000]))
    assert one.tolist() == [[0, 0, 300_000, 1]]
    turning = np.arange(200_000) % 7_919
    assert periods.runs(turning, np.asarray([200_000])).tolist() == [[0, 0, 200_000, 7_919]]
    assert not len(periods.runs(np.zeros(0, np.int64), np.asarray([0, 0])))


def test_rows_nulls_and_clashing_columns(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b\ty", "A a A a A a A", "é é é é é é", "a b " * 8]
    rows = [(i, t, i, "r") for i, t in enumerate(texts)] + [(None, "b b b b b b", 1, "r"), (5, "a a a a a a", 1, "r")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = sorted(periods.collapse(d).collect(), key=lambda x: (x.doc_id is None, x.doc_id, x.text))
    want = sorted(((i, t) for i, t, *_ in rows), key=lambda x: (x[0] is None, x[0]))
    for g, (i, t) in zip(got, want, strict=True):
        words = [w.decode() for w in (t or "").encode().split()]
        found = brute(words)
        assert (g.doc_id, g.n_words, [tuple(x) for x in g.runs], g.text) == (i, len(words), found, " ".join(collapsed(words, found)))
    assert got[4].runs == [] and len(got[5].runs) == 1
    assert periods.collapse(d.where("false")).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(t) for t in some_texts(r, 300)] + [None, "", " "]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "z z z z z z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op11_periods(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) + 1 and got.pop(None).n_runs == 1
    turned = 0
    for i, t in enumerate(texts):
        words, h = (t or "").split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p, turned = 1 + (n - a) // (3 + g % 8), turned + 1
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = brute(words)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (got[i].n_runs, got[i].start, got[i].length, got[i].period) == (len(found), *(best or (None, None, None)))
        assert got[i].exponent_milli == (best and 1000 * best[1] // best[2])
        assert got[i].runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert got[i].collapsed_sha256 == hashlib.sha256(" ".join(collapsed(words, found)).encode()).hexdigest()
    assert turned > 20
