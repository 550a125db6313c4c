import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lectio.llm import fingerprints as fp
from lectio.llm import queries


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def test_collision_rate_is_generalised_jaccard():
    r = random.Random(1)
    sampler, off = fp.Sampler(2048), []
    for i in range(30):
        words = [f"{i}w{int(r.paretovariate(0.7))}" for _ in range(400)]
        a, b = " ".join(words[:300]), " ".join(words[r.randrange(300) :])
        x, y = sampler([a.encode(), b.encode()])
        j, got = jaccard(a, b), float((x == y).mean())
        assert abs(got - j) < 5 * (j * (1 - j) / 2048) ** 0.5 + 0.002
        off.append(got - j)
    assert abs(np.mean(off)) < 0.008


def test_variables_have_their_distributions():
    h = fp.mixed(np.arange(1, 3001, dtype=np.uint64))
    sampler = fp.Sampler()
    keys = sampler.weighted(h, np.full(3000, 7))
    first = -np.log1p(-(keys >> np.uint64(32)).astype(float) * 2.0**-32)
    assert abs(first.mean() - 1 / 7) < 0.002 and abs(first.std() - 1 / 7) < 0.002  # Exp(7)
    one, plain = sampler.weighted(h, np.ones(3000, np.int64)), sampler.bits(h, 0)
    assert ((one ^ plain) & np.uint64(0xFFFFFFFF)).max() == 0
    assert np.abs((one >> np.uint64(32)).astype(float) - (plain >> np.uint64(32)).astype(float)).max() < 2**12
    # a place holds for the weights that share it, and so do name and time
    low, high = sampler.weighted(h, np.full(3000, 20)), sampler.weighted(h, np.full(3000, 21))
    same = (low & np.uint64(0xFFFFFFFF)) == (high & np.uint64(0xFFFFFFFF))
    assert 0.9 < same.mean() < 1 and (low[same] == high[same]).all() and (high[~same] < low[~same]).all()


def test_blocks_cache_and_batches_change_nothing(monkeypatch):
    r = random.Random(2)
    texts = [" ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(r.choice([0, 1, 5, 300]))).encode() for _ in range(60)]
    together = fp.Sampler()(texts)
    assert (np.concatenate([fp.Sampler()([t]) for t in texts]) == together).all()
    monkeypatch.setattr(fp, "TERMS", 7)
    monkeypatch.setattr(fp, "CACHE", 9)
    small = fp.Sampler()
    assert (np.concatenate([small(texts[i : i + 8]) for i in range(0, 60, 8)]) == together).all()
    assert (together.min(1) > 0).tolist() == [bool(t.split()) for t in texts]


def some_texts(r, n):
    out = [None, "", " \t", "a", "é", "a b"]
    while len(out) < n:
        t = " ".join(f"{r.choice('éabc')}{int(r.paretovariate(0.6))}" for _ in range(r.choice([1, 5, 40, 200])))
        out += [t] * r.choice([1, 1, 1, 3])
    return out


@pytest.mark.parametrize("buckets", [1, 4])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(fp, "BUCKETS", buckets)
    r = random.Random(buckets)
    texts = some_texts(r, 150)
    ids = r.sample(range(-500, 5000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    spark.createDataFrame([(i, t, 3, False) for i, t in rows], "doc_id long, text string, bucket int, next boolean").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op13_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    rows.sort(reverse=True)
    own = {i: fp.Sampler()([(t or "").encode()])[0] for i, t in rows}
    for (i, t), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after, x = t or "", after or "", got[i]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        other = fp.Sampler()([edited.encode()])[0]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert [x.fingerprint, x.edited_fingerprint] == fp.written_out(np.stack([own[i], other]))
        assert (x.near_edited, x.near_next) == ((own[i] == other).mean(), (own[i] == own[j]).mean())
        assert (x.near_next == 1) if t == after else True


def test_null_and_repeated_ids_single_and_empty_tables(spark):
    ddl = "doc_id long, text string"
    rows = [(5, "c c"), (None, "z"), (5, "a a a a a a"), (None, None), (7, "k l m")]
    got = fp.following(spark.createDataFrame(rows, ddl)).collect()
    order = [(7, "k l m"), (5, "a a a a a a"), (5, "c c"), (None, ""), (None, "z")]
    want = [(i, len(t), fp.tail_replaced(t, after)) for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(((x.doc_id, x.n_chars, x.edited) for x in got), key=str) == sorted(want, key=str)
    alone = fp.following(spark.createDataFrame([(1, "a b c d e f")], ddl)).first()
    assert alone.edited == "a b c d a b"[:8] + "a b"
    assert alone.near_next == 1
    assert fp.following(spark.createDataFrame([], ddl)).count() == 0
    assert fp.fingerprints(spark.createDataFrame([], ddl)).count() == 0
    both = fp.fingerprints(spark.createDataFrame([(1, "a b b"), (2, "b b a"), (3, "a b c d"), (4, None)], ddl)).collect()
    prints = {x.doc_id: x.fingerprint for x in both}
    assert prints[1] == prints[2] != prints[3] and set(prints[4]) == {"0"}
    d = spark.createDataFrame([(prints[1], prints[3])], "a string, b string")
    share = d.select(fp.likeness(d.a, d.b)).first()[0]
    x, y = fp.Sampler()([b"a b b", b"a b c d"])
    assert share == (x == y).mean()
