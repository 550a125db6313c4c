import random

import numpy as np

from lectio.llm import tiling


def brute(p, t, least):
    """Greedy string tiling by trying every pair of places, longest first."""
    mp, mt, tiles = [False] * len(p), [False] * len(t), []
    while True:
        best = []
        longest = least
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > longest:
                    best, longest = [(i, j)], k
                elif k == longest:
                    best.append((i, j))
        if not best:
            return tiles
        for i, j in best:
            if not any(mp[i : i + longest]) and not any(mt[j : j + longest]):
                mp[i : i + longest] = mt[j : j + longest] = [True] * longest
                tiles.append((i, j, longest))


def test_tiles_are_the_greedy_ones():
    r = random.Random(0)
    for _ in range(120):
        p = [r.randrange(4) for _ in range(r.randrange(25))]
        t = [r.randrange(4) for _ in range(r.randrange(60))]
        if r.random() < 0.5 and len(p) > 6:
            t[3:3] = p[len(p) // 2 :] + [9] + p[: len(p) // 2]
        got = tiling.tile(np.asarray(p, np.uint64), np.asarray(t, np.uint64), 3)
        assert all(p[i : i + k] == t[j : j + k] for i, j, k in got)
        want = brute(p, t, 3)
        assert sum(k for *_, k in got) == sum(k for *_, k in want), (p, t)


def test_every_pair_within_bounds_of_its_seeds():
    """best_covered() passes over items by their seeds alone, and gives what tiling all of them gives."""
    r = random.Random(2)
    for _ in range(60):
        items = [(i, np.asarray([1 + r.randrange(6) for _ in range(r.randrange(4, 14))], np.uint64)) for i in range(8)]
        h = np.asarray([1 + r.randrange(6) for _ in range(40)], np.uint64)
        hits = [(a, k, p) for a in range(38) for k, (_, x) in enumerate(items) for p in range(len(x) - 2) if (x[p : p + 3] == h[a : a + 3]).all()]
        every = [(sum(t[2] for t in tiling.tile(x, h, 3)) / len(x), i) for i, x in items]
        at, owner, place = (np.asarray(c, int) for c in zip(*hits))
        share, item, n = tiling.best_covered(h, at, owner, place, items, 3, 0.5)
        top = max((s for s, _ in every))
        assert (share, n) == (top, sum(s >= 0.5 for s, _ in every)) and item == min(i for s, i in every if s == top)


def test_texts_of_one_token_take_time_in_proportion():
    import time

    began = time.time()
    same = np.full(300_000, 7, np.uint64)
    assert tiling.tile(np.full(30, 7, np.uint64), same, 4) == [(0, 0, 30)]
    two = np.tile(np.asarray([7, 8], np.uint64), 150_000)
    assert sum(k for *_, k in tiling.tile(np.asarray([7, 8] * 9 + [7, 7] + [8, 7] * 5, np.uint64), two, 4)) == 30
    assert time.time() - began < 20


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item_id int")


def test_reordered_passages_are_caught_and_clean_documents_left(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    item = [r.choice(words) for _ in range(24)]
    other = [r.choice(words) for _ in range(20)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    turned = item[12:] + prose(5) + item[:12]
    rows = [(1, " ".join(prose(50) + item + prose(50))), (2, " ".join(prose(9) + turned)), (3, " ".join(prose(200))), (4, " ".join(w.upper() + "," for w in item)), (5, " ".join(item[:8])), (6, None), (7, ""), (8, " ".join(item + other)), (9, "a b")]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, "a b"), (None, "x")], "item_id long, text string")
    for block in (tiling.ITEMS, 2):
        got = {x.doc_id: (x.item_id, round(x.coverage, 3), x.n_items, x.contaminated) for x in tiling.tile_documents(docs(spark, rows), bench, item_block=block).collect()}
        assert got[1] == (10, 1.0, 1, True) and got[2] == (10, 1.0, 1, True) and got[4] == (10, 1.0, 1, True)
        assert got[3][3] is False and got[5] == (10, round(8 / 24, 3), 0, False)
        assert got[6] == got[7] == got[9] == (None, 0.0, 0, False)
        assert got[8][2:] == (2, True)
    assert tiling.tile_documents(docs(spark, rows), bench.where("false")).where("contaminated").count() == 0
    assert tiling.tile_documents(docs(spark, []), bench).count() == 0
    twice = tiling.tile_documents(docs(spark, [rows[0], rows[0], (1, "x")]), bench, item_block=1)
    assert sorted(x.contaminated for x in twice.collect()) == [False, True, True]
