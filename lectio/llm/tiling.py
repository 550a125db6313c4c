"""Operator 6: benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import Hashes, batches, grams, record, texts

#: Tokens of a seed (the least match), tokens of an item that must be tiled, items whose seeds are broadcast at once.
SEED, COVERAGE, ITEMS = 4, 0.5, 20_000
WORD = re.compile(r"\w+")
FILTER_BITS = 20


def tokens(text: bytes | str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores."""
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    return [w.encode() for w in WORD.findall((text or "").lower())]


def tile(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (pattern position, text position, length), longest first, that overlap in neither; ties to earlier ones.

    Running Karp-Rabin: for a search length s, the hash of each unmarked run of s pattern tokens is looked for among
    those of the text, and hits are checked and extended by the tokens that both go on with. A match over twice s long
    restarts at its length; otherwise the matches found are marked in order of length and s is halved, down to `least`.
    Time is in proportion to the product of both lengths, also where every run is like every other.
    """
    n, m = len(pattern), len(text)
    marked_p, marked_t = np.zeros(n, bool), np.zeros(m, bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(n, m) // 2)
    # marked text lets at most so many places of a match of one length fail, so the first ones suffice
    most = n * (n // least + 2) + 1
    while min(n, m) >= least:
        runs_p, runs_t = grams(pattern, s), grams(text, s)
        found, longest = [], 0
        common = np.zeros(m + 1, np.int32)  # of the pattern from p and the text from each place
        for p in range(n - 1, -1, -1):
            common[:m] = np.where((text == pattern[p]) & ~marked_t, common[1:] + 1, 0) if not marked_p[p] else 0
            if p + s > n or marked_p[p]:
                continue
            at = np.flatnonzero(runs_t == runs_p[p])
            at = at[common[at] >= s]
            if not len(at):
                continue
            k = common[at]
            longest = max(longest, int(k.max()))
            if len(at) > most:
                at = np.concatenate([at[k == x][:most] for x in np.unique(k)])
                k = common[at]
            found += [(-x, p, t) for x, t in zip(k.tolist(), at.tolist(), strict=True)]
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for k, p, t in sorted(found):
            if marked_p[p : p - k].any() or marked_t[t : t - k].any():
                again = again or not (marked_p[p : p + s].any() or marked_t[t : t + s].any())
                continue
            marked_p[p : p - k] = marked_t[t : t - k] = True
            tiles.append((p, t, -k))
        if again:
            continue  # what is left of a match that another one cut is still s long or longer
        if s == least:
            break
        s = max(least, s // 2)
    return tiles


def best_covered(h: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray, coded: list[tuple[int, np.ndarray]], seed: int, coverage: float) -> tuple[float, int | None, int]:
    """(coverage, item_id, items covered enough) of a text h whose seeds at `at` are the items' (owner, place).

    Tiles consist of seeds, so the tokens under an item's seeds bound its coverage. Items come by that bound, and none
    is tiled that can neither be covered enough nor be the best.
    """
    by = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.r_[True, owner[by][1:] != owner[by][:-1]])
    bounds = []
    for i, j in zip(cuts, [*cuts[1:], len(by)], strict=True):
        k = int(owner[by[i]])
        item_id, pattern = coded[k]
        under = [np.zeros(size + seed, bool) for size in (len(pattern), len(h))]
        for x in range(seed):
            under[0][place[by[i:j]] + x] = under[1][at[by[i:j]] + x] = True
        bounds.append((-min(under[0].sum(), under[1].sum()) / len(pattern), item_id, pattern, under[1]))
    best, n = (0.0, None), 0
    for bound, item_id, pattern, inside in sorted(bounds, key=lambda x: x[:2]):
        if -bound < coverage and (bound, item_id) > (-best[0], best[1] if best[1] is not None else item_id):
            continue
        # the rest of the text can't be in a tile; a gap stays one token
        cut = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        seen = np.flatnonzero(inside)
        part = np.insert(h[seen], np.searchsorted(seen, cut), np.uint64(0))
        share = sum(t[2] for t in tile(pattern, part, seed)) / len(pattern)
        n += share >= coverage
        if best[1] is None or (-share, item_id) < (-best[0], best[1]):
            best = (share, item_id)
    return *best, n


def tile_documents(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, item_block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, coverage, n_items, contaminated, tag): each document's best covered benchmark item.

    An item's coverage is the share of its tokens under tiles of at least `seed` tokens, in whatever order the document
    has them; a document is contaminated by an item covered to `coverage` or more, and n_items counts these. item_id is
    the best covered item (ties: the smallest) that shares a seed, else null with coverage 0. Items with fewer tokens
    than a seed, null items and null item_ids can't be found. Null and empty texts are clean. Each row of a repeated
    doc_id is judged by itself. An empty benchmark leaves every row clean; empty documents give no rows.

    Benchmark items are broadcast in blocks of at most item_block, each of which all documents pass once; documents
    and items meet on the hashes of shared seeds, and of such pairs only those are tiled whose seeds cover enough.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // item_block))
    tagged = texts(docs, F.crc32(F.col("text").cast("binary")).alias("tag"))
    ddl = "doc_id long, item_id long, coverage double, n_items long, contaminated boolean, tag long"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_items", pa.int64()), ("contaminated", pa.bool_()), ("tag", pa.int64())])

    def one(block: int) -> DataFrame:
        hashes = Hashes()
        held = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").toLocalIterator()
        coded = [(r.item_id, hashes.of(tokens(r.text))) for r in held]
        coded = [x for x in coded if len(x[1]) >= seed]
        keys = np.concatenate([grams(h, seed) for _, h in coded] or [np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(coded)), [len(h) - seed + 1 for _, h in coded]) if coded else np.zeros(0, int)
        place = np.concatenate([np.arange(len(h) - seed + 1) for _, h in coded] or [np.zeros(0, int)])
        by = np.argsort(keys, kind="stable")
        shared = spark.sparkContext.broadcast((coded, keys[by], owner[by].astype(np.int32), place[by].astype(np.int32)))

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coded, keys, owner, place = shared.value
            words, bits = Hashes(), np.zeros(1 << FILTER_BITS, bool)
            bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            for b in batches(rows, 500):
                out = []
                for doc_id, text, tag in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    h = words.of(tokens(text))
                    g = grams(h, seed)
                    at = np.flatnonzero(bits[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
                    many = hi - lo
                    hit = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                    best = best_covered(h, np.repeat(at, many), owner[hit], place[hit], coded, seed, coverage) if len(hit) else (0.0, None, 0)
                    out.append((doc_id, best[1], best[0], best[2], best[2] > 0, tag))
                yield record(schema, *(zip(*out, strict=True) if out else [[]] * 6))

        return tagged.mapInArrow(run, ddl)

    if blocks == 1:
        return one(0)
    every = one(0)
    for k in range(1, blocks):
        every = every.unionByName(one(k))
    # a row of a repeated (doc_id, text) has the same result each time, so the count a block restores their number
    rank = F.struct(-F.col("coverage"), F.coalesce("item_id", F.lit(2**63 - 1)))
    merged = every.groupBy("doc_id", "tag").agg(F.min_by("item_id", rank).alias("item_id"), F.max("coverage").alias("coverage"), F.sum("n_items").alias("n"), F.count("*").alias("rows"))
    merged = merged.withColumn("copies", F.expr(f"cast(rows div {blocks} as int)")).withColumn("n_items", F.expr("n div copies")).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return merged.select("doc_id", "item_id", "coverage", "n_items", (F.col("n_items") > 0).alias("contaminated"), "tag")
