"""Operator 11: runs of periodically repeated words by a harmonic grid.

For every period p the grid has the places 0, p, 2p, …; a run of period p and four periods or more holds a pair of
neighbouring places jp and (j + 1)p. How far the words from the two agree, forward and backward, gives the whole run.
Over all periods that is n ln n pairs, each answered in constant time: the common extension of two suffixes is the least
common prefix between them in the suffix array, a range minimum; backward extensions come from the reversed array.

The first grid place in a run of period p has more than two periods of it after its neighbour, so that pairs which don't
agree in three words are dropped, and a text without any other pair needs no suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import batches, record, texts

#: Periods that a run has at least, and words.
PERIODS, LEAST = 4, 6
#: Words of the texts looked at together, pairs of grid places looked at together.
HELD, PAIRS = 200_000, 2_000_000
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUN), ("text", pa.string())])
DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


class _Extensions:
    """Common extensions of places of one text, for several texts in one array: suffix array, neighbours' common prefixes, range minima.

    code: word numbers; text: the number of each word's text, ascending. Takes about 20 + 4 log2(longest repeat) bytes a word.
    """

    def __init__(self, code: np.ndarray, text: np.ndarray):
        n = len(code)
        stop = np.searchsorted(text, text, "right")
        key = text.astype(np.int64) * (int(code.max()) + 1) + code  # suffixes of two texts have nothing in common
        sa = np.argsort(key, kind="stable").astype(np.int32)
        first = np.r_[True, np.diff(key[sa]) != 0]
        rank = np.empty(n, np.int32)
        rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, h = [rank], 1
        open_ = self._open(sa, first)
        while len(open_):  # suffixes whose first h words others have too, by their next h words
            last = levels[-1]
            after = open_ + h
            inside = after < stop[open_]
            key = last[open_].astype(np.int64) * (n + 1) + np.where(inside, last[np.where(inside, after, 0)] + 1, 0)
            by = np.argsort(key, kind="stable")
            moved, key = open_[by], key[by]
            group = last[moved]
            begins = np.r_[True, np.diff(group) != 0]
            slot = group + np.arange(len(moved)) - np.maximum.accumulate(np.where(begins, np.arange(len(moved)), 0))
            sa[slot] = moved
            first = np.r_[True, np.diff(key) != 0]
            rank = last.copy()
            rank[moved] = slot[np.maximum.accumulate(np.where(first, np.arange(len(moved)), 0))]
            levels.append(rank)
            open_, h = self._open(moved, first), 2 * h
        self.rank = levels[-1]
        common, a, b = np.zeros(n, np.int32), sa[:-1].astype(np.int64), sa[1:].astype(np.int64)
        end = np.minimum(stop[a] - a, stop[b] - b)  # words that both have
        for k in reversed(range(len(levels) - 1)):
            at = common[1:]
            inside = at < end
            same = inside & (levels[k][np.where(inside, a + at, 0)] == levels[k][np.where(inside, b + at, 0)])
            common[1:][same] += 1 << k
        self.common = common

    @staticmethod
    def _open(places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of places sorted in groups, those whose group has others."""
        return places[~(first & np.r_[first[1:], True])].astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on."""
        low, high = self.rank[a], self.rank[b]
        low, high = np.minimum(low, high) + 1, np.maximum(low, high)
        level = np.frexp(high - low + 1)[1] - 1
        out, least = np.zeros(len(a), np.int64), self.common
        for k in range(int(level.max(initial=-1)) + 1):  # minima of 2^k neighbours
            if k:
                half = 1 << (k - 1)
                least = np.minimum(least[:-half], least[half:])
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(least[low[here]], least[high[here] - (1 << k) + 1])
        return out


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place jp, place (j + 1)p, p) for all texts' periods p, as far as more than two periods follow; some PAIRS at a time."""
    starts = np.cumsum(sizes) - sizes
    periods = np.where(sizes >= LEAST, sizes // PERIODS, 0)
    upto = np.cumsum(periods)
    for begin in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        number = np.arange(begin, min(begin + PAIRS, int(upto[-1])))
        text = np.searchsorted(upto, number, "right")
        p = number - (upto - periods)[text] + 1
        pairs = (sizes[text] - 1) // p - 2
        ends = np.cumsum(pairs)
        cuts = np.r_[np.searchsorted(ends, np.arange(0, int(ends[-1]), PAIRS)), len(p)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            each = np.repeat(np.arange(i, j), pairs[i:j])
            step = np.arange(len(each)) - np.repeat(np.cumsum(pairs[i:j]) - pairs[i:j], pairs[i:j])
            left = starts[text[each]] + step * p[each]
            yield left, left + p[each], p[each]


def _agreeing(code: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of the grid from which three words agree."""
    for left, right, p in _grid(sizes):
        for k in range(3):
            same = code[left + k] == code[right + k]
            left, right, p = left[same], right[same], p[same]
        if len(left):
            yield left, right, p


def runs(code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts of `sizes` words each, their word numbers one after the other; in order."""
    found = [np.zeros((0, 3), np.int64)]
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    some = np.zeros(len(sizes), bool)
    for left, _, _ in _agreeing(code, sizes):
        some[text_of[left]] = True
    if not some.any():
        return np.zeros((0, 4), np.int64)
    chosen = some[text_of]
    code, kept, sizes = code[chosen], np.flatnonzero(some), sizes[some]
    text_of, n = np.repeat(np.arange(len(sizes)), sizes), int(sizes.sum())
    starts = np.cumsum(sizes) - sizes
    forward = _Extensions(code, text_of)
    backward = _Extensions(code[::-1].copy(), len(sizes) - 1 - text_of[::-1])
    for left, right, p in _agreeing(code, sizes):
        ahead = forward(left, right)
        more = ahead > 2 * p
        left, right, p, ahead = left[more], right[more], p[more], ahead[more]
        back, inner = np.zeros(len(left), np.int64), np.flatnonzero(left > starts[text_of[left]])
        back[inner] = backward(n - left[inner], n - right[inner])
        start, end = left - back, right + ahead
        long = end - start >= np.maximum(LEAST, PERIODS * p)
        new = np.stack([start, end, p], 1)[long]
        found.append(new[_least_period(new)])
    all_ = np.concatenate(found)
    # a stretch has each multiple of its period too, as far as four of these fit
    start, end, p = all_[_least_period(all_)].T
    t = text_of[start]
    out = np.stack([kept[t], start - starts[t], end - start, p], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _least_period(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period), the places of each stretch's least period."""
    by = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    new = np.r_[True, (np.diff(rows[by, :2], axis=0) != 0).any(1)] if len(by) else np.zeros(0, bool)
    return by[new]


class _Codes(dict):
    """word -> number, by the bytes themselves."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run has after its first period."""
    if len(found):
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, found[:, 0] + found[:, 2], 1)
        np.add.at(covered, found[:, 0] + found[:, 1], -1)
        words = [w for w, c in zip(words, np.cumsum(covered).tolist(), strict=False) if not c]
    return b" ".join(words)


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row of docs: its runs by start and period, and its text without their repeats.

    A run is a stretch of words with smallest period q (words q apart are identical), at least LEAST words and PERIODS * q
    long, that no neighbouring word extends; words between ASCII white space are compared as they are, and numbered from
    0. The text is the words that no run has after its first q words, with one space between them. Null and empty texts
    have no words, no runs and the empty text. A row each for repeated rows and null doc_ids; an empty table gives no
    rows; other columns of docs, whatever their names, are left behind. Texts are whole: one of n words takes some
    hundred bytes a word and n ln n time, alike for repetitive ones.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 500):
            ids, held, many = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or b"").split()
                if held and many + len(words) > HELD:
                    yield _found(ids, held)
                    ids, held, many = [], [], 0
                ids.append(doc_id)
                held.append(words)
                many += len(words)
            if held:
                yield _found(ids, held)

    return texts(docs).mapInArrow(run, DDL)


def _found(ids: list, held: list[list[bytes]]) -> pa.RecordBatch:
    sizes, codes = np.asarray([len(w) for w in held], np.int64), _Codes()
    all_ = runs(np.fromiter((codes[w] for words in held for w in words), np.int64, int(sizes.sum())), sizes)
    edge = np.searchsorted(all_[:, 0], np.arange(len(held) + 1))
    kept = [_collapsed(words, all_[edge[i] : edge[i + 1], 1:]).decode("utf-8", "replace") for i, words in enumerate(held)]
    spans = pa.StructArray.from_arrays([pa.array(all_[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    return record(SCHEMA, ids, sizes, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), spans), kept)


def strongest(found: Column) -> Column:
    """Of a column of runs the one with the greatest exact length / period; ties go to the smallest start, then period; null without runs."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(found, none, lambda best, x: F.when(better(best, x), x).otherwise(best))


def lines(found: Column) -> Column:
    """`start,length,period` and a line end for each run of a column of runs."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
