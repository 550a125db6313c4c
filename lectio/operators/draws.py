"""The seeded resample plan, drawn in parallel and equal to a loop over random.Random(seed).

The generator's stream of 32-bit words is cut in ranges. The driver runs over the words without looking at them and notes
the generator's state where each range begins. Tasks count the words of their range that a draw below n accepts; sums of
these counts say which draw a range begins with. Then each task draws the resamples that begin in its range, and goes on
past its end for the last one's.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of a range where there are few, ranges at most, words that a task has at once.
RANGE, RANGES, AT_ONCE = 1 << 20, 4096, 1 << 20


class Words:
    """The words of a Mersenne Twister, from a state on."""

    def __init__(self, key: np.ndarray, at: int):
        self.twister = np.random.MT19937()
        self.twister.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": at}}

    @classmethod
    def seeded(cls, seed: int) -> Words:
        *key, at = random.Random(seed).getstate()[1]
        return cls(np.asarray(key, np.uint32), at)

    def state(self) -> tuple[bytes, int]:
        s = self.twister.state["state"]
        return s["key"].astype("<u4").tobytes(), int(s["pos"])

    def below(self, n: int, words: int) -> np.ndarray:
        """Draws below n that the next words give: a word's upper bits, if they are below n."""
        drawn = self.twister.random_raw(words) >> np.uint64(32 - n.bit_length())
        return drawn[drawn < n].astype(np.int64)


def _ranges(spark: SparkSession, states: list[tuple]) -> DataFrame:
    rows = spark.createDataFrame(states, "r int, state binary, at int, first long")
    return rows.repartitionByRange(len(states), "r")


def seeded_plan(spark: SparkSession, n: int, b: int, seed: int, words: int | None = None) -> DataFrame:
    """(b, i, w): how often unit i of n is drawn in resample b, as n calls of randrange(n) for each resample draw it.

    words: of a range. No unit or no resample gives no rows.
    """
    if n >= 1 << 31:
        raise ValueError("units are numbered in 31 bits")
    made = "b int, i int, w int"
    if n < 1 or b < 1:
        return spark.createDataFrame([], made)
    # a draw takes 2^bits / n words on average; more ranges follow where that didn't do
    expected = -(-b * n * (1 << n.bit_length()) // n)
    words = words or max(min(RANGE, max(1 << 14, expected // 64)), -(-expected // (RANGES - 64)))
    stream, states, counts = Words.seeded(seed), [], []

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w, left, found = Words(np.frombuffer(r["state"], "<u4"), r["at"]), words, 0
                while left:
                    found, left = found + len(w.below(n, min(left, AT_ONCE))), left - min(left, AT_ONCE)
                yield pa.RecordBatch.from_pydict({"r": pa.array([r["r"]], pa.int32()), "n": pa.array([found], pa.int64())})

    more = -(-expected // words) + 1
    while sum(counts) < b * n:
        new = []
        for _ in range(more):
            new.append((len(states) + len(new), *stream.state(), 0))
            stream.twister.random_raw(words, output=False)
        counts += [x.n for x in sorted(_ranges(spark, new).mapInArrow(counted, "r int, n long").collect())]
        states, more = states + new, max(1, len(states) // 64)
    first = np.cumsum([0, *counts[:-1]])
    ranges = [(r, state, at, int(f)) for (r, state, at, _), f in zip(states, first, strict=True) if f < b * n]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _resamples(Words(np.frombuffer(r["state"], "<u4"), r["at"]), words, r["first"], n, b)

    return _ranges(spark, ranges).mapInArrow(drawn, made)


def _resamples(stream: Words, words: int, first: int, n: int, b: int) -> Iterator[pa.RecordBatch]:
    """Rows of the resamples whose first draw lies within the next words; `first` is the number of the next draw."""
    k, skip = -(-first // n), -first % n
    held, left, have, begun = [], words, 0, None  # have: draws since the first whole resample; begun: how many lie in the range
    while True:
        at_once = min(left, AT_ONCE) if left else min(AT_ONCE, 4 * n + 64)
        new = stream.below(n, at_once)
        cut = min(skip, len(new))
        skip, new = skip - cut, new[cut:]
        held.append(new)
        have += len(new)
        if left:
            left -= at_once
            if not left:
                # draws of the range itself decide which resamples begin in it
                begun = -(-have // n)
        whole = have // n if begun is None else min(have // n, begun)
        whole = min(whole, b - k)
        if whole > 0:
            values = np.concatenate(held)
            key, w = np.unique(np.repeat(np.arange(whole), n) * n + values[: whole * n], return_counts=True)
            for i in range(0, len(key), AT_ONCE):
                part = key[i : i + AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(part // n + k, pa.int32()), pa.array(part % n, pa.int32()), pa.array(w[i : i + AT_ONCE], pa.int32())], names=["b", "i", "w"])
            held, have, k = [values[whole * n :]], have - whole * n, k + whole
            begun = None if begun is None else begun - whole
        if k >= b or begun is not None and begun <= 0:
            return
