"""Operator 13: fingerprints of weighted terms by consistent weighted sampling.

A text's terms are its words between ASCII white space, each weighted by how often it occurs. For each of SAMPLES draws a
term has two Gamma(2, 1) variables and a uniform one, made from its hash alone; they place its weight on a grid of
logarithms and give it a time, and the term with the least time is the draw's sample, along with its place on the grid.
Two texts draw the same sample with the probability of their generalised Jaccard similarity: the sum of the lesser
weights over the sum of the greater ones. So the share of equal samples estimates it, with a standard error of at most
0.5 / sqrt(SAMPLES).

following() brings each document together with its next one in descending order of ids. Documents are dealt to buckets,
ranges of ids, and the first document of each bucket goes to the bucket before as well: whole texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.common import batches, mixed, partitions, record, small_batches, split_words, texts

#: Samples of a fingerprint, hexadecimal digits of each.
SAMPLES, DIGITS = 128, 4
#: (word, count) pairs whose keys a worker keeps, terms taken together.
CACHE, TERMS = 16_384, 512
#: Buckets a partition.
BUCKETS = 4
#: Stands for a null id, which comes after all others.
LAST = -(1 << 63)


def _exponential(bits: np.ndarray) -> np.ndarray:
    """Exponential numbers above 0 of 32 bits each, in single precision, ascending with the bits."""
    out = (~bits).astype(np.float32)
    out *= np.float32(2.0**-32)
    np.log(np.clip(out, np.float32(2.0**-33), np.float32(1 - 2.0**-24), out=out), out=out)
    return np.negative(out, out=out)


class Sampler:
    """Fingerprints of texts.

    A term's variables for a draw come from three exponential ones, a, e and w: c = a + e is Gamma(2, 1), a its uniform
    share of it, so that v = log(c / a) is exponential and independent of c; r = v + w is Gamma(2, 1) and w / r uniform. The
    time of a weight of 1 is then a itself, which most terms need alone. A key has the time in its upper half, as the
    probability of an earlier one, and a hash of term and place on the grid below: the least key is the sample.
    """

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        salts = mixed(np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.salts = salts.reshape(3, 1, samples)
        self.keys, self.rows = np.empty((CACHE, samples), np.uint64), {}

    def bits(self, h: np.ndarray, k: int) -> np.ndarray:
        """64 bits a term and draw."""
        out = h[:, None] ^ self.salts[k]
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out

    def weighted(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keys of terms of any weight, a row each."""
        bits = self.bits(h, 0)
        a, e, w = (_exponential(x) for x in ((bits >> np.uint64(32)).astype(np.uint32), (self.bits(h, 1) >> np.uint64(32)).astype(np.uint32), (self.bits(h, 2) >> np.uint64(32)).astype(np.uint32)))
        c = a + e
        r = np.log(c / a) + w
        place = np.floor((np.log(counts.astype(np.float32))[:, None] + w) / r)
        time = c * np.exp(w - r * (place + 1))
        early = np.minimum(-np.expm1(-time) * np.float32(2.0**32), np.float32(2.0**32 - 256)).astype(np.uint64)
        name = bits ^ place.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # that of a weight of 1 at place 0
        return early << np.uint64(32) | name & np.uint64(0xFFFFFFFF)

    def _common(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """weighted(), kept from text to text."""
        terms = list(zip(h.tolist(), counts.tolist(), strict=True))
        new = {t: i for i, t in enumerate(terms) if t not in self.rows}
        if len(self.rows) + len(new) > CACHE:
            self.rows.clear()
            new = {t: i for i, t in enumerate(terms)}
        if new:
            at, i = len(self.rows), list(new.values())
            self.keys[at : at + len(i)] = self.weighted(h[i], counts[i])
            self.rows.update(zip(new, range(at, at + len(i)), strict=True))
        return self.keys[np.fromiter(map(self.rows.__getitem__, terms), np.int64, len(terms))]

    def __call__(self, texts_: list[bytes]) -> np.ndarray:
        """A row of samples from 1 for each text; of a text without words, zeros."""
        best = np.full((len(texts_), self.samples), np.uint64((1 << 64) - 1))
        _, sizes, _, h = split_words(texts_)
        text = np.repeat(np.arange(len(texts_), dtype=np.uint64), sizes)
        h = np.sort(text << np.uint64(48) | h >> np.uint64(16))  # a word's hash in 48 bits
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        counts, h = np.diff(np.r_[first, len(h)]), h[first]
        text, h = (h >> np.uint64(48)).astype(np.int64), mixed(h << np.uint64(16))
        for kind, keys in ((counts == 1, lambda i: self.bits(h[i], 0)), (counts > 1, lambda i: self._common(h[i], counts[i]))):
            chosen = np.flatnonzero(kind)
            for begin in range(0, len(chosen), TERMS):
                i = chosen[begin : begin + TERMS]
                of = text[i]
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                best[of[starts]] = np.minimum(best[of[starts]], np.minimum.reduceat(keys(i), starts, axis=0))
        out = (best & np.uint64(0xFFFFFFFF)) % np.uint64((1 << 4 * DIGITS) - 1) + np.uint64(1)
        return np.where(sizes[:, None] > 0, out, np.uint64(0)).astype(np.uint16)


def written_out(samples: np.ndarray) -> list[str]:
    """DIGITS hexadecimal digits a sample, for each row."""
    return [x.tobytes().hex() for x in samples.astype(">u2")]


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, 0 to 1."""
    one = lambda c, i: F.substring(c, i * DIGITS + 1, F.lit(DIGITS))
    n = F.length(a) / DIGITS
    return F.size(F.filter(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: one(a, i) == one(b, i))) / n


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs, where it lies; null and empty texts and white space have zeros.

    A row each for repeated rows and null doc_ids; an empty table gives no rows; other columns are left behind.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for b in batches(rows, 64):
            yield record(schema, b.column(0), written_out(sampler([t or b"" for t in b.column(1).to_pylist()])))

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def tail_replaced(text: str, after: str) -> str:
    """text, whose last third is replaced by as many code points of the beginning of another, or all that it has."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _buckets(spark: SparkSession, ids: DataFrame) -> np.ndarray:
    """(least, greatest) id of each bucket, descending: at most BUCKETS a partition, of a narrow shuffle of ids alone."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(int(a.min()), int(a.max())) for a in (b.column(0).to_numpy() for b in rows) if len(a)]
        if found:
            yield pa.RecordBatch.from_pydict({"low": [min(a for a, _ in found)], "high": [max(b for _, b in found)]})

    ranges = ids.repartitionByRange(BUCKETS * partitions(spark), F.col("at").desc()).mapInArrow(run, "low long, high long")
    return np.asarray(sorted(map(tuple, ranges.collect()), reverse=True), np.int64).reshape(-1, 2)


def following(docs: DataFrame, edit=tail_replaced, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and its likeness to that and to the next document's.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next). The next document is the one of
    the next smaller doc_id, after the smallest that of the greatest; edit(text, next text) gives the edited text. Rows
    that repeat a doc_id follow each other by text, nulls first; rows of a null doc_id come last; a single document is its
    own next. Null texts are empty; texts without words are alike 1 and 0 to others. An empty table gives no rows; other
    columns of docs, whatever their names, are left behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at")
    ranges = _buckets(spark, docs.select(at))
    low, high, n = ranges[:, 0][::-1].copy(), ranges[:, 1], len(ranges)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column(0).to_numpy()
            own = n - np.searchsorted(low, ids, "right")
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.zeros(len(ids), bool)), *b.columns], names=["bucket", "next", *b.schema.names])
            first = np.flatnonzero(ids == high[own])
            if len(first):
                of = pa.array((own[first] - 1) % n, pa.int32())
                yield pa.RecordBatch.from_arrays([of, pa.array(np.ones(len(first), bool)), *(c.take(pa.array(first)) for c in b.columns)], names=["bucket", "next", *b.schema.names])

    columns = "at long, doc_id long, text string"
    dealt = docs.select(at, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(deal, f"bucket int, next boolean, {columns}")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "next", F.col("at").desc(), F.col("text").asc_nulls_first())
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(samples), None  # the row before and its samples
        for b in batches(rows, 64):
            here = [(x, d, t or "", g) for x, d, t, g in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "next")), strict=True)]
            own = sampler([t.encode() for _, _, t, _ in here])
            if held:
                here, own = [held[0], *here], np.concatenate([held[1], own])
            pairs = [i for i in range(len(here) - 1) if here[i][0] == here[i + 1][0] and not here[i][3]]
            edited = [edit(here[i][2], here[i + 1][2]) for i in pairs]
            other = sampler([t.encode() for t in edited])
            if pairs:
                yield record(
                    schema, [here[i][1] for i in pairs], [len(here[i][2]) for i in pairs], edited, written_out(own[pairs]), written_out(other),
                    (own[pairs] == other).mean(1), (own[pairs] == own[np.asarray(pairs) + 1]).mean(1),
                )
            held = (here[-1], own[-1:])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
