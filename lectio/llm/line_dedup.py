"""Operator 4: removal of repeated multi-line runs, found by chunks whose boundaries a rolling hash of the lines chooses.

A document is cut once into chunks; of equal chunks all places but the first go as a whole. remove_repeated_chunks() leaves
it at that, so that it finds a run only where it holds a whole chunk. remove_repeated_runs() then looks, in what the chunks
leave, at every two lines that follow each other: what a repeated chunk has before and after it, and runs that hold none.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import batches, evenly, mixed, per_document, record, texts, written
from lectio.llm.ngram_join import CHUNK, _pack, _unpack, summed_chunks

#: Lines a rolling hash spans, one in how many line ends is a boundary, least and most lines of a chunk, buckets of the chunk counts.
SPAN, ONE_IN, LEAST, MOST, BUCKETS = 2, 3, 2, 64, 1 << 22
#: lines -> (first line, end) and hash of each part that is looked for elsewhere.
Spans = Callable[[list[bytes]], tuple[list[tuple[int, int]], np.ndarray]]


def windows(lines: list[bytes]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first line, end) and hash of every two lines with text that follow each other, blank lines between them included."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, (lines[i] for i in full)), np.uint64, len(full))
    gap = np.diff(np.asarray(full, np.int64)).astype(np.uint64)
    return [(i, j + 1) for i, j in zip(full, full[1:])], mixed((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0x9E3779B97F4A7C15) + gap)


def text_chunks(lines: list[bytes]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first line, end) and hash of each of chunks() from its first line with text to its last, where it has two or more."""
    full = [bool(x.strip()) for x in lines]
    found = [[k for k in range(i, j) if full[k]] for i, j in chunks(b"\n".join(lines))]
    at = [(x[0], x[-1] + 1) for x in found if len(x) > 1]
    return at, np.fromiter((xxhash.xxh3_64_intdigest(b"\n".join(lines[i:j])) for i, j in at), np.uint64, len(at))


def chunks(text: bytes | None, span: int = SPAN, one_in: int = ONE_IN, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """(first line, end) of each chunk. A boundary follows a line where the rolling hash of the last `span` lines says so.

    Whether a line is a candidate depends on these lines alone; which candidates hold also depends on the last boundary
    before, as a chunk has at least `least` and at most `most` lines, so text put in before a passage can shift its first ones.
    """
    lines = (text or b"").split(b"\n")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    roll = np.zeros(len(h), np.uint64)
    for j in range(span):
        roll[j:] += h[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15) ** np.uint64(j)
    ends = np.flatnonzero(mixed(roll) % np.uint64(one_in) == 0) + 1
    out, start = [], 0
    for end in [*ends.tolist(), len(lines)]:
        while end - start > most:
            out.append((start, start + most))
            start += most
        if end - start >= least or end == len(lines) and end > start:
            out.append((start, end))
            start = end
    return out


def remove_repeated_runs(docs: DataFrame, carry: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, …carried): each document without the lines that an earlier place has in the same run.

    A line goes if it lies in a run of two lines with text or more whose bytes also stand at an earlier place by
    (doc_id, line), without overlap where that is in the same document; runs of any length and place are found. Blank
    lines between two such lines belong to the run; they make no run of their own, and a single repeated line stays.
    The first place of a line is never removed, but where runs overlap, a run's first place can lose lines that an
    earlier run has. Runs are the same where the SHA-256 of their bytes is. Lines end at a newline. Null and empty texts have one empty line and give an empty text; repeated rows of a doc_id and text share
    their marks, so the first place stays in each; rows of a null doc_id stay whole. An empty table gives no rows.

    Chunks come first: a later place of a chunk holds no first place of two lines, as the chunk's first place has them all
    before, and each of its lines lies in two that go. Two lines are looked for only where they aren't in such a place.
    """
    return _removed(docs, (text_chunks, windows), carry, buckets)


def remove_repeated_chunks(docs: DataFrame, carry: tuple[str, ...] = (), buckets: int = BUCKETS, **shape) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, …carried): each document without the chunks that an earlier place has too.

    Of the places of a chunk of two lines or more, the first by (doc_id, line) keeps it, and every other place loses it.
    Chunks are the same where the SHA-256 of their bytes is. Chunks of a single line are never removed, and a repeated
    run that holds no whole chunk stays. Lines end at a newline. Null and empty texts have one empty line and give an
    empty text; repeated rows of a doc_id and text share their marks, so the first place stays in each; rows of a null
    doc_id stay whole. An empty table gives no rows.
    """
    least = shape.get("least", LEAST)

    def spans(lines: list[bytes]) -> tuple[list[tuple[int, int]], np.ndarray]:
        found = [(i, j) for i, j in chunks(b"\n".join(lines), **shape) if j - i >= least]
        return found, np.fromiter((xxhash.xxh3_64_intdigest(b"\n".join(lines[i:j])) for i, j in found), np.uint64, len(found))

    return _removed(docs, (spans,), carry, buckets)


def repeated(docs: DataFrame, ways: tuple[Spans, ...], buckets: int = BUCKETS) -> list[DataFrame]:
    """For each way of finding spans, (doc_id, tag, i, j) of those that an earlier place has too, but for spans inside those of a way before.

    One pass counts span hashes in a fixed number of buckets a way; a second sends on the SHA-256 of only those spans whose
    bucket was hit twice or more.
    """
    tagged = texts(docs, F.crc32(F.col("text").cast("binary")).alias("tag")).where("doc_id is not null")
    size, every = min(CHUNK, buckets), len(ways) * buckets

    def found_in(text: bytes | None) -> tuple[list[bytes], list[tuple[int, int]], np.ndarray]:
        lines, at, bucket = (text or b"").split(b"\n"), [], []
        for k, spans in enumerate(ways):
            more, h = spans(lines)
            at += more
            bucket.append((h & np.uint64(buckets - 1)).astype(np.int64) + k * buckets)
        return lines, at, np.concatenate(bucket)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]), np.zeros(every, np.uint8)
        for b in batches(rows):
            at, n = np.unique(np.concatenate([found_in(t)[-1] for t in b.column(1).to_pylist()]), return_counts=True)
            seen[at] = np.minimum(seen[at] + n, 2)  # whether once or oftener is all that counts
        for c in range(every // size):
            part = seen[c * size : (c + 1) * size]
            if part.any():
                yield record(schema, [c], [_pack(part)])

    twice = np.zeros(every, bool)
    for c, blob in summed_chunks(tagged.mapInArrow(count, "chunk int, counts binary")).toLocalIterator():
        twice[c * size : (c + 1) * size] = _unpack(bytes(blob)) > 1
    again = docs.sparkSession.sparkContext.broadcast(np.packbits(twice))

    def places(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("way", pa.int32()), ("sha", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])
        hit = np.unpackbits(again.value).astype(bool)
        for b in batches(rows):
            out = []
            for doc_id, t, tag in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                lines, at, bucket = found_in(t)
                for k in np.flatnonzero(hit[bucket]).tolist():
                    i, j = at[k]
                    out.append((int(bucket[k]) // buckets, hashlib.sha256(b"\n".join(lines[i:j])).digest(), doc_id, tag, i, j))
            if out:
                yield record(schema, *zip(*out, strict=True))

    found = written(tagged.mapInArrow(places, "way int, sha binary, doc_id long, tag long, i int, j int"))
    place, cuts = F.struct("doc_id", "tag", "i", "j"), []
    for k in range(len(ways)):
        held = found.where(F.col("way") == k).drop("way")
        if cuts:
            held = written(_outside(held, functools.reduce(DataFrame.unionByName, cuts)))
        firsts = written(held.groupBy("sha").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
        overlaps = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag")) & (F.col("i") < F.col("first.j"))  # the first place itself too
        cuts.append(evenly(held, firsts.select("sha", "first"), "sha").where(~overlaps).select("doc_id", "tag", "i", "j"))
        if k + 1 < len(ways):
            cuts[k] = written(cuts[k])
    return cuts


def _outside(held: DataFrame, cuts: DataFrame) -> DataFrame:
    """The spans that lie in no span of cuts; a document has at most as many as lines."""
    of = cuts.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("i", "j")).alias("_cuts"))
    inside = F.exists(F.coalesce("_cuts", F.array().cast("array<struct<i:int,j:int>>")), lambda x: (x["i"] <= F.col("i")) & (F.col("j") <= x["j"]))
    return held.join(of, ["doc_id", "tag"], "left").where(~inside).select(*held.columns)


def _removed(docs: DataFrame, ways: tuple[Spans, ...], carry: tuple[str, ...], buckets: int) -> DataFrame:
    """Each document without its repeated() spans; texts and the lines to drop meet in one shuffle."""
    cut = functools.reduce(DataFrame.unionByName, repeated(docs, ways, buckets))
    marks = cut.select("doc_id", "tag", F.encode(F.concat_ws(" ", "i", "j"), "utf-8").alias("payload"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])

    def drop(doc_id, text, found):
        lines, out = (text or b"").split(b"\n"), set()
        for f in found:
            out.update(range(*map(int, f.split())))
        return doc_id, b"\n".join(x for k, x in enumerate(lines) if k not in out) if out else text or b"", len(lines), len(out)

    result = per_document(docs, marks, drop, schema, "doc_id long, text binary, n_lines long, n_removed long", carry)
    return result.withColumn("text", F.col("text").cast("string"))
