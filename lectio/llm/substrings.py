"""Operator 7: repeated word passages by prefix-partitioned suffix trees.

Every run of `depth` words has an anchor, a position that its words choose alike wherever they stand: of the positions
that have PREFIX words left in the run, the one whose next PREFIX words are rarest in the corpus. Only anchors' suffixes
go into trees, each with the words that its runs have before it, so that a word is sent a few times and not `depth` times.

A suffix goes to the group of a prefix of its words: one word where no more suffixes than fit in memory start so, else
two, else PREFIX. In a group the suffixes are sorted by their words, and so are the words before them, backwards; the
common prefixes of neighbours are the internal nodes of both trees. Suffixes under one node `depth - o` words deep, whose
words before them are under one node `o` deep, share the run that starts o words before the anchor: all its documents
but the smallest lose it. Words are compared as they are; hashes only choose anchors and groups.

A task first merges what is the same in its own documents and sends on the smallest document's, so that a passage found
in a third of all documents has a row a task; where a passage goes over into other words, these choose the anchor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import batches, grams, partitions, record, split_words, texts, written
from lectio.llm.ngram_join import CHUNK, _pack, _unpack, summed_chunks

#: Words of the longest prefix, buckets of the counts of prefixes of each length.
PREFIX, BUCKETS = 4, 1 << 20
#: Suffixes that a group is to hold, words a task holds before it merges, words whose marks are in memory at once.
GROUP, HELD, MARKED = 1_000_000, 1_000_000, 1_000_000
#: Tasks of a shuffle at most.
TASKS = 20_000
BLOBS = pa.schema([("part", pa.int64()), ("suffixes", pa.bool_()), ("payload", pa.binary())])
DDL = "part long, suffixes boolean, payload binary"


def _shrunk(a: np.ndarray) -> bytes:
    """Ascending or small integers, compressed."""
    d = np.diff(a, prepend=a.dtype.type(0))
    low, high = int(d.min(initial=0)), int(d.max(initial=0))
    kind = np.uint8 if low >= 0 and high < 1 << 8 else np.uint16 if low >= 0 and high < 1 << 16 else np.int32 if -(1 << 31) <= low and high < 1 << 31 else np.int64
    z = zlib.compress(d.astype(kind).tobytes(), 1)
    return bytes([np.dtype(kind).itemsize]) + len(z).to_bytes(4, "little") + z


def _grown(blob: memoryview) -> tuple[np.ndarray, memoryview]:
    n = int.from_bytes(blob[1:5], "little")
    d = np.frombuffer(zlib.decompress(blob[5 : 5 + n]), {1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.int64}[blob[0]])
    return np.cumsum(d, dtype=np.int64), blob[5 + n :]


def _lengths(prefix: int) -> tuple[int, ...]:
    return tuple(p for p in (1, 2) if p < prefix) + (prefix,)


def _low(h: np.ndarray, bits: int) -> np.ndarray:
    return h & np.uint64((1 << bits) - 1)


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g & np.uint64(BUCKETS - 1)).astype(np.int64)


def _prefix_counts(docs: DataFrame, prefix: int, bits: int) -> tuple[np.ndarray, int]:
    """Suffixes by prefix length and hashed prefix, and words, over all documents: a fixed number of buckets, whatever the corpus."""
    schema, lengths = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]), _lengths(prefix)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, many = np.zeros((len(lengths), BUCKETS), np.uint32), [], 0

        def add() -> None:
            sizes = np.concatenate([n for n, _ in held])
            ends, h = np.repeat(np.cumsum(sizes), sizes), _low(np.concatenate([h for _, h in held]), bits)
            for i, p in enumerate(lengths):
                inside = np.arange(len(h) - p + 1) + p <= ends[: len(h) - p + 1] if len(h) >= p else np.zeros(0, bool)
                counts[i] += np.bincount(_bucket(grams(h, p)[inside]), minlength=BUCKETS).astype(np.uint32)

        for b in batches(rows, 500):
            _, sizes, _, h = split_words(b.column(1).to_pylist())
            held.append((sizes, h))
            many += len(h)
            if many >= HELD:
                add()
                held, many = [], 0
        if held:
            add()
        if counts.any():
            flat = counts.ravel()
            for c in range(len(flat) // CHUNK):
                part = flat[c * CHUNK : (c + 1) * CHUNK]
                if part.any():
                    yield record(schema, [c], [_pack(part)])

    out = np.zeros(len(lengths) * BUCKETS, np.uint32)
    for c, blob in summed_chunks(texts(docs).mapInArrow(run, "chunk int, counts binary")).toLocalIterator():
        out[c * CHUNK : (c + 1) * CHUNK] = _unpack(bytes(blob))
    out = out.reshape(len(lengths), BUCKETS)
    return out, int(out[0].sum(dtype=np.int64))


def _anchors(value: np.ndarray, choices: int) -> np.ndarray:
    """For each start of `choices` values that follow each other: where the least of them is, the first of equal ones."""
    m = max(0, len(value) - choices + 1)
    best, at = value[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, choices):
        less = value[j : j + m] < best
        best[less], at[less] = value[j : j + m][less], j
    return at + np.arange(m)


def _merge(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in ascending order of documents: (order by key, whether each one's document isn't its key's first)."""
    by = np.argsort(key, kind="stable")
    first = np.r_[True, key[by][1:] != key[by][:-1]]
    lead = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    return by, doc[by] != doc[lead]


def _tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (rows of word codes) in lexicographic order, and the common prefix of each with the one before it."""
    width = rows.shape[1]
    by = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel(), kind="stable")
    same = rows[by[1:]] == rows[by[:-1]]
    return by, np.r_[0, np.where(same.all(1), width, same.argmin(1))]


def _nodes(by: np.ndarray, common: np.ndarray, deep: int) -> np.ndarray:
    """Each suffix's node `deep` words below the root."""
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(common < deep)
    return out


class _Codes(dict):
    """word -> code from 1, by the bytes themselves."""

    def __missing__(self, word: bytes) -> int:
        c = self[word] = len(self) + 1
        return c


def _suspects(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows, in ascending order of documents, whose key two documents have."""
    by = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
    several = doc[by[cuts]] != doc[by[np.r_[cuts[1:], len(by)] - 1]]
    return np.sort(by[np.repeat(several, np.diff(np.r_[cuts, len(by)]))])


def _shared_runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, doc: np.ndarray, depth: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, run) of every run of `depth` words that a smaller document has too.

    A row is an anchor's suffix with the words before it: `size` word codes of flat from `begin`, of which `left` come
    before the anchor; its runs start at each of its words that has depth - 1 more behind it. Rows are in ascending
    order of documents.
    """
    anchor = begin + left
    after, before = np.zeros((len(doc), depth), np.uint32), np.zeros((len(doc), max(1, depth - prefix)), np.uint32)
    for j in range(depth):
        has = j < size - left
        after[has, j] = flat[anchor[has] + j]
    for j in range(depth - prefix):
        has = j < left
        before[has, j] = flat[anchor[has] - 1 - j]
    right, left_tree = _tree(after), _tree(before)
    rows, runs = [], []
    for o in range(depth - prefix + 1):
        here = np.flatnonzero((o <= left) & (left - o <= size - depth))
        if len(here):
            node = _nodes(*right, depth - o)[here] * (len(doc) + 1) + _nodes(*left_tree, o)[here]
            order, other = _merge(node, doc[here])
            hit = here[order[other]]
            rows.append(hit)
            runs.append(left[hit] - o)
    return np.concatenate(rows), np.concatenate(runs)


def _tasks(docs: DataFrame, words: int) -> int:
    return min(TASKS, max(partitions(docs.sparkSession), words // MARKED))


def repeats(docs: DataFrame, depth: int = 13, prefix: int = PREFIX, bits: int = 64) -> tuple[DataFrame, int]:
    """((part, payload), parts): word positions whose next `depth` words also start in a smaller doc_id, packed by parts of the documents.

    bits: of word hashes, which choose anchors and groups but decide nothing.
    """
    prefix = min(prefix, depth)
    counted, words_in_all = _prefix_counts(docs, prefix, bits)
    counts = docs.sparkSession.sparkContext.broadcast(counted)
    tasks = _tasks(docs, words_in_all)
    groups, parts = max(tasks, -(-words_in_all // GROUP)), max(tasks, -(-words_in_all // MARKED))
    lengths, choices = _lengths(prefix), depth - prefix + 1
    hot = GROUP + 2 * (words_in_all // BUCKETS)  # in a bucket, beside the share that any prefixes have in it

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, many = counts.value, [], 0

        def deal() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:2])
            ids, tags = (np.fromiter((x[k] for x in held), np.int64, len(held)) for k in (0, 1))
            sizes = np.fromiter((len(x[2]) for x in held), np.int64, len(held))
            starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
            h, text = _low(np.concatenate([x[2] for x in held]), bits), b"".join(x[3] for x in held)
            byte = np.r_[0, np.cumsum(np.concatenate([x[4] for x in held]) + 1)]
            owner = np.repeat(np.arange(len(held)), sizes)
            g = [grams(h, p) for p in lengths]
            value = seen[-1][_bucket(g[-1])].astype(np.uint64) << np.uint64(32) | g[-1] >> np.uint64(32)
            run_at = np.flatnonzero(np.arange(len(h)) + depth <= ends[owner])
            anchor = _anchors(value, choices)[run_at]
            new = np.r_[True, anchor[1:] != anchor[:-1]]
            low, high, anchor = run_at[new], run_at[np.r_[new[1:], True]], anchor[new]
            row = owner[low]
            # the same words at all runs of an anchor: only the smallest document's are sent on
            cut = list(map(text.__getitem__, map(slice, byte[low].tolist(), (byte[high + depth] - 1).tolist())))
            first: dict[bytes, int] = {}
            other = np.fromiter(map(first.setdefault, cut, ids[row].tolist()), np.int64, len(row)) != ids[row]
            del first
            again = np.flatnonzero(other)
            many_runs = (high - low + 1)[again]
            at = np.repeat(low[again] - np.cumsum(many_runs) + many_runs, many_runs) + np.arange(many_runs.sum())
            out = list(_packed(np.arange(len(at)), owner[at], at - starts[owner[at]], ids, tags, parts))
            group, fits = (g[-1][anchor] >> np.uint64(24)).astype(np.int64) % groups, np.zeros(len(row), bool)
            for x, n in zip(g, seen, strict=True):
                here = x[anchor]
                rare = ~fits & (n[_bucket(here)] <= GROUP)
                group[rare] = (here[rare] >> np.uint64(24)).astype(np.int64) % groups
                fits |= rare
            left = np.flatnonzero(~other)
            apart = (~fits & (seen[-1][_bucket(g[-1][anchor])] > hot))[left]
            if apart.any():  # beyond the longest prefix there is the whole run: each run of such a prefix is a row of its own
                runs = np.where(apart, high[left] - low[left] + 1, 1)
                of, alone = np.repeat(left, runs), np.repeat(apart, runs)
                low = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
                high, anchor, row, group = np.where(alone, low, high[of]), anchor[of], row[of], group[of]
                cut = [text[byte[i] : byte[i + depth] - 1] if a else cut[k] for i, a, k in zip(low.tolist(), alone.tolist(), of.tolist(), strict=True)]
                at, first = np.flatnonzero(alone), {}
                group[at] = (grams(h, depth)[low[at]] >> np.uint64(24)).astype(np.int64) % groups
                other = np.fromiter((first.setdefault(cut[k], i) for k, i in zip(at.tolist(), ids[row[at]].tolist(), strict=True)), np.int64, len(at)) != ids[row[at]]
                again, left = at[other], np.delete(np.arange(len(of)), at[other])
                out.extend(_packed(np.arange(len(again)), row[again], low[again] - starts[row[again]], ids, tags, parts))
            by = left[np.argsort(group[left], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]]) if len(by) else np.zeros(0, int)
            for i, j in zip(cuts, [*cuts[1:], len(by)], strict=True):
                k = by[i:j]
                inside, begins = np.unique(row[k], return_index=True)
                shape = np.concatenate([anchor[k] - low[k], high[k] - low[k]]).astype("<u4").tobytes()
                said = zlib.compress(b"\n".join([cut[x] for x in k.tolist()]), 1)
                head = (_shrunk(ids[inside]), _shrunk(tags[inside]), _shrunk(begins), _shrunk(low[k] - starts[row[k]]))
                out.append((int(group[k[0]]), True, b"".join((*head, g[-1][anchor[k]].astype("<u4").tobytes(), zlib.compress(shape, 1), said))))
            for x in range(0, len(out), 64):
                yield record(BLOBS, *zip(*out[x : x + 64], strict=True))

        for b in batches(rows, 500):
            plain, sizes, long, h = split_words(b.column(1).to_pylist())
            ends = np.cumsum(sizes)
            bytes_ = np.r_[0, np.cumsum(long + 1)]
            for doc_id, tag, i, j in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                if j - i >= depth and doc_id is not None:
                    held.append((doc_id, tag, h[i:j], plain[bytes_[i] : bytes_[j]], long[i:j]))
                    many += j - i
                if many >= HELD:
                    yield from deal()
                    held, many = [], 0
        if held:
            yield from deal()

    def settled(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        parsed = []
        for blob in held:
            i, rest = _grown(memoryview(blob))
            t, rest = _grown(rest)
            begins, rest = _grown(rest)
            low, rest = _grown(rest)
            z, key = zlib.decompressobj(), np.frombuffer(rest[: 4 * len(low)], "<u4")
            shape = np.frombuffer(z.decompress(rest[4 * len(low) :]), "<u4").astype(np.int64)
            row = np.repeat(np.arange(len(i)), np.diff(begins, append=len(low)))
            parsed.append((i[row], t[row], low, shape[: len(low)], shape[len(low) :] + depth, key, z.unused_data))
        ids, tags, low, left, size, key = (np.concatenate([x[c] for x in parsed]) for c in range(6))
        by = np.lexsort((low, tags, ids))
        # the same first words in two documents, by hash, or there is nothing to share; only these rows' words are read
        use = by[_suspects(key[by], ids[by])]
        if not len(use):
            return
        chosen, many, at = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), 0
        chosen[use] = True
        codes, flat = _Codes(), []
        for x in parsed:
            some = chosen[at : at + len(x[2])]
            if some.any():
                words = b" ".join(compress(zlib.decompress(x[-1]).split(b"\n"), some)).split()
                flat.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                many[at : at + len(x[2])][some] = x[4][some]
            at += len(x[2])
        begin = (np.cumsum(many) - many)[use]
        ids, tags, low, left, size = ids[use], tags[use], low[use], left[use], size[use]
        rows, runs = _shared_runs(np.concatenate(flat), begin, size, left, ids, depth, prefix)
        if len(rows):
            new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]
            order = np.lexsort((low[rows] + runs, rows))
            doc, pos = (np.cumsum(new) - 1)[rows[order]], (low[rows] + runs)[order]
            for x in _packed(np.arange(len(doc)), doc, pos, ids[new], tags[new], parts):
                yield record(BLOBS, *([v] for v in x))

    def nodes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in rows:
            for part, suffixes, blob in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if not suffixes:
                    yield record(BLOBS, [part], [False], [blob])
                    continue
                if part != at and held:
                    yield from settled(held)
                    held = []
                at = part
                held.append(blob)
        if held:
            yield from settled(held)

    tagged = texts(docs, F.crc32(F.col("text").cast("binary")).alias("tag"))
    where = F.when(F.col("suffixes"), F.pmod("part", F.lit(tasks))).otherwise(F.pmod(F.hash("payload"), F.lit(tasks))).cast("int")
    dealt = tagged.mapInArrow(run, DDL).repartitionById(tasks, where).sortWithinPartitions("suffixes", "part")
    return dealt.mapInArrow(nodes, DDL).select("part", "payload"), parts


def _packed(hit: np.ndarray, row: np.ndarray, pos: np.ndarray, ids: np.ndarray, tags: np.ndarray, parts: int) -> Iterator[tuple]:
    """Blobs of the positions pos[hit] of documents row[hit], for the part that each document is dealt to."""
    if not len(hit):
        return
    part = (ids ^ tags) % parts
    hit = hit[np.argsort(part[row[hit]], kind="stable")]
    of = part[row[hit]]
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for i, j in zip(cuts, [*cuts[1:], len(hit)], strict=True):
        inside, first = np.unique(row[hit[i:j]], return_index=True)
        yield int(of[i]), False, b"".join((_shrunk(ids[inside]), _shrunk(tags[inside]), _shrunk(first), zlib.compress(pos[hit[i:j]].astype("<i4").tobytes(), 1)))


def _unpacked(blobs: list[bytes]) -> dict[tuple[int, int], list[np.ndarray]]:
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for blob in blobs:
        ids, rest = _grown(memoryview(blob))
        tags, rest = _grown(rest)
        first, rest = _grown(rest)
        pos = np.frombuffer(zlib.decompress(rest), "<i4")
        for i, t, a, b in zip(ids.tolist(), tags.tolist(), first.tolist(), [*first.tolist()[1:], len(pos)], strict=True):
            found.setdefault((i, t), []).append(pos[a:b])
    return found


def remove_repeats(docs: DataFrame, depth: int = 13, prefix: int = PREFIX, bits: int = 64) -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans): each document without the passages a smaller doc_id has too.

    A word is removed if a run of `depth` words that covers it also starts in a document with a smaller doc_id; runs
    are judged on the input, and words compared byte by byte. Words are runs of bytes other than ASCII white space; what
    is kept is joined by one space. spans: (first word, end) of each stretch removed. Null and empty texts have no words
    and give an empty text; texts shorter than depth lose nothing; repeats within a document, or between rows of one
    doc_id, stay; repeated rows of a doc_id and text are cut alike; rows of a null doc_id stay whole. An empty table
    gives no rows. Other columns of docs are ignored.

    A task holds one group of suffixes, or the marks of one part of the documents, whose numbers follow from counts of
    words and not from the cluster's settings.
    """
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span)])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        at, found = None, None
        for whole in rows:
            for b in batches(iter([whole]), 500):
                out = []
                for doc_id, tag, payload, mark, part in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                    if part != at:
                        at, found, blobs = part, None, []
                    if mark:
                        blobs.append(payload)
                        continue
                    if found is None:
                        found, blobs = _unpacked(blobs), []
                    words, pos = (payload or b"").split(), found.get((doc_id, tag))
                    if not pos:
                        out.append((doc_id, b" ".join(words), len(words), 0, []))
                        continue
                    edge, pos = np.zeros(len(words) + 1, np.int32), np.concatenate(pos)
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + depth, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    turns = np.flatnonzero(np.diff(np.r_[True, keep, True]))
                    spans = [{"first": i, "end": j} for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
                    out.append((doc_id, b" ".join(compress(words, keep)), len(words), len(words) - int(keep.sum()), spans))
                if out:
                    yield record(schema, *zip(*out, strict=True))

    none = F.lit(None)
    marks, parts = repeats(docs, depth, prefix, bits)
    marks = written(marks).select(none.cast("long").alias("doc_id"), none.cast("long").alias("tag"), "payload", F.lit(True).alias("mark"), "part")
    text = texts(docs, F.crc32(F.col("text").cast("binary")).alias("tag")).select("doc_id", "tag", F.col("text").alias("payload"), F.lit(False).alias("mark"), F.pmod(F.coalesce(F.col("doc_id").bitwiseXOR(F.col("tag")), F.lit(0)), F.lit(parts)).alias("part"))
    # a part's marks, which are small, come before its texts
    tasks = min(TASKS, parts)
    met = text.unionByName(marks).repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", F.col("mark").desc()).select("doc_id", "tag", "payload", "mark", "part")
    return met.mapInArrow(cut, "doc_id long, text binary, n_words long, n_removed long, spans array<struct<first int, end int>>").withColumn("text", F.col("text").cast("string"))
