"""Operator 2: bounded-space online packing of documents into fixed token windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm import bpe
from lectio.llm.common import batches, record, texts, written

#: Windows that a partition keeps open, partitions whose leftovers are merged together.
OPEN_WINDOWS, MERGE_PARTITIONS = 16, 64
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_()), ("part", pa.int32())])
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean, part int"


class Windows:
    """At most `most` open windows of `size` tokens, kept ordered by the room they have left."""

    def __init__(self, size: int, most: int, base: int):
        self.size, self.most, self.base, self.made = size, most, base, 0
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.inside: dict[int, list[tuple]] = {}
        self.closed: list[tuple[int, list[tuple]]] = []

    def put(self, piece: tuple, at: int) -> None:
        """piece = (doc_id, start, ids, doc_tokens), which fits in the window at self.rooms[at]."""
        room, w = self.rooms.pop(at)
        self.inside[w].append(piece)
        left = room - len(piece[2]) // 4
        if left:
            insort(self.rooms, (left, w))
        else:
            self.close(w)

    def close(self, w: int) -> None:
        self.closed.append((self.base + w, self.inside.pop(w)))

    def fresh(self) -> int:
        w, self.made = self.made, self.made + 1
        self.inside[w] = []
        insort(self.rooms, (self.size, w))
        return bisect_left(self.rooms, (self.size, w))

    def add(self, doc_id: int, start: int, ids: bytes, total: int) -> None:
        """Best fit; when nothing fits and all windows are taken, the fullest is topped up with the piece's head and emitted."""
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                self.put((doc_id, start, ids[: 4 * self.size], total), self.fresh())
                start, ids = start + self.size, ids[4 * self.size :]
                continue
            at = bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                return self.put((doc_id, start, ids, total), at)
            if len(self.rooms) < self.most:
                return self.put((doc_id, start, ids, total), self.fresh())
            room = self.rooms[0][0]
            self.put((doc_id, start, ids[: 4 * room], total), 0)
            start, ids = start + room, ids[4 * room :]

    def take(self) -> list[tuple[int, list[tuple]]]:
        out, self.closed = self.closed, []
        return out


def _rows(windows: list[tuple[int, list[tuple]]], still: bool, part: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in SCHEMA]
    for seq, pieces in windows:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for c, v in zip(cols, (doc_id, start, n, total, seq, offset, ids, still, part), strict=True):
                c.append(v)
            offset += n
    return record(SCHEMA, *cols)


def pack(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 0, open_windows: int = OPEN_WINDOWS, merge_partitions: int = MERGE_PARTITIONS, derive: dict[str, Callable[[Column], Column]] | None = None, keep_ids: bool = True, added: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids), ids as little-endian uint32 bytes.

    Every document, then end_id, is placed whole where it fits best among open_windows windows of its partition; when
    it fits nowhere the fullest window takes its head and is emitted full. What is open at a partition's end goes,
    by groups of merge_partitions partitions (a bounded number of windows), into full windows again, and each group's
    last one is cut into lengths that are powers of two, which need no padding. Memory is bounded by the open windows.

    derive: further columns from ids; keep_ids=False drops ids, so that closed windows' ids are never stored.
    added: the content of an added token in a text is that token, as the tokenizer's file has it, not plain text.
    Null and empty texts are documents of the one token end_id; repeated and null doc_ids are packed as documents of
    their own, under the id that they have; an empty table gives no rows; other columns of docs are ignored. Of windows
    with equal room the one opened first is taken.
    """
    path, derive = path or bpe.default_path(), derive or {}

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tok, w, end = bpe.load(path, added), Windows(size, open_windows, part << 32), np.asarray([end_id], "<u4").tobytes()
        for b in batches(rows, 200):
            every = tok.ids([(t or b"").decode("utf-8", "replace") for t in b.column(1).to_pylist()])
            for doc_id, ids in zip(b.column(0).to_pylist(), every, strict=True):
                ids += end
                w.add(doc_id, 0, ids, len(ids) // 4)
            yield _rows(w.take(), False, part)
        yield _rows([(w.base + k, v) for k, v in w.inside.items()], True, part)

    def merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for b in rows:
            for r in b.to_pylist():
                groups.setdefault(r["part"] // merge_partitions, []).append((r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        for g, pieces in sorted(groups.items()):
            # any window with room takes a piece's head, so only the last one stays open
            w = Windows(size, 1, (1 << 62) | (g << 32))
            for _, _, doc_id, start, ids, total in sorted(pieces):
                w.add(doc_id, start, ids, total)
            last = [(w.base + w.made + 1, p) for p in w.inside.values()]
            yield _rows(w.take() + _powers(last), False, -1)

    first = texts(docs).mapInArrow(packed, DDL)
    kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", *derive]
    made = [f(F.col("ids")).alias(k) for k, f in derive.items()]
    held = F.col("ids") if keep_ids else F.when(F.col("open"), F.col("ids"))
    stored = written(first.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "open", "part", *made, held.alias("ids")))
    rest = stored.where("open").select(*SCHEMA.names).repartition(F.expr(f"part div {merge_partitions}")).mapInArrow(merged, DDL)
    out = [*kept, "ids"] if keep_ids else kept
    return stored.where("not open").select(*out).unionByName(rest.select(*kept[: 6], *made, "ids").select(*out))


def _powers(windows: list[tuple[int, list[tuple]]]) -> list[tuple[int, list[tuple]]]:
    """Each window as windows of the powers of two that its length is the sum of."""
    out = []
    for seq, pieces in windows:
        left = sum(len(p[2]) // 4 for p in pieces)
        pieces, k = list(pieces), 0
        while left:
            want = 1 << (left.bit_length() - 1)
            left, now = left - want, []
            while want:
                doc_id, start, ids, total = pieces.pop(0)
                n = min(want, len(ids) // 4)
                now.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc_id, start + n, ids[4 * n :], total))
                want -= n
            out.append((seq + k, now))
            k += 1
    return out
