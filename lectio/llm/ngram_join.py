"""Operator 1: n-gram Jaccard self-join by rare-first prefix filtering, as classes of linked documents.

1. One pass hashes every document's n-gram set, keys it (equal sets share a key) and counts n-grams into a fixed
   array of buckets. The counts only choose the order of n-grams: any one total order is right, a rare-first one is fast.
2. A second pass takes the prefix of each set in that order. A task keeps, for each prefix n-gram, the smallest
   document as leader; only leaders are shuffled, so that a hot n-gram has a row a task at most.
3. Each member is verified on whole sets with its likeliest leader, of those that pass the length and positional
   filters, which gives first classes.
4. Of the n-grams whose documents still lie in several classes, each document meets the one with the most links so
   far, in another class; then all pairs across classes that are left are formed, filtered and verified. No pair is
   verified twice, and pairs within a class need no check: they can't change it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import Hashes, batches, components, discard, discard_since, evenly, extended, grams, partitions, record, tables, texts, written

#: Buckets of the n-gram counts (4 bytes each, sent to every executor), counts in one shuffled row, postings a task holds before it deals them out.
BUCKETS, CHUNK, HELD = 1 << 22, 1 << 16, 2_000_000
#: Groups of tasks whose n-gram counts are summed before the sums are.
GROUPS = 64
#: Shingles whose postings a task reads, and tasks of a shuffle at most.
SHINGLES, TASKS = 12_000_000, 20_000
#: Rounds in which postings meet their n-gram's most linked set before the rest meets across classes.
HUBS = 1
#: Postings of a class at an n-gram up to which its members are met one by one.
FEW = 64

KEYS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
POST = np.dtype([("token", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("n", "<i4"), ("pos", "<i4")])
POSTINGS = "token long, doc long, key long, n int, pos int, leader long, fits boolean"


def gram_set(text: bytes | None, n: int, hashes: Hashes) -> np.ndarray:
    """Distinct n-word shingle hashes, ascending. Fewer words than n: the whole sequence as one; none: empty."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    return np.unique(grams(h, min(n, len(h))) + np.uint64(min(n, len(h)) != n) * np.uint64(len(h)))


def set_key(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _least(n, num: int, den: int):
    """ceil(n * num / den): the least overlap of a set of n with any set it links with."""
    return (n * num + den - 1) // den


def _fits(na, pa_, nb, pb, num: int, den: int):
    """Length filter, then positional filter for an n-gram at pa_ of the one and pb of the other; numpy or Column."""
    need = den + num
    return (na * den >= nb * num) & (nb * den >= na * num) & (_minimum(na - pa_, nb - pb) * need >= num * (na + nb))


def _minimum(a, b):
    return np.minimum(a, b) if isinstance(a, np.ndarray) else F.least(a, b)


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """An upper bound of the overlap of two ascending sets, by splitting both at the longer one's median."""
    if depth == 0 or min(len(a), len(b)) < 8:
        return min(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    mid = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, mid))
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i:], b[j:], depth - 1)


def _pack(a: np.ndarray) -> bytes:
    top = int(a.max(initial=0))
    a = a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)
    return bytes([a.itemsize]) + zlib.compress(a.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[1:]), {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[b[0]])


def _keys(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, any_row = Hashes(), np.zeros(buckets, np.uint32), False
        for b in batches(rows, 500):
            any_row, ns, keys, found = True, [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = gram_set(t, n, hashes)
                ns.append(len(s))
                keys.append(set_key(s) if len(s) and doc is not None else None)
                found.append((s & np.uint64(buckets - 1)).astype(np.int64))
            counts += np.bincount(np.concatenate(found), minlength=buckets).astype(np.uint32)
            yield record(KEYS, b.column(0), b.column(2), ns, keys, pa.nulls(len(ns), pa.int32()), pa.nulls(len(ns), pa.binary()))
        if any_row:
            size = min(CHUNK, buckets)
            for c in range(buckets // size):
                part = counts[c * size : (c + 1) * size]
                if part.any():
                    yield record(KEYS, [None], [None], [None], [None], [c], [_pack(part)])

    tag = F.crc32(F.col("text").cast("binary")).alias("tag")
    return texts(docs, tag).mapInArrow(run, "doc_id long, tag long, n long, key long, chunk int, counts binary")


def _summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, total = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]), {}
    for b in rows:
        for c, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[c] = total.get(c, 0) + _unpack(blob).astype(np.uint64)
    for c, a in total.items():
        yield record(schema, [c], [_pack(np.minimum(a, 0xFFFFFFFF).astype(np.uint64))])


def summed_chunks(parts: DataFrame) -> DataFrame:
    """(chunk, counts) summed over tasks: first by groups of tasks, then over the groups, so that no task reads them all."""
    ddl = "chunk int, counts binary"
    some = parts.select("chunk", "counts", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g")).repartition("chunk", "g").select("chunk", "counts").mapInArrow(_summed, ddl)
    return some.repartition("chunk").mapInArrow(_summed, ddl)


def _postings(docs: DataFrame, n: int, num: int, den: int, counts, parts: int) -> DataFrame:
    """Rows (bucket, blob): leaders for the bucket of their n-gram, or members with the leader they lie under."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order = Hashes(), counts.value
        schema = pa.schema([("bucket", pa.int32()), ("members", pa.bool_()), ("blob", pa.binary())])
        held, many, turn = [], 0, 0

        def deal() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            p = np.concatenate(held)
            p = p[np.lexsort((p["doc"], p["token"]))]
            first = np.r_[True, p["token"][1:] != p["token"][:-1]]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
            other = p["key"] != p["key"][lead]
            # a leader with members here is in a group of several sets wherever else its n-gram is found
            grouped = np.zeros(len(p), bool)
            grouped[lead[other]] = True
            leaders, g = p[first], grouped[first]
            bucket = (leaders["token"] >> np.uint64(40)).astype(np.int64) % parts
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(parts + 1))
            blobs = [(k, False, leaders[by[i:j]].tobytes() + g[by[i:j]].tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            m, u = p[other], p[lead[other]]
            if len(m):
                fits = _fits(m["n"].astype(np.int64), m["pos"].astype(np.int64), u["n"].astype(np.int64), u["pos"].astype(np.int64), num, den)
                turn += 1
                blobs.append((int(m["doc"][0] + turn) % parts, True, m.tobytes() + u["key"].tobytes() + fits.tobytes()))
            yield record(schema, *zip(*blobs, strict=True))

        for b in batches(rows, 500):
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = gram_set(t, n, hashes) if doc is not None else ()
                if not len(s):
                    continue
                seen = order[(s & np.uint64(len(order) - 1)).astype(np.int64)]
                s_pre = s[np.argsort(seen, kind="stable")[: len(s) - _least(len(s), num, den) + 1]]
                p = np.empty(len(s_pre), POST)
                p["token"], p["doc"], p["key"], p["n"], p["pos"] = s_pre, doc, set_key(s), len(s), np.arange(len(s_pre))
                held.append(p)
                many += len(p)
                if many >= HELD:
                    yield from deal()
                    held, many = [], 0
        if held:
            yield from deal()

    return texts(docs).mapInArrow(run, "bucket int, members boolean, blob binary")


def _led(num: int, den: int):
    """In each bucket: the n-grams of several sets, each posting with its leader."""
    schema = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("leader", pa.int64()), ("fits", pa.bool_())])

    def rows_of(p: np.ndarray, leader: np.ndarray, fits: np.ndarray) -> pa.RecordBatch:
        return record(schema, p["token"].view(np.int64), p["doc"], p["key"], p["n"], p["pos"], leader, fits)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flags = [], []
        for b in rows:
            for members, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                k = len(blob) // (POST.itemsize + (9 if members else 1))
                p, rest = np.frombuffer(blob[: k * POST.itemsize], POST), blob[k * POST.itemsize :]
                if members:
                    yield rows_of(p.copy(), np.frombuffer(rest[: 8 * k], np.int64), np.frombuffer(rest[8 * k :], bool))
                else:
                    held.append(p)
                    flags.append(np.frombuffer(rest, bool))
        if not held:
            return
        p, g = np.concatenate(held), np.concatenate(flags)
        by = np.lexsort((p["doc"], p["token"]))
        p, g = p[by], g[by]
        first = np.r_[True, p["token"][1:] != p["token"][:-1]]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
        other = p["key"] != p["key"][lead]
        keep = np.zeros(len(p), bool)
        keep[lead[other | g]] = True
        keep |= other | g
        p, lead = p[keep], p[lead[keep]]
        if len(p):
            fits = (p["key"] != lead["key"]) & _fits(p["n"].astype(np.int64), p["pos"].astype(np.int64), lead["n"].astype(np.int64), lead["pos"].astype(np.int64), num, den)
            yield rows_of(p, lead["key"].copy(), fits)

    return run


def _sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(key, grams): the whole sets of some keys, each from the smallest document that has it; other texts under its doc_id give none."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, schema = Hashes(), pa.schema([("key", pa.int64()), ("grams", pa.binary())])
        for b in batches(rows, 500):
            sets = [gram_set(t, n, hashes) for t in b.column(0).to_pylist()]
            own = [(k, s.tobytes()) for k, s in zip(b.column(1).to_pylist(), sets, strict=True) if set_key(s) == k]
            if own:
                yield record(schema, *zip(*own, strict=True))

    wanted = reps.join(nodes, "key", "left_semi").select(F.col("rep").alias("doc_id"), "key")
    return written(texts(docs).join(wanted, "doc_id").select("text", "key").mapInArrow(run, "key long, grams binary").dropDuplicates(["key"]))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of set keys that link, compared on whole sets: suffix filter first, then the intersection."""

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for b in batches(rows, 500):
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                need = _least(num * (len(p) + len(q)), 1, num + den)
                ok.append(suffix_bound(p, q) >= need and len(p) + len(q) - len(np.union1d(p, q)) >= need)
            ok = pa.array(ok, pa.bool_())
            yield record(schema, b.column(0).filter(ok), b.column(1).filter(ok))

    # a set that many are compared with is dealt out, as each pair takes a copy of it along
    left = evenly(pairs, sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a", share=100)
    both = evenly(left, sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b", share=100, counted=pairs).select("a", "b", "ga", "gb")
    return written(both.mapInArrow(compare, "a long, b long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()


def _mixed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings (token, key, n, pos, c) of the n-grams whose sets lie in several classes; c is the class."""
    now = rows.select("token", "key", "n", "pos").join(classes.select(F.col("node").alias("key"), F.col("component").alias("c")), "key", "left").withColumn("c", F.coalesce("c", "key"))
    several = now.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("token")
    return written(now.join(several, "token", "left_semi"))


def _across(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets in different classes that pass the filters at a shared n-gram; filters are part of the joins.

    Members of classes with few postings at an n-gram meet each other there. A class with many is met by its length
    range and first position, and by its members only from postings that could link, so its own pairs are never tried.
    """
    side = lambda d, s: d.select("token", *[F.col(x).alias(f"{x}{s}") for x in ("key", "n", "pos", "c")])
    c = lambda x: F.col(x).cast("long")
    fits = lambda s, t: _fits(c(f"n{s}"), c(f"pos{s}"), c(f"n{t}"), c(f"pos{t}"), num, den)
    size = rows.groupBy("token", "c").agg(F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("at"))
    sized = rows.join(size.select("token", "c", "size"), ["token", "c"])
    few, many = sized.where(F.col("size") <= FEW), sized.where(F.col("size") > FEW)
    met = [side(few, "x").join(side(few, "y"), "token").where((F.col("cx") < F.col("cy")) & fits("x", "y"))]
    big = size.where(F.col("size") > FEW).select("token", F.col("c").alias("cy"), "lo", "hi", "at")
    other = (F.col("cx") != F.col("cy")) & ((F.col("size") <= FEW) | (F.col("cx") < F.col("cy")))
    could = (c("hi") * den >= c("nx") * num) & (c("nx") * den >= c("lo") * num) & (F.least(c("nx") - c("posx"), c("hi") - c("at")) * (den + num) >= num * (c("nx") + c("lo")))
    reach = sized.select("token", "size", *[F.col(x).alias(f"{x}x") for x in ("key", "n", "pos", "c")]).join(big, "token").where(other & could).select("token", "keyx", "nx", "posx", "cx", "cy")
    met.append(reach.join(side(many, "y"), ["token", "cy"]).where(fits("x", "y")))
    return met[0].select("keyx", "keyy").unionByName(met[1].select("keyx", "keyy")).select(F.least("keyx", "keyy").alias("a"), F.greatest("keyx", "keyy").alias("b")).distinct()


def ngram_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents linked by den * |A ∩ B| >= num * |A ∪ B|.

    Words are runs of bytes that aren't ASCII white space, A-Z lower-cased; sets hold n-word shingles by 64-bit hash.
    component_id is the smallest doc_id reachable by links, the document included. Null and empty texts have no
    shingles and are their own class; texts with fewer words than n have one shingle, the whole sequence. Equal sets
    are linked by their key and never paired. A repeated doc_id gives a row each, of the class its text has. A row of a
    null doc_id links with none: its component_id is null. An empty table gives no rows. Other columns of docs are ignored.
    """
    return classes_of(docs, n, num, den, buckets).select("doc_id", "n_shingles", "component_id")


def classes_of(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, class): ngram_join() with crc32 of the text and the class itself.

    class tells classes apart that have the same smallest doc_id, as a repeated doc_id with other texts can make them;
    it is null where the row is its own class for want of shingles or of a doc_id.
    """
    keys, named, links = _joined(docs, n, num, den, buckets)
    discard(links)
    return _members(keys, named)


def classes_and_links(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """classes_of(), and (a, b): verified links between documents, each the smallest that has its set, that connect every class.

    A pair of sets within a class that other links connect already isn't tried, so these are not all its links. Equal
    sets have no pair; the table of classes says which they are. a <= b; the two are the same only where a doc_id is
    repeated with other texts.
    """
    keys, named, links = _joined(docs, n, num, den, buckets)
    reps = keys.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    of = lambda c: reps.select(F.col("key").alias(c), F.col("rep").alias(f"r{c}"))
    pairs = links.join(of("a"), "a").join(of("b"), "b")
    return _members(keys, named), pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def _members(keys: DataFrame, named: DataFrame) -> DataFrame:
    return evenly(keys, named, "key", "left").select("doc_id", "tag", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class")


def _joined(docs: DataFrame, n: int, num: int, den: int, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, tag, n, key), classes of keys (key, component_id, class), and the links (a, b) between keys."""
    spark, before = docs.sparkSession, tables()
    first = written(_keys(docs, n, buckets))
    keys = first.where("chunk is null").select("doc_id", "tag", "n", "key")
    shingles = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    parts = min(TASKS, max(partitions(spark), shingles // SHINGLES))
    order, size = np.zeros(buckets, np.uint32), min(CHUNK, buckets)
    for c, blob in summed_chunks(first.where("chunk is not null")).toLocalIterator():  # buckets * 4 bytes at most, however large the corpus
        order[c * size : (c + 1) * size] = _unpack(bytes(blob))
    counts = spark.sparkContext.broadcast(order)
    del order

    posted = written(_postings(docs, n, num, den, counts, parts).repartitionById(parts, F.col("bucket")).mapInArrow(_led(num, den), POSTINGS))
    counts.unpersist()
    reps = keys.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    # each member with its likeliest leader first; with others only where that leaves them in different classes
    shared = posted.where("fits and leader <> key").groupBy("leader", "key").agg(F.count("*").alias("n"))
    shared = written(shared.select(F.col("leader").alias("a"), F.col("key").alias("b"), "leader", "key", "n"))
    best = shared.groupBy("key").agg(F.max(F.struct("n", F.bitwise_not("leader").alias("not_leader"))).alias("m")).withColumn("leader", F.bitwise_not("m.not_leader"))
    best = best.select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b"))
    best = written(best.distinct())
    sets, tried = _sets(_ends(shared), reps, docs, n), best
    links = _verify(best, sets, num, den)
    classes = written(components(links))

    def checked(more: DataFrame) -> DataFrame:
        nonlocal sets
        lacking = _ends(more).join(sets.select("key"), "key", "left_anti")
        if not lacking.isEmpty():
            sets = sets.unionByName(_sets(lacking, reps, docs, n))
        return _verify(more, sets, num, den)

    c = lambda x: F.col(x).cast("long")
    rows = _mixed(posted.select("token", "key", "n", "pos").distinct(), classes)
    for _ in range(HUBS):  # every posting with its n-gram's most linked set, where that is in another class
        degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("d"))
        most = rows.join(degree, "key", "left").groupBy("token").agg(F.max(F.struct(F.coalesce("d", F.lit(0)), "key", "n", "pos", "c")).alias("h"))
        met = rows.join(most, "token").where(F.col("c") != F.col("h.c")).where(_fits(c("n"), c("pos"), c("h.n"), c("h.pos"), num, den))
        more = written(met.select(F.least("key", "h.key").alias("a"), F.greatest("key", "h.key").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        found = checked(more)
        tried, links = tried.unionByName(more), links.unionByName(found)
        classes = extended(classes, found)
        rows = _mixed(rows, classes)

    more = written(_across(rows, num, den).join(tried, ["a", "b"], "left_anti"))
    found = checked(more)
    links, final = written(links.unionByName(found)), extended(classes, found)
    named = reps.join(final.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("c"))
    low = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = written(named.join(low, "c").select("key", "component_id", F.col("c").alias("class")))
    discard_since(before, first, named, links)
    return keys, named, links
