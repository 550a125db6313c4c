"""Shared pieces: the cluster's shared folder, word hashing, bounded bitmaps and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries a worker keeps in a word cache before it starts afresh, and rows in an Arrow batch of texts.
CACHE_ENTRIES, ARROW_ROWS = 300_000, 1000


#: Paths of tables that written() made and nothing deleted yet, in order.
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master may do without and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lectio-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/lectio/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    _MADE[path] = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        if _MADE.pop(p, None):
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that written() made, once nothing lazy reads them any more; other frames stay."""
    for df in frames:
        _delete(df.sparkSession, [p for p in [vars(df).get("table_path")] if p])


def tables() -> set[str]:
    """The tables that stand now, for discard_since()."""
    return set(_MADE)


def discard_since(before: set[str], *keep: DataFrame) -> None:
    """Delete what was written since, but the tables of keep, once nothing lazy reads the others."""
    kept = {d.table_path for d in keep}
    _delete(keep[0].sparkSession, [p for p in _MADE if p not in before and p not in kept])


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """written(make()), after which all tables that make() wrote on its way are deleted."""
    before = tables()
    out = written(make())
    discard_since(before, out)
    return out


def clear(spark: SparkSession) -> None:
    """Delete every table that this process has written and not deleted yet; no result may be read after it."""
    _delete(spark, list(_MADE))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Rows that Spark hands to Python at once: whole texts are long, and each batch is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as UTF-8 bytes, and the columns named. Other columns of docs, whatever their names, are left behind."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def batches(rows: Iterator[pa.RecordBatch], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made from a batch stays small."""
    for b in rows:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class Hashes(dict):
    """word -> 64-bit hash, for bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that sums of word hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: Which bytes are ASCII white space, and the low n bytes of eight.
_GAP = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_LOW = np.asarray([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes from which a word is hashed by itself.
_LONG = 256


def split_words(texts_: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words with one space after each, words in each text, bytes of each word, 64-bit hash of each word), as bytes.split() has them."""
    raw = b"\n".join(t or b"" for t in texts_) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    gap = _GAP[data]
    word = ~gap
    turn = np.flatnonzero(np.diff(np.r_[False, word]))
    start, size = turn[::2], turn[1::2] - turn[::2]
    ends = np.cumsum([len(t or b"") + 1 for t in texts_])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    word[turn[1::2]] = True  # and the gap's first byte
    plain = np.where(gap, np.uint8(32), data)[word].tobytes()
    eight = np.ndarray((len(data),), "<u8", raw + bytes(8), 0, (1,))
    h, live, done = np.zeros(len(start), np.uint64), np.flatnonzero(size < _LONG), 0
    while len(live):
        h[live] = mixed(h[live] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[live] + done] & _LOW[np.minimum(size[live] - done, 8)]) + np.uint64(1))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size >= _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]])
    return plain, counts, size, h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs that start at each word; fewer words than n give none."""
    if len(h) < n:
        return h[:0]
    m, out = len(h) - n + 1, np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    return mixed(out)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    Alternates large-star and small-star steps until neither changes an edge. Each step is a join and a minimum, so
    a hub of any degree is never gathered in one row or task. Tables are cut in the shared folder after each round.
    """
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    before = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = written(small.where("a <> b").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if tuple(now) == before:
            break
        before = tuple(now)
    stars = e.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def evenly(many: DataFrame, one: DataFrame, key: str, how: str = "inner", share: int = 1000, counted: DataFrame | None = None) -> DataFrame:
    """many.join(one, key), where no key's rows meet in one task: those of a key with more than a `share`-th of all rows,
    of which there are less than `share`, are dealt by a salt, and the key's row of `one` goes to each salt.

    key is unique in one. how: inner or left. Rows of a null key, which match nothing, aren't shuffled. counted: a table
    that has the keys as often as many does and is read faster.
    """
    spark, named = many.sparkSession, many.where(F.col(key).isNotNull())
    counted = (many if counted is None else counted).where(F.col(key).isNotNull())
    most, n = max(share, counted.count() // share), counted.groupBy(key).agg(F.count("*").alias("_n"))
    hot = [(r[0], -(-r[1] // most)) for r in n.where(F.col("_n") > most).collect()]  # fewer than share rows
    if hot:
        salts = F.broadcast(spark.createDataFrame(hot, f"{key} {many.schema[key].dataType.simpleString()}, _salts long"))
        dealt = named.join(salts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.coalesce("_salts", F.lit(1)))).drop("_salts")
        each = one.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        out = dealt.join(each, [key, "_salt"], how).drop("_salt")
    else:
        out = named.join(one, key, how)
    if how == "inner":
        return out
    none = many.where(F.col(key).isNull())
    return out.unionByName(none.select("*", *[F.lit(None).cast(one.schema[c].dataType).alias(c) for c in one.columns if c != key]))


def extended(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (node, component) after further links (a, b); only the classes that links touch are walked again."""
    if links.isEmpty():
        return classes
    of = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = written(components(edges))
    moved = classes.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = written(moved.unionByName(new.join(classes.select("node"), "node", "left_anti")))
    discard(new)
    return out


def per_document(docs: DataFrame, marks: DataFrame, make, schema: pa.Schema, ddl: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """make(doc_id, text, [payload, …]) -> tuple for every row of docs, with its payloads of marks (doc_id, tag, payload).

    tag is crc32 of the text, so that rows which repeat a doc_id with other texts keep their own marks. One shuffle
    brings texts and marks together; a partition is read as a stream, one document at a time. schema and ddl: of what
    make returns, after which the carried columns of docs follow.
    """
    small_batches(docs.sparkSession)
    kinds = [docs.schema[c] for c in carry]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("text").cast("binary")).alias("tag"), F.lit(False).alias("mark"), F.col("text").cast("binary").alias("payload"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    flags = marks.select("doc_id", "tag", F.lit(True).alias("mark"), "payload", *[F.lit(None).cast(k.dataType).alias(f"c{i}") for i, k in enumerate(kinds)])
    rows = text.unionByName(flags).repartition("doc_id", "tag").sortWithinPartitions("doc_id", "tag", F.col("mark").desc())

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        for b in batches_:
            out, taken = [], []
            for i, (doc_id, tag, mark, payload) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                if (doc_id, tag) != at:
                    at, found = (doc_id, tag), []
                if mark:
                    found.append(payload)
                else:
                    out.append(make(doc_id, payload, found))
                    taken.append(i)
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types]
            more = [b.column(4 + i).take(pa.array(taken, pa.int32())) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays(cols + more, names=[*schema.names, *carry])

    made = T.StructType(T.StructType.fromDDL(ddl).fields + kinds)
    return rows.mapInArrow(run, made)


def crc_mod(col: str, n: int):
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
