"""Hashed text features for the classifiers, and bounded samples to fit them on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import written

#: Rows that a sample may have in all, however many classes there are; a vector of each goes to the driver.
MOST = 12_000


def byte_grams(text: bytes, size: int) -> np.ndarray:
    """L2-normalised square roots of counts of byte 1-, 2- and 3-grams, hashed to size (a power of two)."""
    a = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    shift, found = np.uint32(32 - (size.bit_length() - 1)), []
    h = np.zeros(len(a), np.uint32)
    for n in range(3):
        if len(a) <= n:
            break
        h = (h[: len(a) - n] * np.uint32(0x01000193) ^ a[n:] + np.uint32(n << 8)) * np.uint32(0x9E3779B1)
        found.append((h >> shift).astype(np.int64))
    x = np.sqrt(np.bincount(np.concatenate(found), minlength=size).astype(np.float32)) if found else np.zeros(size, np.float32)
    norm = float(np.sqrt(x @ x))
    return x / norm if norm else x


def word_counts(hashes: np.ndarray, size: int) -> np.ndarray:
    """L2-normalised log counts of hashed words."""
    x = np.log1p(np.bincount((hashes >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64), minlength=size)).astype(np.float32)
    norm = float(np.sqrt(x @ x))
    return x / norm if norm else x


def sample(rows: DataFrame, by: Column, each: int, most: int = MOST) -> DataFrame:
    """About `each` rows of every class, chosen by a hash of doc_id, and never more than `most` in all.

    Where classes are many, all get the same smaller share of `most`, one row at least; no class is left out while there
    are at most `most` of them. Classes are counted in a table; a row finds its class's rate there.
    """
    keyed = rows.withColumn("_class", by.cast("string")).where("_class is not null")
    counts = written(keyed.groupBy("_class").agg(F.count("*").alias("_n")))
    classes = counts.count()
    if not classes:
        return keyed.limit(0)
    share = max(1, min(each, most // classes))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000_000))
    # the first of a class by hash comes in any case, so that rates, which only expect so many, leave none out
    first = keyed.groupBy("_class").agg(F.min(chosen).alias("_first"))
    rates = written(counts.join(first, "_class").select("_class", "_first", (F.lit(share) / F.col("_n") * 1_000_000_000).alias("_below")))
    taken = keyed.withColumn("_at", chosen).join(rates, "_class").where("_at < _below or _at = _first")
    return taken.orderBy(F.col("_at") != F.col("_first"), "_at", "doc_id").limit(min(most, share * classes)).drop("_at", "_first", "_below")


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, each: int, most: int = MOST, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label) of the sampled labels: only their ids, which are bounded, go to the texts; texts aren't shuffled.

    Of rows that repeat a doc_id the smallest text counts, and the smallest label; null texts and labels are left out,
    and texts of more than most_bytes bytes.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    ids = sample(ids, F.col(label), each, most).select("doc_id", label)
    met = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    if most_bytes is not None:
        met = met.where(F.octet_length("text") <= most_bytes)
    return met.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min(label).alias(label))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
