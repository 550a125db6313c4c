"""Operator 10: exact length histogram of encoded documents, with suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectio.llm import bpe
from lectio.llm.common import batches, record, texts, written

#: Neighbouring lengths that one task sums; the sums of the blocks are few.
BLOCK = 4096


def token_lengths(docs: DataFrame, path: str | None = None, added: bool = False) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null and empty texts have 0 tokens. added: as in packing.pack().

    A row each for repeated and null doc_ids; an empty table gives no rows. Other columns of docs are ignored.
    """
    path = path or bpe.default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(path, added)
        for b in batches(rows, 200):
            yield record(schema, b.column(0), [len(x) // 4 for x in tok.ids([(t or b"").decode("utf-8", "replace") for t in b.column(1).to_pylist()])])

    return texts(docs).mapInArrow(counted, "doc_id long, n_tokens long")


def length_table(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs, from (…, n_tokens); exact for every context limit.

    n_docs and tokens at this length; docs_ge and tokens_ge at this length or more; docs_le; share_le = docs_le over
    all documents, so the q-quantile is the least n_tokens with share_le >= q; truncated_total = sum of
    min(length, n_tokens) over all documents. For a limit L between two rows, truncated_total(L) = tokens below L +
    L * docs_ge(next row). Suffix sums run in blocks of lengths and then over the blocks, so no task sees more than
    BLOCK lengths or one row a block. An empty table gives no rows; null lengths are left out. Documents are counted,
    and encoded, once: the histogram, with a row a length, is written and read again.
    """
    hist = written(lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("tokens", F.expr("n_tokens * n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}")))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    down = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = hist.join(blocks, "block").withColumn("docs_ge", F.col("ad") + F.sum("n_docs").over(down)).withColumn("tokens_ge", F.col("at") + F.sum("tokens").over(down))
    return t.select(
        "n_tokens", "n_docs", "tokens", "docs_ge", "tokens_ge", (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("share_le"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The least length that at least q of the documents don't exceed."""
    return table.where(F.col("share_le") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """Tokens kept when every document is cut at `limit`."""
    return table.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")).alias("total"))
