"""A corpus from raw documents to packed sequences: language ID, line dedup, near-duplicates, decontamination, packing.

All stages but the last return the columns of documents and take rows as they come: a repeated row is judged like the
row that it repeats, rows of a null doc_id are judged by their text alone where a stage needs no id and pass the others,
null langs, sources and n_chars play no part, and an empty table gives no rows. Columns beyond those of documents pass
too, whatever their names and types: a stage sees them as one column.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio.llm import language, line_dedup, ngram_join, packing, tiling
from lectio.llm.common import discard, settled, written

#: Documents whose language has a lower score are rejected, as are those without a letter.
LEAST_SCORE = 0.2


#: Columns that stages read; all others are one, OTHERS, while a stage runs.
COLUMNS, OTHERS = ("doc_id", "text", "lang", "source", "n_chars"), "_others"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _of_documents(docs: DataFrame) -> DataFrame:
    """docs as COLUMNS and, where it has more, OTHERS. Columns are taken by place, so that no two names can clash."""
    at = [docs.columns.index(c) for c in COLUMNS]
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    more = [f"c{i}" for i in range(len(docs.columns)) if i not in at]
    return d.select(*[F.col(f"c{i}").alias(c) for i, c in zip(at, COLUMNS, strict=True)], *([F.struct(*more).alias(OTHERS)] if more else []))


def _keeping_columns(stage: Stage) -> Stage:
    """stage on _of_documents(), whose result has docs' own columns again."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        out, at = stage(spark, _of_documents(docs), sf_dir), {docs.columns.index(c): c for c in COLUMNS}
        return out.select(*[at.get(i, f"{OTHERS}.c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)

    return run


def _kept(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text) is in marked (doc_id, tag), nulls included; texts meet only ids."""
    m = marked.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.crc32(F.col("text").cast("binary")).eqNullSafe(F.col("_tag"))
    return docs.join(m, same, "left_semi")


@_keeping_columns
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents without a letter, or of no language it is sure of, go.

    So do null and empty texts. A table without any language, from which nothing can be learnt, keeps no row. Of scores
    equal to LEAST_SCORE the document stays.
    """
    found = language.identify(docs, language.fit(docs))
    return _kept(docs, found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


@_keeping_columns
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated runs of lines go, and documents that consisted of them; n_chars becomes the new text's.

    The first place of a run, by doc_id and line, stays. Null and empty texts, which have no run, and rows of a null
    doc_id stay as they are.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = line_dedup.remove_repeated_runs(docs, carry=rest)
    out = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


@_keeping_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on five-word shingles at 0.8: one row of each class stays, of its smallest doc_id.

    Of rows that repeat that doc_id and text, the first by the other columns stays. Null and empty texts and rows of a
    null doc_id have no class and stay, each of them.
    """
    rows = ngram_join.classes_of(docs, n=5, num=80, den=100).groupBy("class", "doc_id", "tag").agg(F.count("*").alias("n"))
    own = F.struct("doc_id", "tag", "n")
    first = rows.where("class is not null").groupBy("class").agg(F.min(own).alias("m")).select("m.*", F.lit(True).alias("one"))
    marked = written(first.unionByName(rows.where("class is null").select("doc_id", "tag", "n", F.lit(False).alias("one"))))
    repeated = F.col("one") & (F.col("n") > 1)
    kept = _kept(docs, marked.where(~repeated))
    if marked.where(repeated).isEmpty():
        return kept
    # maps and variants have no order, but their JSON has
    order = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars", *([F.to_json(OTHERS)] if OTHERS in docs.columns else []))
    once = _kept(docs, marked.where(repeated)).withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")
    return kept.unionByName(once)


@_keeping_columns
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold half of a benchmark item or more go; without benchmark items none does.

    Null and empty texts stay; rows of a null doc_id are judged like any other.
    """
    found = tiling.tile_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _kept(docs, found.where("not contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of the sequences, with their tokens' checksum; null and empty texts are the end token alone."""
    return packing.pack(_of_documents(docs), derive={"ids_crc32": F.crc32}, keep_ids=False, added=True)


STAGES = [("language_id", languages), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]
#: SQL can't express the classifier, the rolling hashes or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other over documents, each written and read again; what a stage wrote besides is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        kept = settled(lambda f=stage, d=docs: f(spark, d, sf_dir))
        discard(docs)
        docs = kept
    return docs
