"""Reports, projections and predictions as files: deterministic, checked before they are written, replaced at once."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a line of an append-only log may have, newline included, so that one write is one block.
LOG_LINE = 4096

# Policy texts of a score report.
POLICIES = {"normalization": "NFD (scoring) / LC-order (raw GT)", "denominator_policy": {"tier1": "consonants_only", "tier2": "consonants+nikkud", "tier3": "full"}, "qere_ketiv_policy": "score_against_qere"}


def atomic_json(data: object, path: str | Path, check=None, indent: int | None = 2, sort_keys: bool = False) -> None:
    """Write a small document beside its place and move it there; check(data) may raise first, and nothing is written."""
    if check:
        check(data)
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=".", suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(json.dumps(data, ensure_ascii=False, indent=indent, sort_keys=sort_keys) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def deterministic_json(data: object) -> str:
    return json.dumps(data, ensure_ascii=False, sort_keys=True, indent=2)


def append_lines(records: DataFrame, path: str) -> None:
    """Append records to a JSONL log; one longer than LOG_LINE fails the job and nothing is committed."""
    line = F.to_json(F.struct(*records.columns))
    sized = F.when(F.octet_length(line) + 1 < LOG_LINE, line).otherwise(F.raise_error(F.concat(F.lit("log record too long: "), F.octet_length(line).cast("string"))))
    records.select(sized.alias("value")).write.mode("append").text(path)


def score_report(row: dict, confusion: list[dict], prediction_id: str, gt_version: str, manifest_hash: str, scorer_version: str, caveats: list[str] | None = None) -> dict:
    """A score row and its confusion counts as the report document; the manifest's hash must be given."""
    if not manifest_hash:
        raise ValueError("manifest_hash must be a non-empty string")
    matrix: dict[str, dict[str, int]] = {}
    for c in confusion:
        matrix.setdefault(c["gt_mark"], {})[c["pred_mark"]] = c["n"]
    tier = lambda k, *more: {"cer": row[f"{k}_cer"], "edits": row[f"{k}_edits"], "denominator": row[f"{k}_denominator"], **{m: row.get(m) for m in more}}
    return {
        "prediction_id": prediction_id, "gt_version": gt_version, "manifest_hash": manifest_hash, "scorer_version": scorer_version, **POLICIES,
        "tiers": {
            "tier1": tier("tier1"), "tier2": tier("tier2", "dec", "cha", "wor", "voc", "nakdimon_disagreement_rate", "dicta_disagreement_rate"), "tier3": tier("tier3"),
            "tier4": {"f1": row["f1"], "precision": row["precision"], "recall": row["recall"], "tp_exact": row["tp_exact"], "tp_partial": row["tp_partial"], "fp": row["fp"], "fn": row["fn"]},
        },
        "composite": {"cer3": row["cer3"]}, "confusion_matrices": {"tier2_nikkud": matrix}, "caveats": caveats or [],
    }


def projection(verses: DataFrame) -> DataFrame:
    """One row a side: (side_label, verses) as the projection document nests them, in document order."""
    v = F.struct("seq", "verse_ref", "folio", "chunk", "consonant_count", "tier4_positional")
    return verses.groupBy("side_label").agg(F.array_sort(F.collect_list(v)).alias("v")).select("side_label", F.lit(1).alias("format_version"), F.transform("v", lambda x: x.dropFields("seq")).alias("verses"))


def folio_goldens(verses: DataFrame) -> DataFrame:
    """One row a folio: parallel arrays in document order, and their totals."""
    v = F.struct("seq", "chunk", "verse_ref", "consonant_count", "tier4_positional")
    g = verses.groupBy("folio").agg(F.array_sort(F.collect_list(v)).alias("v"), F.count("*").alias("line_count"), F.sum("consonant_count").alias("consonant_total"), F.sum(F.size("tier4_positional")).alias("tier4_positional_total"))
    pick = lambda c: F.transform("v", lambda x: x[c])
    return g.select(F.col("folio").alias("folio_id"), pick("chunk").alias("lines"), pick("verse_ref").alias("verse_refs"), pick("consonant_count").alias("consonant_counts"), F.transform("v", lambda x: F.struct(x["verse_ref"].alias("verse_ref"), x["tier4_positional"].alias("tier4_positional"))).alias("tier4_positional_by_verse"), "line_count", "consonant_total", "tier4_positional_total")


def prediction_json(predictions: DataFrame) -> DataFrame:
    """(folio_id, value): a prediction document a row; keys without a value are left out."""
    return predictions.select("folio_id", F.to_json(F.struct(*[c for c in predictions.columns]), {"ignoreNullFields": "true"}).alias("value"))


# The namespace and the frame of a page-layout document without page geometry.
PAGE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
HEAD = """<?xml version='1.0' encoding='UTF-8'?>\n<PcGts xmlns="{ns}"><Metadata><Creator>{creator}</Creator></Metadata><Page imageFilename="{image}" imageWidth="0" imageHeight="0"><TextRegion id="region_{folio}"><Coords points="0,0 0,0 0,0 0,0"/>"""
TAIL = "</TextRegion></Page></PcGts>"


def _escaped(c: Column, attribute: bool = False) -> Column:
    """Text as an XML serialiser writes it."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")] + ([('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")] if attribute else [])
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


@F.pandas_udf(T.StringType())
def _four_places(x: pd.Series) -> pd.Series:
    # the JVM rounds a double's shortest decimal, other serialisers its exact value
    return x.map(lambda v: None if pd.isna(v) else f"{round(float(v), 4):.4f}")


def page_xml(lines: DataFrame, creator: str, order: str = "at", image: str | None = None) -> DataFrame:
    """(folio_id, value): a page-layout document a folio from lines (folio_id, at, line_id, bbox, tier1, kraken_confidence).

    Byte for byte the same for the same lines: no times, a fixed order, the text as it is. A line's number is that of
    its id's suffix _L<number>, else its place. image: a column with the image's name; else it is <folio_id>.jpg. A
    folio without lines has no rows here and so no document.
    """
    number = F.coalesce(F.regexp_extract("line_id", r"_L([0-9]+)$", 1).try_cast("long"), F.col("_at"))
    x0, y0, x1, y1 = (F.col("bbox")[i].cast("string") for i in range(4))
    corner = lambda x, y: F.concat_ws(",", x, y)
    points = F.concat_ws(" ", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))
    conf = F.when(F.col("kraken_confidence").isNull(), "").otherwise(F.concat(F.lit(' conf="'), _four_places(F.col("kraken_confidence").cast("double")), F.lit('"')))
    place = F.row_number().over(Window.partitionBy("folio_id").orderBy(order)).cast("long")
    line = F.concat(F.lit('<TextLine id="line_'), number.cast("string"), F.lit('"><Coords points="'), points, F.lit('"/><TextEquiv'), conf, F.lit("><Unicode>"), _escaped(F.col("tier1")), F.lit("</Unicode></TextEquiv></TextLine>"))
    named = F.col(image) if image else F.concat("folio_id", F.lit(".jpg"))
    made = lines.withColumn("_at", place).select("folio_id", "_at", line.alias("line"), named.alias("image"))
    g = made.groupBy("folio_id").agg(F.array_sort(F.collect_list(F.struct("_at", "line"))).alias("l"), F.min("image").alias("image"))
    head = F.lit(HEAD.replace("{ns}", PAGE)).alias("head")
    for key, c in (("{creator}", _escaped(F.lit(creator))), ("{image}", _escaped(F.col("image"), True)), ("{folio}", _escaped(F.col("folio_id"), True))):
        head = F.replace(head, F.lit(key), c)
    return g.select("folio_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit(TAIL)).alias("value"))
