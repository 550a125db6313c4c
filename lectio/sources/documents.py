"""JSON, JSONL, YAML, text and file-set sources, each with an explicit schema."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.functions import views
from lectio.operators.marks import extract_positional

MARKS = "array<struct<type:string,verse_ref:string,ordinal:int,codepoints:string>>"
SCORER_INPUT = f"text string, metamarks {MARKS}, folio_id string, gt_version string"
POSITIONAL = "array<struct<type:string,ordinal:int>>"
PROJECTION = f"format_version int, side_label string, license string, source string, verses array<struct<verse_ref:string,folio:string,chunk:string,consonant_count:int,tier4_positional:{POSITIONAL}>>"
GOLDEN = f"folio_id string, side_label string, lines array<string>, verse_refs array<string>, consonant_counts array<int>, tier4_positional_by_verse array<struct<verse_ref:string,tier4_positional:{POSITIONAL}>>"
MANIFEST = "version string, frozen_at string, scorer_version string, folios array<struct<id:string,folio_id:string,manuscript:string,book:string,folio:string,image_url:string,iaa_folio:boolean,in_frozen_scope:boolean,gt_hash:string,gt_source:string>>, iaa_subset array<string>, expected_reports_per_baseline map<string,int>, expected_total_reports string, manifest_changelog array<struct<prev_frozen_at:string,new_frozen_at:string,reason:string>>"
REPLAY = "prompt_hash string, request string, response string, response_id string, model_version_returned string, token_counts struct<input:int,output:int>, actual_spend_usd double, finish_reason string, timestamp string"
LINES = "array<struct<line_id:string,bbox:array<int>,tier1:string,tier2:string,tier3:string,tier4_records:array<struct<type:string,verse_ref:string,ordinal:int>>,kraken_confidence:double,llm_winner:string,llm_tie_breaks:int>>"
PREDICTION = f"schema_version string, baseline_id string, folio_id string, manifest_hash string, run_meta_ref string, lines {LINES}"


def whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def json_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row a document, with its path and text; fields of another shape are null, for rule tables to find."""
    return whole(spark, path).withColumn("doc", F.from_json("value", schema)).select("path", "value", "doc.*")


def scorer_inputs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_documents(spark, path, SCORER_INPUT)


def projections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, side_label, seq, verse_ref, folio, chunk, consonant_count, tier4_positional, derived…, drift) of positional projections.

    drift marks verses whose stored counts or marks aren't what their text yields.
    """
    d = json_documents(spark, path, PROJECTION).select("path", "side_label", F.posexplode("verses").alias("seq", "v")).select("path", "side_label", "seq", "v.*")
    return with_drift(d)


def with_drift(verses: DataFrame) -> DataFrame:
    marks = F.array_sort("tier4_positional")
    d = verses.withColumns({"derived_count": views.consonant_count(F.col("chunk")), "derived_marks": extract_positional(F.col("chunk"))})
    return d.withColumn("drift", ~(F.col("consonant_count").eqNullSafe(F.col("derived_count")) & marks.eqNullSafe(F.col("derived_marks"))))


def goldens(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(folio, line, verse_ref, chunk, consonant_count, tier4_positional) of per-folio goldens, in document order."""
    d = json_documents(spark, path, GOLDEN)
    rows = d.select("folio_id", "side_label", F.posexplode(F.arrays_zip("lines", "verse_refs", "consonant_counts", "tier4_positional_by_verse")).alias("line", "z"))
    return rows.select(F.col("folio_id").alias("folio"), "line", F.col("z.verse_refs").alias("verse_ref"), F.col("z.lines").alias("chunk"), F.col("z.consonant_counts").alias("consonant_count"), F.col("z.tier4_positional_by_verse.tier4_positional").alias("tier4_positional"))


def raw_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, seq, chunk): an annotator's text cut at verse ends, editor page tags and newlines as spaces, empty ones dropped."""
    return chunked(whole(spark, path), "value")


# Editor tags that pass through a text.
PASS_TAGS = ("<MF>", "<EF>", "<L>", "<C>", "<BL>", "<WS>", "<P>")


def chunked(texts: DataFrame, column: str) -> DataFrame:
    s = F.col(column)
    s = F.regexp_replace(s, "|".join(PASS_TAGS), " ")
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    parts = F.filter(F.transform(F.split(s, cp.SOF_PASUQ), views.stripped), lambda c: c != "")
    keep = [c for c in texts.columns if c != column]
    return texts.select(*keep, F.posexplode(parts).alias("seq", "chunk"))


def verse_folios(spark: SparkSession, path: str) -> DataFrame:
    """(seq, verse_ref, folio) of either shape: {"folios": {folio: [ref, …]}} or [[ref, folio], …]."""
    d = whole(spark, path)
    by_folio = F.flatten(F.transform(F.map_entries(F.from_json("value", "folios map<string,array<string>>")["folios"]), lambda e: F.transform(e["value"], lambda r: F.struct(r.alias("verse_ref"), e["key"].alias("folio")))))
    listed = F.transform(F.from_json("value", "array<array<string>>"), lambda p: F.struct(p[0].alias("verse_ref"), p[1].alias("folio")))
    shaped = F.when(F.ltrim("value").startswith("["), listed).otherwise(by_folio)
    return d.select(F.posexplode(shaped).alias("seq", "v")).select("seq", "v.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest; older versions get the newer fields' defaults. raw_hash is of the document before that."""
    from lectio.functions.scalars import canonical_hash

    d = json_documents(spark, path, MANIFEST).withColumn("raw_hash", canonical_hash(F.col("value")))
    folios = F.transform("folios", lambda f: f.withField("id", F.coalesce(f["id"], f["folio_id"])).withField("iaa_folio", F.coalesce(f["iaa_folio"], F.lit(False))).withField("in_frozen_scope", F.coalesce(f["in_frozen_scope"], F.lit(True))))
    total = F.coalesce(F.expr("try_cast(expected_total_reports as int)"), F.aggregate(F.map_values(F.from_json("expected_total_reports", "map<string,int>")), F.lit(0), lambda a, x: a + x))
    return d.withColumns({"folios": F.coalesce(folios, F.array().cast(d.schema["folios"].dataType)), "iaa_subset": F.coalesce("iaa_subset", F.array().cast("array<string>")), "total_reports": total})


def folios(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.posexplode("folios").alias("seq", "f"), "iaa_subset").select("seq", "f.*", F.array_contains("iaa_subset", F.col("f.id")).alias("in_subset"))


def json_lines(spark: SparkSession, path: str, schema: str = REPLAY) -> DataFrame:
    """Records of a JSONL log; none for a path that isn't there."""
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not probe.getFileSystem(spark._jsc.hadoopConfiguration()).exists(probe):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def yaml_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A YAML list of mappings as rows; small configuration, parsed on the driver."""
    import yaml

    data = yaml.safe_load("\n".join(r.value for r in whole(spark, path).collect()))
    rows = data if isinstance(data, list) else next((v for v in data.values() if isinstance(v, list)), [data])
    text = spark.createDataFrame([(json.dumps(r, ensure_ascii=False, default=str),) for r in rows], "value string")
    return text.select("value", F.from_json("value", schema).alias("doc")).select("value", "doc.*") if schema else text


def pinned_sha(spark: SparkSession, path: str, prefix: str = "| 2026-", column: int = 3) -> DataFrame:
    """(line, sha256) of the first row of a markdown table that starts with prefix; the digest must be 64 hex digits."""
    rows = whole(spark, path).select(F.posexplode(F.split("value", "\n")).alias("line", "row")).where(F.col("row").startswith(prefix))
    first = rows.agg(F.min("line").alias("line"), F.min_by("row", "line").alias("row"))
    cell = F.regexp_replace(F.trim(F.get(F.split("row", r"\|"), F.lit(column))), "`", "")
    return first.select("line", F.when(cell.rlike("^[0-9a-f]{64}$"), cell).alias("sha256"))


def files(spark: SparkSession, path: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """(path, length, content, sha256) of a tree's files."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    cols = ["path", "length", *(["content", F.sha2("content", 256).alias("sha256")] if content else [])]
    return d.select(*cols)


def prediction_lines(document: Column) -> Column:
    """Tier-2 lines of a prediction in any of its shapes (JSON text): {text}, {lines: [{tier2}]}, {tier2} or a list; empty ones dropped."""
    lines = F.transform(F.from_json(document, "lines array<struct<tier2:string>>")["lines"], lambda x: x["tier2"])
    items = F.transform(F.from_json(document, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.tier2"), F.get_json_object(x, "$.text"), F.when(~x.startswith("{"), x)))
    one = lambda f: F.when(F.get_json_object(document, f"$.{f}").isNotNull(), F.array(F.get_json_object(document, f"$.{f}")))
    found = F.when(F.ltrim(document).startswith("["), items).otherwise(F.coalesce(lines, one("text"), one("tier2"), F.array().cast("array<string>")))
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


def first_existing(root: str, *names: str) -> str | None:
    """The first of several files that is there: page XML before JSON, say."""
    return next((str(p) for n in names if (p := Path(root, n)).exists()), None)


def in_order(rows: DataFrame, by: str, order: list[str], text: str, separator: str = " ") -> DataFrame:
    """(by, text): each group's texts joined in order."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), separator).alias(text))


def reading_order(lines: DataFrame, group: str = "folio_id") -> DataFrame:
    """Adds place: top to bottom and right to left by bbox, or by line_id where every bbox of the group is zero; stable.

    lines: (group, line_id, bbox [x0, y0, x1, y1], at) with at the place in the input.
    """
    w = Window.partitionBy(group)
    placed = F.max(F.exists("bbox", lambda x: x != 0)).over(w)
    key = lambda c, other: F.when(F.col("_placed"), c).otherwise(other)
    d = lines.withColumn("_placed", F.coalesce(placed, F.lit(False)))
    order = [key(F.col("bbox")[1], F.lit(0)), key(-F.col("bbox")[2], F.lit(0)), key(F.lit(""), F.col("line_id")), F.col("at")]
    return d.withColumn("place", F.row_number().over(w.orderBy(*order))).drop("_placed")
