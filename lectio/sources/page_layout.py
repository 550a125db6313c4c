"""Page-layout XML lines and their custom attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "_id string, _custom string, TextEquiv array<struct<_conf:double,Unicode:string>>"


def parsed_custom(attribute: Column) -> Column:
    """struct<verse_ref, parashah, large_letters, small_letters, stichographic_column, errors> of "key:value; …".

    The last of a repeated scalar wins, letter indices keep their order. errors lists tokens that no rule admits.
    """
    toks = F.filter(F.transform(F.split(F.coalesce(attribute, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    value = lambda t, key: F.trim(F.substr(t, F.lit(len(key) + 1)))
    last = lambda key: F.try_element_at(F.transform(F.filter(toks, lambda t: t.startswith(key)), lambda t: value(t, key)), F.lit(-1))
    sizes = F.flatten(F.transform(F.filter(toks, lambda t: t.startswith("letter_size:")), lambda t: F.transform(F.split(value(t, "letter_size:"), ","), lambda e: F.trim(e))))
    of = lambda size: F.transform(F.filter(sizes, lambda e: e.rlike(rf"^{size}@\d+$")), lambda e: F.split(e, "@")[1].cast("int"))
    ok = lambda t: (
        t.startswith("verse_ref:")
        | t.rlike(r"^parashah:\s*(petuhah|setumah)$")
        | t.rlike(r"^letter_size:\s*(large|small)@\d+\s*(,\s*(large|small)@\d+\s*)*$")
        | t.rlike(r"^layout:stichographic_column@\s*[12]$")
    )
    return F.struct(
        F.coalesce(last("verse_ref:"), F.lit("")).alias("verse_ref"), last("parashah:").alias("parashah"), of("large").alias("large_letters"), of("small").alias("small_letters"),
        last("layout:stichographic_column@").try_cast("int").alias("stichographic_column"), F.filter(toks, lambda t: ~ok(t)).alias("errors"),
    )


def strict_custom(attribute: Column, line: Column) -> Column:
    """The same, raising at the first token that no rule admits."""
    c = parsed_custom(attribute)
    said = F.concat(F.lit("malformed custom token "), F.get(c["errors"], F.lit(0)), F.lit(" in line "), line)
    return F.when(F.size(c["errors"]) > 0, F.raise_error(said)).otherwise(c)


def lines(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """(path, line_num, line_id, verse_ref, text, conf, parashah, large_letters, small_letters, stichographic_column) sorted within a page.

    Line ids that aren't numbers give 0; lines without a TextEquiv go, those without text are empty. Unless strict,
    errors lists malformed tokens instead of raising.
    """
    d = spark.read.format("xml").schema(SCHEMA).option("rowTag", "TextLine").option("ignoreSurroundingSpaces", False).load(path)
    d = d.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "*").where("TextEquiv is not null and size(TextEquiv) > 0")
    num = F.coalesce(F.try_element_at(F.split("_id", "_"), F.lit(-1)).try_cast("int"), F.lit(0))
    c = strict_custom(F.col("_custom"), F.col("_id")) if strict else parsed_custom(F.col("_custom"))
    first = F.col("TextEquiv")[0]
    out = d.select("path", num.alias("line_num"), F.col("_id").alias("line_id"), F.coalesce(first["Unicode"], F.lit("")).alias("text"), first["_conf"].alias("conf"), c.alias("c"), "at")
    return out.select("path", "line_num", "line_id", "c.verse_ref", "text", "conf", "c.parashah", "c.large_letters", "c.small_letters", "c.stichographic_column", *([] if strict else ["c.errors"]), "at").orderBy("path", "line_num", "at").drop("at")
