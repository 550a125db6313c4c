"""Positional marks: extraction from text, folding, exact, tolerant and partial-credit matching, units on the letter axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.functions import views
from lectio.functions.scalars import f1, precision, recall
from lectio.operators.alignment import matched, most_matched

#: Editor token that stands for a double rafe; the other upper-case tokens are passed over.
DOUBLE = "<DR>"


def mark_positions(chunk: Column, marks: dict[str, str], unit: str, skip: str = "<[A-Z]+>") -> Column:
    """array<struct<type, ordinal>> of marks after the n-th unit, sorted, in one pass over the text's tokens.

    marks: token -> type; unit: regular-expression class of what is counted. Marks before the first unit are ignored,
    several on one ordinal are kept.
    """
    spoken = sorted(marks, key=len, reverse=True)
    tokens = F.regexp_extract_all(chunk, F.lit("|".join([*(f"\\Q{m}\\E" for m in spoken), skip, f"[{unit}]"])), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in marks.items() for x in kv])
    walk = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<type:string,ordinal:int>>").alias("out")),
        lambda acc, t: F.struct(
            (acc["n"] + t.rlike(f"^[{unit}]$").cast("int")).alias("n"),
            F.when(names[t].isNotNull() & (acc["n"] > 0), F.array_append(acc["out"], F.struct(names[t].alias("type"), acc["n"].alias("ordinal")))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.array_sort(walk["out"])


def extract_positional(chunk: Column) -> Column:
    """Circelli, rafes and double rafes of a verse by the ordinal of the consonant they follow."""
    return mark_positions(chunk, {DOUBLE: "double_rafe", cp.CIRCELLUS: "circellus", cp.RAFE: "rafe"}, cp.CONSONANT)


def exploded(verses: DataFrame, arrays: str, *keys: str) -> DataFrame:
    """(keys…, type, ordinal), a row a mark."""
    return verses.select(*keys, F.explode(arrays).alias("m")).select(*keys, "m.type", "m.ordinal")


def detections(marks: DataFrame, *keys: str) -> DataFrame:
    """One folded detection (keys…, type, ordinal) an ordinal: circellus, rafe or both. Types outside these raise."""
    t = views.folded_type(F.col("type"))
    bad = F.max(F.when(~t.isin("circellus", "rafe", "both"), t))
    has = lambda x: F.max(t.isin(x, "both"))
    kind = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("can't fold mark type "), bad))).when(has("circellus") & has("rafe"), "both").when(has("circellus"), "circellus").otherwise("rafe")
    return marks.groupBy(*keys, "ordinal").agg(kind.alias("type")).select(*keys, "type", "ordinal")


def covering(found: DataFrame, kind: str) -> DataFrame:
    """Detections that cover a type, under its name."""
    return found.where(F.col("type").isin(kind, "both")).withColumn("type", F.lit(kind))


def match_counts(a: DataFrame, b: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """(keys…, tp, fp, fn): detections matched within (keys, type) buckets; fn: a has it and b doesn't.

    One shuffle gathers both sides' ordinals of a bucket; only keys with a detection have a row.
    """
    return match_table(a, b, keys, tolerance).groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _buckets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, type, x, y): both sides' distinct ordinals of every bucket."""
    both = a.select(*keys, "type", F.col("ordinal").alias("x"), F.lit(None).cast("int").alias("y")).unionByName(b.select(*keys, "type", F.lit(None).cast("int").alias("x"), F.col("ordinal").alias("y")))
    return both.groupBy(*keys, "type").agg(F.collect_set("x").alias("x"), F.collect_set("y").alias("y"))


def match_table(a: DataFrame, b: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """(keys…, type, pairs, tp, fp, fn) of every bucket; pairs: array<struct<a, b>>."""
    found = _buckets(a, b, keys).withColumn("pairs", matched(F.col("x"), F.col("y"), tolerance))
    n = F.size("pairs").cast("long")
    return found.select(*keys, "type", "pairs", n.alias("tp"), (F.size("y") - n).alias("fp"), (F.size("x") - n).alias("fn"))


def lost_pairs(a: DataFrame, b: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """(keys…, type, greedy, most, lost) of every bucket: pairs that the rule makes, that could be made, and how many it loses."""
    size = lambda way: F.size(way(F.col("x"), F.col("y"), tolerance)).cast("long")
    found = _buckets(a, b, keys).withColumns({"greedy": size(matched), "most": size(most_matched)})
    return found.select(*keys, "type", "greedy", "most", (F.col("most") - F.col("greedy")).alias("lost"))


def partial_credit(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, tp_exact, tp_partial, fp, fn, precision, recall, f1): exact marks count 1, same type and verse a third.

    gt and pred: (keys…, type, verse_ref, ordinal), as sets. A key of either side has a row.
    """
    on = [*keys, "type", "verse_ref", "ordinal"]
    rows = gt.select(*on, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*on, F.lit(0).alias("g"), F.lit(1).alias("p")))
    one = rows.groupBy(*on).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    by = one.groupBy(*keys, "type", "verse_ref").agg(F.sum(F.col("g") * F.col("p")).alias("e"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    q = F.least(F.col("g") - F.col("e"), F.col("p") - F.col("e"))
    t = by.withColumn("q", q).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in "eqgp"))
    return with_credit(t, keys)


def with_credit(t: DataFrame, keys: list[str]) -> DataFrame:
    e, q, g, p = (F.col(c) for c in "eqgp")
    tp = e + q * cp.PARTIAL
    pr = F.when(p == 0, F.when(g == 0, 1.0).otherwise(0.0)).otherwise(tp / p)
    rc = F.when(g == 0, F.when(p == 0, 1.0).otherwise(0.0)).otherwise(tp / g)
    return t.select(*keys, e.alias("tp_exact"), q.alias("tp_partial"), (p - e - q).alias("fp"), (g - e - q).alias("fn"), pr.alias("precision"), rc.alias("recall"), F.when(pr + rc == 0, 0.0).otherwise(2 * pr * rc / (pr + rc)).alias("f1"))


def scored(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn."""
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    return counts.withColumns({"precision": precision(*c), "recall": recall(*c), "f1": f1(*c)})


def coded_units(a: DataFrame, b: DataFrame, axis: DataFrame, keys: list[str], canonical: bool = True) -> DataFrame:
    """(keys…, a, b, n): nominal units on the axis 1..n_units of each key, counted by the pair of codes.

    The axis is never exploded: none/none is what the marked ordinals leave. Marks past the axis don't count. Codes
    are none, circellus, rafe, both and, unless canonical, double_rafe where it is alone.
    """
    t = views.folded_type(F.col("type"), raw=not canonical)
    side = lambda d, k: d.select(*keys, "ordinal", t.alias("type"), F.lit(k).alias("side"))
    has = lambda s, x: F.max((F.col("side") == s) & F.col("type").isin(x, "both"))

    def code(s: str) -> Column:
        c, r, any_ = F.coalesce(has(s, "circellus"), F.lit(False)), F.coalesce(has(s, "rafe"), F.lit(False)), F.coalesce(F.max(F.col("side") == s), F.lit(False))
        return F.when(c & r, "both").when(c, "circellus").when(r, "rafe").when(any_, "double_rafe").otherwise("none")

    marked = side(a, "a").unionByName(side(b, "b")).join(axis.select(*keys, "n_units"), keys).where("ordinal between 1 and n_units")
    pairs = marked.groupBy(*keys, "ordinal").agg(code("a").alias("a"), code("b").alias("b")).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    used = pairs.groupBy(*keys).agg(F.sum("n").alias("used"))
    rest = axis.join(used, keys, "left").select(*keys, F.lit("none").alias("a"), F.lit("none").alias("b"), (F.col("n_units") - F.coalesce("used", F.lit(0))).alias("n")).where("n > 0")
    return pairs.unionByName(rest)


def binary_units(units: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """(keys…, pp, pn, np, nn) of whether the two codes cover a type."""
    on = lambda c: F.col(c).isin(kind, "both", *(["double_rafe"] if kind == "rafe" else []))
    cell = lambda x, y: F.sum(F.when((on("a") == x) & (on("b") == y), F.col("n")).otherwise(0))
    return units.groupBy(*keys).agg(cell(True, True).alias("pp"), cell(True, False).alias("pn"), cell(False, True).alias("np"), cell(False, False).alias("nn"))


def offsets(table: DataFrame, kind: str = "circellus", span: int = 3) -> DataFrame:
    """One row: n_matched, median, iqr_lower, iqr_upper of b - a over matched pairs of a type, and a histogram with all buckets."""
    off = table.where(F.col("type") == kind).select(F.explode("pairs").alias("p")).select((F.col("p.b") - F.col("p.a")).alias("d"))
    label = F.when(F.col("d") < -span, f"<{-span:+d}").when(F.col("d") > span, f">{span:+d}").when(F.col("d") >= 0, F.concat(F.lit("+"), F.col("d").cast("string"))).otherwise(F.col("d").cast("string"))
    q = F.expr("percentile(d, array(0.25, 0.5, 0.75))")
    names = [*(f"{i:+d}" for i in range(-span, span + 1)), f"<{-span:+d}", f">{span:+d}"]
    cells = F.create_map(*[x for k in names for x in (F.lit(k), F.coalesce(F.sum((F.col("k") == k).cast("long")), F.lit(0)))])
    nan = F.lit(float("nan"))
    return off.withColumn("k", label).agg(F.count("*").alias("n_matched"), q.alias("q"), cells.alias("histogram")).select("n_matched", F.coalesce(F.col("q")[1], nan).alias("median"), F.coalesce(F.col("q")[0], nan).alias("iqr_lower"), F.coalesce(F.col("q")[2], nan).alias("iqr_upper"), "histogram")


def ordinals_by_type(events: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """Adds the running number of each mark among those of its type under keys."""
    return events.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys, "type").orderBy(*order)))
