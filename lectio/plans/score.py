"""Document scoring: pairs of texts and marks to nested error rates, accuracies, credit and a composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions import views
from lectio.functions.scalars import composite, rate
from lectio.operators import confusion, marks
from lectio.operators.alignment import aligned, alignment_cost, cer, small_batches


def prepared(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, gt_text, pred_text, …) with each side's tier views, each text normalised once, and cluster arrays."""
    d = pairs.withColumns({"_g": views.normalize(F.col("gt_text")), "_p": views.normalize(F.col("pred_text"))})
    for t, view in views.TIERS.items():
        d = d.withColumns({f"g{t}": view(F.col("_g")), f"p{t}": view(F.col("_p"))})
    return d.withColumns({f"{s}c{t}": views.clusters(F.col(f"{s}{t}")) for t in views.TIERS for s in "gp"}).drop("_g", "_p")


def score(pairs: DataFrame, version: str = "v0.1") -> DataFrame:
    """One wide row a doc_id from (doc_id, gt_text, pred_text, gt_marks, pred_marks), marks as array<struct<type, verse_ref, ordinal>>.

    Tiers 1 to 3: cer, edits, denominator; dec, cha, voc, wor of tier 2; cer3; f1, precision, recall, tp_exact,
    tp_partial, fp, fn of the marks; alignment of tier 2, for mark_confusion. Null texts give null rates; null mark
    arrays count as empty; a doc_id that two rows have raises, as marks couldn't be told apart. A row goes through three
    Python steps with its cluster arrays, so that the session's Arrow batches are set to be small.
    """
    if version != "v0.1":
        raise ValueError(f"unknown scorer version: {version}")
    small_batches(pairs.sparkSession)
    d = cer(cer(prepared(pairs), "gc1", "pc1", "tier1_"), "gc3", "pc3", "tier3_")
    # tier 2 is aligned once: its edits, accuracies and confusion all read the one alignment
    d = d.withColumn("alignment", aligned("gc2", "pc2"))
    d = d.withColumns({"tier2_edits": alignment_cost(F.col("alignment")), "tier2_denominator": F.length(F.array_join("gc2", "")).cast("long")})
    d = d.withColumn("tier2_cer", rate(F.col("tier2_edits"), F.col("tier2_denominator")))
    d = confusion.factoring(d, "alignment", "g2", "p2").withColumn("cer3", composite(*[F.col(f"tier{t}_cer") for t in views.TIERS]))
    flat = lambda c: pairs.select("doc_id", F.explode(c).alias("m")).select("doc_id", "m.type", "m.verse_ref", "m.ordinal")
    credit = marks.partial_credit(flat("gt_marks"), flat("pred_marks"), ["doc_id"])
    credit = pairs.groupBy("doc_id").agg(F.count("*").alias("_rows")).join(credit, "doc_id", "left")
    once = F.when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit("rows with the same doc_id: "), F.col("doc_id").cast("string"))).cast("boolean")).otherwise(True)
    rates = [f"tier{t}_{c}" for t in views.TIERS for c in ("cer", "edits", "denominator")]
    whole = {"tp_exact": 0, "tp_partial": 0, "fp": 0, "fn": 0, "precision": 1.0, "recall": 1.0, "f1": 1.0}
    return d.join(credit, "doc_id", "left").where(once).select("doc_id", *rates, "dec", "cha", "voc", "wor", "cer3", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in whole.items()], "alignment")


def mark_confusion(scores: DataFrame) -> DataFrame:
    return confusion.mark_confusion(scores, "alignment", ["doc_id"])


def disagreement(lines: DataFrame) -> DataFrame:
    """Adds rate = 1 - dec of (prediction, oracle) lines; null where the oracle failed (null text)."""
    d = lines.withColumns({"_a": views.tier2(views.normalize(F.col("prediction"))), "_b": views.tier2(views.normalize(F.col("oracle")))})
    d = d.withColumn("_x", aligned(views.clusters(F.col("_a")), views.clusters(F.col("_b"))))
    return confusion.factoring(d, "_x", "_a", "_b").withColumn("rate", F.when(F.col("oracle").isNotNull(), 1 - F.col("dec"))).drop("_a", "_b", "_x", "dec", "cha", "voc", "wor")


def disagreement_rates(rated: DataFrame, keys: list[str], empty: float | None = None) -> DataFrame:
    """(keys…, rate, n, failures): mean over lines that the oracle answered; all failed gives null, no lines `empty`."""
    n, bad = F.count("*"), F.count_if(F.col("rate").isNull())
    return rated.groupBy(*keys).agg(F.when(n == 0, F.lit(empty)).otherwise(F.avg("rate")).alias("rate"), n.alias("n"), bad.alias("failures"))


def combined_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """(line_id, text, winner, tie_break): the first source always wins; a tie break is counted where consonants differ."""
    j = a.select("line_id", F.col("text").alias("ta")).join(b.select("line_id", F.col("text").alias("tb")), "line_id", "left")
    same = views.consonants_of(F.col("ta")) == views.consonants_of(F.coalesce("tb", F.lit("")))
    return j.select("line_id", F.col("ta").alias("text"), F.lit("claude").alias("winner"), F.when(same, 0).otherwise(1).alias("tie_break"))


def combined_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, n_lines, first_wins, second_wins, tie_breaks) of combined lines; a line counts for the source that won it."""
    first = F.col("winner") == "claude"
    return lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if(first).alias("first_wins"), F.count_if(~first).alias("second_wins"), F.sum("tie_break").cast("long").alias("tie_breaks"))
