"""Report documents from metric tables; assembled on the driver, as they hold a value a metric."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions import views
from lectio.operators import metrics as m
from lectio.operators.alignment import cer
from lectio.plans import agreement


def _value(x: float | None, places: int | None) -> float | None:
    return None if x is None or math.isnan(x) else round(x, places) if places is not None else x


def panel_report(panel: DataFrame, n_verses: int, b: int, seed: int, pins: dict[str, str] | None = None, places: int | None = None) -> dict:
    """{frame: {stratum: {metric: {point, ci_lower, ci_upper, ci_method}}}} with its inputs' digests; NaN becomes null."""
    out: dict = {"n_verses": n_verses, "bootstrap_b": b, "bootstrap_seed": seed, "inputs": pins or {}, "frames": {}}
    for r in panel.collect():
        cell = {"point": _value(r.point, places), "ci_lower": _value(r.lo, places), "ci_upper": _value(r.hi, places), "ci_method": r.ci_method}
        out["frames"].setdefault(r.frame, {}).setdefault(r.stratum, {})[r.metric] = cell
    return out


def error_table(rates: DataFrame) -> DataFrame:
    """Edits, denominators and macro rates of every tier, per folio and, under a null folio, overall, by grouping sets."""
    cols = [F.sum(f"{c}_{t}").alias(f"{c}_{t}") for t in (1, 2, 3) for c in ("edits", "denominator")] + [F.avg(f"cer_{t}").alias(f"cer_{t}") for t in (1, 2, 3)]
    return rates.rollup("folio").agg(*cols, F.count("*").alias("n_verses"))


def error_totals(rates: DataFrame) -> list[dict]:
    return [r.asDict() for r in error_table(rates).orderBy(F.col("folio").asc_nulls_first()).collect()]


def rule_report(rule: DataFrame, b: int, seed: int) -> dict:
    """The rule baseline: counts, scores with intervals and tolerant score overall, and panels by folio and section."""
    spark = rule.sparkSession
    n = rule.count()
    shown = [m.f1("f1", "tp0", "fp0", "fn0"), m.f1("f1_tolerance_1", "tp1", "fp1", "fn1")]
    total = rule.agg(*[F.sum(c).alias(c) for c in ("tp0", "fp0", "fn0")]).first()
    drawn = m.plan(spark, n, b, seed) if b > 0 and n else None
    got = {r.metric: {"point": r.point, "ci_lower": r.lo, "ci_upper": r.hi} for r in m.intervals(rule, shown, drawn).collect()}
    tp, fp, fn = total.tp0, total.fp0, total.fn0
    panels = [r.asDict() for r in agreement.strata(rule, shown).orderBy("kind", "stratum").collect()]
    return {"n_verses": n, "tp": tp, "fp": fp, "fn": fn, "precision": tp / (tp + fp) if tp + fp else 1.0, "recall": tp / (tp + fn) if tp + fn else 1.0, **got, "strata": panels}


def sensitivity(stats: DataFrame, metrics: list[m.Metric], b: int, seed: int) -> DataFrame:
    """The same metrics with clusters of folios drawn first, bias-corrected; for comparison with the headline intervals."""
    labels = [r.folio for r in stats.select("i", "folio").orderBy("i").collect()]
    return m.intervals(stats, metrics, m.plan(stats.sparkSession, len(labels), b, seed, labels), clusters="folio")


def diacritizer_report(verses: DataFrame, diacritize, b: int, seed: int) -> dict:
    """Tier-2 error rates of a diacritizer on an edition's consonants, overall and by folio, with intervals.

    verses: (seq, verse_ref, folio, text) of an edition; diacritize: a string -> string Column function (U3's slot).
    """
    spark = verses.sparkSession
    d = m.numbered(verses, ["seq"]).withColumns({"consonants": views.loader_view(F.col("text"), 1), "gold": views.loader_view(F.col("text"), 2)})
    d = d.withColumn("predicted", diacritize(F.col("consonants")))
    for s, c in (("_g", "gold"), ("_p", "predicted")):
        d = d.withColumn(s, views.clusters(views.scorer_view(F.col(c), 2)))
    rates = cer(d, "_g", "_p", "_", native=False).select("i", "verse_ref", "folio", F.col("_cer").alias("cer"), F.lit(1).alias("one")).persist()
    macro = [m.mean("cer", "cer", "one")]

    def cell(part: DataFrame) -> dict:
        n = part.count()
        r = m.intervals(part, macro, m.plan(spark, n, b, seed) if b > 0 and n else None).first()
        return {"point": r.point, "ci_lower": r.lo, "ci_upper": r.hi, "ci_method": r.ci_method, "n_verses": n}

    names = sorted(r.folio for r in rates.select("folio").distinct().collect())
    of = lambda f: m.numbered(rates.where(F.col("folio") == f).withColumnRenamed("i", "at"), ["at"])
    return {"tier": 2, "bootstrap_b": b, "bootstrap_seed": seed, "overall_cer": cell(rates), "per_folio_cer": {f: cell(of(f)) for f in names}, "per_verse_cer": {r.verse_ref: r.cer for r in rates.collect()}}
