"""Annotator agreement: any two sides of a verse list to rates, detection scores, chance-corrected coefficients and intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.functions import views
from lectio.operators import alignment, marks
from lectio.operators import metrics as m

CANON, RAW = ["none", "circellus", "rafe", "both"], ["none", "circellus", "rafe", "both", "double_rafe"]
KINDS = {"circellus": "c", "rafe": "r"}


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(seq, verse_ref, folio, a_chunk, b_chunk) of sides that list the same verses in the same places; raises if they don't."""
    on = ["seq", "verse_ref", "folio"]
    j = a.select(*on, F.col("chunk").alias("a_chunk")).join(b.select(*on, F.col("chunk").alias("b_chunk")), on, "full_outer")
    lone = F.col("a_chunk").isNull() | F.col("b_chunk").isNull()
    return j.withColumn("a_chunk", F.when(lone, F.raise_error(F.concat(F.lit("verse of one side only: "), "verse_ref"))).otherwise(F.col("a_chunk")))


def joined(verses: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Adds a gold or backbone text by verse_ref; a verse without one raises."""
    j = verses.join(other.select("verse_ref", F.col("chunk").alias(name)), "verse_ref", "left")
    return j.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit(f"no {name} for "), "verse_ref"))).otherwise(F.col(name)))


def _marks(verses: DataFrame, side: str) -> DataFrame:
    return marks.exploded(verses.withColumn("_m", marks.extract_positional(F.col(f"{side}_chunk"))), "_m", "i", "verse_ref")


def framed(verses: DataFrame, backbone: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks of both sides and the axis (i, n_units): side a's consonants, or a backbone text's onto which both are aligned."""
    a, b = _marks(verses, "a"), _marks(verses, "b")
    if backbone is None:
        return a, b, verses.select("i", views.consonant_count(F.col("a_chunk")).alias("n_units"))
    on = lambda s: verses.select("verse_ref", views.consonants_of(views.strip_editor_tokens(F.col(f"{s}_chunk"))).alias("side"), views.consonants_of(views.strip_editor_tokens(F.col(backbone))).alias("backbone"))
    move = lambda d, s: alignment.reproject(d, on(s)).where("kept").select("i", "verse_ref", "type", F.col("new_ordinal").alias("ordinal"))
    return move(a, "a"), move(b, "b"), verses.select("i", views.consonant_count(F.col(backbone)).alias("n_units"))


def verse_stats(verses: DataFrame, a: DataFrame, b: DataFrame, axis: DataFrame) -> DataFrame:
    """One row a verse (i, folio, section, counts…): everything that the tier-4 metrics sum."""
    da, db = marks.detections(a, "i"), marks.detections(b, "i")
    tables = []
    for tol in (0, 1):
        tables.append(marks.match_counts(da, db, ["i"], tol).select("i", *[F.col(c).alias(f"{c}{tol}") for c in ("tp", "fp", "fn")]))
        for kind, k in KINDS.items():
            tables.append(marks.match_counts(marks.covering(da, kind), marks.covering(db, kind), ["i"], tol).select("i", *[F.col(c).alias(f"{k}_{c}{tol}") for c in ("tp", "fp", "fn")]))
    canon, raw = marks.coded_units(a, b, axis, ["i"]), marks.coded_units(a, b, axis, ["i"], canonical=False)
    tables += [m.alpha_stats(canon, ["i"], CANON, "uc_"), m.alpha_stats(raw, ["i"], RAW, "ur_")]
    tables += [marks.binary_units(canon, kind, ["i"]).select("i", *[F.col(c).alias(f"{k}_{c}") for c in m.CELLS]) for kind, k in KINDS.items()]
    base = verses.select("i", "folio", section(F.col("verse_ref")).alias("section"))
    return reduce(lambda x, y: x.join(y, "i", "left"), tables, base).na.fill(0)


def section(ref: Column) -> Column:
    """haazinu: Deuteronomy 32:1-43; prose: the rest."""
    r = views.parsed_ref(ref)
    return F.when((r["book"] == "Deut") & (r["chapter"] == 32) & r["verse"].between(1, 43), "haazinu").otherwise("prose")


def tier4_metrics() -> list[m.Metric]:
    out = [m.f1("f1_exact", "tp0", "fp0", "fn0"), m.f1("f1_tolerance_1", "tp1", "fp1", "fn1")]
    out += [m.alpha("alpha_full_canon", CANON, "uc_"), m.alpha("alpha_positive_canon", CANON, "uc_", True), m.alpha("alpha_full_raw", RAW, "ur_"), m.alpha("alpha_positive_raw", RAW, "ur_", True)]
    for kind, k in KINDS.items():
        out += [m.f1(f"f1_{kind}_exact", f"{k}_tp0", f"{k}_fp0", f"{k}_fn0"), m.f1(f"f1_{kind}_tolerance_1", f"{k}_tp1", f"{k}_fp1", f"{k}_fn1")]
        out += [m.kappa(f"kappa_{kind}", f"{k}_"), m.pabak(f"pabak_{kind}", f"{k}_"), m.ac1(f"ac1_{kind}", f"{k}_")]
    return out


STRATUM = ("f1_exact", "f1_tolerance_1", "f1_circellus_exact", "f1_circellus_tolerance_1", "f1_rafe_exact", "f1_rafe_tolerance_1", "alpha_full_canon", "alpha_positive_canon")


def strata(stats: DataFrame, metrics: list[m.Metric] | None = None) -> DataFrame:
    """(kind, stratum, n_verses, values…) by folio and by section, in one aggregation; empty strata have no row."""
    metrics = metrics or [x for x in tier4_metrics() if x.name in STRATUM]
    s = stats.withColumn("one", F.lit(1)).withColumn("_s", F.explode(F.array(F.struct(F.lit("folio").alias("kind"), F.col("folio").alias("stratum")), F.struct(F.lit("section").alias("kind"), F.col("section").alias("stratum"))))).select("*", "_s.*")
    n = m.Metric("n_verses", ("one",), lambda x: x)
    return m.evaluate(s, [n, *metrics], ["kind", "stratum"])


def error_rates(verses: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """(i, folio, cer_1 … cer_3, edits_1 …, denominator_1 …, one): per-verse rates of hypothesis against reference."""
    d = verses.withColumns({"_r": views.normalize(views.strip_editor_tokens(F.col(reference))), "_h": views.normalize(views.strip_editor_tokens(F.col(hypothesis)))})
    for t, view in views.TIERS.items():
        d = d.withColumns({"_g": views.clusters(view(F.col("_r"))), "_p": views.clusters(view(F.col("_h")))})
        d = alignment.cer(d, "_g", "_p", "_")
        d = d.withColumns({f"cer_{t}": F.col("_cer"), f"edits_{t}": F.col("_edits"), f"denominator_{t}": F.col("_denominator")})
    return d.select("i", "folio", *[f"{c}_{t}" for t in views.TIERS for c in ("cer", "edits", "denominator")], F.lit(1).alias("one"))


def cer_metrics() -> list[m.Metric]:
    return [m.mean(f"cer_tier{t}", f"cer_{t}", "one") for t in views.TIERS]


def panel(verses: DataFrame, backbone: str | None = None, b: int = cp.RESAMPLES, seed: int = cp.SEED, references: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(frame, stratum, metric, point, lo, hi, ci_method): the whole agreement panel of (seq, verse_ref, folio, a_chunk, b_chunk, …).

    references: further error-rate comparisons by name, as (reference, hypothesis) columns. Resample plans are drawn
    once for each number of verses and shared by all metrics over it.
    """
    spark = verses.sparkSession
    v = m.numbered(verses, ["seq"]).persist()
    n = v.count()
    plans: dict[int, DataFrame] = {}

    def plan(k: int) -> DataFrame | None:
        if b > 0 and k and k not in plans:
            plans[k] = m.plan(spark, k, b, seed).persist()
        return plans.get(k)

    stats = verse_stats(v, *framed(v, backbone)).persist()
    tag = lambda d, frame, stratum: d.select(F.lit(frame).alias("frame"), F.lit(stratum).alias("stratum"), "*")
    out = [tag(m.intervals(stats, tier4_metrics(), plan(n)), "tier4", "overall")]
    sizes = v.where("folio is not null").groupBy("folio").agg(F.count("*").alias("n"))
    # units of n verses share a plan, so there are as many plans as different numbers of verses, far fewer than folios
    drawn = [plan(r.n).select(F.lit(r.n).alias("n"), "b", "i", "w") for r in sizes.select("n").distinct().collect()] if b > 0 else []
    plans_by_size = reduce(DataFrame.unionByName, drawn) if drawn else None
    places = m.numbered(v.select("folio", F.col("i").alias("at")), ["at"], ["folio"]).join(sizes, "folio").select("at", "n", "i")
    for frame, (ref, hyp) in {"a_vs_b": ("a_chunk", "b_chunk"), **(references or {})}.items():
        rates = error_rates(v, ref, hyp).persist()
        out.append(tag(m.intervals(rates, cer_metrics(), plan(n)), frame, "overall"))
        by_folio = m.stratum_intervals(rates.withColumnRenamed("i", "at").join(places, "at"), cer_metrics(), plans_by_size, "folio")
        out.append(by_folio.select(F.lit(frame).alias("frame"), F.col("folio").alias("stratum"), "metric", "point", "lo", "hi", "ci_method"))
    return reduce(DataFrame.unionByName, out)


def offset_table(verses: DataFrame, backbone: str | None = None) -> DataFrame:
    v = m.numbered(verses, ["seq"])
    a, b, _ = framed(v, backbone)
    return marks.offsets(marks.match_table(marks.detections(a, "i"), marks.detections(b, "i"), ["i"], 1))


def rafe_rule(verses: DataFrame, stored: str | None = None) -> DataFrame:
    """(i, folio, section, tp0 … fn1): the begadkefat rule's rafes against a text's own rafes, a row a verse."""
    v = verses if "i" in verses.columns else m.numbered(verses, ["seq"])
    gold = marks.exploded(v.withColumn("_m", F.col(stored) if stored else marks.extract_positional(F.col("chunk"))), "_m", "i").where("type in ('rafe', 'double_rafe')").withColumn("type", F.lit("rafe"))
    rule = v.select("i", F.explode(views.predicted_rafe(F.col("chunk"))).alias("ordinal")).withColumn("type", F.lit("rafe"))
    base = v.select("i", "folio", section(F.col("verse_ref")).alias("section"))
    for tol in (0, 1):
        c = marks.match_counts(gold, rule, ["i"], tol).select("i", *[F.col(x).alias(f"{x}{tol}") for x in ("tp", "fp", "fn")])
        base = base.join(c, "i", "left")
    return base.na.fill(0)


def rafe_gates(verses: DataFrame) -> DataFrame:
    """(rule, verse_ref, ordinal): gold marks off any consonant, and gold rafes on a letter with dagesh; none is right."""
    letters = verses.select("verse_ref", F.explode(views.consonant_records(F.col("chunk"))).alias("c")).select("verse_ref", "c.*")
    gold = verses.select("verse_ref", F.explode("tier4_positional").alias("m")).select("verse_ref", "m.*")
    off = gold.join(letters, ["verse_ref", "ordinal"], "left_anti").select(F.lit("ordinal off a consonant").alias("rule"), "verse_ref", "ordinal")
    hard = gold.where("type in ('rafe', 'double_rafe')").join(letters.where("dagesh"), ["verse_ref", "ordinal"]).select(F.lit("rafe over a dagesh").alias("rule"), "verse_ref", "ordinal")
    return off.unionByName(hard)
