import json
import random

import pytest
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.operators import metrics as m
from lectio.plans import agreement, reports, score
from lectio.streaming import live_scores

C, R = cp.CIRCELLUS, cp.RAFE
MARKS = "array<struct<type:string,verse_ref:string,ordinal:int>>"
PAIR = f"doc_id string, gt_text string, pred_text string, gt_marks {MARKS}, pred_marks {MARKS}"


def test_scores_of_equal_and_of_empty_documents(spark):
    text = "שְׁמַע"
    rows = [("same", text, text, [("pe", "v", 1)], [("pe", "v", 1)]), ("empty", "", "", [], []), ("off", "בָ ר", "בַ ר", [("pe", "v", 1)], []), ("null", None, "x", None, None)]
    d = score.score(spark.createDataFrame(rows, PAIR)).persist()
    got = {r.doc_id: r for r in d.collect()}
    assert (got["same"].tier3_cer, got["same"].cer3, got["same"].f1, got["same"].dec) == (0.0, 0.0, 1.0, 1.0)
    assert (got["empty"].tier1_cer, got["empty"].f1, got["empty"].wor) == (0.0, 1.0, 1.0)
    o = got["off"]
    assert (o.tier1_edits, o.tier2_edits, o.tier2_denominator, o.fn, o.f1) == (0, 1, 4, 1, 0.0)
    assert o.cer3 == pytest.approx(0.3 * 0.25 + 0.2 * 0.25)
    assert got["null"].tier1_cer is None
    conf = {(r.gt_mark, r.pred_mark): r.n for r in score.mark_confusion(d).where("doc_id = 'off'").collect()}
    assert conf == {("qamatz", "patach"): 1}
    with pytest.raises(ValueError):
        score.score(spark.createDataFrame(rows, PAIR), "v9")
    with pytest.raises(Exception, match="rows with the same doc_id: off"):
        score.score(spark.createDataFrame([*rows, ("off", text, text, [], [])], PAIR)).select("tier1_cer").collect()


def test_canonical_equivalents_score_nothing(spark):
    a, b = "ב" + "ָ" + "ּ", "ב" + "ּ" + "ָ"
    r = score.score(spark.createDataFrame([("x", a, b, [], [])], PAIR)).first()
    assert (r.tier1_edits, r.tier2_edits, r.tier3_edits) == (0, 0, 0)


def test_disagreement_leaves_failures_out(spark):
    d = spark.createDataFrame([("f", "בָ", "בַ"), ("f", "בָ", "בָ"), ("f", "בָ", None), ("g", "בָ", None)], "k string, prediction string, oracle string")
    got = {r.k: (r.rate, r.n, r.failures) for r in score.disagreement_rates(score.disagreement(d), ["k"]).collect()}
    assert got == {"f": (0.5, 3, 1), "g": (None, 1, 1)}


def test_combined_lines_count_ties(spark):
    a = spark.createDataFrame([("1", "בָ"), ("2", "ב")], "line_id string, text string")
    b = spark.createDataFrame([("1", "ב"), ("2", "ר")], "line_id string, text string")
    assert [tuple(r) for r in score.combined_lines(a, b).orderBy("line_id").collect()] == [("1", "בָ", "claude", 0), ("2", "ב", "claude", 1)]


def verses(spark, n=6, seed=3):
    r = random.Random(seed)
    text = lambda: "".join(r.choice("אבגדכת") + r.choice(["", "", C, R, "<DR>", cp.DAGESH]) for _ in range(12))
    rows = []
    for i in range(n):
        a = text()
        rows.append((i, f"Deut.{32 if i < 4 else 33}.{i + 1}", f"F{i % 2}", a, a if i % 3 else text()))
    return spark.createDataFrame(rows, "seq int, verse_ref string, folio string, a_chunk string, b_chunk string")


def test_folios_at_once_are_those_one_by_one(spark):
    v = verses(spark, 11).withColumn("folio", F.when(F.col("seq") == 10, None).when(F.col("seq") == 9, "G").otherwise(F.col("folio")))
    got = {(r.stratum, r.metric): (r.point, r.lo, r.hi) for r in agreement.panel(v, b=30, seed=4).where("frame = 'a_vs_b' and stratum <> 'overall'").collect()}
    rates = agreement.error_rates(m.numbered(v, ["seq"]), "a_chunk", "b_chunk").persist()
    want = {}
    for folio, k in (("F0", 5), ("F1", 4), ("G", 1)):
        part = m.numbered(rates.where(F.col("folio") == folio).withColumnRenamed("i", "at"), ["at"])
        for r in m.intervals(part, agreement.cer_metrics(), m.plan(spark, k, 30, 4)).collect():
            want[folio, r.metric] = (r.point, r.lo, r.hi)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)


def test_panel_has_every_metric_and_agrees_with_itself(spark):
    v = verses(spark)
    got = {(r.frame, r.stratum, r.metric): r for r in agreement.panel(v, b=50, seed=1).collect()}
    assert len([k for k in got if k[0] == "tier4"]) == 16
    assert {k[1] for k in got if k[0] == "a_vs_b"} == {"overall", "F0", "F1"}
    same = {r.metric: r.point for r in agreement.panel(v.withColumn("b_chunk", F.col("a_chunk")), b=0).where("frame = 'tier4'").collect()}
    assert all(x == 1.0 for x in same.values())
    back = {r.metric: r.point for r in agreement.panel(v.withColumn("bone", F.col("a_chunk")), backbone="bone", b=0).where("frame = 'tier4'").collect()}
    assert back["f1_exact"] == pytest.approx(got["tier4", "overall", "f1_exact"].point)


def test_strata_and_report(spark):
    v = m.numbered(verses(spark), ["seq"])
    stats = agreement.verse_stats(v, *agreement.framed(v))
    got = {(r.kind, r.stratum): r.n_verses for r in agreement.strata(stats).collect()}
    assert got == {("folio", "F0"): 3, ("folio", "F1"): 3, ("section", "haazinu"): 4, ("section", "prose"): 2}
    doc = reports.panel_report(agreement.panel(verses(spark), b=20, seed=2), 6, 20, 2)
    assert json.dumps(doc, sort_keys=True) == json.dumps(reports.panel_report(agreement.panel(verses(spark), b=20, seed=2), 6, 20, 2), sort_keys=True)
    rates = agreement.error_rates(v, "a_chunk", "b_chunk")
    assert [x["folio"] for x in reports.error_totals(rates)] == [None, "F0", "F1"]


def test_editor_tokens_change_no_rate(spark):
    v = m.numbered(verses(spark), ["seq"])
    noisy = v.withColumn("b_chunk", F.concat(F.lit("<MF>"), "b_chunk", F.lit("<DR>")))
    a, b = (sorted(map(tuple, agreement.error_rates(d, "a_chunk", "b_chunk").collect())) for d in (v, noisy))
    assert a == b


def test_sides_must_pair(spark):
    a = spark.createDataFrame([(0, "v", "F", "x")], "seq int, verse_ref string, folio string, chunk string")
    with pytest.raises(Exception, match="one side only"):
        agreement.paired(a, a.withColumn("verse_ref", F.lit("w"))).collect()
    with pytest.raises(Exception, match="no gold for"):
        agreement.joined(a, a.where("false"), "gold").collect()


def test_rule_and_gates(spark):
    v = spark.createDataFrame([(0, "Deut.1.1", "F", f"ב{R}דּכ", [("rafe", 1), ("rafe", 2), ("rafe", 9)])], "seq int, verse_ref string, folio string, chunk string, tier4_positional array<struct<type:string,ordinal:int>>")
    r = agreement.rafe_rule(v).first()
    assert (r.tp0, r.fp0, r.fn0) == (1, 1, 0)
    assert {(x.rule, x.ordinal) for x in agreement.rafe_gates(v).collect()} == {("ordinal off a consonant", 9), ("rafe over a dagesh", 2)}
    doc = reports.rule_report(agreement.rafe_rule(v), 10, 1)
    assert (doc["tp"], doc["fp"], doc["fn"], doc["precision"]) == (1, 1, 0, 0.5)


def test_offset_table(spark):
    v = spark.createDataFrame([(0, "v", "F", f"א{C}בג", f"אב{C}ג")], "seq int, verse_ref string, folio string, a_chunk string, b_chunk string")
    assert agreement.offset_table(v).first().histogram["+1"] == 1


def test_stream_scores_each_batch_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text(json.dumps({"doc_id": "a", "gt_text": "ב", "pred_text": "ב", "gt_marks": [], "pred_marks": []}))
    for _ in range(2):
        live_scores.score_stream(live_scores.arriving(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    (src / "2.json").write_text(json.dumps({"doc_id": "b", "gt_text": "ב", "pred_text": "ר", "gt_marks": [], "pred_marks": []}))
    live_scores.score_stream(live_scores.arriving(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert {(r.doc_id, r.tier1_cer) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 0.0), ("b", 1.0)}


def test_diacritizer_report(spark):
    from lectio.plans import runs

    v = spark.createDataFrame([(0, "v1", "F", "בָ ר"), (1, "v2", "G", "רָ")], "seq int, verse_ref string, folio string, text string")
    doc = reports.diacritizer_report(v, runs.text_slot(lambda s: s), 20, 1)
    assert doc["per_verse_cer"] == {"v1": 0.25, "v2": 0.5} and doc["overall_cer"]["point"] == pytest.approx(0.375)
    assert doc["per_folio_cer"]["F"]["n_verses"] == 1 and doc["per_folio_cer"]["G"]["ci_lower"] == 0.5


def test_scoring_hands_python_small_batches(spark):
    """Each Python step holds cluster arrays of a batch, so that 10,000 rows of some hundred clusters took over 3 GB."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    @F.arrow_udf("int")
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int32())

    text = "שָׁלוֹם עוֹלָם"
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    try:
        pairs = spark.range(2000).coalesce(1).select(F.col("id").cast("string").alias("doc_id"), F.lit(text).alias("gt_text"), F.lit(text).alias("pred_text"), *[F.lit(None).cast("array<struct<type:string,verse_ref:string,ordinal:int>>").alias(c) for c in ("gt_marks", "pred_marks")])
        d = score.score(pairs)
        assert d.agg(F.count("*"), F.sum("tier2_edits")).first() == (2000, 0)
        assert pairs.select(rows("doc_id").alias("n")).agg(F.max("n")).first()[0] <= 256
        long = pairs.limit(100).coalesce(1).select(rows(F.repeat("gt_text", 50_000)).alias("n"))
        assert long.agg(F.max("n")).first()[0] < 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
