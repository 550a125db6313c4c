import pytest
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.operators import confusion
from lectio.operators import marks as mk
from lectio.operators.alignment import align_clusters, PAIRS

C, R = cp.CIRCELLUS, cp.RAFE
M = "k int, type string, verse_ref string, ordinal int"


def test_positions_from_text(spark):
    chunk = f"{C}ב{C}{R}<MF>ג<DR>ד א{R}{R}"
    d = spark.createDataFrame([(chunk,), ("",)], "c string").select("c", mk.extract_positional(F.col("c")).alias("m")).collect()
    assert [tuple(x) for x in d[0].m] == [("circellus", 1), ("double_rafe", 2), ("rafe", 1), ("rafe", 4), ("rafe", 4)]
    assert d[1].m == []


def test_fold(spark):
    d = spark.createDataFrame([(1, "circellus", "v", 1), (1, "double_rafe", "v", 1), (1, "rafe", "v", 2), (1, "rafe", "v", 2)], M)
    assert {(r.ordinal, r.type) for r in mk.detections(d, "k").collect()} == {(1, "both"), (2, "rafe")}
    with pytest.raises(Exception, match="can't fold"):
        mk.detections(spark.createDataFrame([(1, "pe", "v", 1)], M), "k").collect()


def test_credit(spark):
    case = lambda g, p: mk.partial_credit(spark.createDataFrame(g, M), spark.createDataFrame(p, M), ["k"]).first()
    r = case([(1, "pe", "v", 1)], [(1, "pe", "v", 2)])
    assert abs(r.f1 - 1 / 3) < 1e-12 and (r.tp_exact, r.tp_partial, r.fp, r.fn) == (0, 1, 0, 0)
    r = case([(1, "pe", "v", 1)], [(1, "pe", "v", 1), (1, "pe", "v", 2)])
    assert (r.tp_exact, r.tp_partial, r.fp, r.fn) == (1, 0, 1, 0)
    r = case([(1, "pe", "v", 1), (1, "pe", "v", 1)], [(1, "samekh", "v", 1)])
    assert (r.tp_exact, r.tp_partial, r.fp, r.fn, r.f1) == (0, 0, 1, 1, 0.0)


def test_counts_and_types(spark):
    a = spark.createDataFrame([(1, "both", 1), (1, "rafe", 4)], "k int, type string, ordinal int")
    b = spark.createDataFrame([(1, "rafe", 1), (1, "rafe", 5)], "k int, type string, ordinal int")
    assert tuple(mk.match_counts(a, b, ["k"]).first()) == (1, 0, 2, 2)
    assert tuple(mk.match_counts(a, b, ["k"], 1).first()) == (1, 1, 1, 1)
    assert tuple(mk.match_counts(mk.covering(a, "rafe"), mk.covering(b, "rafe"), ["k"], 1).first()) == (1, 2, 0, 0)


def test_units_never_explode_the_axis(spark):
    a = spark.createDataFrame([(1, "circellus", 1), (1, "double_rafe", 2), (1, "rafe", 99)], "k int, type string, ordinal int")
    b = spark.createDataFrame([(1, "circellus", 1), (1, "rafe", 1)], "k int, type string, ordinal int")
    axis = spark.createDataFrame([(1, 10), (2, 5)], "k int, n_units int")
    got = {(r.k, r.a, r.b): r.n for r in mk.coded_units(a, b, axis, ["k"]).collect()}
    assert got == {(1, "circellus", "both"): 1, (1, "rafe", "none"): 1, (1, "none", "none"): 8, (2, "none", "none"): 5}
    raw = {(r.a, r.b) for r in mk.coded_units(a, b, axis, ["k"], canonical=False).collect()}
    assert ("double_rafe", "none") in raw
    cells = {r.k: (r.pp, r.pn, r.np, r.nn) for r in mk.binary_units(mk.coded_units(a, b, axis, ["k"]), "rafe", ["k"]).collect()}
    assert cells == {1: (0, 1, 1, 8), 2: (0, 0, 0, 5)}


def test_offsets_keep_empty_buckets(spark):
    t = spark.createDataFrame([("circellus", [(1, 2), (5, 5), (9, 2)]), ("rafe", [(1, 1)])], "type string, pairs array<struct<a:int,b:int>>")
    r = mk.offsets(t).first()
    assert (r.n_matched, r.median) == (3, 0.0)
    assert r.histogram == {"-3": 0, "-2": 0, "-1": 0, "+0": 1, "+1": 1, "+2": 0, "+3": 0, "<-3": 1, ">+3": 0}
    none = mk.offsets(t.where("type = 'pe'")).first()
    assert none.n_matched == 0 and none.median != none.median and none.histogram["+0"] == 0


def confused(spark, g, p):
    d = spark.createDataFrame([(1, [{"g": x, "p": y} for x, y in align_clusters(g, p)])], "k int, al array<struct<g:string,p:string>>")
    return {(r.gt_mark, r.pred_mark): r.n for r in confusion.mark_confusion(d, "al", ["k"]).collect()}


def test_confusion_cases(spark):
    assert confused(spark, ["בָ"], ["בַ"]) == {("qamatz", "patach"): 1}
    assert confused(spark, ["בָ", "רֵ"], ["רֵ"]) == {("qamatz", cp.ABSENT): 1, ("tsere", "tsere"): 1}
    assert confused(spark, ["ב"], ["בּ"]) == {(cp.ABSENT, "dagesh"): 1}
    assert confused(spark, ["בָָ"], ["בָ"]) == {("qamatz", "qamatz"): 1, ("qamatz", cp.ABSENT): 1}
    assert confused(spark, ["שׁ"], ["שׂ"]) == {("shin_dot", "sin_dot"): 1}


def test_accuracies(spark):
    g, p = ["בָ", "ר"], ["בַ", "ר"]
    d = spark.createDataFrame([("x", [{"g": a, "p": b} for a, b in align_clusters(g, p)], "בָר אב", "בַר אב"), ("none", [], "", "")], f"k string, al {PAIRS.simpleString()}, gt string, pred string")
    got = {r.k: (r.dec, r.cha, r.voc, r.wor) for r in confusion.factoring(d, "al", "gt", "pred").collect()}
    assert got == {"x": (0.5, 2 / 3, 0.0, 0.5), "none": (1.0, 1.0, 1.0, 1.0)}


def test_accuracies_of_nulls_and_gaps(spark):
    rows = [("gap", [("\u05d1\u05b8", None), (None, "\u05d2"), ("\u05d3\u05b7\u05bc", "\u05d3\u05bc\u05b7")], "\u05d1 \u05d3", "\u05d2 \u05d3"), ("none", [], "", ""), ("null", None, None, "x")]
    d = spark.createDataFrame(rows, "k string, al array<struct<g:string,p:string>>, gt string, pred string").repartition(2)
    got = {r.k: (r.dec, r.cha, r.voc, r.wor) for r in confusion.factoring(d, "al", "gt", "pred").collect()}
    # decisions: one of two consonants right, whatever the order of points; code points and points by place
    assert got["gap"] == (0.5, 1 / 6, 0.0, 0.5) and got["none"] == (1.0, 1.0, 1.0, 1.0) and got["null"][:3] == (None, None, None)
