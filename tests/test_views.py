from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.functions import scalars, views

SHEMA = "שְׁמַ֖ע יִשְׂרָאֵ֑ל"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


def test_joiner_goes_before_normalisation(spark):
    assert one(spark, "ב" + cp.CGJ + "ָּ", views.normalize) == "בָּ"
    assert one(spark, "ב" + "ָּ", views.normalize) == one(spark, "ב" + "ָּ", views.normalize)
    assert one(spark, None, views.normalize) is None


def test_clusters_follow_the_grapheme_rules(spark):
    import regex

    for s in ("", SHEMA, "ab", "👨‍👩‍👧é\r\n한", "בּ ָ"):
        assert one(spark, s, views.clusters) == regex.findall(r"\X", s)


def test_tiers_are_nested(spark):
    s = f"{SHEMA}{cp.MAQAF}x  y׃"
    assert one(spark, s, views.tier1) == f"שמע ישראל{cp.MAQAF}"
    assert one(spark, SHEMA, lambda c: views.scorer_view(c, 2)).count("֖") == 0
    assert one(spark, "  a  ", views.tier3) == "  a  "
    assert one(spark, "<DR>a<MF>", views.strip_editor_tokens) == "a"


def test_loader_views_keep_what_scorers_drop(spark):
    s = f"abc{cp.CGJ}בּ"
    assert one(spark, s, lambda c: views.loader_view(c, 1)) == f"abc{cp.CGJ}ב"
    assert one(spark, s, views.tier1) == "ב"
    assert one(spark, s, lambda c: views.loader_view(c, 3)) == s
    assert one(spark, "א ׀ ב", lambda c: views.loader_view(c, 1)) == "א ב"


def test_consonants_and_rule(spark):
    chunk = "בּ<DR>ברָ ת"
    got = one(spark, chunk, views.consonant_records)
    assert [(r.ordinal, r.letter, r.dagesh) for r in got] == [(1, "ב", True), (2, "ב", False), (3, "ר", False), (4, "ת", False)]
    assert one(spark, chunk, views.predicted_rafe) == [2, 4]
    assert one(spark, "", views.predicted_rafe) == []


def test_mark_names_and_classes(spark):
    assert sorted(one(spark, "בָּ֖", views.mark_names)) == ["dagesh", "qamatz"]
    assert [one(spark, n, views.mark_class) for n in ("qamatz", "shin_dot", "dagesh", "meteg")] == ["vowel", "dot", "dagesh", "meteg"]
    assert one(spark, "reversednun", views.canonical_type) == "inverted_nun"
    assert one(spark, "no such", lambda c: views.canonical_type(c, strict=False)) is None


def test_references(spark):
    assert one(spark, "Samuel 1", lambda b: views.verse_ref(b, F.lit(2), F.lit(3))) == "1Sam.2.3"
    assert tuple(one(spark, "Deut.32.x", views.parsed_ref)) == ("Deut", 32, None)


def test_unicode_white_space(spark):
    s = "  a\x1cb c "
    assert one(spark, s, views.stripped) == s.strip()
    assert one(spark, s, views.tokens) == s.split()
    assert one(spark, "", views.tokens) == []


def test_hashes(spark):
    import hashlib
    import json

    doc = {"b": 1, "a": [2, "é"]}
    for compact, sep in ((True, (",", ":")), (False, None)):
        want = hashlib.sha256(json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=sep).encode()).hexdigest()
        assert one(spark, json.dumps(doc), lambda c, k=compact: scalars.canonical_hash(c, 64, k)) == want
    want = hashlib.sha256(b"m==1:abc").hexdigest()[:16]
    assert one(spark, "m", lambda c: scalars.model_hash(c, F.lit("1"), F.lit("abc"))) == want


def test_rates_and_scores_of_nothing(spark):
    f = lambda tp, fp, fn: one(spark, "", lambda _: scalars.f1(F.lit(tp), F.lit(fp), F.lit(fn)))
    assert (f(0, 0, 0), f(0, 1, 0), f(0, 0, 1), f(1, 1, 1)) == (1.0, 0.0, 0.0, 0.5)
    r = lambda e, d: one(spark, "", lambda _: scalars.rate(F.lit(e), F.lit(d)))
    assert (r(0, 0), r(2, 0), r(1, 4)) == (0.0, 1.0, 0.25)
    assert abs(one(spark, "", lambda _: scalars.composite(F.lit(0.1), F.lit(None).cast("double"), F.lit(0.5))) - 0.15) < 1e-12


def test_reshaping(spark):
    assert one(spark, '[{"sep":true,"str":" "},{"sep":false,"str":"x","options":["y","z"]},{"sep":false,"str":"q"}]', scalars.reconstructed) == " yq"
    assert one(spark, "", lambda _: scalars.mean_confidence(F.array(F.lit(0.5), F.lit(0.25)))) == 0.375
    assert one(spark, "", lambda _: scalars.polygon_box(F.array(F.struct(F.lit(3).alias("x"), F.lit(9).alias("y")), F.struct(F.lit(1).alias("x"), F.lit(4).alias("y"))))) == [1, 4, 3, 9]


def test_visible_text(spark):
    md = "<!-- hidden --><b>Real</b> &amp; [](/x)​ text\n[ref]: https://example.org\n<!-- unclosed"
    assert one(spark, "<!-- a --><b>Real</b> &amp; done[](/x)\n[ref]: https://example.org", scalars.visible_text).strip() == "Real & done"
    assert one(spark, md, scalars.visible_text).split() == ["Real", "&", "text"]


def test_versions(spark):
    ok = lambda v, s: one(spark, v, lambda c: scalars.version_admitted(c, F.lit(s)))
    assert ok("1.2.3", ">=1.2,<2") and not ok("2.0", ">=1.2,<2") and ok("1.2.9", "~=1.2.3") and not ok("1.3.0", "~=1.2.3") and ok("1.4.7", "==1.4.*") and not ok("1.0", "!=1.0.0")
    assert one(spark, "My_Pkg..x", scalars.package_name) == "my-pkg-x"
