import json

import pytest
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.operators import validate
from lectio.sources import documents, edition, page_layout, sinks

EDITION = """<Tanach><book><names><name>Deuteronomy</name></names><c n="6">
<v n="3"><w>אב</w><pe/></v>
<v n="4"><w>ש<x>5</x>מע</w><w>כל־</w><w>ישׂ</w><k>כתב</k><q>קרא</q><k>לבד</k><samekh/><w>אחד<x>5</x><s t="large">ד</s></w><reversednun/></v>
<v n="5"/></c></book></Tanach>"""

PAGE = """<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion>
<TextLine id="line_2" custom="verse_ref:Deut.6.4; letter_size:large@0,large@7; parashah:petuhah"><TextEquiv conf="0.9"><Unicode>שמע </Unicode></TextEquiv></TextLine>
<TextLine id="line_1" custom=""><TextEquiv><Unicode></Unicode></TextEquiv></TextLine>
<TextLine id="line_x" custom="layout:stichographic_column@2"><TextEquiv><Unicode>א</Unicode></TextEquiv></TextLine>
<TextLine id="line_3" custom="verse_ref:a"></TextLine></TextRegion></Page></PcGts>"""


def file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text if isinstance(text, str) else json.dumps(text, ensure_ascii=False), encoding="utf-8")
    return str(p)


def test_edition(spark, tmp_path):
    e = edition.events(spark, file(tmp_path, "e.xml", EDITION)).persist()
    got = {r.ref: (r.text, r.fallbacks) for r in edition.verses(e).collect()}
    assert got == {"Deut.6.3": ("אב", 0), "Deut.6.4": ("שמע כל־ישׂ קרא לבד אחדד", 1), "Deut.6.5": ("", 0)}
    marks = {(r.ref, r.type, r.ordinal) for r in edition.marks(e).collect()}
    assert marks == {("Deut.6.3", "pe", 1), ("Deut.6.4", "samekh", 1), ("Deut.6.4", "inverted_nun", 1), ("Deut.6.4", "large_letter", 1), ("Deut.6.4", "large_letter", 2)}
    t1 = {r.ref: r.text for r in edition.tier_texts(edition.verses(e), 1).collect()}
    assert t1["Deut.6.4"] == "שמע כל־יש קרא לבד אחדד"


def plain_events(path):
    """Events by one tree of the whole file."""
    from xml.etree import ElementTree as E

    out, seq = [], 0
    for book in E.parse(path).getroot().iter("book"):
        name = (book.findtext("names/name") or "").strip()
        for chapter in book.iter("c"):
            for verse in chapter.iter("v"):
                ref = f"{cp.BOOKS.get(name, name)}.{chapter.get('n')}.{verse.get('n')}"
                for pos, e in enumerate(verse):
                    if e.tag in edition.READ:
                        out.append((ref, seq, pos, e.tag, edition._spoken(e).strip(), tuple((x.text or "").strip() for x in e.iter("x"))))
                if not len(verse):
                    out.append((ref, seq, -1, "", "", ()))
                seq += 1
    return out


def large_edition(r):
    """Books with whole verses in comments, ends of verses in comments between verses, empty verses, and CDATA."""
    out = ["<?xml version='1.0' encoding='UTF-8'?>\n<!-- <book><c n='0'><v n='0'>no</v></c></book> -->\n<Tanach><tanach>"]
    for b in range(5):
        out.append(f"<book><names><!-- x --><name>Book &amp; {b}</name><abbrev>{b}</abbrev></names>")
        for c in range(r.randrange(1, 9)):
            out.append(f"<c n='{c + 1}' note='a > b'>")
            for v in range(r.randrange(25)):
                if r.random() < 0.15:
                    out.append("<!-- " + "".join(f"<v n='9'><w>{'hidden ' * r.randrange(9)}</w></v> <c n='7'>" for _ in range(r.randrange(1, 9))) + " -->")
                words = "".join(r.choice([f"<w>שמע{i}<x>5</x></w>", f"<k>כ{i}</k>", f"<q>ק{i}</q>", "<pe/>", "<!-- <w>n</w> -->", "<w><![CDATA[<v>&]]></w>", "<vs/>"]) for i in range(r.randrange(9)))
                out.append(f"<v n='{v + 1}'>{words}</v>\n" if words else f"<v n='{v + 1}'/>" if v % 2 else f"<v n='{v + 1}'></v >")
            out.append("</c>")
        out.append("</book>")
    return "".join(out) + "</tanach></Tanach>\n<!-- after </v> all -->"


@pytest.mark.parametrize("size", [60, 777, 5000, 1 << 30])
def test_edition_in_ranges_is_that_of_one_tree(spark, tmp_path, size):
    import random

    paths = [file(tmp_path, f"{k}.xml", large_edition(random.Random(k))) for k in range(2)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if size < 1 << 20 else str(4 << 20))
    try:
        got = edition.events(spark, paths).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for p in paths:
        assert sorted((r.ref, r.seq, r.pos, r.tag, r.text, tuple(r.codes)) for r in got if r.path.endswith(p)) == sorted(plain_events(p))


def test_edition_with_more_ranges_than_are_broadcast(spark, tmp_path, monkeypatch):
    import random

    path = file(tmp_path, "e.xml", large_edition(random.Random(5)))
    monkeypatch.setattr(edition, "MOST_RANGES", 0)
    got = edition.events(spark, path).collect()
    assert sorted((r.ref, r.seq, r.pos, r.tag, r.text, tuple(r.codes)) for r in got) == sorted(plain_events(path))


def test_edition_faults(spark, tmp_path):
    good = "<book><names><name>A</name></names><c n='1'><v n='1'><w>a</w></v></c></book>"
    for bad, said in ((good[:-12], "ends within"), (good[:-20], "ends within"), ("<v n='1'><w>a</w></v>" + good, "outside of a chapter"), (good.replace("</w>", "</w><!-- </v> -->"), "holds the end")):
        with pytest.raises(Exception, match=said):
            edition.events(spark, file(tmp_path, "bad.xml", bad)).collect()
    assert edition.events(spark, file(tmp_path, "none.xml", "")).collect() == []


def test_page_lines(spark, tmp_path):
    path = file(tmp_path, "p.xml", PAGE)
    rows = page_layout.lines(spark, path).collect()
    assert [(r.line_num, r.text) for r in rows] == [(0, "א"), (1, ""), (2, "שמע ")]
    assert (rows[2].verse_ref, rows[2].large_letters, rows[2].parashah, rows[2].conf) == ("Deut.6.4", [0, 7], "petuhah", 0.9)
    assert rows[0].stichographic_column == 2
    bad = file(tmp_path, "b.xml", PAGE.replace("parashah:petuhah", "parasha:petuhah"))
    with pytest.raises(Exception, match="malformed custom token"):
        page_layout.lines(spark, bad).collect()
    assert sum(len(r.errors) for r in page_layout.lines(spark, bad, strict=False).collect()) == 1


def test_custom_rules(spark):
    bad = ["parashah:other", "letter_size:huge@1", "letter_size:large@x", "layout:stichographic_column@3", "layout:other@1", "note:x"]
    d = spark.createDataFrame([(x,) for x in [*bad, "verse_ref:a;verse_ref:b;;", None]], "c string")
    got = [r.p for r in d.select(page_layout.parsed_custom(F.col("c")).alias("p")).collect()]
    assert [len(p.errors) for p in got] == [1] * len(bad) + [0, 0]
    assert got[-2].verse_ref == "b" and got[-1].verse_ref == ""


def test_scorer_inputs_and_rules(spark, tmp_path):
    good = {"text": "ב", "metamarks": [{"type": "pe", "verse_ref": "v", "ordinal": 1}]}
    files = [file(tmp_path, "a.json", good), file(tmp_path, "b.json", {"text": 1, "metamarks": [{"type": "no", "verse_ref": "v", "ordinal": 0}], "extra": 1}), file(tmp_path, "c.json", "[]")]
    d = documents.scorer_inputs(spark, files)
    bad = {}
    for r in validate.rules(d, "path", validate.scorer_input_rules(d)).collect():
        bad.setdefault(r.subject.rsplit("/", 1)[-1], set()).add(r.rule)
    assert "a.json" not in bad and {"mark type is known", "ordinal is 1 or more", "no other keys"} <= bad["b.json"] and "metamarks is a list" in bad["c.json"]


def test_projection_round_trip_and_drift(spark, tmp_path):
    chunk = f"ב{cp.RAFE}<DR>ג"
    v = {"verse_ref": "v", "folio": "F", "chunk": chunk, "consonant_count": 2, "tier4_positional": [{"type": "rafe", "ordinal": 1}, {"type": "double_rafe", "ordinal": 1}]}
    d = documents.projections(spark, file(tmp_path, "p.json", {"format_version": 1, "side_label": "a", "verses": [v, {**v, "consonant_count": 3}]})).persist()
    assert [r.drift for r in d.orderBy("seq").collect()] == [False, True]
    back = sinks.projection(d).first()
    assert back.side_label == "a" and [x.consonant_count for x in back.verses] == [2, 3]
    g = sinks.folio_goldens(d).first()
    assert (g.line_count, g.consonant_total, g.tier4_positional_total) == (2, 5, 4)


def test_raw_chunks_and_maps(spark, tmp_path):
    d = documents.raw_chunks(spark, file(tmp_path, "t.txt", "<MF>אב׃\nג<DR>ד ׃ ׃"))
    assert [(r.seq, r.chunk) for r in d.orderBy("seq").collect()] == [(0, "אב"), (1, "ג<DR>ד")]
    want = [(0, "a", "F1"), (1, "b", "F1"), (2, "c", "F2")]
    for shape in ({"folios": {"F1": ["a", "b"], "F2": ["c"]}}, [["a", "F1"], ["b", "F1"], ["c", "F2"]]):
        assert [tuple(r) for r in documents.verse_folios(spark, file(tmp_path, "m.json", shape)).orderBy("seq").collect()] == want


def test_manifest_coercion(spark, tmp_path):
    old = {"version": "0.1", "folios": [{"id": "a", "manuscript": "m", "book": "b"}], "expected_total_reports": 4}
    r = documents.manifest(spark, file(tmp_path, "m.json", old)).first()
    assert (r.total_reports, r.iaa_subset, r.folios[0].iaa_folio) == (4, [], False)
    new = documents.manifest(spark, file(tmp_path, "n.json", {**old, "expected_total_reports": {"x": 2, "y": 3}, "iaa_subset": ["a"]}))
    assert new.first().total_reports == 5 and documents.folios(new).first().in_subset


def test_small_sources(spark, tmp_path):
    assert documents.json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    pins = file(tmp_path, "pins.md", f"| date | x | sha |\n| 2026-02-01 | v2 | `{'a' * 64}` |\n| 2026-01-01 | v1 | {'b' * 64} |")
    assert documents.pinned_sha(spark, pins).first().sha256 == "a" * 64
    docs = spark.createDataFrame([('{"text":"x"}',), ('{"lines":[{"tier2":"a"},{"tier2":""}]}',), ('{"tier2":"t"}',), ('["p","q"]',), ("{}",)], "v string")
    assert [r.x for r in docs.select(documents.prediction_lines(F.col("v")).alias("x")).collect()] == [["x"], ["a"], ["t"], ["p", "q"], []]
    assert documents.first_existing(str(tmp_path), "no.xml", "pins.md").endswith("pins.md")
    assert documents.files(spark, str(tmp_path), "*.md").count() == 1


def test_reading_order(spark):
    rows = [("f", "b", [0, 5, 9, 6], 0), ("f", "a", [0, 5, 20, 6], 1), ("f", "c", [0, 1, 3, 2], 2), ("g", "2", [0, 0, 0, 0], 0), ("g", "1", [0, 0, 0, 0], 1)]
    d = spark.createDataFrame(rows, "folio_id string, line_id string, bbox array<int>, at int")
    got = documents.in_order(documents.reading_order(d), "folio_id", ["place"], "line_id")
    assert {r.folio_id: r.line_id for r in got.collect()} == {"f": "c a b", "g": "1 2"}


def test_sinks(spark, tmp_path):
    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        sinks.atomic_json({}, tmp_path / "x.json", refuse)
    assert not (tmp_path / "x.json").exists()
    sinks.atomic_json({"b": "ב"}, tmp_path / "x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"b": "ב"}
    log = str(tmp_path / "log")
    for k in (1, 2):
        sinks.append_lines(spark.createDataFrame([(k, "x")], "k int, v string"), log)
    assert documents.json_lines(spark, log, "k int, v string").count() == 2
    with pytest.raises(Exception, match="too long"):
        sinks.append_lines(spark.createDataFrame([(1, "x" * 5000)], "k int, v string"), log)
    assert sinks.prediction_json(spark.createDataFrame([("f", None)], "folio_id string, x string")).first().value == '{"folio_id":"f"}'
    with pytest.raises(ValueError):
        sinks.score_report({}, [], "p", "g", "", "v")


def test_page_layout_documents_are_those_of_an_xml_writer(spark, tmp_path):
    from xml.etree import ElementTree as E

    rows = [("f", 1, "f_L007", [0, 1, 2, 3], "<ב> & \"q\" \u034f", 0.12345), ("f", 0, "odd", [4, 5, 6, 7], "", None), ("f", 2, "f_Lx", [1, 1, 1, 1], "a\rb", 0.12335), ("g&", 0, "g_L1", [0, 0, 0, 0], "x", 1.0)]
    d = spark.createDataFrame(rows, "folio_id string, at int, line_id string, bbox array<int>, tier1 string, kraken_confidence double").repartition(3)
    got = {r.folio_id: r.value for r in sinks.page_xml(d, "me <1>").collect()}
    assert set(got) == {"f", "g&"}
    for folio, value in got.items():
        E.register_namespace("", sinks.PAGE)
        n = lambda x: f"{{{sinks.PAGE}}}{x}"
        top = E.Element(n("PcGts"))
        E.SubElement(E.SubElement(top, n("Metadata")), n("Creator")).text = "me <1>"
        region = E.SubElement(E.SubElement(top, n("Page"), imageFilename=f"{folio}.jpg", imageWidth="0", imageHeight="0"), n("TextRegion"), id=f"region_{folio}")
        E.SubElement(region, n("Coords"), points="0,0 0,0 0,0 0,0")
        for _, at, line_id, (x0, y0, x1, y1), text, conf in sorted(r for r in rows if r[0] == folio):
            number = int(line_id[-1]) if line_id[-1].isdigit() else at + 1
            line = E.SubElement(region, n("TextLine"), id=f"line_{number}")
            E.SubElement(line, n("Coords"), points=f"{x0},{y0} {x1},{y0} {x1},{y1} {x0},{y1}")
            equiv = E.SubElement(line, n("TextEquiv"), {} if conf is None else {"conf": f"{round(conf, 4):.4f}"})
            E.SubElement(equiv, n("Unicode")).text = text.replace("\r", "@CR@")
        want = "<?xml version='1.0' encoding='UTF-8'?>\n" + E.tostring(top, encoding="unicode", short_empty_elements=True)
        want = want.replace(" />", "/>").replace("@CR@", "&#13;").replace("<Unicode/>", "<Unicode></Unicode>")
        assert value == want
        (tmp_path / f"{folio[0]}.xml").write_text(value, encoding="utf-8")
    assert {r.text for r in page_layout.lines(spark, str(tmp_path / "f.xml")).collect()} >= {rows[0][4], "a\rb"}
