import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lectio.functions import scalars
from lectio.operators import schema
from lectio.operators import validate as v
from lectio.plans import govern, registry, runs
from lectio.sources import documents

FOLIO = "id string, manuscript string, book string, folio string, gt_hash string, gt_source string, iaa_folio boolean, in_frozen_scope boolean"
LOG = "at int, prev_frozen_at string, new_frozen_at string, reason string"


def found(d):
    return sorted((r.rule, r.subject) for r in d.collect())


def manifests(spark, head, staged, log):
    h = spark.createDataFrame(head, FOLIO)
    base = spark.createDataFrame([(0, "t0", "t1", "phase 1: x")], LOG)
    return govern.successor(h, spark.createDataFrame(staged, FOLIO), base, spark.createDataFrame([(0, "t0", "t1", "phase 1: x"), *log], LOG), "t1", "t2")


A, B = ("a", "m", "b", "1", None, None, False, True), ("b", "m", "b", "2", "h", None, True, False)
OK = [(1, "t1", "t2", "phase 2: more")]


def test_successor(spark):
    assert found(manifests(spark, [A, B], [A, B], OK)) == []
    assert found(manifests(spark, [A, B], [B], OK)) == []
    assert found(manifests(spark, [A, B], [A], OK)) == [("row removed", "b")]
    assert found(manifests(spark, [A, B], [B], [(1, "t1", "t2", "because")])) == [("row removed", "a")]
    assert found(manifests(spark, [A, B], [A, (*B[:4], "other", *B[5:])], OK)) == [("immutable field changed", "b")]
    assert found(manifests(spark, [A, B], [A, (*B[:-1], True)], OK)) == [("flag restored", "b")]
    assert found(manifests(spark, [A, B], [A, B], [(1, "t9", "t2", "phase 2: x")])) == [("chain broken", "1")]
    assert found(manifests(spark, [A, B], [A, B], [(1, "t1", "t3", "phase 2: x")])) == [("chain broken", "end")]
    staged = spark.createDataFrame([(0, "t0", "t1", "edited")], LOG)
    assert found(v.append_only(spark.createDataFrame([(0, "t0", "t1", "phase 1: x")], LOG), staged, "at")) == [("not append-only", "0")]


SIGN = """# log
## v1.0 (2026-01-02) — first
- **Version**: v1.0
- **Authorized by**: me
- **Authorization**: in writing
- **Signed off**: 2026-01-02
## v1.0.1
- Version: v1.0
- Authorized by:
- Signed off: soon
"""


def test_signoff_and_disclosure(spark):
    d = spark.createDataFrame([("s.md", SIGN)], "path string, value string")
    day = dt.date(2026, 1, 3)
    assert found(govern.signoff(d, "v1.0", day)) == []
    assert {r for r, _ in found(govern.signoff(d, "v1.0.1", day))} == {"has Authorized by", "has Authorization", "version agrees", "signed on a day that was"}
    assert found(govern.signoff(d, "v2", day)) == [("no sign-off", "v2")]
    assert found(govern.signoff(d, "v1.0", dt.date(2025, 12, 1))) == [("signed on a day that was", "s.md")]
    log = lambda body: spark.createDataFrame([("c.md", f"## v1\n{body}\n## v0\nx")], "path string, value string")
    assert found(govern.disclosure(log("### Governance\nThe keeper signed."), "v1")) == []
    assert found(govern.disclosure(log("### Governance\n<!-- none -->\n### Next\nx"), "v1")) == [("discloses something", "c.md")]
    assert found(govern.disclosure(log("### Governance\n- **TBD**"), "v1")) == [("discloses something", "c.md")]
    assert ("has a disclosure", "c.md") in found(govern.disclosure(log("nothing"), "v1"))


def test_needles_are_those_of_a_plain_scan(spark):
    import random

    r = random.Random(0)
    word = lambda: r.choice(["a", "bb", "Ccc", "dd.", "e-e", "f"])
    gap = lambda: r.choice([" ", " ", "  ", "\n"])
    say = lambda n: "".join(word() + gap() for _ in range(n))
    texts = [(i, say(r.randrange(30))) for i in range(60)] + [(99, None)]
    terms = sorted({say(r.randrange(1, 6))[r.randrange(3) :] for _ in range(60)} | {"x", " a bb ", "c dd. e"} - {""})
    d, n = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame([(x,) for x in terms] + [(None,)], "needle string")
    want = sorted((i, x) for i, t in texts for x in terms if t is not None and x.lower() in t.lower())
    for block in (1000, 7):
        assert sorted(map(tuple, v.needles(d, "i", "t", n, block=block).collect())) == want


def test_time_of_a_scan_does_not_go_by_the_number_of_terms(spark):
    import time

    words = [f"w{i:05d}" for i in range(50_000)]
    d = spark.createDataFrame([(i, " ".join(words[(7 * i + k) % 50_000] for k in range(0, 2_000, 40)) + " end") for i in range(400)], "i int, t string").repartition(4).persist()
    d.count()
    few, took = [*words[:8], "end", ""], []
    for terms in (few, [*words, "end", ""]):
        n = spark.createDataFrame([(x,) for x in terms], "needle string").persist()
        n.count()
        began = time.time()
        got = v.needles(d, "i", "t", n).collect()
        took.append(time.time() - began)
    by: dict[int, set] = {}
    for r in got:
        by.setdefault(r.subject, set()).add(r.needle)
    assert all(by[r.i] == {*r.t.split(), ""} for r in d.collect())
    assert took[1] < 10 * took[0] + 20


def test_a_chain_without_keys_is_that_of_a_plain_walk(spark):
    import random

    r = random.Random(1)
    rows, last, want = [], None, []
    for i in range(900):
        previous = r.choice([None, last, last, last, i])
        if previous is not None and previous != (0 if last is None else last):
            want.append(str(i))
        new = r.choice([None, i * 10])
        rows.append((i, previous, new))
        last = new if new is not None else last
    d = spark.createDataFrame(rows, "o int, p int, n int").repartition(5)
    assert sorted(x.subject for x in v.chain(d, "o", "p", "n", F.lit(0)).collect()) == sorted(want) and want
    assert v.chain(d.where("false"), "o", "p", "n").count() == 0


def test_digests_are_of_sixteen_digits_and_say_what_of(spark):
    full = "ab" * 32
    have = spark.createDataFrame([("f", full), ("g", "00" * 32), ("a@b", full)], "path string, sha256 string")
    rows = [("ok", "f@r1 (projection of g@r2)", "ab" * 8), ("at", "a@b@r1", "ab" * 8), ("null", "f@r1", None), ("empty", "f@r1", ""), ("short", "f@r1", "a"), ("full", "f@r1", full), ("upper", "f@r1", "AB" * 8), ("line", "f@r1", "ab" * 8 + "\n")]
    rows += [("sourceless", None, "ab" * 8), ("blank", "", "ab" * 8), ("bare", "f (x@y)", "ab" * 8), ("gone", "h@r1", "ab" * 8), ("other", "g@r1", "ab" * 8)]
    want = {"null": "no digest", "sourceless": "no source", "blank": "no source", "bare": "source without revision", "gone": "file missing", "other": "digest differs"}
    d = spark.createDataFrame(rows, "id string, source string, digest string")
    assert found(govern.digests(have, d)) == sorted((want.get(i, "malformed digest"), i) for i, *_ in rows if i not in ("ok", "at"))
    assert found(govern.digests(have, d.where("false"))) == [("nothing frozen", "")]


def test_digests_are_set_once(spark):
    have = spark.createDataFrame([(f"g/{i}.json", f"{i * 16}" + "0" * 48) for i in "ab"], "path string, sha256 string")
    rows = [("a", None, None, True), ("b", None, None, True), ("z", "old", "x@1", False)]
    d = spark.createDataFrame(rows, "id string, gt_hash string, gt_source string, in_frozen_scope boolean")
    go = lambda x: govern.fused(x, have, "g/{id}.json", "r1", "all.json", "r2")
    got = {r.id: (r.gt_hash, r.gt_source) for r in go(d).collect()}
    assert got == {**{i: (i * 16, f"g/{i}.json@r1 (projection of all.json@r2)") for i in "ab"}, "z": ("old", "x@1")}
    recorded = go(d).where("in_frozen_scope").select("id", F.col("gt_source").alias("source"), F.col("gt_hash").alias("digest"))
    assert found(govern.digests(have, recorded)) == []
    with pytest.raises(Exception, match="already set"):
        go(go(d)).collect()
    with pytest.raises(Exception, match="no golden"):
        go(d.withColumn("id", F.lit("c"))).collect()


SEEN = {
    "<!-- closed --> a": "a", "b <!-- open\n\nc": "b", "<style>body{color:red}</style>": "", "<SCRIPT x>\ny</script >z": "z", "<template>open": "",
    "<https://example.org>": "<https://example.org>", "real <em>text</em><br/>": "real text", "a < b > c": "a < b > c",
    "[r]: <a b>": "", "[r]: https://x.org 'title'": "", '[r]: https://x.org\n    "title"': "", "[]: x": "[]: x", "&lt;!-- seen": "<!-- seen",
    "[](/x)": "", "![ ](x)": "", "[][ref]": "", "[\u200b](/x)": "", "[policy](https://x.org)": "[policy](https://x.org)", "[](foo(and)bar)": "bar)",
    "\u0301": "", "\u05e9\u05b8": "\u05e9", "\x01": "", "&nbsp;": "", "[]{}()": "[]{}()",
}


def test_readers_see_what_renders(spark):
    d = spark.createDataFrame(list(SEEN.items()), "md string, want string")
    got = {r.md: (r.t.strip(), r.said) for r in d.select("md", scalars.visible_text(F.col("md")).alias("t"), govern.substantive(F.col("md")).alias("said")).collect()}
    assert {k: v[0] for k, v in got.items()} == SEEN
    assert all(said == (SEEN[k] != "") for k, (_, said) in got.items())
    odd = spark.createDataFrame([(x,) for x in ("- **TBD**", "Coming  soon.", "---", "n/a", "\u2028Nil\x1f", "tbd later")], "md string")
    assert [r[0] for r in odd.select(govern.substantive(F.col("md"))).collect()] == [False, False, False, False, False, True]


def test_versions_are_named_whole(spark):
    heads = ["benchmark-v0.1.1 (2026-07-29) -- x", "[v0.1.1]", "my-v0.1.1", "(v0.1.1", "v0.1.1.2", "v0.1.1-rc", "a/v0.1.1 b", "1v0.1.1"]
    d = spark.createDataFrame([(h, f"## {h}\nbody") for h in heads], "path string, value string")
    assert {r.path for r in govern.versioned(d, "v0.1.1").collect()} == {"(v0.1.1", "a/v0.1.1 b"}
    assert {r.path for r in govern.versioned(d, "benchmark-v0.1.1").collect()} == {heads[0]}


SCHEMA = {
    "type": "object", "required": ["id", "lines"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 1, "pattern": "^[a-z]+$"}, "kind": {"enum": ["x", 1, None]}, "share": {"type": ["number", "null"], "minimum": 0, "maximum": 1},
        "lines": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"$ref": "#/$defs/line"}}, "how": {"oneOf": [{"const": 1}, {"type": "integer"}]}, "n": {"type": "integer", "exclusiveMinimum": 0},
    },
    "$defs": {"line": {"type": "object", "properties": {"bbox": {"type": "array", "minItems": 4, "maxItems": 4, "uniqueItems": False, "items": {"type": "integer", "minimum": 0}}}, "required": ["bbox"]}},
}


def test_schemas(spark):
    good = {"id": "a", "lines": [{"bbox": [0, 1, 2, 3.0]}], "kind": None, "share": 0.5, "how": 2, "n": 1}
    bad = {
        "not an object": ([1], {"$ type"}), "missing": ({"id": "a"}, {"$.lines required"}), "extra": ({**good, "z": 1}, {"$.z additionalProperties"}), "short": ({**good, "id": ""}, {"$.id minLength", "$.id pattern"}),
        "kinds": ({**good, "id": 1, "kind": True, "share": True, "n": 1.5}, {"$.id type", "$.kind enum", "$.share type", "$.n type"}), "deep": ({**good, "lines": [{"bbox": [0, -1, 2]}]}, {"$.lines[0].bbox minItems", "$.lines[0].bbox[1] minimum"}),
        "many": ({**good, "lines": [{"bbox": [0, 0, 0, 0]}] * 2 + [{}]}, {"$.lines maxItems", "$.lines[2].bbox required"}), "one": ({**good, "how": 1, "n": 0, "share": 2}, {"$.how oneOf", "$.n exclusiveMinimum", "$.share maximum"}),
    }
    rows = [("good", json.dumps(good)), ("none", None), ("text", "{"), *((k, json.dumps(x)) for k, (x, _) in bad.items())]
    got = schema.violations(spark.createDataFrame(rows, "path string, value string"), "path", "value", SCHEMA).collect()
    by = {}
    for r in got:
        by.setdefault(r.subject, set()).add(r.detail)
    assert by == {"none": {"not JSON"}, "text": {"not JSON"}, **{k: w for k, (_, w) in bad.items()}}
    more = {"if": {"required": ["a"]}, "then": {"required": ["b"]}, "allOf": [{"not": {"required": ["c"]}}], "anyOf": [{"required": ["a"]}, {"required": ["d"]}], "patternProperties": {"^x": {"type": "string"}}, "propertyNames": {"maxLength": 2}}
    assert sorted(schema.check({"a": 1, "c": 1, "x1": 2, "long": 1}, more)) == [("$", "not"), ("$.b", "required"), ("$.long", "maxLength"), ("$.x1", "type")]
    assert list(schema.check({}, more)) == [("$", "anyOf")] and list(schema.check([1, "a"], {"prefixItems": [{"type": "string"}], "items": False})) == [("$[0]", "type"), ("$[1]", "false")]
    with pytest.raises(ValueError, match="required"):
        schema.require({}, SCHEMA)


def test_catalog(spark):
    entry = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "n": {"type": "integer"}}}
    rows = [(0, '{"id": "m", "n": 1}'), (1, '{"id": "m"}'), (2, '{"n": "x"}'), (3, '{"id": "k", "n": "y"}')]
    folios = spark.createDataFrame([("a", "m"), ("b", "gone"), ("c", None)], "id string, manuscript string")
    d = spark.createDataFrame(rows, "at int, value string")
    assert found(govern.catalog(d, entry, folios)) == [("duplicate id", "m"), ("no catalog entry", "gone"), ("schema", "entry 2"), ("schema", "entry 2"), ("schema", "k")]
    assert found(govern.catalog(d.where("at = 0"), entry, folios.where("id = 'a'"))) == []
    assert ("no entries", "") in found(govern.catalog(d.where("false"), entry, folios))


def test_pins_of_project_files(spark):
    toml = lambda name, version, *deps, extra="": f'[project]\nname = "{name}"\nversion = "{version}"\ndependencies = {json.dumps(list(deps))}\n{extra}'
    old = [("core/p.toml", toml("my_core", "1.0")), ("app/p.toml", toml("app", "1.0"))]
    new = [
        ("core/p.toml", toml("my_core", "2.0", "my-core<1")), ("app/p.toml", toml("app", "1.0", "My.Core[fast] >=1,<2 ; python_version > '3'", "other==1")),
        ("lib/p.toml", toml("lib", "0.1", "my-core", extra='[project.optional-dependencies]\ndev = ["my_core (>=1.5,<1.9)", "my-core>=2"]')), ("bad/p.toml", "[project"), ("none/p.toml", "[tool]\nx = 1"),
    ]
    a, b = (spark.createDataFrame(x, "path string, value string") for x in (old, new))
    changed = govern.changed_versions(a, b)
    assert sorted((r.package, r.version) for r in changed.collect()) == [("lib", "0.1"), ("my_core", "2.0")]
    got = govern.consumers(b)
    assert sorted((r.consumer, r.package, r.specifier, r.extra) for r in got.collect() if r.path == "lib/p.toml") == [("lib", "my-core", "", None), ("lib", "my-core", ">=2", "dev"), ("lib", "my_core", ">=1.5,<1.9", "dev")]
    assert found(govern.version_cascade(changed, got)) == [("pin doesn't admit", "app"), ("pin doesn't admit", "lib")]


def test_gates(spark):
    files = spark.createDataFrame([("a/x.PNG", 1), ("scans/y.txt", 1), ("z.txt", 6 * 1024 * 1024), ("ok.txt", 9)], "path string, length long")
    assert found(govern.tree_gate(files, [".png"], ["scans"])) == [("extension", "a/x.PNG"), ("folder", "scans/y.txt"), ("size", "z.txt")]
    texts = spark.createDataFrame([("a", "my /Home/Bob/x"), ("b", "/home/bob"), ("c", "fine /home/bob/public")], "path string, value string")
    terms = spark.createDataFrame([("/home/bob", ["b"])], "needle string, exempt array<string>")
    assert [tuple(r) for r in v.needles(texts, "path", "value", terms, allowed=["/home/bob/public"]).collect()] == [("a", "/home/bob")]
    c = spark.createDataFrame([("my_pkg", "2.0")], "package string, version string")
    k = spark.createDataFrame([("other", "My-Pkg", ">=1,<2"), ("fine", "my-pkg", ">=1"), ("my.pkg", "my-pkg", "<1")], "consumer string, package string, specifier string")
    assert found(govern.version_cascade(c, k)) == [("pin doesn't admit", "other")]
    got, pins = spark.createDataFrame([("f1", 0.62101)], "metric string, point double"), spark.createDataFrame([("f1", 0.6210), ("kappa", 0.5)], "metric string, value double")
    assert found(govern.reverified(got, pins)) == [("pinned value", "kappa")]
    cards = spark.createDataFrame([("a", "---\nlanguage: he\nlicense: x\ntags: y\n---\n"), ("b", "none")], "path string, value string")
    assert {s for _, s in found(govern.front_matter(cards))} == {"b"}
    assert found(govern.report_status(texts.where("false"))) == [("report status", "missing")]


def tree(tmp_path, **change):
    doc = {"version": "0.2", "frozen_at": "t", "scorer_version": "1", "manifest_hash": "h", "folios": [{"id": "a", "manuscript": "m", "book": "b", "in_frozen_scope": True}, {"id": "z", "manuscript": "m", "book": "b", "in_frozen_scope": False}], "expected_reports_per_baseline": {"x": 0}, "manifest_changelog": [], **change}
    (tmp_path / "manifest.json").write_text(json.dumps(doc))
    return tmp_path / "manifest.json"


def test_audit(spark, tmp_path):
    tree(tmp_path, expected_reports_per_baseline={"x": 2})
    (tmp_path / "results/x").mkdir(parents=True)
    (tmp_path / "results/x/a.json").write_text('{"manifest_hash": "stale"}')
    (tmp_path / "results/x/run_meta.json").write_text('{"scorer_version": "0"}')
    terms = spark.createDataFrame([("secret name",)], "needle string")
    rules = [r for r, _ in found(govern.audit(spark, str(tmp_path), "m", "b", terms, release=True))]
    assert sorted(rules) == ["manifest hash", "promised and shipped differ", "report status", "scorer version"]
    (tmp_path / "schemas").mkdir()
    (tmp_path / "schemas/leaderboard.schema.json").write_text('{"required": ["rows"]}')
    (tmp_path / "schemas/iaa_report.schema.json").write_text('{"required": ["iaa_status"]}')
    (tmp_path / "leaderboard.json").write_text("{}")
    (tmp_path / "iaa_report.json").write_text('{"iaa_status": "real"}')
    (tmp_path / "old.md").write_text("fine\nthe OldName here, oldnames not\n")
    (tmp_path / "kept.md").write_text("OldName")
    more = found(govern.audit(spark, str(tmp_path), "m", "b", terms, release=True, legacy=["oldname"], legacy_allowed=("kept.md",)))
    assert sorted(r for r, _ in more) == ["legacy word", "manifest hash", "promised and shipped differ", "schema of leaderboard.json", "scorer version"]
    assert [s for r, s in more if r == "legacy word"][0].endswith("/old.md:2")


def infer(folios):
    return folios.select(F.col("id").alias("folio_id"), F.to_json(F.struct(F.col("id").alias("folio_id"))).alias("value"))


def test_run_promotes_with_its_manifest(spark, tmp_path):
    man = tree(tmp_path)
    folios = documents.folios(documents.manifest(spark, str(man)))
    want = spark.createDataFrame([("a",)], "id string")
    assert runs.run("x", folios, want, infer, tmp_path / "results", man) == 1
    after = json.loads(man.read_text())
    assert after["expected_reports_per_baseline"] == {"x": 1} and len(after["manifest_changelog"]) == 1
    assert (tmp_path / "results/x/a.json").exists() and (tmp_path / "results/x/run_meta.json").exists()
    assert not (tmp_path / "results/.in_progress/x").exists()
    with pytest.raises(runs.ScopeViolation):
        runs.run("x", folios, spark.createDataFrame([("z",)], "id string"), infer, tmp_path / "results", man)


def test_run_checks_before_it_calls_and_before_it_promotes(spark, tmp_path):
    caps = {"cost_caps_usd": {"per_folio": 5, "per_run": 8}}
    man = tree(tmp_path, folios=[{"id": i, "manuscript": "m", "book": "b", "in_frozen_scope": True} for i in "ab"], **caps)
    folios, want = documents.folios(documents.manifest(spark, str(man))), spark.createDataFrame([("a",), ("b",)], "id string")
    usd = lambda a, b: spark.createDataFrame([("a", a), ("b", b), ("z", 99.0)], "id string, usd double")

    def never(_):
        raise AssertionError("called")

    for e in (usd(5.5, 1.0), usd(4.5, 4.0)):
        with pytest.raises(runs.BudgetExceeded):
            runs.run("x", folios, want, never, tmp_path / "results", man, estimates=e)
    needs = {"required": ["lines"]}
    with pytest.raises(ValueError, match="lines"):
        runs.run("x", folios, want, infer, tmp_path / "results", man, check=lambda d: schema.require(d, needs), estimates=usd(4.0, 4.0))
    assert not (tmp_path / "results/x").exists() and json.loads(man.read_text())["manifest_changelog"] == []
    stale = folios.withColumn("in_frozen_scope", F.lit(True)).unionByName(folios.limit(1).withColumn("id", F.lit("c")))
    with pytest.raises(runs.ScopeViolation):  # by the manifest as it stands, not by the table read before
        runs.run("x", stale, spark.createDataFrame([("c",)], "id string"), infer, tmp_path / "results", man)


def test_whole_runs_and_side_folders(tmp_path):
    man = tree(tmp_path)
    keep = lambda m: m
    with runs.Staging(tmp_path / "r", "x") as s:
        s.write("a", {"v": 1}, {"d": 1}, beside={"one.json": {}, "two.json": {}})
        s.promote("a", man, keep)
    assert sorted(p.name for p in (tmp_path / "r/x/a").iterdir()) == ["one.json", "two.json"]

    def fail(_):
        raise OSError("disk")

    with pytest.raises(OSError), runs.Staging(tmp_path / "r", "x") as s:
        s.write("a", {"v": 2}, beside={"three.json": {}})
        s.promote("a", man, fail)
    assert sorted(p.name for p in (tmp_path / "r/x/a").iterdir()) == ["one.json", "two.json"]  # as it was before
    assert [p.name for p in (tmp_path / "r/.in_progress/x/a").iterdir()] == ["three.json"]
    with pytest.raises(FileNotFoundError), runs.Staging(tmp_path / "r", "x") as s:
        s.promote("a", man, keep)
    with runs.Staging(tmp_path / "r", "y") as s:
        for f in "ab":
            s.write(f, {"f": f}, {"d": f})
        assert s.count() == 0
        s.promote_all()
        assert s.count() == 2 and len(list((tmp_path / "r/y/diagnostic").iterdir())) == 2
    assert not (tmp_path / "r/.in_progress/y").exists()


def test_attempts_are_charged_and_spaced():
    slept, charged, errors = [], [], [TimeoutError(), TimeoutError()]

    def call(request):
        if errors:
            raise errors.pop()
        return request["x"]

    go = lambda **k: runs.attempted(call, {"x": 7}, 0.5, charged.append, (TimeoutError,), sleep=slept.append, **k)
    assert go() == (7, 1.5) and slept == [2.0, 4.0] and charged == [0.5] * 3
    errors += [TimeoutError(), TimeoutError()]
    with pytest.raises(TimeoutError):
        go(attempts=2)
    errors[:] = [KeyError()]
    with pytest.raises(KeyError):
        go()

    def broke(_):
        raise runs.BudgetExceeded("cap")

    with pytest.raises(runs.BudgetExceeded):
        runs.attempted(call, {"x": 7}, 9.0, broke, (TimeoutError,))


def test_command(spark, tmp_path, capsys):
    man = tree(tmp_path)
    args = ["--manifest", str(man), "--results", str(tmp_path / "results"), "--baseline", "own"]
    assert registry.main(args, spark) == 1 and "LookupError" in capsys.readouterr().err
    assert registry.main([*args, "--target", "tests_infer:infer"], spark) == 1  # no such module
    registry.PREDICTORS["own"] = f"{__name__}:infer"
    assert registry.main(args, spark) == 0 and (tmp_path / "results/own/a.json").exists()
    assert registry.main([*args, "--folio", "z"], spark) == 1 and "ScopeViolation" in capsys.readouterr().err
    with pytest.raises(ValueError):
        registry.register("own", "other:x")
    assert registry.main([*args[:1], str(tmp_path / "none.json"), *args[2:]], spark) == 1
    with pytest.raises(SystemExit):
        registry.main([])


def test_caps_and_slots(spark, tmp_path):
    assert runs.cost_caps({"cost_caps_usd": {"per_folio": 5, "per_run": 30}}) == (5.0, 30.0)
    with pytest.raises(runs.BudgetExceeded):
        runs.cost_caps({"cost_caps_usd": {"per_run": 30}})
    d = spark.createDataFrame([("a",), (None,)], "s string")
    assert [r.x for r in d.select(runs.text_slot(lambda s: s + "!")(F.col("s")).alias("x")).collect()] == ["a!", None]
    man = tree(tmp_path)
    folios = documents.folios(documents.manifest(spark, str(man)))
    infer_lines = runs.line_slot(lambda folio: [{"line_id": folio["id"] + "1"}])
    assert runs.run("x", folios, spark.createDataFrame([("a",)], "id string"), infer_lines, tmp_path / "results", man) == 1
    assert json.loads((tmp_path / "results/x/a.json").read_text())["lines"] == [{"line_id": "a1"}]


def test_promotion_rolls_back(tmp_path):
    man = tree(tmp_path)

    def fail(_):
        raise OSError("disk")

    with pytest.raises(OSError):
        with runs.Staging(tmp_path / "results", "x") as s:
            s.write("a", {}, {"d": 1})
            s.promote("a", man, fail)
    assert not (tmp_path / "results/x/a.json").exists()
    assert (tmp_path / "results/.in_progress/x/a.json").exists() and (tmp_path / "results/.in_progress/x/diagnostic/a.gt_fed.json").exists()


def test_counts_and_changelog_limits():
    runs.check_counts({"expected_reports_per_baseline": {"x": 2}}, "x", 2)
    runs.check_counts({"expected_total_reports": 3}, "x", 3)
    for m in ({"expected_reports_per_baseline": {"x": 2}}, {"expected_reports_per_baseline": {"y": 1}, "expected_total_reports": 1}, {}):
        with pytest.raises(runs.CountMismatch):
            runs.check_counts(m, "x", 1)
    with pytest.warns(UserWarning):
        runs.bumped({"manifest_changelog": [{}] * 39}, "x", "a")
    with pytest.raises(OverflowError):
        runs.bumped({"manifest_changelog": [{}] * 49}, "x", "a")


def test_budget_and_replay(spark, tmp_path):
    calls = spark.createDataFrame([("r", "f", i, 2.0) for i in range(3)], "run string, folio string, at int, usd double")
    assert runs.within_budget(calls, 6.0, 6.0).count() == 3
    with pytest.raises(Exception, match="budget exceeded"):
        runs.within_budget(calls, 5.0, 100.0).collect()
    spent = v.running_budget(calls, ["folio"], "at", "usd", 3.0)
    assert tuple(v.first_breach(spent, ["folio"], "at").first()) == ("f", 1, 4.0)
    from lectio.functions.scalars import canonical_hash

    req = spark.createDataFrame([("1", '{"b": 1, "a": 2}')], "id string, request string")
    log = req.select(canonical_hash(F.col("request"), 64, compact=False).alias("prompt_hash"), F.lit("yes").alias("response"))
    assert runs.replayed(req.withColumn("request", F.lit('{"a":2,"b":1}')), log).first().response == "yes"
    with pytest.raises(Exception, match="not recorded"):
        runs.replayed(req.withColumn("request", F.lit("{}")), log).collect()
    (tmp_path / "i.txt").write_text("x")
    f = documents.files(spark, str(tmp_path))
    with pytest.raises(ValueError):
        runs.pinned(f, {"i.txt": "0"})
    runs.pinned(f, {"i.txt": "0"}, force=True)
