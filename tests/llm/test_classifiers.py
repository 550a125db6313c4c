import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.llm import language, quality, toxicity

STEMS = {"en": ["the", "ing", "wh", "tion", "ough"], "de": ["der", "ung", "sch", "keit", "ein"], "fr": ["eau", "oux", "que", "ment", "les"], "es": ["cion", "ando", "los", "mente", "ñ"], "xx": ["kz", "zzq", "qk", "kkz", "zk"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages_of_held_out_documents(spark):
    r = random.Random(0)
    rows = [(i, prose(r, k, r.randrange(5, 60)), k, 1) for i, k in enumerate(list(STEMS) * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.fit(d.where("doc_id % 3 > 0"))
    assert model.families == ["germanic", "romance", "xx"] and set(model.pairs) == {("de", "en"), ("es", "fr")}
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !!"), (-4, "the " * 20_000)], "doc_id long, text string")
    got = {x.doc_id: x for x in language.identify(d.select("doc_id", "text").where("doc_id % 3 = 0").unionByName(odd), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (-1, -2, -3)) and got[-4].lang_pred in ("en", "fr")
    right = [got[i].lang_pred == k for i, _, k, _ in rows if i % 3 == 0]
    assert np.mean(right) > 0.97 and all(0 <= x.score <= 1 for x in got.values())
    assert language.fit(d.where("false")) is None
    assert {x.lang_pred for x in language.identify(odd, None).collect()} == {"und"}
    one = language.fit(d.where("lang = 'en'"))
    assert {x.lang_pred for x in language.identify(d.select("doc_id", "text"), one).collect()} == {"en"}
    assert language.identify(d.where("false"), model).count() == 0


def test_grades_of_held_out_documents(spark):
    r = random.Random(1)
    words = {0: ["junk", "###", "buy"], 1: ["fair", "so", "ok"], 2: ["fine", "clear", "sound"]}
    text = lambda g: " ".join(r.choice(words[g]) if r.random() < 0.5 else r.choice(["the", "of", "a"]) for _ in range(30))
    rows = [(i, text(i % 3), i % 3) for i in range(360)]
    d = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit(d.drop("grade"), d.where("doc_id % 4 > 0").drop("text"))
    assert list(model.grades) == [0, 1, 2] and model.theta[0] < model.theta[1]
    held = d.where("doc_id % 4 = 0").unionByName(spark.createDataFrame([(-1, None, None), (-2, "", None)], d.schema))
    got = {x.doc_id: x for x in quality.grade(held, model, at_least=1).collect()}
    assert all(abs(got[i].expected_grade - g) < 0.75 for i, _, g in rows if i % 4 == 0)
    assert all(got[i].selected == (g > 0) for i, _, g in rows if i % 4 == 0)
    assert all(x.tails[0] >= x.tails[1] and x.tail_probability == x.tails[0] for x in got.values())
    assert got[-1].expected_grade == got[-2].expected_grade
    top = quality.grade(held, model, at_least=2).where("selected").count()
    assert 20 <= top <= 40
    assert quality.fit(d, d.where("false").drop("text")) is None and quality.grade(held, None).where("selected").count() == 0
    one = quality.fit(d, d.where("grade = 2").drop("text"))
    assert {x.expected_grade for x in quality.grade(held, one).collect()} == {2.0}


def test_gradients_are_the_numeric_ones():
    r = np.random.default_rng(0)
    net = toxicity.Network(1)
    x = r.standard_normal((7, toxicity.WIDTH)).astype(np.float32)
    idx = r.integers(0, 7, (5, 6))
    mask = np.ones((5, 6), np.float32)
    mask[1, 4:] = mask[2, :] = 0
    y = np.array([1, 0, 1, 0, 1], np.float32)

    def loss():
        z = net.run(x @ net.p["x"] + net.p["bx"], idx, mask).astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    g, dx = net.grads(x, idx, mask, y, np.float32(1))
    for name, v, d in [*((k, net.p[k], g[k]) for k in net.p), ("input", x, dx)]:
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in v.shape)
            old, step = v[at], np.float32(3e-2)
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert d[at] == pytest.approx((up - down) / (2 * step), abs=2e-3, rel=3e-2), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        s = toxicity.windows(n)
        seen = {x for a in s for x in range(a, min(n, a + toxicity.WINDOW))}
        assert seen == set(range(n)) and len(s) >= 1


def test_toxic_stems_are_found_in_held_out_documents(spark):
    r = random.Random(2)
    bad = lambda: r.choice(["slurry", "vexkor"]) + r.choice(["", "a", "en", "ito", "xyz"])

    def text(k):
        w = prose(r, "en", r.randrange(10, 150)).split()
        for _ in range(3 * k):
            w[r.randrange(len(w))] = bad()
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    net = toxicity.fit(d, d.where("doc_id % 5 > 0").drop("text"), epochs=6)
    odd = spark.createDataFrame([(-1, None, 0), (-2, "", 0), (-3, "the " * 30_000 + "slurryq vexkorq slurryen", 1)], d.schema)
    got = {x.doc_id: x.score for x in toxicity.score(d.where("doc_id % 5 = 0").unionByName(odd), net).collect()}
    assert all((got[i] >= 0.5) == bool(k) for i, _, k in rows if i % 5 == 0)
    assert got[-3] >= 0.5 and got[-1] == got[-2] < 0.5
    assert toxicity.fit(d, d.where("label = 0").drop("text")) is None
    assert {x.score for x in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.score(d.where("false"), net).count() == 0


def test_fit_sample_is_bounded(spark):
    from lectio.llm.features import sample

    d = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("k"))
    got = sample(d, F.col("k"), 50).groupBy("k").count().collect()
    assert sum(x["count"] for x in got) <= 150 and min(x["count"] for x in got) > 20


def test_a_sample_has_every_class_and_no_more_than_its_bound(spark):
    from lectio.llm import features

    rows = [(i, f"k{i}") for i in range(1001)] + [(2000 + i, "big") for i in range(5000)] + [(9000 + i, None) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, lang string")
    got = [r.lang for r in features.sample(d, F.col("lang"), 800, 3000).collect()]
    assert set(got) == {x for _, x in rows if x} and len(got) <= 3000
    few = [r.lang for r in features.sample(d, F.col("lang"), 800, 500).collect()]
    assert len(few) == 500  # more classes than rows allowed
    two = [r.lang for r in features.sample(d.where("doc_id >= 1000"), F.col("lang"), 800).collect()]
    assert two.count("k1000") == 1 and 600 < two.count("big") < 1000
    assert features.sample(d.where("false"), F.col("lang"), 5).count() == 0


def test_signs_that_are_no_letters_have_no_language(spark):
    from lectio.llm import language

    r = random.Random(0)
    words = {"en": ["the", "with", "thing"], "de": ["der", "und", "nicht"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["en", "de"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "\u2167 12"), (3, "_"), (4, None), (5, ""), (6, "the"), (None, "und")], "doc_id long, text string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(odd, language.fit(docs)).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(1, 6)) and got[6][0] == "en" and got[None][0] == "de"


def test_long_labelled_texts_stay_out_of_the_toxicity_fit(spark):
    from lectio.llm import features

    docs = spark.createDataFrame([(1, "a" * 100), (2, "b" * 5), (3, None), (4, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1)], "doc_id long, label int")
    assert [bytes(x.text) for x in features.sampled_texts(docs, labels, "label", 10, most_bytes=50).collect()] == [b"bbbbb"]
    assert features.sampled_texts(docs, labels, "label", 10).count() == 2
