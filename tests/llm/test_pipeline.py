import glob
import os
import random

import duckdb
import pytest

import corpus_pipeline
from lectio.llm import language, line_dedup, ngram_join, queries, tiling

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
pytest.importorskip("public_tokenizers")


def corpus(spark, tmp_path):
    r = random.Random(0)
    words = {"en": ["the", "ing", "ough", "with"], "de": ["der", "ung", "sch", "ein"]}
    text = lambda k, n: "\n".join(" ".join(r.choice(words[k]) + r.choice(words[k]) + str(r.randrange(50)) for _ in range(12)) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [(i, text("en" if i % 2 else "de", 6), "en" if i % 2 else "de", "s", 1) for i in range(80)]
    near = rows[3][1].replace("\n", " ")
    rows += [(100, rows[5][1], "en", "s", 1), (101, near, "en", "s", 1), (102, near + " x", "en", "s", 1), (103, "123 456", "en", "s", 1), (104, None, None, None, None), (105, text("en", 2) + "\n" + item, "en", "s", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).persist()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept.append({x.doc_id: x.text for x in docs.collect()})
    every = {x[0] for x in rows}
    lang, lines, near, clean = kept
    assert every - set(lang) == {103, 104}
    assert set(lang) - set(lines) == {100}  # all of it stands in document 5
    assert set(lines) - set(near) == {101, 102}  # document 3, the smallest of the class of near copies, stays
    assert set(near) - set(clean) == {105}
    assert {x.doc_id for x in docs.select("doc_id").distinct().collect()} == set(clean)
    run = corpus_pipeline.run(spark, str(tmp_path))
    whole = lambda d: {(x.doc_id, x.doc_tokens) for x in d.collect()}
    assert whole(run) == whole(docs)


def test_each_stage_is_its_operator(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    f = dict(corpus_pipeline.STAGES)
    ids = lambda d: {x.doc_id for x in d.select("doc_id").collect()}
    pred = language.identify(docs, language.fit(docs))
    assert ids(f["language_id"](spark, docs, "")) == {x.doc_id for x in pred.collect() if x.lang_pred != "und" and x.score >= corpus_pipeline.LEAST_SCORE}
    cut = {x.doc_id: x.text for x in line_dedup.remove_repeated_chunks(docs).collect() if not x.n_removed or x.text.strip()}
    assert {x.doc_id: x.text for x in f["line_dedup"](spark, docs, "").collect()} == cut
    low = ngram_join.ngram_join(docs, 5, 80, 100)
    assert ids(f["ngram_join"](spark, docs, "")) == {x.doc_id for x in low.collect() if x.doc_id == x.component_id}
    dirty = tiling.tile_documents(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert ids(f["decontamination"](spark, docs, str(tmp_path))) == {x.doc_id for x in dirty.collect() if not x.contaminated}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    d = queries.queries()[name](spark, DATA)
    rel = con.sql(queries.SQL[name])
    order = [rel.columns.index(c) for c in d.columns]
    assert sorted(map(tuple, d.collect())) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())


def test_rows_of_a_null_doc_id_pass_the_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path / "a")
    whole = spark.read.parquet(f"{tmp_path}/a/documents.parquet").unionByName(spark.createDataFrame([(None, rows[3][1], "en", "s", 1)], COLUMNS))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert None in got and 3 in got and 101 not in got


def test_one_row_of_each_class_stays(spark):
    r = random.Random(3)
    a, b, c = (" ".join(str(r.randrange(10**6)) for _ in range(40)) for _ in range(3))
    # 1 has a, twice, and b; 2 has b and a near copy of a; 3 has c twice and a copy of c; no class for the rest
    rows = [(1, a), (1, a), (1, b), (2, b), (2, a + " x"), (3, c), (3, c), (3, c + " y"), (4, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], COLUMNS).repartition(3)
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert [x for x in got if x[1] in (c, c + " y")] in ([(3, c)], [(3, c + " y")])
    assert sorted((x for x in got if x[0] != 3), key=repr) == sorted([(1, a), (1, b), (4, None), (None, a), (None, a)], key=repr)


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    corpus(spark, tmp_path / "a")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_last_table_of_a_run_stays(spark, tmp_path):
    from lectio.llm import common

    corpus(spark, tmp_path)
    before = common.tables()
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert common.tables() - before == {run.table_path} and run.count() > 0


def test_a_cluster_must_name_its_shared_folder():
    from lectio.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_a_run_is_its_plain_version(spark, tmp_path):
    """All five stages by loops over rows, on what the one before kept."""
    import zlib

    import numpy as np
    import tokenizers
    from test_line_dedup import brute_runs
    from test_ngram_join import brute

    from lectio.llm import bpe, features

    rows = corpus(spark, tmp_path)
    model = language.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    texts = [(i, t) for i, t, *_ in rows]
    langs, scores = model.predict(np.stack([features.byte_grams((t or "").encode(), language.SIZE) for _, t in texts]))
    texts = [x for x, s in zip(texts, scores, strict=True) if x[1] and any(map(str.isalpha, x[1])) and s >= corpus_pipeline.LEAST_SCORE]
    texts = [(d, t) for d, t, _, gone in brute_runs(texts) if not gone or t.strip()]
    texts = [x for x in texts if x[0] in {d for d, _, low in brute(texts, 5, 80, 100) if d == low}]
    words = lambda t: tiling.Hashes().of(tiling.tokens(t))
    item = words(spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text)
    texts = [(d, t) for d, t in texts if sum(k for *_, k in tiling.tile(item, words(t), tiling.SEED)) < tiling.COVERAGE * len(item)]
    tok = tokenizers.Tokenizer.from_file(bpe.default_path())
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in texts}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in got} == set(ids) and len(ids) > 50
    for d, own in ids.items():
        pieces = sorted((p for p in got if p.doc_id == d), key=lambda p: p.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(own) == pieces[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(np.asarray(own[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)


#: Names that operators, joins and windows use themselves, and some that need quoting.
CLASHING = ["n_removed", "n_lines", "_id", "_tag", "_row", "tag", "mark", "payload", "c0", "_others", "class", "a`b.c", "DOC_ID2", "score"]


def with_clashing_columns(docs):
    from pyspark.sql import functions as F

    extra = [F.concat(F.lit(f"{i}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for i, c in enumerate(CLASHING)]
    return docs.select(F.create_map(F.lit("k"), F.col("doc_id")).alias("kv"), *extra, *docs.columns, F.struct(F.col("doc_id").alias("x`y")).alias("text2"))


def test_stages_take_any_other_columns(spark, tmp_path):
    rows = corpus(spark, tmp_path / "a")
    plain = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    docs = with_clashing_columns(plain.unionByName(plain.where("doc_id in (3, 5, 104)")).unionByName(spark.createDataFrame([(None, rows[7][1], "en", "s", 1)] * 2, COLUMNS)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, want = stage(spark, docs, str(tmp_path)), stage(spark, docs.select(*COLUMNS_OF), str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = out.collect()
        assert sorted(map(str, ((x.doc_id, x.text, x.n_chars) for x in got))) == sorted(map(str, ((x.doc_id, x.text, x.n_chars) for x in want.collect())))
        for x in got:
            assert x["a`b.c"] == f"{CLASHING.index('a`b.c')}/{'-' if x.doc_id is None else x.doc_id}" and x.kv == {"k": x.doc_id} and x.text2[0] == x.doc_id
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {None, 3}


COLUMNS_OF = ["doc_id", "text", "lang", "source", "n_chars"]
