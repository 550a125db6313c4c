import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectio.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ODD = ["", " ", "  a", "a  b", " a\n b", "a\n\n b ", "\n\n", "a b\n", "x\x1fy z", "<|endoftext|> a", "a <|endoftext|>", "it's  we'll I'm 'tis", "日本 語 テ", "tab\tsep a", "a\r\nb c", "Été çà 12 345,67 %%% || ñandú!", "a\xa0b c", "é é x​ y", "👍🏽 ok 👨‍👩‍👧"]


def test_ids_are_the_tokenizer_s(plain):
    t = bpe.ByteBPE(bpe.default_path())
    r = random.Random(0)
    some = [" ".join(r.choice(["the", "Thé,", "of.", "x\ny", "über", "1234", "%%", "日本", "don't", "a" * 60, "\x7f", "×÷", "\t", "_a-b"]) for _ in range(r.randrange(60))) for _ in range(60)]
    every = [bytes([b]).decode("latin-1") * n + " a" for b in range(256) for n in (1, 2, 3)]
    texts = [*ODD, *some, *every, "a" * 5000, " " * 300 + "b"]
    assert t.ranked is not None
    want = [plain(s) for s in texts]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in t.ids(texts)] == want
    t.ranked = None
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in t.ids(texts)] == want


@pytest.mark.parametrize("parts,merge", [(1, 64), (6, 64), (6, 2)])
def test_each_token_lies_in_one_piece(spark, plain, parts, merge):
    r = random.Random(parts)
    texts = [*ODD, None, "word " * 3000, *[" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(300))) for _ in range(60)]]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(parts)
    got = packing.pack(d, size=128, merge_partitions=merge, derive={"ids_crc32": F.crc32}).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.length == len(p.ids) // 4 > 0
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert sorted(pieces) == [i for i, _, _ in rows]
    for i, t, _ in rows:
        own = sorted(pieces[i], key=lambda p: p.start)
        ids = [*plain(t or ""), 0]
        assert b"".join(bytes(p.ids) for p in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert all(p.doc_tokens == len(ids) for p in own)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        n = sum(p.length for p in s)
        assert n <= 128 and n & (n - 1) == 0  # full windows and powers of two: no padding


def plain_packing(pieces, size, most):
    """Windows one by one, by looking at all that are open: (number, pieces) in the order in which they close, and the rest."""
    windows, closed, made = {}, [], 0
    room = lambda w: size - sum(len(p[2]) // 4 for p in windows[w])
    for doc, ids in pieces:
        start, total = 0, len(ids) // 4
        while ids:
            n = len(ids) // 4
            fits = [w for w in windows if room(w) >= n]
            if n >= size:
                w, take = made, size
            elif fits:
                w, take = min(fits, key=lambda x: (room(x), x)), n
            elif len(windows) < most:
                w, take = made, n
            else:
                w = min(windows, key=lambda x: (room(x), x))
                take = room(w)
            if w == made:
                windows[w], made = [], made + 1
            windows[w].append((doc, start, ids[: 4 * take], total))
            start, ids = start + take, ids[4 * take :]
            if not room(w):
                closed.append((w, windows.pop(w)))
    return closed, windows


@pytest.mark.parametrize("most", [1, 2, 16])
def test_windows_are_those_of_a_plain_best_fit(most):
    r = random.Random(most)
    for _ in range(30):
        pieces = [(i, bytes(4 * r.choice([1, 2, 3, 5, 9, 16, 31, 32, 33, 70]))) for i in range(r.randrange(80))]
        w = packing.Windows(32, most, 0)
        for doc, ids in pieces:
            w.add(doc, 0, ids, len(ids) // 4)
        assert (w.take(), w.inside) == plain_packing(pieces, 32, most)


def test_rows_of_a_null_doc_id_are_documents(spark):
    d = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    got = packing.pack(d, keep_ids=False, derive={"c": F.crc32}).where("start = 0").collect()
    assert sorted(((r.doc_id, r.doc_tokens) for r in got), key=repr) == [(1, 3), (None, 1), (None, 3)]
    from lectio.llm import lengths

    assert sorted(((r.doc_id, r.n_tokens) for r in lengths.token_lengths(d).collect()), key=repr) == [(1, 2), (None, 0), (None, 2)]


def test_without_ids_and_without_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = packing.pack(d, keep_ids=False, derive={"c": F.crc32})
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "c"]
    assert sorted((r.doc_id, r.doc_tokens) for r in got.where("start = 0").collect()) == [(1, 3), (1, 3), (2, 1)]
    assert packing.pack(d.where("false")).count() == 0


def test_very_long_runs_of_white_space(plain):
    t = bpe.ByteBPE(bpe.default_path())
    for s in (" " * 2_000_000, "a" + "\n" * 1_200_000 + "b"):
        assert t.ids([s, "a b"]) == [struct.pack(f"<{len(x)}I", *x) for x in (plain(s), plain("a b"))]


def test_queries_encode_added_tokens_as_the_file_does(spark, tmp_path):
    import corpus_pipeline
    from lectio.llm import queries

    as_loaded = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [*ODD, "a<|endoftext|><|endoftext|>b", "<|endoftext", "é <|endoftext|> 日本"]
    want = [as_loaded.encode(s, add_special_tokens=False).ids for s in texts]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in bpe.ByteBPE(bpe.default_path(), added=True).ids(texts)] == want
    assert any(50256 in x for x in want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op2_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.doc_tokens for r in got.collect()} == {i: len(x) + 1 for i, x in enumerate(want)}
    table = queries.op10_token_counts(spark, str(tmp_path)).collect()
    assert sum(r.n_tokens * r.n_docs for r in table) == sum(map(len, want))
