import random

import pytest

from lectio.llm import lengths

pytest.importorskip("public_tokenizers")


def test_histogram_answers_every_limit(spark):
    r = random.Random(1)
    texts = [None, "", "a", *[" ".join("tok" for _ in range(r.choice([3, 3, 50, 5000, 9000]))) for _ in range(40)]]
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    per = lengths.token_lengths(d).persist()
    n = sorted(x.n_tokens for x in per.collect())
    from lectio.llm import bpe

    assert n == sorted(len(x) // 4 for x in bpe.load(bpe.default_path()).ids([t or "" for t in texts]))
    table = lengths.length_table(per).persist()
    for row in table.collect():
        k = row.n_tokens
        assert (row.n_docs, row.tokens) == (n.count(k), k * n.count(k))
        assert (row.docs_ge, row.tokens_ge, row.docs_le) == (sum(x >= k for x in n), sum(x for x in n if x >= k), sum(x <= k for x in n))
        assert row.truncated_total == sum(min(x, k) for x in n) and row.share_le == pytest.approx(row.docs_le / len(n))
    for q in (0.1, 0.5, 0.9, 1.0):
        assert lengths.quantile(table, q).first().n_tokens == next(x for i, x in enumerate(n, 1) if i / len(n) >= q)
    for limit in (0, 1, 2, 60, 5000, 10**6):
        assert lengths.truncated_total(table, limit).first().total == sum(min(x, limit) for x in n)
    assert lengths.length_table(per.where("false")).count() == 0
