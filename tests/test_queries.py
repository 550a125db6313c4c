"""Every query of the catalogue that has SQL, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from lectio import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def normal(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    d = queries.QUERIES[name](spark, DATA)
    rows = normal(map(tuple, d.collect()))
    if name in queries.SQL:
        rel = con.sql(queries.SQL[name])
        order = [rel.columns.index(c) for c in d.columns]
        assert sorted(rel.columns) == sorted(d.columns)
        assert rows == normal(tuple(r[i] for i in order) for r in rel.fetchall())
    else:
        assert d.columns and rows is not None


def test_entry_needs_no_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['lectio.llm'] = None; import __spark_entry__ as e; assert 'cer_panel' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def plain_cost(g, p, same):
    """Cost of the best alignment of two sequences, whole table."""
    row = [0]
    for y in p:
        row.append(row[-1] + same("", y))
    for x in g:
        new = [row[0] + same(x, "")]
        for j, y in enumerate(p):
            new.append(min(row[j] + same(x, y), row[j + 1] + same(x, ""), new[j] + same("", y)))
        row = new
    return row[-1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    import unicodedata

    texts = ["Été à l’œuvre,\nçà et là", "Ete a l'oeuvre, \u00e7a et la\n", "日本\nе\u0301 n\u0303o", "nio\u034f é", "", "a\n\nb", "ab", "שָׁלוֹם"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def clusters(t):  # of these texts: a base and the marks after it
        out = []
        for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", t.replace("\u034f", ""))):
            if unicodedata.combining(c):
                out[-1] += c
            else:
                out.append(c)
        return out

    letters = lambda a, b: plain_cost(a, b, lambda x, y: int(x != y))
    want = {}
    for (_, turn, role, gt), (*_, pred) in zip(rows, rows[1:], strict=False):
        g, p = clusters(gt), clusters(pred)
        want[turn] = (role, plain_cost(g, p, letters), len("".join(g)))
    got = {r.turn: r for r in queries.cer_pairs_whole(spark, str(tmp_path)).collect()}
    assert {k: (r.edits, r.denominator) for k, r in got.items()} == {k: v[1:] for k, v in want.items()}
    folded = {r.turn: r.denominator for r in queries.cer_pairs(spark, str(tmp_path)).collect()}
    assert folded[2] == len(texts[2]) and got[2].denominator == len("日本") + 1 + len("е\u0301 n\u0303o")
    panel = {r.stratum: (r.edits, r.denominator, r.n) for r in queries.cer_panel_whole(spark, str(tmp_path)).collect()}
    for s in ("user", "assistant", "overall"):
        own = [v for v in want.values() if s in (v[0], "overall")]
        assert panel[s] == (sum(v[1] for v in own), sum(v[2] for v in own), len(own))
