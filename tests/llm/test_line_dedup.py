import random

from lectio.llm import line_dedup as ld


def brute(rows):
    """Chunks by chunks(), removed wherever an earlier place has the same bytes."""
    first = {}
    for d, t in rows:
        lines = (t or "").encode().split(b"\n")
        for i, j in ld.chunks((t or "").encode()):
            if d is not None and j - i >= ld.LEAST:
                k = b"\n".join(lines[i:j])
                first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, t in rows:
        lines, gone = (t or "").encode().split(b"\n"), set()
        for i, j in ld.chunks((t or "").encode()):
            k = b"\n".join(lines[i:j])
            if d is not None and j - i >= ld.LEAST and first[k] != (d, i):
                gone.update(range(i, j))
        out.append((d, b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode(), len(lines), len(gone)))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(2)
    line = lambda: " ".join(r.choice("abcdef") * 3 for _ in range(4)) + str(r.randrange(10**6))
    shared = [line() for _ in range(40)]
    rows = []
    for i in range(60):
        own = [line() for _ in range(r.randrange(12))]
        if i % 2:
            at = r.randrange(len(own) + 1)
            own[at:at] = shared[r.randrange(5) :]
        rows.append((i, "\n".join(own)))
    return rows + [(100, None), (101, ""), (102, rows[1][1]), (103, "x\n" * 500), (None, rows[1][1]), (104, "one line"), (105, "one line")], shared


def test_against_a_table_of_chunks(spark):
    rows, shared = corpus()
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, h string, tag int").repartition(4)
    got = ld.remove_repeated_chunks(d, carry=("h", "tag"), buckets=1 << 10)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed", "h", "tag"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == brute(rows)
    # a shared passage survives shifts: all places but the first lose most of it
    lost = sum(r.n_removed for r in got.collect() if r.doc_id is not None and r.doc_id < 60)
    assert lost > 0.8 * 29 * 35


def test_chunks_cover_lines_in_order():
    r = random.Random(0)
    for n in (1, 2, 3, 200):
        text = "\n".join(str(r.randrange(10**9)) for _ in range(n)).encode()
        got = ld.chunks(text)
        assert [x for i, j in got for x in range(i, j)] == list(range(n))
        assert all(j - i <= ld.MOST for i, j in got) and all(j - i >= ld.LEAST for i, j in got[:-1])


def test_repeated_rows_and_no_rows(spark):
    d = spark.createDataFrame([(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in ld.remove_repeated_chunks(d, buckets=1 << 10).collect()) == [(1, 0), (1, 0), (2, 0)]
    assert ld.remove_repeated_chunks(d.where("false"), buckets=1 << 10).count() == 0


def brute_runs(rows):
    """Lines in two lines with text that an earlier place has too, blank lines between them included."""

    def pairs(lines):
        full = [i for i, x in enumerate(lines) if x.strip()]
        return [(i, j + 1) for i, j in zip(full, full[1:], strict=False)]

    first = {}
    split = [(d, (t or "").split("\n")) for d, t in rows]
    for d, lines in split:
        for i, j in pairs(lines) if d is not None else ():
            k = tuple(lines[i:j])
            first[k] = min(first.get(k, (d, i, j)), (d, i, j))
    out = []
    for d, lines in split:
        gone = set()
        for i, j in pairs(lines) if d is not None else ():
            e, _, end = first[tuple(lines[i:j])]
            if e != d or i >= end:
                gone.update(range(i, j))
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=repr)


def test_runs_are_those_of_all_pairs_of_lines(spark):
    rows, _ = corpus()
    rows += [(200, "a b\n\nc d\n\ne f"), (201, "\nc d\n\n\n\ne f\n\nx"), (202, "g\n\nc d\n\ne f\n\nh"), (203, "c d\n\ng"), (204, "p\nq\np\nq\np\nq"), (205, "y\ny\ny"), (206, "y\ny")]
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, h string, tag int").repartition(4)
    got = ld.remove_repeated_runs(d, carry=("h", "tag"), buckets=1 << 10)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed", "h", "tag"]
    got = {r.doc_id: r for r in got.collect()}
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.values()), key=repr) == brute_runs(rows)
    assert [got[i].text for i in (203, 204, 205, 206)] == ["c d\n\ng", "p\nq", "y\ny\ny", ""]
    assert got[103].text == "x\nx\n" and got[202].text == "g\n\n\nh"
    # every line keeps a place
    assert {x for _, t in rows for x in (t or "").split("\n")} == {x for r in got.values() if r.doc_id is not None for x in r.text.split("\n")}


def test_every_short_passage_between_unlike_lines_goes(spark):
    r = random.Random(5)
    line = lambda: f"{r.randrange(10**12)} {r.randrange(10**12)}"
    rows, want = [], {}
    for n in range(2, 11):
        for k in range(20):
            passage = [line() for _ in range(n)]
            for d in (1000 * n + k, 1000 * n + 500 + k):
                before, after = ([line() for _ in range(r.randrange(1, 6))] for _ in range(2))
                rows.append((d, "\n".join(before + passage + after)))
                want[d] = n if d % 1000 >= 500 else 0
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.n_removed for x in ld.remove_repeated_runs(d, buckets=1 << 10).collect()} == want


def test_runs_come_by_chunks_and_two_lines_only_where_these_leave_some(spark):
    """Chunks find what lies in them; two lines are looked for outside of later places of chunks alone, and nothing is lost."""
    from pyspark.sql import functions as F

    rows, _ = corpus()
    rows += [(i, "\n\nu 1\n\n \nv 2\n\n" * (i % 3)) for i in range(300, 306)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by_chunk, rest = ld.repeated(d, (ld.text_chunks, ld.windows), buckets=1 << 10)
    lines = {i: (t or "").split("\n") for i, t in rows if i is not None}
    chunks_, rest = ([(r.doc_id, r.i, r.j) for r in x.collect()] for x in (by_chunk, rest))
    assert all((i, j) in ld.text_chunks([x.encode() for x in lines[d]])[0] for d, i, j in chunks_)
    gone = lambda spans: {(d, k) for d, i, j in spans for k in range(i, j)}
    assert not any(d == e and i <= a and b <= j for d, i, j in chunks_ for e, a, b in rest)
    want = {(d, n) for d, _, _, n in brute_runs(rows) if d is not None}
    assert {(d, sum(x == d for x, _ in gone(chunks_ + rest))) for d in lines} == want
    assert len(gone(chunks_)) > len(gone(rest)) > 0


def test_the_pipelines_lines_come_by_chunks(spark, monkeypatch):
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(ld, "repeated", lambda docs, ways, *more, f=ld.repeated: (asked.append(ways), f(docs, ways, *more))[1])
    rows, _ = corpus()
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, d, "").collect() if r.doc_id is not None}
    assert asked == [(ld.text_chunks, ld.windows)]
    assert got == {d: t for d, t, _, n in brute_runs(rows) if d is not None and (not n or t.strip())}
