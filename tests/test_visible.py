import pytest

from lectio.functions.visible import seen

#: What renders to nothing.
NOTHING = [
    "", "<!-- a note -->", "<!-- open to the end", "<!-- a --> <!-- b", "<!-->x-->", "<b></b>", "<br/>", "</p >", '<a href="/x">', "<script>let x = 1</script>", "<SCRIPT src=a>1 < 2</script >",
    "<style>p { color: red }", "<template><b>x</b></template>", "&nbsp;", "&#160;", "&#8203;", "&zwnj;&#x200b;", "\u200b", "\u2060\ufeff", "\xa0", "\u0301\u05b8", "\x01",
    "[a]: https://example.org", "[a]: https://x.org\n[b]: https://y.org", '[a]: /x "title"', "[a]: /x 'title'", '[a]: /x\n    "title"', "[a]: /x\n\t(title)", "[a]: <b c>", '   [a]: <b c> "t"', "[a]: <open",
    "<!-- x -->[a]: /x <!-- y -->", "[]()", "[](/x)", "![](x)", "[][a]", "![ \t][a]", "[\u200b](/x)", "![\u0301](x)", "[&#8203;](x)",
]
#: (text, what is seen of it).
SEEN = [
    ("Real. <!-- open", "Real. "), ("<!-- a -->Real", "Real"), ("&lt;!-- kept --&gt;", "<!-- kept -->"), ("<https://example.org>", "<https://example.org>"), ("a < b > c", "a < b > c"), ("<1>", "<1>"),
    ("a <em>word</em>", "a word"), ("[text](/x)", "[text](/x)"), ("[]: x", "[]: x"), ("[]{}()", "[]{}()"), ("    [a]: /x", "    [a]: /x"), ("say [a]: /x", "say [a]: /x"), ("[a]: /x and more", "[a]: /x and more"),
    ("[a]: /x\n\"t\"", '\n"t"'), ("[a]: /x\n  \"t\" more", '\n  "t" more'), ("Said.\n\n[a]: /x", "Said.\n\n"), ("\u05d1\u05b8\u05e8", "\u05d1\u05e8"), ("a\xa0b\u2003c", "a b c"), ("<scripture>x", "x"), ("<span title=\"a>b\">c", 'b">c'),
    ("[](a(b)c)", "c)"), ("![alt](x)", "![alt](x)"), ("!x", "!x"), ("a\tb\r\nc", "a\tb\r\nc"), ("<script", "<script"), ("<b", "<b"), ("x<b <i>y", "x<b y"),
]


@pytest.mark.parametrize("text", NOTHING)
def test_nothing_is_seen(text):
    assert seen(text).strip() == ""


@pytest.mark.parametrize(("text", "want"), SEEN)
def test_seen(text, want):
    assert seen(text) == want


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for part in ("<!-- ", "<b ", "[", "[a]: ", "![", "<script>", "< ", "[a]: <"):
        seen(part * 20_000)
    assert time.time() - began < 60


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a &amp b", "a &amp b"), ("R&ampD", "R&ampD"), ("&copy 2020 &copy;", "&copy 2020 ©"), ("&notit; &not;", "&notit; ¬"), ("&ampamp;", "&ampamp;"), ("&#160 &#xA0 &#65;&#x42;", "&#160 &#xA0 AB"), ("&amp;lt;", "&lt;"),
        (f"&#{'1' * 5000};", f"&#{'1' * 5000};"), ("&unknown; &;", "&unknown; &;"),
    ],
)
def test_a_reference_ends_with_its_semicolon(text, want):
    assert seen(text) == want


def test_a_page_with_an_open_reference_is_its_sql(spark, tmp_path):
    """Titles are cut at a length, so that a page's reference can lose its semicolon."""
    import duckdb

    from lectio import queries

    pages = ["<title>R&amp;D &amp</title><p>x &lt y &copy</p>", "<p>&amp;amp; &middot &middot;</p>", "<p>plain</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, queries.queries()["visible_pages"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(queries.oracle_sql()["visible_pages"]).fetchall())
