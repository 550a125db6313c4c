"""Edition XML: an ordered child scan of every verse, then relational reading of qere, joins and marks.

Spark reads a document in byte ranges, cut into records at each verse's end, so that a worker holds a batch of verses. What a
range begins in (a book, a chapter, a comment) follows from the ranges before it: a first pass tells what each range makes
of whatever it may begin in, a row a range, and following those rows gives every range its beginning.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.functions import views

EVENTS = "path string, ref string, seq int, pos int, tag string, text string, codes array<string>"
EVENT_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
#: Rows that a worker gives out at once.
AT_ONCE = 20_000
READ = ("w", "k", "q", *cp.MARKER_TAGS)
END = "</v>"
#: What begins a part without markup, and what ends it.
OPAQUE = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}
#: What a range may begin in: markup, or a part that ends so.
BEGINS = (None, *OPAQUE.values())
TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<\?|<(?P<closing>/?)(?P<tag>book|names|name|c|v)(?=[\s/>])(?:[^<>"']|"[^"]*"|'[^']*')*>""")
#: Ranges whose beginnings go through the driver and are broadcast, some 100 bytes each; more meet their texts in a shuffle.
MOST_RANGES = 500_000
UNSEEN = object()


class Scan:
    """Where a reader of records stands: book and chapter, and the end of the comment or the like that it is in."""

    def __init__(self, closer: str | None = None, book=UNSEEN, chapter=UNSEEN):
        self.closer, self.book, self.chapter = closer, book, chapter

    def verses(self, record: str, strict: bool) -> Iterator[str]:
        """Each verse's XML. A part without markup that holds a verse's end is read over, unless it lies in a verse."""
        record += END
        at, begun, named = 0, None, False
        while True:
            if self.closer:
                end = record.find(self.closer, at)
                if end < 0:
                    if strict and (begun is not None or named):
                        raise ValueError("a comment in a verse or in a book's names holds the end of a verse")
                    return
                at, self.closer = end + len(self.closer), None
            token = TOKEN.search(record, at)
            if token is None:
                return
            at, tag, closing, empty = token.end(), token["tag"], token["closing"], token[0].endswith("/>")
            if tag is None:
                self.closer = OPAQUE[token[0]]
            elif begun is not None:
                if tag == "v" and closing:
                    yield record[begun:at]
                    begun = None
            elif tag == "v" and empty:
                yield token[0]
            elif tag == "v":
                begun = None if closing else token.start()
            elif tag == "c":
                self.chapter = None if closing or empty else (ET.fromstring(token[0][:-1] + "/>").get("n") or "")
            elif tag == "book":
                self.book, self.chapter = (None if closing or empty else ""), None
            elif tag == "names":
                named = not (closing or empty)
            elif named and not closing and not empty and not self.book:
                self.book = (ET.fromstring(record[token.start() : record.index("</name", at)] + "</name>").text or "").strip()


def _spoken(el: ET.Element) -> str:
    """Text of a word, its children's text and what follows them; a code's own text isn't part of the word."""
    out = [el.text or ""]
    for child in el:
        if child.tag != "x":
            out.append(_spoken(child))
        out.append(child.tail or "")
    return "".join(out)


def _outlined(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each range and each of BEGINS: what it ends in, its verses, and the book and chapter it leaves, if it names any."""
    at, scans, counts = None, [], []

    def rows():
        if at is None:
            return pd.DataFrame([], columns=OUTLINE_COLUMNS)
        seen = lambda x: (x is not UNSEEN, None if x is UNSEEN else x)
        return pd.DataFrame([(*at, k, BEGINS.index(s.closer), n, *seen(s.book), *seen(s.chapter)) for k, (s, n) in enumerate(zip(scans, counts, strict=True))], columns=OUTLINE_COLUMNS)

    for pdf in it:
        for path, start, record in zip(pdf["path"], pdf["start"], pdf["value"], strict=True):
            if (path, start) != at:
                yield rows()
                at, scans, counts = (path, start), [Scan(c) for c in BEGINS], [0] * len(BEGINS)
            for k, s in enumerate(scans):
                counts[k] += sum(1 for _ in s.verses(record, strict=False))
    yield rows()


OUTLINE = "path string, start long, begins int, ends int, n long, in_book boolean, book string, in_chapter boolean, chapter string"
OUTLINE_COLUMNS = [c.split()[0] for c in OUTLINE.split(", ")]
BEGINNINGS = "path string, start long, closer string, book string, chapter string, seq long"


def _followed(ranges: pd.DataFrame) -> pd.DataFrame:
    """Beginnings of a document's ranges from their outlines, in order."""
    made = {(r.start, r.begins): r for r in ranges.astype(object).where(ranges.notna(), None).itertuples()}
    begins, book, chapter, seq, out = 0, None, None, 0, []
    for start in sorted({s for s, _ in made}):
        r = made[start, begins]
        out.append((r.path, start, BEGINS[begins], book, chapter, seq))
        begins, seq = r.ends, seq + r.n
        book, chapter = r.book if r.in_book else book, r.chapter if r.in_chapter else chapter
    if begins or book is not None or chapter is not None:
        raise ValueError(f"{ranges['path'].iloc[0]} ends within a comment, a book or a chapter")
    return pd.DataFrame(out, columns=["path", "start", "closer", "book", "chapter", "seq"])


def _events(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at = scan = None
    seq = 0
    for pdf in it:
        rows = []
        for path, start, record, closer, book, chapter, before in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
            if (path, start) != at:
                at, scan, seq = (path, start), Scan(closer, book, chapter), int(before)
            for xml in scan.verses(record, strict=True):
                if scan.book is None or scan.chapter is None:
                    raise ValueError(f"a verse outside of a chapter in {path}")
                verse = ET.fromstring(xml)
                ref = f"{cp.BOOKS.get(scan.book, scan.book)}.{scan.chapter}.{verse.get('n')}"
                rows.extend((path, ref, seq, pos, e.tag, _spoken(e).strip(), [(x.text or "").strip() for x in e.iter("x")]) for pos, e in enumerate(verse) if e.tag in READ)
                if not len(verse):
                    rows.append((path, ref, seq, -1, "", "", []))
                seq += 1
            if len(rows) >= AT_ONCE:
                yield pd.DataFrame(rows, columns=EVENT_COLUMNS)
                rows = []
        yield pd.DataFrame(rows, columns=EVENT_COLUMNS)


def events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, ref, seq, pos, tag, text, codes): a row for each child of a verse; seq counts a document's verses in order.

    Documents are UTF-8, of any length, on any file system that Spark reads; spark.sql.files.maxPartitionBytes cuts them.
    A verse without children gives one row of pos -1, one of none but other children gives no row. A book's name stands before its verses. A document that
    ends within a book, a verse outside of a chapter, and a comment in a verse that holds a verse's end raise an error.
    """
    d = spark.read.text(path, lineSep=END).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    begun = d.mapInPandas(_outlined, OUTLINE).groupBy("path").applyInPandas(_followed, BEGINNINGS)
    missing = F.raise_error(F.concat(F.lit("ranges have changed since they were outlined: "), "path"))
    found = F.col("seq").isNotNull()
    few = begun.limit(MOST_RANGES + 1).toArrow()  # not persisted: a cached plan would also serve a file written anew under the same name
    if few.num_rows <= MOST_RANGES:
        known = spark.createDataFrame(few.to_pylist(), BEGINNINGS)
        joined = d.join(F.broadcast(known), ["path", "start"], "left")
    else:
        numbered = d.withColumn("_at", F.monotonically_increasing_id())
        joined = numbered.join(begun, ["path", "start"], "left").repartition("path", "start").sortWithinPartitions("path", "start", "_at")
    return joined.select("path", "start", "value", "closer", "book", "chapter", F.when(found, F.col("seq")).otherwise(missing.cast("long")).alias("seq")).mapInPandas(_events, EVENTS)


def joined_words(parts) -> F.Column:
    """Words joined by spaces, but for those that end in a maqaf."""
    return F.rtrim(F.aggregate(parts, F.lit(""), lambda acc, x: F.concat(acc, x, F.when(x.endswith(cp.MAQAF), "").otherwise(" "))))


def spoken_parts(rows: DataFrame) -> DataFrame:
    """Rows that are read: a written form goes exactly where a read form follows it; markers aren't words."""
    w = Window.partitionBy("path", "seq").orderBy("pos")
    following = F.lead("tag").over(w)
    return rows.withColumn("following", following).where((F.col("tag").isin("w", "q")) | ((F.col("tag") == "k") & ~F.col("following").eqNullSafe(F.lit("q"))))


def verses(rows: DataFrame) -> DataFrame:
    """(path, seq, ref, text, fallbacks): fallbacks counts written forms read for want of another."""
    said = spoken_parts(rows).groupBy("path", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"), F.sum((F.col("tag") == "k").cast("int")).alias("fallbacks"))
    text = joined_words(F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != ""))
    every = rows.select("path", "seq", "ref").distinct()
    return every.join(said, ["path", "seq"], "left").select("path", "seq", "ref", F.coalesce(text, F.lit("")).alias("text"), F.coalesce("fallbacks", F.lit(0)).alias("fallbacks"))


def marks(rows: DataFrame) -> DataFrame:
    """(path, ref, type, ordinal): marker elements first, then codes inside words, numbered by type within a verse."""
    names = F.create_map(*[F.lit(x) for kv in cp.MARKER_TAGS.items() for x in kv])
    codes = F.create_map(*[F.lit(x) for kv in cp.X_CODES.items() for x in kv])
    tags = rows.where(F.col("tag").isin(*cp.MARKER_TAGS)).select("path", "seq", "ref", F.lit(0).alias("phase"), "pos", F.lit(0).alias("at"), names[F.col("tag")].alias("type"))
    inside = rows.where("tag = 'w'").select("path", "seq", "ref", F.lit(1).alias("phase"), "pos", F.posexplode("codes").alias("at", "code")).withColumn("type", codes[F.col("code")]).where("type is not null").drop("code")
    w = Window.partitionBy("path", "seq", "type").orderBy("phase", "pos", "at")
    return tags.unionByName(inside).withColumn("ordinal", F.row_number().over(w)).select("path", "seq", "ref", "type", "ordinal")


def tier_texts(v: DataFrame, tier: int) -> DataFrame:
    """An edition's verses in a loader's tier view, which normalises nothing."""
    return v.withColumn("text", views.loader_view(F.col("text"), tier))
