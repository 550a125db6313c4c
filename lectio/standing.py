"""Queries of operators that other queries don't call, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.functions import scalars
from lectio.operators import free, marks, normal
from lectio.operators import metrics as m
from lectio.operators import validate as v
from lectio.plans import agreement, reports, score
from lectio.pointed import RECORDS_SQL, pointed
from lectio.queries import DRAWS, KEYS, PAIRS, UNITS, _pairs, _t, query
from lectio.sources import edition, scratch


@query(r"""WITH w AS (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM conversations)
SELECT conv_id, turn, sha256(array_to_string(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i % 3 = 1 THEN '<' || ws[i] ELSE ws[i] END), ' ')) AS digest FROM w""")
def reconstructed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together from a service's token lists: separators, first options, and tokens without options as they are."""
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    token = lambda s, sep, options: F.struct(F.lit(sep).alias("sep"), s.alias("str"), options.alias("options"))
    none = F.array().cast("array<string>")
    tokens = F.flatten(F.transform(words, lambda w, i: F.array(
        token(F.when(i == 0, "").otherwise(" "), True, none), token(w, False, F.when(i % 3 == 0, F.array(F.concat(F.lit("<"), w), w)).when(i % 3 == 1, none)))))
    d = _t(spark, sf_dir, "conversations").select(*KEYS, F.to_json(tokens).alias("response"))
    return d.select(*KEYS, F.sha2(scalars.reconstructed(F.col("response")), 256).alias("digest"))


@query("SELECT 'other kind' AS rule, event_id::VARCHAR AS subject, event_type AS detail FROM events WHERE event_type <> 'click' UNION ALL SELECT 'no kind', 'expected value is missing', ''")
def bound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that aren't the one that all are bound to, and a binding without a value."""
    e = _t(spark, sf_dir, "events")
    return v.all_of(v.bound_to(e, "event_id", "event_type", "click", "other kind"), v.bound_to(e, "event_id", "event_type", None, "no kind"))


@query(f"""WITH {PAIRS}, s AS (SELECT role, regexp_replace(gt, '[^א-ת]', '', 'g') = regexp_replace(pred, '[^א-ת]', '', 'g') AS same FROM p)
SELECT role AS source, count(*)::BIGINT AS n_lines, count(*)::BIGINT AS first_wins, 0::BIGINT AS second_wins, count_if(NOT same)::BIGINT AS tie_breaks FROM s GROUP BY role""")
def combined_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, winners and tie breaks of combined sources, in total."""
    p = _pairs(spark, sf_dir).withColumn("line_id", F.concat_ws(".", *[F.col(c).cast("string") for c in KEYS]))
    got = score.combined_lines(p.select("line_id", F.col("gt").alias("text")), p.select("line_id", F.col("pred").alias("text")))
    return score.combined_totals(got.join(p.select("line_id", F.col("role").alias("source")), "line_id"), ["source"])


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT conv_id, turn, unnest(cs) AS c FROM x), t AS (SELECT conv_id, turn, contains(c, '{cp.RAFE}') AS gold, c[1] IN {tuple(cp.BEGADKEFAT)} AND NOT contains(c, '{cp.DAGESH}') AS rule FROM r),
s AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 AND turn * 9 + conv_id % 5 BETWEEN 1 AND 43 THEN 'haazinu' ELSE 'prose' END AS stratum FROM conversations)
SELECT stratum, count(DISTINCT (s.conv_id, s.turn))::BIGINT AS n_verses, count_if(gold AND rule)::BIGINT AS tp, count_if(rule AND NOT gold)::BIGINT AS fp, count_if(gold AND NOT rule)::BIGINT AS fn FROM s LEFT JOIN t USING (conv_id, turn) GROUP BY stratum""")
def sectioned_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's counts within and outside of a song, by verses of Deuteronomy 31 to 33."""
    ref = F.concat_ws(".", F.lit("Deut"), (31 + F.col("conv_id") % 3).cast("string"), (F.col("turn") * 9 + F.col("conv_id") % 5).cast("string"))
    verses = _t(spark, sf_dir, "conversations").select(F.struct(*KEYS).alias("i"), F.col("role").alias("folio"), ref.alias("verse_ref"), pointed("text").alias("chunk"))
    shown = [m.Metric(n, (c,), lambda x: x.cast("long")) for n, c in (("tp", "tp0"), ("fp", "fp0"), ("fn", "fn0"))]
    return agreement.strata(agreement.rafe_rule(verses), shown).where("kind = 'section'").drop("kind")


@query("""WITH r AS (SELECT lang AS folio, n_chars AS d, doc_id % 5 AS e1, doc_id % 7 AS e2, doc_id % 11 AS e3 FROM documents)
SELECT folio, sum(e1)::BIGINT AS edits_1, sum(d)::BIGINT AS denominator_1, sum(e2)::BIGINT AS edits_2, sum(d)::BIGINT AS denominator_2, sum(e3)::BIGINT AS edits_3, sum(d)::BIGINT AS denominator_3,
  round(avg(e1 / d), 8) AS cer_1, round(avg(e2 / d), 8) AS cer_2, round(avg(e3 / d), 8) AS cer_3, count(*)::BIGINT AS n_verses FROM r GROUP BY ROLLUP (folio)""")
def error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro totals and macro rates of every tier, by folio and overall, in one pass."""
    d, of = F.col("n_chars"), {1: 5, 2: 7, 3: 11}
    rates = _t(spark, sf_dir, "documents").select(F.col("lang").alias("folio"), *[x for t, k in of.items() for x in ((F.col("doc_id") % k).alias(f"edits_{t}"), d.alias(f"denominator_{t}"), (F.col("doc_id") % k / d).alias(f"cer_{t}"))])
    got = reports.error_table(rates)
    return got.select("folio", *[c for t in of for c in (f"edits_{t}", f"denominator_{t}")], *[F.round(f"cer_{t}", 8).alias(f"cer_{t}") for t in of], F.col("n_verses"))


@query("""WITH u AS (SELECT source, CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality = 1 THEN 'circellus' WHEN toxic = 1 THEN 'rafe' ELSE 'none' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'both' WHEN doc_id % 3 = 1 THEN 'rafe' ELSE 'none' END AS b FROM labels JOIN documents USING (doc_id)),
k AS (SELECT source, kind, a IN (kind, 'both') AS x, b IN (kind, 'both') AS y FROM u CROSS JOIN (VALUES ('circellus'), ('rafe')) t(kind))
SELECT kind, source, count_if(x AND y)::BIGINT AS pp, count_if(x AND NOT y)::BIGINT AS pn, count_if(NOT x AND y)::BIGINT AS np, count_if(NOT x AND NOT y)::BIGINT AS nn FROM k GROUP BY kind, source""")
def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coders' cells of whether a unit has a mark of a type, alone or with the other."""
    d = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    a = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "both").when(F.col("quality") == 1, "circellus").when(F.col("toxic") == 1, "rafe").otherwise("none")
    b = F.when(F.col("doc_id") % 3 == 0, "both").when(F.col("doc_id") % 3 == 1, "rafe").otherwise("none")
    units = d.groupBy("source", a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))
    cells = [marks.binary_units(units, kind, ["source"]).select(F.lit(kind).alias("kind"), "source", *[F.col(c).cast("long").alias(c) for c in m.CELLS]) for kind in agreement.KINDS]
    return v.all_of(*cells)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey < l_partkey AND l_linenumber < l_quantity")
def real_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: boxes with an area."""
    at = [F.col(c).cast("int") for c in ("l_suppkey", "l_linenumber", "l_partkey", "l_quantity")]
    return v.real_boxes(_t(spark, sf_dir, "lineitem").withColumn("bbox", F.array(*at))).select("l_orderkey", "l_linenumber")


def _ratio_sql(x: str, parts: tuple) -> str:
    """A rational function of x, by Horner's rule, with the coefficients of normal.py."""
    value = lambda c: "(" * (len(c) - 1) + f"{c[0]!r}::DOUBLE" + "".join(f" * {x} + {k!r}::DOUBLE)" for k in c[1:])
    return f"({value(parts[0])} / {value(parts[1])})"


def _inverse_sql(x: str) -> str:
    tail = f"sqrt(-ln(least({x}, 1 - {x})))"
    far = f"CASE WHEN {tail} <= 5 THEN {_ratio_sql(f'({tail} - 1.6)', normal.TAIL)} ELSE {_ratio_sql(f'({tail} - 5.0)', normal.FAR)} END"
    middle = f"({x} - 0.5) * {_ratio_sql(f'(0.180625 - ({x} - 0.5) * ({x} - 0.5))', normal.MIDDLE)}"
    return f"CASE WHEN abs({x} - 0.5) <= 0.425 THEN {middle} WHEN {x} < 0.5 THEN -({far}) ELSE {far} END"


def _distribution_sql(z: str) -> str:
    y = f"(abs({z}) / sqrt(2))"
    beyond = f"exp(-{y} * {y}) / {y} * (1 / sqrt(pi()) - (1 / ({y} * {y})) * {_ratio_sql(f'(1 / ({y} * {y}))', normal.BEYOND)})"
    upper = f"(CASE WHEN {y} <= 4 THEN exp(-{y} * {y}) * {_ratio_sql(y, normal.LARGE)} ELSE {beyond} END)"
    return f"CASE WHEN {y} <= 0.46875 THEN 0.5 + 0.5 * {z} / sqrt(2) * {_ratio_sql(f'({y} * {y})', normal.SMALL)} WHEN {z} < 0 THEN {upper} / 2 ELSE 1 - {upper} / 2 END"


@query(f"""WITH x AS (SELECT p_partkey, least(greatest(p_partkey % 1001 / 1000, 0.0005::DOUBLE), 0.9995::DOUBLE) AS b, (p_size - 25) / 60 AS a FROM part),
z AS (SELECT p_partkey, a, {_inverse_sql('b')} AS z, unnest(['lo', 'hi']) AS side, unnest([{_inverse_sql('0.025::DOUBLE')}, {_inverse_sql('0.975::DOUBLE')}]) AS q FROM x),
w AS (SELECT p_partkey, side, CASE WHEN 1 - a * (z + q) <= 0 THEN z + q ELSE z + (z + q) / (1 - a * (z + q)) END AS w FROM z),
s AS (SELECT p_partkey, side, {_distribution_sql('w')} AS share FROM w)
SELECT p_partkey, round(max(share) FILTER (side = 'lo'), 9) AS lo, round(max(share) FILTER (side = 'hi'), 9) AS hi FROM s GROUP BY p_partkey""")
def adjusted_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares at which bias-corrected and accelerated intervals read their percentiles, by the normal distribution and its inverse as columns."""
    p = _t(spark, sf_dir, "part").withColumns({"below": F.col("p_partkey") % 1001, "a": (F.col("p_size") - 25) / 60})
    share = lambda s: F.round(normal.adjusted(F.lit(s), F.col("below"), F.lit(1000), F.col("a")), 9)
    return p.select("p_partkey", share(0.025).alias("lo"), share(0.975).alias("hi"))


def _median(units, w) -> float:
    return float(np.median(np.repeat(units["rate"].to_numpy(), w)))


def _spread(units, w) -> float:
    lo, hi = np.percentile(np.repeat(units["rate"].to_numpy(), w), (10, 90))
    return float(hi - lo)


@query(f"""WITH u AS (SELECT doc_id % {UNITS} AS i, sum(doc_id % 13)::DOUBLE / sum(n_chars) AS rate FROM documents GROUP BY ALL), d AS (SELECT b, ((b * 7919 + k * 104729 + b * k * 31) % {UNITS}) AS i FROM range({DRAWS}) t(b), range({UNITS}) s(k)),
v AS (SELECT b, median(rate) AS median, quantile_cont(rate, 0.9) - quantile_cont(rate, 0.1) AS spread FROM d JOIN u USING (i) GROUP BY b), p AS (SELECT median(rate) AS median, quantile_cont(rate, 0.9) - quantile_cont(rate, 0.1) AS spread FROM u)
SELECT 'median' AS metric, round((SELECT median FROM p), 9) AS point, round(quantile_cont(median, 0.025), 9) AS lo, round(quantile_cont(median, 0.975), 9) AS hi FROM v
UNION ALL SELECT 'spread', round((SELECT spread FROM p), 9), round(quantile_cont(spread, 0.025), 9), round(quantile_cont(spread, 0.975), 9) FROM v""")
def free_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of statistics that aren't sums: the median of units' rates, and the distance of their tenths."""
    rate = F.sum(F.col("doc_id") % 13).cast("double") / F.sum("n_chars")
    u = _t(spark, sf_dir, "documents").groupBy((F.col("doc_id") % UNITS).alias("i")).agg(rate.alias("rate"))
    k = F.explode(F.sequence(F.lit(0), F.lit(UNITS - 1))).alias("k")
    d = spark.range(DRAWS).select(F.col("id").alias("b"), k)
    d = d.select("b", ((F.col("b") * 7919 + F.col("k") * 104729 + F.col("b") * F.col("k") * 31) % UNITS).alias("i")).groupBy("b", "i").agg(F.count("*").alias("w"))
    got = free.intervals(u, ["rate"], {"median": _median, "spread": _spread}, d)
    return got.select("metric", *[F.round(c, 9).alias(c) for c in ("point", "lo", "hi")])


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g'), ' '), lambda x: x <> '') AS ws FROM conversations),
r AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: NOT (i % 4 = 2 AND i < len(ws))) AS spoken FROM w)
SELECT conv_id || '.1.' || turn AS ref, sha256(array_to_string(list_transform(spoken, lambda i: ws[i]), ' ')) AS digest, len(list_filter(spoken, lambda i: i % 2 = 0))::INT AS fallbacks,
  len(list_filter(range(1, len(ws) + 1), lambda i: i % 4 = 1))::BIGINT AS large_letters, (turn % 2 = 0)::BIGINT AS closed FROM r""")
def edition_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 to S4, S2a to S2d, W3, W4: turns written as an edition's verses, read in byte ranges: spoken texts, readings for want of another, numbered marks."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", ""), " "), lambda x: x != "")
    child = lambda w, i: F.when(i % 4 == 0, F.concat(F.lit("<w>"), w, F.lit("<x>5</x></w>"))).when(i % 4 == 2, F.concat(F.lit("<q>"), w, F.lit("</q>"))).otherwise(F.concat(F.lit("<k>"), w, F.lit("</k>")))
    inside = F.concat(F.array_join(F.transform(words, child), ""), F.when(F.col("turn") % 2 == 0, "<pe/>").otherwise(""))
    verse = F.format_string("<v n='%d'>%s</v>", "turn", inside)
    book = F.format_string("<book><names><name>%d</name></names><c n='1'>%s</c></book>", "conv_id", F.array_join("verses.verse", ""))
    path = scratch.folder(spark)
    own = _t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", verse.alias("verse")).alias("v"))
    own.groupBy("conv_id").agg(F.array_sort(F.collect_list("v")).alias("verses")).select(book).write.text(path)
    events = edition.events(spark, path)
    n = lambda t: F.coalesce(F.max(F.when(F.col("type") == t, F.col("ordinal"))), F.lit(0)).cast("long")
    numbered = edition.marks(events).groupBy("path", "seq").agg(n("large_letter").alias("large_letters"), n("pe").alias("closed"))
    texts = edition.verses(events).join(numbered, ["path", "seq"], "left")
    return texts.select("ref", F.sha2("text", 256).alias("digest"), F.col("fallbacks").cast("int").alias("fallbacks"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("large_letters", "closed")])
