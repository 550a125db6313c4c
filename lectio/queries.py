"""The operators as queries over the shared tables, each with the SQL that it must agree with.

The tables hold no pointed text, so letters stand for consonants, commas and full stops for marks, and consecutive turns
of a conversation for the two sides of a comparison; the operators are those of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio.functions import scalars, views
from lectio.operators import alignment, confusion, marks
from lectio.operators import metrics as m
from lectio.operators import validate as v
from lectio.plans import score
from lectio.sources import documents, edition, page_layout, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Marks of plain text: what stands for a circellus and a rafe after a letter.
PLAIN = {",": "circellus", ".": "rafe", "\n": "circellus"}
KEYS = ["conv_id", "turn"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str) -> Column:
    return F.round(c, 6)


#: Letters past ASCII, and unused characters of one byte that stand for them, as DuckDB's levenshtein compares bytes.
WIDE = "éèêçüßäöóñíÉÈÊÇÜÄÖÓÑÍ"
NARROW = "".join(map(chr, [*range(1, 9), *range(14, 27)]))


def _narrow(c: str) -> Column:
    return F.translate(c, WIDE, NARROW)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, gt, pred): every turn with the next one."""
    t = _t(spark, sf_dir, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return t.select(*KEYS, "role", F.col("text").alias("gt")).join(nxt, KEYS)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _pairs(spark, sf_dir)
    side = lambda c: marks.exploded(p.withColumn("_m", marks.mark_positions(F.col(c), PLAIN, "A-Za-z")), "_m", *KEYS)
    return side("gt"), side("pred")


PAIRS = "p AS (SELECT a.conv_id, a.turn, a.role, a.text AS gt, b.text AS pred FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
FOLDED = f"translate({{c}}, '{WIDE}', '{NARROW}')"
CER = f"c AS (SELECT conv_id, turn, role, levenshtein({FOLDED.format(c='gt')}, {FOLDED.format(c='pred')})::BIGINT AS edits, length({FOLDED.format(c='gt')})::BIGINT AS denominator FROM p)"
RATE = "CASE WHEN denominator = 0 THEN CASE WHEN edits = 0 THEN 0.0 ELSE 1.0 END ELSE edits / denominator END"


def _tokens_sql(side: str) -> str:
    return rf"""t{side} AS (SELECT conv_id, turn, unnest(regexp_extract_all({side}, '<[A-Z]+>|[A-Za-z]|[,.\n]')) AS tok, unnest(range(len(regexp_extract_all({side}, '<[A-Z]+>|[A-Za-z]|[,.\n]')))) AS ix FROM p),
o{side} AS (SELECT *, sum((tok SIMILAR TO '[A-Za-z]')::INT) OVER (PARTITION BY conv_id, turn ORDER BY ix) AS n FROM t{side}),
m{side} AS (SELECT conv_id, turn, CASE WHEN tok = '.' THEN 'rafe' ELSE 'circellus' END AS type, n::BIGINT AS ordinal FROM o{side} WHERE n > 0 AND (tok IN (',', '.') OR tok = chr(10)))"""


def _fold_sql(side: str) -> str:
    return f"d{side} AS (SELECT conv_id, turn, ordinal, CASE WHEN max((type = 'circellus')::INT) + max((type = 'rafe')::INT) = 2 THEN 'both' ELSE max(type) END AS type FROM m{side} GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY conv_id, turn, ordinal")


MARKS = ",\n".join([PAIRS, _tokens_sql("gt"), _tokens_sql("pred"), _fold_sql("gt"), _fold_sql("pred")])
PRF = """CASE WHEN tp + fp = 0 THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fp) END AS pr,
  CASE WHEN tp + fn = 0 THEN CASE WHEN tp + fp = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fn) END AS rc"""


@query(rf"""
SELECT lang, count(*)::BIGINT AS docs,
  sum(length(trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '  +', ' ', 'g'))))::BIGINT AS tier1,
  sum(length(regexp_replace(regexp_replace(regexp_replace(text, '[.,;:!?]', '', 'g'), '  +', ' ', 'g'), '^\s+|\s+$', '', 'g')))::BIGINT AS tier2,
  sum(length(text))::BIGINT AS tier3
FROM documents GROUP BY lang""")
def tier_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested views and their denominators."""
    t, n = F.col("text"), lambda c: F.sum(F.length(c)).cast("long")
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), n(views.kept(t, "A-Za-z ")).alias("tier1"), n(views.dropped(t, ".,;:!?")).alias("tier2"), n(t).alias("tier3"))


@query("SELECT doc_id, length_grapheme(text)::BIGINT AS clusters, length(text)::BIGINT AS code_points FROM documents")
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P4."""
    return _t(spark, sf_dir, "documents").select("doc_id", views.cluster_count(F.col("text")).cast("long").alias("clusters"), F.length("text").cast("long").alias("code_points"))


def _cer(spark: SparkSession, sf_dir: str, view: Callable[[str], Column] = _narrow) -> DataFrame:
    p = _pairs(spark, sf_dir).repartition(*KEYS)  # the alignment is the cost, so it is spread before
    return alignment.cer(alignment.with_clusters(p, g=view("gt"), p=view("pred")), "g", "p")


def _whole(c: str) -> Column:
    return views.normalize(F.col(c))


def _panel(rates: DataFrame) -> DataFrame:
    g = rates.rollup("role").agg(F.sum("edits").alias("edits"), F.sum("denominator").alias("denominator"), _r(F.avg("cer")).alias("macro_cer"), F.count("*").alias("n"))
    return g.select(F.coalesce("role", F.lit("overall")).alias("stratum"), "edits", "denominator", "macro_cer", "n")


@query(f"WITH {PAIRS}, {CER} SELECT conv_id, turn, edits, denominator, round({RATE}, 6) AS cer FROM c")
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3: error rates of whole texts, letter for letter; normalised to clusters of several code points: cer_pairs_whole."""
    return _cer(spark, sf_dir).select(*KEYS, "edits", "denominator", _r("cer").alias("cer"))


@query(f"WITH {PAIRS}, {CER} SELECT coalesce(role, 'overall') AS stratum, sum(edits)::BIGINT AS edits, sum(denominator)::BIGINT AS denominator, round(avg({RATE}), 6) AS macro_cer, count(*)::BIGINT AS n FROM c GROUP BY GROUPING SETS ((role), ())")
def cer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro rates and totals by stratum and overall of the texts of cer_pairs."""
    return _panel(_cer(spark, sf_dir))


@query()
def cer_pairs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3: cluster-aligned error rates of whole normalised texts; tested against a plain cluster alignment."""
    return _cer(spark, sf_dir, _whole).select(*KEYS, "edits", "denominator", _r("cer").alias("cer"))


@query()
def cer_panel_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro rates and totals by stratum and overall, of whole normalised texts."""
    return _panel(_cer(spark, sf_dir, _whole))


@query(rf"WITH {MARKS} SELECT conv_id, turn, type, ordinal, count(*)::BIGINT AS n FROM mgt GROUP BY ALL")
def positional_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by the ordinal of the letter that they follow."""
    return _sides(spark, sf_dir)[0].groupBy(*KEYS, "type", F.col("ordinal").cast("long").alias("ordinal")).agg(F.count("*").alias("n"))


@query(rf"WITH {MARKS} SELECT conv_id, turn, ordinal, type FROM dgt")
def folded_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection an ordinal."""
    return marks.detections(_sides(spark, sf_dir)[0], *KEYS).select(*KEYS, F.col("ordinal").cast("long").alias("ordinal"), "type")


EXACT = f"""x AS (SELECT coalesce(g.conv_id, q.conv_id) AS conv_id, coalesce(g.turn, q.turn) AS turn, (g.type IS NOT NULL AND q.type IS NOT NULL)::INT AS both_have, (q.type IS NULL)::INT AS g_only, (g.type IS NULL)::INT AS q_only
  FROM dgt g FULL JOIN dpred q ON g.conv_id = q.conv_id AND g.turn = q.turn AND g.type = q.type AND g.ordinal = q.ordinal),
k AS (SELECT conv_id, turn, sum(both_have)::BIGINT AS tp, sum(q_only)::BIGINT AS fp, sum(g_only)::BIGINT AS fn FROM x GROUP BY conv_id, turn)"""


@query(f"WITH {MARKS}, {EXACT}, s AS (SELECT *, {PRF} FROM k) SELECT conv_id, turn, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM s")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, missed and surplus detections of two sides."""
    a, b = (marks.detections(x, *KEYS) for x in _sides(spark, sf_dir))
    s = marks.scored(marks.match_counts(a, b, KEYS))
    return s.select(*KEYS, "tp", "fp", "fn", *[_r(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {MARKS}, {EXACT}, u AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k), s AS (SELECT *, {PRF} FROM u)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM s""")
def pooled_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched by unit, then pooled."""
    a, b = (marks.detections(x, *KEYS) for x in _sides(spark, sf_dir))
    s = marks.scored(marks.match_counts(a, b, KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))
    return s.select("tp", "fp", "fn", *[_r(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {MARKS}, t AS (SELECT unnest(['circellus', 'rafe']) AS kind),
a AS (SELECT kind, conv_id, turn, ordinal, 1 AS has FROM t JOIN dgt ON type IN (kind, 'both')), b AS (SELECT kind, conv_id, turn, ordinal, 1 AS has FROM t JOIN dpred ON type IN (kind, 'both')),
j AS (SELECT kind, a.has AS ina, b.has AS inb FROM a FULL JOIN b USING (kind, conv_id, turn, ordinal))
SELECT kind, count_if(ina = 1 AND inb = 1)::BIGINT AS tp, count_if(ina IS NULL)::BIGINT AS fp, count_if(inb IS NULL)::BIGINT AS fn FROM j GROUP BY kind""")
def match_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each type, with both counted for each."""
    a, b = (marks.detections(x, *KEYS) for x in _sides(spark, sf_dir))
    each = lambda d: d.withColumn("kind", F.explode(F.when(F.col("type") == "both", F.array(F.lit("circellus"), F.lit("rafe"))).otherwise(F.array("type")))).withColumn("type", F.col("kind"))
    return marks.match_counts(each(a), each(b), [*KEYS, "kind"]).groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query(f"""WITH {MARKS},
g AS (SELECT DISTINCT conv_id, type, turn, ordinal FROM mgt), q AS (SELECT DISTINCT conv_id, type, turn, ordinal FROM mpred),
j AS (SELECT coalesce(g.conv_id, q.conv_id) AS conv_id, coalesce(g.type, q.type) AS type, coalesce(g.turn, q.turn) AS turn, g.ordinal IS NOT NULL AS ing, q.ordinal IS NOT NULL AS inq FROM g FULL JOIN q ON g.conv_id = q.conv_id AND g.type = q.type AND g.turn = q.turn AND g.ordinal = q.ordinal),
t AS (SELECT conv_id, type, turn, count_if(ing AND inq) AS e, count_if(ing AND NOT inq) AS go, count_if(inq AND NOT ing) AS qo FROM j GROUP BY conv_id, type, turn),
s AS (SELECT conv_id, sum(e) AS e, sum(least(go, qo)) AS h, sum(go) AS go, sum(qo) AS qo FROM t GROUP BY conv_id),
r AS (SELECT *, (e + h / 3) / (e + qo) AS pr, (e + h / 3) / (e + go) AS rc FROM s)
SELECT conv_id, e::BIGINT AS tp_exact, h::BIGINT AS tp_partial, (qo - h)::BIGINT AS fp, (go - h)::BIGINT AS fn,
  round(CASE WHEN e + qo = 0 THEN CASE WHEN e + go = 0 THEN 1.0 ELSE 0.0 END ELSE pr END, 6) AS precision, round(CASE WHEN e + go = 0 THEN CASE WHEN e + qo = 0 THEN 1.0 ELSE 0.0 END ELSE rc END, 6) AS recall FROM r""")
def partial_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact marks and a third for the right type in the right unit."""
    a, b = (x.withColumn("verse_ref", F.col("turn").cast("string")) for x in _sides(spark, sf_dir))
    s = marks.partial_credit(a, b, ["conv_id"])
    return s.select("conv_id", *[F.col(c).cast("long").alias(c) for c in ("tp_exact", "tp_partial", "fp", "fn")], _r("precision").alias("precision"), _r("recall").alias("recall"))


def _coders(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Cells of two coders, quality and toxic, a row a label."""
    t = _t(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    cell = lambda x, y: ((F.col("quality") == x) & (F.col("toxic") == y)).cast("long")
    return t.select("doc_id", *more, cell(1, 1).alias("pp"), cell(1, 0).alias("pn"), cell(0, 1).alias("np"), cell(0, 0).alias("nn"))


def _nominal(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"u_1_1": F.col("pp"), "u_1_0": F.col("pn"), "u_0_1": F.col("np"), "u_0_0": F.col("nn")})


AGREE = [m.kappa("kappa"), m.pabak("pabak"), m.ac1("ac1"), m.alpha("alpha", ["0", "1"])]
CELL_SQL = "sum(quality * toxic)::DOUBLE AS pp, sum(quality * (1 - toxic))::DOUBLE AS pn, sum((1 - quality) * toxic)::DOUBLE AS np, sum((1 - quality) * (1 - toxic))::DOUBLE AS nn"
SHARES = "pp + pn + np + nn AS n, (pp + nn) / (pp + pn + np + nn) AS po, (pp + pn) / (pp + pn + np + nn) AS pa, (pp + np) / (pp + pn + np + nn) AS pb"
KAPPA = "(po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb)))"
AC1 = "(po - (pa + pb) * (1 - (pa + pb) / 2)) / (1 - (pa + pb) * (1 - (pa + pb) / 2))"
ALPHA = "1 - 2 * (pn + np) / (((2 * n) * (2 * n) - (2 * pp + pn + np) * (2 * pp + pn + np) - (2 * nn + pn + np) * (2 * nn + pn + np)) / (2 * n - 1))"


@query(f"WITH c AS (SELECT {CELL_SQL} FROM labels), s AS (SELECT *, {SHARES} FROM c) SELECT round({KAPPA}, 6) AS kappa, round(2 * po - 1, 6) AS pabak, round({AC1}, 6) AS ac1, round({ALPHA}, 6) AS alpha FROM s")
def coder_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement of two coders."""
    return m.evaluate(_nominal(_coders(spark, sf_dir)), AGREE).select(*[_r(x.name).alias(x.name) for x in AGREE])


@query(f"""WITH {PAIRS},
g AS (SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split_regex(gt, '\\s+')) AS token FROM p) WHERE token <> '' GROUP BY ALL),
q AS (SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split_regex(pred, '\\s+')) AS token FROM p) WHERE token <> '' GROUP BY ALL),
j AS (SELECT conv_id, turn, token, coalesce(g.n, 0) AS x, coalesce(q.n, 0) AS y FROM g FULL JOIN q USING (conv_id, turn, token))
SELECT conv_id, turn, sum(least(x, y))::BIGINT AS common, sum(x - least(x, y))::BIGINT AS a_only, sum(y - least(x, y))::BIGINT AS b_only FROM j GROUP BY conv_id, turn""")
def token_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset intersection and differences."""
    p = _pairs(spark, sf_dir)
    side = lambda c: p.select(*KEYS, F.explode(views.tokens(F.col(c))).alias("token"))
    return confusion.multiset(side("gt"), side("pred"), KEYS, "token").groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("common", "a_only", "b_only")])


UNITS, DRAWS = 200, 400


@query(f"""WITH u AS (SELECT doc_id % {UNITS} AS i, {CELL_SQL} FROM labels GROUP BY ALL), d AS (SELECT b, ((b * 7919 + k * 104729 + b * k * 31) % {UNITS}) AS i FROM range({DRAWS}) t(b), range({UNITS}) s(k)),
c AS (SELECT b, sum(pp) AS pp, sum(pn) AS pn, sum(np) AS np, sum(nn) AS nn FROM d JOIN u USING (i) GROUP BY b), s AS (SELECT *, {SHARES} FROM c)
SELECT round(quantile_cont({KAPPA}, 0.025), 6) AS kappa_lo, round(quantile_cont({KAPPA}, 0.975), 6) AS kappa_hi, round(quantile_cont(2 * po - 1, 0.025), 6) AS pabak_lo, round(quantile_cont(2 * po - 1, 0.975), 6) AS pabak_hi FROM s""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B3 with a plan that both engines can draw: blocks of labels resampled, one pass for all metrics."""
    u = _coders(spark, sf_dir).groupBy((F.col("doc_id") % UNITS).alias("i")).agg(*[F.sum(c).alias(c) for c in m.CELLS])
    d = spark.range(DRAWS).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(UNITS - 1))).alias("k"))
    d = d.select("b", ((F.col("b") * 7919 + F.col("k") * 104729 + F.col("b") * F.col("k") * 31) % UNITS).alias("i")).groupBy("b", "i").agg(F.count("*").alias("w"))
    got = m.resampled(u, AGREE[:2], d)
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return got.agg(q("kappa").alias("k"), q("pabak").alias("p")).select(*[_r(F.col(c)[i]).alias(f"{n}_{e}") for c, n in (("k", "kappa"), ("p", "pabak")) for i, e in enumerate(("lo", "hi"))])


@query()
def seeded_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B3 with the seeded generator's plan over blocks of labels; the draws are tested against a plain loop."""
    u = _nominal(_coders(spark, sf_dir)).groupBy((F.col("doc_id") % UNITS).cast("int").alias("i")).agg(*[F.sum(c).alias(c) for c in (*m.CELLS, "u_1_1", "u_1_0", "u_0_1", "u_0_0")])
    return m.intervals(u, AGREE, m.plan(spark, UNITS, 2000))


@query()
def rule_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of one F1 score at 10,000 resamples of 96 units, seeded."""
    u = _coders(spark, sf_dir).groupBy((F.col("doc_id") % 96).cast("int").alias("i")).agg(*[F.sum(c).alias(c) for c in m.CELLS])
    return m.intervals(u, [m.f1("f1", "pp", "np", "pn")], m.plan(spark, 96))


@query()
def bca_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters drawn first, bias-corrected and accelerated."""
    u = _coders(spark, sf_dir).groupBy((F.col("doc_id") % UNITS).cast("int").alias("i")).agg(*[F.sum(c).alias(c) for c in m.CELLS]).withColumn("cluster", F.col("i") % 10)
    return m.intervals(u, AGREE[:3], m.plan(spark, UNITS, 1000, clusters=[i % 10 for i in range(UNITS)]), clusters="cluster")


@query(f"""WITH u AS (SELECT source, {CELL_SQL} FROM labels JOIN documents USING (doc_id) GROUP BY source), t AS (SELECT sum(pp) AS tpp, sum(pn) AS tpn, sum(np) AS tnp, sum(nn) AS tnn FROM u),
c AS (SELECT source, tpp - pp AS pp, tpn - pn AS pn, tnp - np AS np, tnn - nn AS nn FROM u, t), s AS (SELECT *, {SHARES} FROM c) SELECT source, round({KAPPA}, 6) AS kappa, round(2 * po - 1, 6) AS pabak FROM s""")
def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value without one cluster."""
    d = _coders(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return m.jackknife(d, AGREE[:2], "source").select("source", _r("kappa").alias("kappa"), _r("pabak").alias("pabak"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INT, l_partkey::INT DESC, l_linenumber, l_suppkey) AS place FROM lineitem)
SELECT l_orderkey, string_agg(t, ' ' ORDER BY place) AS text FROM o GROUP BY l_orderkey""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by place on the page, joined."""
    t = _t(spark, sf_dir, "lineitem")
    at = (F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_suppkey")).alias("at")
    d = t.select("l_orderkey", F.col("l_linenumber").cast("string").alias("line_id"), F.array(F.lit(0), F.col("l_quantity").cast("int"), F.col("l_partkey").cast("int"), F.lit(0)).alias("bbox"), at, F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return documents.in_order(documents.reading_order(d, "l_orderkey"), "l_orderkey", ["place"], "text")


@query("""SELECT event_id, event_type || '.' || user_id AS verse_ref, CASE WHEN event_type = 'view' THEN 'petuhah' WHEN event_type = 'click' THEN 'setumah' END AS parashah,
(props->>'$.k') || '|' || ((props->>'$.k')::INT + 1) AS large, CASE WHEN user_id IN (1, 2) THEN user_id::INT END AS col, (event_type = 'error')::INT::BIGINT AS errors FROM events""")
def custom_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The custom mini-language, with a list of what no rule admits."""
    k = F.get_json_object("props", "$.k")
    e = _t(spark, sf_dir, "events")
    size = F.concat(F.lit("letter_size: large@"), k, F.lit(" , large@"), (k.cast("int") + 1).cast("string"))
    extra = F.when(F.col("event_type") == "view", "parashah:petuhah").when(F.col("event_type") == "click", "parashah: setumah").when(F.col("event_type") == "error", "parasha:petuhah")
    col = F.when(F.col("user_id").isin(1, 2), F.concat(F.lit("layout:stichographic_column@"), F.col("user_id").cast("string")))
    c = page_layout.parsed_custom(F.concat_ws(" ; ", F.concat(F.lit("verse_ref:"), "event_type", F.lit("."), F.col("user_id").cast("string")), extra, size, col, F.lit("")))
    return e.select("event_id", c.alias("c")).select("event_id", "c.verse_ref", "c.parashah", F.array_join(F.col("c.large_letters").cast("array<string>"), "|").alias("large"), F.col("c.stichographic_column").alias("col"), F.size("c.errors").cast("long").alias("errors"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE d.source <> 'src3'")
def needle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages contained in texts, a source whitelisted."""
    d, b = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    exempt = d.where("source = 'src3'").select("doc_id")
    named = b.where("text is not null").select(F.col("text").alias("needle"), "item_id")
    hits = v.needles(d, "doc_id", "text", named, exempt)
    return hits.join(named, "needle").select(F.col("subject").alias("doc_id"), "item_id")


@query("""SELECT rule, o_orderkey::VARCHAR AS subject FROM (SELECT o_orderkey, unnest([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status is known' END, CASE WHEN o_totalprice < 1000 THEN 'price is real' END, CASE WHEN o_orderpriority NOT LIKE '_-%' THEN 'priority is coded' END]) AS rule FROM orders) WHERE rule IS NOT NULL""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: a rule table in one pass."""
    d = _t(spark, sf_dir, "orders")
    checks = {"status is known": F.col("o_orderstatus").isin("O", "F"), "price is real": F.col("o_totalprice") >= 1000, "priority is coded": F.col("o_orderpriority").like("_-%")}
    return v.rules(d, "o_orderkey", checks).select("rule", "subject")


@query("SELECT user_id::VARCHAR AS subject, count(*)::VARCHAR AS detail FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19."""
    return v.duplicates(_t(spark, sf_dir, "events"), "user_id").select("subject", "detail")


@query("""SELECT 'missing' AS rule, doc_id::VARCHAR AS subject FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'extra', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one side only."""
    return v.coverage(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("rule", "subject")


@query("SELECT c_custkey::VARCHAR AS subject, (c_nationkey % 20) || ' promised, ' || coalesce(n, 0) || ' shipped' AS detail FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey % 20 <> coalesce(n, 0)")
def promised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and shipped counts."""
    e = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 20).alias("promised"))
    return v.promised(e, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k").select("subject", "detail")


@query("""WITH k AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders),
d AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS expected FROM k)
SELECT o_orderkey AS orderkey FROM d WHERE prev IS NOT NULL AND prev IS DISTINCT FROM expected""")
def changelog_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't continue the one before them."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    d = o.withColumn("prev", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    d = d.withColumn("order", F.struct("o_orderdate", "o_orderkey"))
    bad = v.chain(d, "order", "prev", "o_orderkey", by=["o_custkey"])
    return bad.select(F.regexp_extract("subject", r"(\d+)}$", 1).cast("long").alias("orderkey"))


@query("SELECT a.l_orderkey::VARCHAR AS subject, CASE WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'edited' END AS detail FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a LEFT JOIN (SELECT o_orderkey, o_custkey % 7 + 1 AS n FROM orders) b ON a.l_orderkey = b.o_orderkey WHERE a.n IS DISTINCT FROM b.n")
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that aren't where and what they were."""
    head = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("at")).agg(F.count("*").alias("n"))
    staged = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), (F.col("o_custkey") % 7 + 1).alias("n"))
    return v.append_only(head, staged, "at").select("subject", "detail")


@query("SELECT o_orderkey::VARCHAR AS subject, 'status' AS detail FROM orders WHERE o_orderstatus <> CASE WHEN o_totalprice > 200000 THEN 'F' ELSE o_orderstatus END")
def immutable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that had a value and changed."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return v.immutable_fields(o, o.withColumn("status", F.when(F.col("o_totalprice") > 200000, "F").otherwise(F.col("status"))), "id", ["status"]).select("subject", "detail")


@query("SELECT doc_id, sha256(text) AS full_hash, left(sha256(text), 16) AS short_hash, left(sha256(lang || '==' || source || ':' || sha256(text)), 16) AS model_hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, whole, cut and composed."""
    h = scalars.sha256_hex(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", h.alias("full_hash"), scalars.sha256_hex(F.col("text"), 16).alias("short_hash"), scalars.model_hash(F.col("lang"), F.col("source"), h).alias("model_hash"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT user_id, count(*)::BIGINT AS read_parts, count_if(event_type = 'view')::BIGINT AS fallbacks FROM e WHERE NOT (event_type = 'view' AND nxt IS NOT DISTINCT FROM 'click') GROUP BY user_id""")
def pending_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written form goes where its read form follows."""
    tag = F.when(F.col("event_type") == "view", "k").when(F.col("event_type") == "click", "q").otherwise("w")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").select(F.lit("").alias("path"), F.col("user_id").alias("seq"), F.row_number().over(w).alias("pos"), tag.alias("tag"))
    return edition.spoken_parts(e).groupBy(F.col("seq").alias("user_id")).agg(F.count("*").alias("read_parts"), F.count_if(F.col("tag") == "k").alias("fallbacks"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS spent FROM lineitem)
SELECT l_orderkey, min(l_linenumber)::BIGINT AS at, round(min_by(spent, l_linenumber), 2) AS spent FROM s WHERE spent > 100 GROUP BY l_orderkey""")
def budget_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call strictly over a running cap."""
    s = v.running_budget(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", 100)
    return v.first_breach(s, ["l_orderkey"], "l_linenumber").select("l_orderkey", F.col("l_linenumber").cast("long").alias("at"), F.round("spent", 2).alias("spent"))


@query(rf"WITH {PAIRS} SELECT conv_id || '.' || turn AS line_id, gt AS text, 'claude' AS winner, CASE WHEN regexp_replace(gt, '[^א-ת]', '', 'g') = regexp_replace(pred, '[^א-ת]', '', 'g') THEN 0 ELSE 1 END::BIGINT AS tie_break FROM p")
def combined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of a line, with the tie flag."""
    p = _pairs(spark, sf_dir).withColumn("line_id", F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    got = score.combined_lines(p.select("line_id", F.col("gt").alias("text")), p.select("line_id", F.col("pred").alias("text")))
    return got.withColumn("tie_break", F.col("tie_break").cast("long"))


@query("SELECT lang, round(avg(toxic), 6) AS rate, count(*)::BIGINT AS n, count_if(toxic IS NULL)::BIGINT AS failures FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def mean_without_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures are counted, not averaged."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("rate")), "doc_id", "left")
    return score.disagreement_rates(d, ["lang"]).withColumn("rate", _r("rate"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE l_returnflag WHEN 'R' THEN 'Deut' WHEN 'A' THEN '1Sam' ELSE 'Other' END || '.' || l_orderkey || '.' || l_linenumber AS ref, CASE l_returnflag WHEN 'R' THEN 'Deut' WHEN 'A' THEN '1Sam' ELSE 'Other' END AS book, l_orderkey::BIGINT AS chapter FROM lineitem")
def verse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: references built and parsed."""
    book = F.when(F.col("l_returnflag") == "R", "Deuteronomy").when(F.col("l_returnflag") == "A", "Samuel 1").otherwise("Other")
    d = _t(spark, sf_dir, "lineitem").withColumn("ref", views.verse_ref(book, F.col("l_orderkey"), F.col("l_linenumber"))).withColumn("r", views.parsed_ref(F.col("ref")))
    return d.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "ref", "r.book", F.col("r.chapter").cast("long").alias("chapter"))


@query("SELECT p_type, sum(p_size)::BIGINT AS tokens, round(sum(coalesce(p_size, 0) * 3.0 + p_partkey * 15.0) / 1000000, 6) AS usd, round(0.5 * avg(p_size) + 0.3 * avg(p_retailprice), 4) AS composite FROM part GROUP BY p_type")
def costs_and_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token costs, and the weighted composite with a missing part."""
    usd = scalars.cost_usd(F.col("p_size"), F.col("p_partkey"), F.lit(3.0), F.lit(15.0))
    g = _t(spark, sf_dir, "part").groupBy("p_type").agg(F.sum("p_size").alias("tokens"), _r(F.sum(usd)).alias("usd"), F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"))
    return g.select("p_type", "tokens", "usd", F.round(scalars.composite(F.col("a"), F.col("b"), F.lit(None).cast("double")), 4).alias("composite"))


@query("SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, count(*)::BIGINT AS line_count, sum(length(text))::BIGINT AS total FROM conversations GROUP BY conv_id")
def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: documents nested again in their order."""
    c = _t(spark, sf_dir, "conversations")
    d = c.select(F.col("conv_id").alias("folio"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), F.col("role").alias("verse_ref"), F.length("text").alias("consonant_count"), F.array().cast(documents.POSITIONAL).alias("tier4_positional"))
    return sinks.folio_goldens(d).select(F.col("folio_id").alias("conv_id"), F.array_join("verse_refs", "|").alias("roles"), "line_count", F.col("consonant_total").alias("total"))


@query()
def letter_reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: a turn's marks on the next turn's letters; tested against a plain dynamic program."""
    p = _pairs(spark, sf_dir).repartition(*KEYS).withColumn("verse_ref", F.concat_ws(".", *[F.col(c).cast("string") for c in KEYS]))
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z]", "")
    a = marks.exploded(p.withColumn("_m", marks.mark_positions(F.col("gt"), PLAIN, "A-Za-z")), "_m", "verse_ref")
    return alignment.reproject(a, p.select("verse_ref", letters("gt").alias("side"), letters("pred").alias("backbone"))).groupBy("type").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


@query()
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scorer over pairs of turns."""
    none = F.array().cast("array<struct<type:string,verse_ref:string,ordinal:int>>")
    p = _pairs(spark, sf_dir).repartition(*KEYS).select(F.concat_ws(".", *[F.col(c).cast("string") for c in KEYS]).alias("doc_id"), F.col("gt").alias("gt_text"), F.col("pred").alias("pred_text"), none.alias("gt_marks"), none.alias("pred_marks"))
    return score.score(p).drop("alignment")


def queries() -> dict[str, Query]:
    from lectio import pointed, standing  # noqa: F401 - add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
