"""Further queries over the shared tables, each with its SQL: the text operators on pointed text, and rules, joins and documents.

The tables hold no pointed text, so letters are read as Hebrew ones, vowels as points and punctuation as marks, the same
way in both engines; what then runs are the library's own operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio import codepoints as cp
from lectio.functions import scalars, views
from lectio.operators import alignment, confusion, marks, schema
from lectio.operators import metrics as m
from lectio.operators import validate as v
from lectio.plans import agreement, govern, runs, score
from lectio.queries import AC1, AGREE, ALPHA, CELL_SQL, DRAWS, KAPPA, KEYS, MARKS, SHARES, UNITS, _coders, _nominal, _r, _sides, _t, query
from lectio.sources import documents, sinks

#: Letters, then vowels and punctuation, and what they are read as; a point or mark never precedes a vowel's point.
LETTERS = ("bcdfghjklmnpqrstvwxyzéèêçüßäöóñí", "בגדהוזחטיכלמנסעפצקרשתאךםןףץבגדהו")
POINTS = ("aeiou,.;:!?-", "\u05B7\u05B6\u05B4\u05B9\u05BB\u05AF\u05BF\u05BC\u05C3\u0591\u05BD\u05BE")
#: The one vowel that the second side of a comparison reads as another one.
TURNED = ("\u05BB", "\u05B9")


def pointed(c: str | Column) -> Column:
    s = F.lower(c)
    for pattern, new in ((r"([aeiou])[aeiou]+", "$1"), (r"([.,;:!?\-])[.,;:!?\-]+", "$1"), (r"([.,;:!?\-])([aeiou])", "$1 $2")):
        s = F.regexp_replace(s, pattern, new)
    return F.translate(s, LETTERS[0] + POINTS[0], LETTERS[1] + POINTS[1])


def _sql(c: str) -> str:
    s = f"lower({c})"
    for pattern, new in ((r"([aeiou])[aeiou]+", r"\1"), (r"([.,;:!?\-])[.,;:!?\-]+", r"\1"), (r"([.,;:!?\-])([aeiou])", r"\1 \2")):
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    return f"translate({s}, '{LETTERS[0] + POINTS[0]}', '{LETTERS[1] + POINTS[1]}')"


def _drop_sql(x: str, chars: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[{chars}]', '', 'g'), '  +', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _class(*codes: str) -> str:
    return "".join(rf"\x{{{c}}}" if "-" not in c else "-".join(rf"\x{{{e}}}" for e in c.split("-")) for c in codes)


TIER1_SQL = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[^{_class('05D0-05EA')} {_class('05BE')}]', '', 'g'), '  +', ' ', 'g'))"
TIER2_SQL = lambda x: _drop_sql(x, _class("0591-05AF", "05BD", "05BF", "05C0", "05C3", "05C6"))


@query(f"""WITH x AS (SELECT doc_id, {_sql('text')} AS t FROM documents)
SELECT doc_id, sha256({TIER1_SQL('t')}) AS tier1, sha256({TIER2_SQL('t')}) AS tier2, sha256(t) AS tier3, sha256({TIER2_SQL('t')}) AS agreed,
  sha256({_drop_sql('t', _class('0591-05AF', '05B0-05BD', '05BF-05C7'))}) AS loaded1, sha256({TIER2_SQL('t')}) AS loaded2, sha256(regexp_replace(t, '  +', ' ', 'g').regexp_replace('^\\s+|\\s+$', '', 'g')) AS loaded3,
  length(regexp_replace(t, '[^א-ת]', '', 'g'))::BIGINT AS consonants FROM x""")
def pointed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer's, the annotators' and the loader's views of whole texts."""
    x = _t(spark, sf_dir, "documents").select("doc_id", pointed("text").alias("t"))
    t, sha = F.col("t"), lambda c: F.sha2(c, 256)
    tagged = F.concat(F.lit("<MF>"), t, F.lit("<BL>͏"))
    own = {**{f"tier{k}": views.scorer_view(t, k) for k in views.TIERS}, "agreed": views.agreement_view(tagged, 2), **{f"loaded{k}": views.loader_view(t, k) for k in (1, 2, 3)}}
    return x.select("doc_id", *[sha(c).alias(k) for k, c in own.items()], F.length(views.consonants_of(t)).cast("long").alias("consonants"))


RECORDS_SQL = f"x AS (SELECT conv_id, turn, regexp_extract_all({_sql('text')}, '[א-ת][^א-ת]*') AS cs FROM conversations)"


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT conv_id, turn, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM x)
SELECT conv_id, turn, count(*)::BIGINT AS letters, count_if(contains(c, '{cp.DAGESH}'))::BIGINT AS hard, sum(i * unicode(c[1]))::BIGINT AS weighted,
  count_if(c[1] IN {tuple(cp.BEGADKEFAT)} AND NOT contains(c, '{cp.DAGESH}'))::BIGINT AS ruled FROM r GROUP BY conv_id, turn""")
def letter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consonants with their ordinals, and where the rule puts a rafe."""
    x = _t(spark, sf_dir, "conversations").select(*KEYS, pointed("text").alias("t"))
    x = x.select(*KEYS, views.consonant_records(F.col("t")).alias("r"), views.predicted_rafe(F.col("t")).alias("p"), views.consonant_count(F.col("t")).alias("letters")).where("letters > 0")
    e = x.select(*KEYS, "letters", "p", F.explode("r").alias("c"))
    code = F.conv(F.hex(F.encode(F.col("c.letter"), "UTF-16BE")), 16, 10).cast("long")
    g = e.groupBy(*KEYS).agg(F.first("letters").cast("long").alias("letters"), F.count_if("c.dagesh").alias("hard"), F.sum(F.col("c.ordinal") * code).alias("weighted"), F.first(F.size("p")).cast("long").alias("ruled"))
    return g


NAMED_SQL = " ".join(f"WHEN {k} THEN '{n}'" for k, n in cp.MARK_NAMES.items())


@query(f"""WITH x AS (SELECT unnest(string_split({_sql('text')}, '')) AS c FROM documents), n AS (SELECT CASE unicode(c) {NAMED_SQL} END AS name FROM x)
SELECT name, CASE WHEN name IN {cp.OWN_CLASS} THEN name WHEN name IN {cp.DOT_CLASS} THEN 'dot' ELSE 'vowel' END AS class, count(*)::BIGINT AS n FROM n WHERE name IS NOT NULL GROUP BY name""")
def point_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by name and class."""
    x = _t(spark, sf_dir, "documents").select(F.explode(views.mark_names(pointed("text"))).alias("name"))
    return x.groupBy("name").agg(F.count("*").alias("n")).withColumn("class", views.mark_class(F.col("name")))


@query(f"""WITH x AS (SELECT unnest(regexp_extract_all({_sql('text')}, '[א-ת]\\p{{Mn}}*')) AS c FROM documents)
SELECT list_aggregate(list_sort(regexp_extract_all(c, '[{_class('05B0-05BD', '05C1', '05C2', '05C7')}]')), 'string_agg', '') AS points, count(*)::BIGINT AS n FROM x GROUP BY points""")
def vowel_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that each consonant's cluster decides on."""
    x = _t(spark, sf_dir, "documents").select(F.explode(views.clusters(pointed("text"))).alias("c")).where(views.has_consonant(F.col("c")))
    return x.groupBy(F.array_join(views.vowel_decision(F.col("c")), "").alias("points")).agg(F.count("*").alias("n")).withColumn("points", F.nullif("points", F.lit("")))


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, g, p): a turn's pointed text and the same with one vowel read as another."""
    return _t(spark, sf_dir, "conversations").select(*KEYS, "role", pointed("text").alias("g")).withColumn("p", F.translate("g", *TURNED))


TURNED_SQL = f"x AS (SELECT conv_id, turn, role, {_sql('text')} AS g FROM conversations)"
COUNTS_SQL = rf"""k AS (SELECT conv_id, turn, g, length(g) AS n, length(regexp_replace(g, '[^\x{{05BB}}]', '', 'g')) AS changed, length(regexp_replace(g, '[^א-ת]', '', 'g')) AS letters, len(regexp_extract_all(g, '[א-ת]\x{{05BB}}')) AS on_letters,
  length(regexp_replace(g, '[^{_class('05B0-05BD', '05C1', '05C2', '05C7')}]', '', 'g')) AS points, list_filter(string_split_regex(g, '\s+'), lambda w: w <> '') AS ws FROM x)"""
SHARE_SQL = lambda wrong, of: f"round(CASE WHEN {of} = 0 THEN 1.0 ELSE ({of} - ({wrong})) / {of} END, 6)"


@query(f"""WITH {TURNED_SQL}, {COUNTS_SQL}
SELECT conv_id, turn, {SHARE_SQL('on_letters', 'letters')} AS dec, {SHARE_SQL('changed', 'n')} AS cha, {SHARE_SQL('changed', 'points')} AS voc, {SHARE_SQL(f"len(list_filter(ws, lambda w: contains(w, '{TURNED[0]}')))", 'len(ws)')} AS wor FROM k""")
def aligned_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, code points, points and words right, over the optimal alignment of clusters."""
    d = _turned(spark, sf_dir).repartition(*KEYS).withColumn("al", alignment.aligned(views.clusters(F.col("g")), views.clusters(F.col("p"))))
    return confusion.factoring(d, "al", "g", "p").select(*KEYS, *[_r(c).alias(c) for c in ("dec", "cha", "voc", "wor")])


CLUSTER_SQL = r"(?s).[\x{0591}-\x{05BD}\x{05BF}]*"
#: Letters and points as ASCII letters, which the pointed text has none of: SQL's edit distance counts bytes.
PLAIN_SQL = lambda x: f"translate({x}, '{LETTERS[1] + POINTS[1]}', '{''.join(map(chr, [*range(65, 91), *range(97, 116)]))}')"
NAMED = ("p_name", "p_brand", "p_type")


@query(f"""WITH RECURSIVE x AS (SELECT p_partkey, regexp_extract_all({_sql(" || ' ' || ".join(NAMED))}, '{CLUSTER_SQL}') AS cs FROM part),
s AS (SELECT a.p_partkey, a.cs AS g, b.cs AS p FROM x a JOIN x b ON b.p_partkey = a.p_partkey + 1),
t(p_partkey, i, g, p, scores) AS (
  SELECT p_partkey, 0::BIGINT, g, p, list_transform(range(len(p) + 1), lambda j: {{'c': length(array_to_string(p[1:j], ''))::BIGINT, 'w': repeat('i', j)}}) FROM s
  UNION ALL
  SELECT p_partkey, i + 1, g, p, list_reduce(list_prepend([{{'c': scores[1].c + length(g[i + 1]), 'w': scores[1].w || 'd'}}], list_transform(range(1, len(p) + 1), lambda j: [
      {{'c': scores[j].c + levenshtein({PLAIN_SQL('g[i + 1]')}, {PLAIN_SQL('p[j]')}), 'w': scores[j].w || 'm'}}, {{'c': scores[j + 1].c + length(g[i + 1]), 'w': scores[j + 1].w || 'd'}}, {{'c': length(p[j])::BIGINT, 'w': 'i'}}])),
    lambda a, x: list_append(a, CASE WHEN x[1].c <= x[2].c AND x[1].c <= a[-1].c + x[3].c THEN x[1] WHEN x[2].c <= a[-1].c + x[3].c THEN x[2] ELSE {{'c': a[-1].c + x[3].c, 'w': a[-1].w || 'i'}} END))
  FROM t WHERE i < len(g))
SELECT p_partkey, scores[-1].c AS edits, length(array_to_string(g, ''))::BIGINT AS denominator, scores[-1].w AS way FROM t WHERE i = len(g)""")
def gapped_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: unlike pointed texts aligned cluster by cluster, with gaps, ties and pairs of clusters of several code points; each part against the next."""
    x = _t(spark, sf_dir, "part").select("p_partkey", views.clusters(pointed(F.concat_ws(" ", *NAMED))).alias("cs"))
    pairs = x.select("p_partkey", F.col("cs").alias("g")).join(x.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("cs").alias("p")), "p_partkey")
    move = lambda c: F.when(c["g"].isNull(), "i").when(c["p"].isNull(), "d").otherwise("m")
    al = pairs.withColumn("al", alignment.aligned("g", "p"))
    return al.select("p_partkey", alignment.alignment_cost(F.col("al")).alias("edits"), F.length(F.array_join("g", "")).cast("long").alias("denominator"), F.array_join(F.transform("al", move), "").alias("way"))


@query(f"""WITH {TURNED_SQL}, c AS (SELECT role, unnest(string_split(g, '')) AS c FROM x), n AS (SELECT role, c, CASE unicode(c) {NAMED_SQL} END AS gt_mark FROM c)
SELECT role, gt_mark, CASE WHEN c = '{TURNED[0]}' THEN 'holam' ELSE gt_mark END AS pred_mark, count(*)::BIGINT AS n FROM n WHERE gt_mark IS NOT NULL GROUP BY ALL""")
def point_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which point was read as which, over aligned clusters."""
    d = _turned(spark, sf_dir).repartition(*KEYS).withColumn("al", alignment.aligned(views.clusters(F.col("g")), views.clusters(F.col("p"))))
    return confusion.mark_confusion(d, "al", ["role"])


SCORED_SQL = rf"""b AS (SELECT conv_id, turn, g, {TIER1_SQL('g')} AS t1, {TIER2_SQL('g')} AS t2 FROM x),
h AS (SELECT conv_id, turn, regexp_extract_all(g, '[א-ת][^א-ת]*') AS cs FROM b), r AS (SELECT conv_id, turn, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM h),
mk AS (SELECT conv_id, turn, count_if(contains(c, '{cp.CIRCELLUS}')) AS nc, count_if(contains(c, '{cp.RAFE}')) AS nr, count_if(contains(c, '{cp.RAFE}') AND nxt) AS kept
  FROM (SELECT *, coalesce(contains(lead(c) OVER (PARTITION BY conv_id, turn ORDER BY i), '{cp.RAFE}'), false) AS nxt FROM r) GROUP BY conv_id, turn),
s AS (SELECT b.conv_id, b.turn, g, t1, t2, length(regexp_replace(g, '[^{TURNED[0]}]', '', 'g')) AS e, coalesce(nc, 0) AS nc, coalesce(nr, 0) AS nr, coalesce(kept, 0) AS kept FROM b LEFT JOIN mk USING (conv_id, turn))"""


@query(rf"""WITH {TURNED_SQL}, {SCORED_SQL}, c AS (SELECT *, nc + kept AS ex, nr - kept AS q, CASE WHEN length(t2) = 0 THEN CASE WHEN e = 0 THEN 0.0 ELSE 1.0 END ELSE e / length(t2) END AS c2, CASE WHEN length(g) = 0 THEN CASE WHEN e = 0 THEN 0.0 ELSE 1.0 END ELSE e / length(g) END AS c3 FROM s)
SELECT conv_id || '.' || turn AS doc_id, 0::BIGINT AS tier1_edits, length(t1)::BIGINT AS tier1_denominator, e::BIGINT AS tier2_edits, length(t2)::BIGINT AS tier2_denominator, e::BIGINT AS tier3_edits, length(g)::BIGINT AS tier3_denominator,
  round(0.3 * c2 + 0.2 * c3, 6) AS cer3, ex::BIGINT AS tp_exact, q::BIGINT AS tp_partial, 0::BIGINT AS fp, 0::BIGINT AS fn,
  round(CASE WHEN nc + nr = 0 THEN 1.0 ELSE (ex + q / 3) / (nc + nr) END, 6) AS f1 FROM c""")
def whole_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer over pairs of texts with marks (A2, P10, J4, G12, P26): the second side turns one vowel and puts each rafe a letter on."""
    mk = "array<struct<type:string,verse_ref:string,ordinal:int>>"
    placed = lambda step: F.transform(marks.extract_positional(F.col("g")), lambda x: F.struct(x["type"].alias("type"), F.lit("v").alias("verse_ref"), (x["ordinal"] + F.when(x["type"] == "rafe", step).otherwise(0)).alias("ordinal"))).cast(mk)
    d = _turned(spark, sf_dir).repartition(*KEYS)
    d = d.select(F.concat_ws(".", *[F.col(c).cast("string") for c in KEYS]).alias("doc_id"), F.col("g").alias("gt_text"), F.col("p").alias("pred_text"), placed(0).alias("gt_marks"), placed(1).alias("pred_marks"))
    s = score.score(d)
    return s.select("doc_id", *[f"tier{t}_{c}" for t in views.TIERS for c in ("edits", "denominator")], _r("cer3").alias("cer3"), *[F.col(c).cast("long").alias(c) for c in ("tp_exact", "tp_partial", "fp", "fn")], _r("f1").alias("f1"))


@query(rf"""WITH x AS (SELECT conv_id, turn, unnest(string_split(replace({_sql('text')}, chr(10), ' '), '{cp.SOF_PASUQ}')) AS c FROM conversations), y AS (SELECT conv_id, turn, regexp_replace(c, '^\s+|\s+$', '', 'g') AS c FROM x)
SELECT conv_id, turn, count(*)::BIGINT AS chunks, sum(length(c))::BIGINT AS total FROM y WHERE c <> '' GROUP BY conv_id, turn""")
def verse_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text cut at verse ends."""
    c = documents.chunked(_t(spark, sf_dir, "conversations").select(*KEYS, F.concat(F.lit("<MF>"), pointed("text")).alias("t")), "t")
    return c.groupBy(*KEYS).agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("total"))


@query(f"""WITH {RECORDS_SQL} SELECT conv_id, turn, (len(cs) + CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS stored, turn % 3 = 1 OR (turn % 3 = 2 AND len(list_filter(cs, lambda c: contains(c, '{cp.CIRCELLUS}') OR contains(c, '{cp.RAFE}'))) > 0) AS drift FROM x""")
def drifted_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts and marks against what a text yields."""
    x = _t(spark, sf_dir, "conversations").select(*KEYS, pointed("text").alias("chunk"))
    kept = F.when(F.col("turn") % 3 == 2, F.array().cast(documents.POSITIONAL)).otherwise(marks.extract_positional(F.col("chunk")))
    x = x.withColumns({"consonant_count": views.consonant_count(F.col("chunk")) + (F.col("turn") % 3 == 1).cast("int"), "tier4_positional": kept})
    return documents.with_drift(x).select(*KEYS, F.col("consonant_count").cast("long").alias("stored"), "drift")


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT conv_id, turn, unnest(cs) AS c FROM x), t AS (SELECT conv_id, turn, contains(c, '{cp.RAFE}') AS gold, c[1] IN {tuple(cp.BEGADKEFAT)} AND NOT contains(c, '{cp.DAGESH}') AS rule FROM r)
SELECT 'folio' AS kind, f AS stratum, count(DISTINCT (v.conv_id, v.turn))::BIGINT AS n_verses, count_if(gold AND rule)::BIGINT AS tp, count_if(rule AND NOT gold)::BIGINT AS fp, count_if(gold AND NOT rule)::BIGINT AS fn
FROM (SELECT conv_id, turn, role AS f FROM conversations) v LEFT JOIN t USING (conv_id, turn) GROUP BY f
UNION ALL SELECT 'section', 'prose', (SELECT count(*) FROM conversations), count_if(gold AND rule), count_if(rule AND NOT gold), count_if(gold AND NOT rule) FROM t""")
def ruled_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule against a text's own rafes, by folio and by section."""
    x = _t(spark, sf_dir, "conversations")
    verses = x.select(F.struct(*KEYS).alias("i"), F.col("role").alias("folio"), F.concat_ws(".", F.lit("Gen"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("verse_ref"), pointed("text").alias("chunk"))
    shown = [m.Metric(n, (c,), lambda x: x.cast("long")) for n, c in (("tp", "tp0"), ("fp", "fp0"), ("fn", "fn0"))]
    return agreement.strata(agreement.rafe_rule(verses), shown)


@query(f"""WITH u AS (SELECT lang AS folio, 'prose' AS section, {CELL_SQL} FROM labels JOIN documents USING (doc_id) GROUP BY lang),
s AS (SELECT 'folio' AS kind, folio AS stratum, pp, pn, np, nn FROM u UNION ALL SELECT 'section', 'prose', sum(pp), sum(pn), sum(np), sum(nn) FROM u)
SELECT kind, stratum, (pp + pn + np + nn)::BIGINT AS n_verses, round(CASE WHEN 2 * pp + pn + np = 0 THEN 1.0 ELSE 2 * pp / (2 * pp + pn + np) END, 6) AS f1, round(2 * (pp + nn) / (pp + pn + np + nn) - 1, 6) AS pabak FROM s""")
def label_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stratifications of a panel in one aggregation."""
    d = _coders(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("folio")), "doc_id").withColumn("section", F.lit("prose"))
    return agreement.strata(d, [m.f1("f1", "pp", "np", "pn"), AGREE[1]]).select("kind", "stratum", F.col("n_verses").cast("long").alias("n_verses"), _r("f1").alias("f1"), _r("pabak").alias("pabak"))


@query("""WITH d AS (SELECT l.doc_id, quality, toxic, source FROM labels l JOIN documents USING (doc_id)), n AS (SELECT source, max(doc_id) + 1 AS units FROM documents GROUP BY source),
c AS (SELECT source, CASE WHEN quality = 1 THEN 'circellus' ELSE 'none' END AS a, CASE WHEN toxic = 1 THEN 'rafe' ELSE 'none' END AS b FROM d WHERE quality = 1 OR toxic = 1)
SELECT source, a, b, count(*)::BIGINT AS n FROM c GROUP BY ALL UNION ALL SELECT source, 'none', 'none', units - (SELECT count(*) FROM c WHERE c.source = n.source) FROM n WHERE units > (SELECT count(*) FROM c WHERE c.source = n.source)""")
def coded_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coders' marks on an axis of units, none/none counted without spelling it out."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source")
    d = _t(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("ordinal", F.col("doc_id") + 1)
    side = lambda c, kind: d.where(F.col(c) == 1).select("source", "ordinal", F.lit(kind).alias("type"))
    axis = docs.groupBy("source").agg((F.max("doc_id") + 1).alias("n_units"))
    return marks.coded_units(side("quality", "circellus"), side("toxic", "rafe"), axis, ["source"])


@query(f"""WITH u AS (SELECT doc_id % {UNITS} AS i, {CELL_SQL} FROM labels GROUP BY ALL), d AS (SELECT b, ((b * 7919 + k * 104729 + b * k * 31) % {UNITS}) AS i FROM range({DRAWS}) t(b), range({UNITS}) s(k)),
c AS (SELECT b, sum(pp) AS pp, sum(pn) AS pn, sum(np) AS np, sum(nn) AS nn FROM d JOIN u USING (i) GROUP BY b), s AS (SELECT *, {SHARES} FROM c), r AS (SELECT {KAPPA} AS kappa, 2 * po - 1 AS pabak, {AC1} AS ac1, {ALPHA} AS alpha FROM s),
p AS (SELECT *, {SHARES} FROM (SELECT {CELL_SQL} FROM labels)), q AS (SELECT {KAPPA} AS kappa, 2 * po - 1 AS pabak, {AC1} AS ac1, {ALPHA} AS alpha FROM p)
{' UNION ALL '.join(f"SELECT '{x}' AS metric, round((SELECT {x} FROM q), 6) AS point, round(quantile_cont({x}, 0.025), 6) AS lo, round(quantile_cont({x}, 0.975), 6) AS hi FROM r" for x in ('kappa', 'pabak', 'ac1', 'alpha'))}""")
def metric_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and percentile intervals of all metrics from one pass over a plan."""
    u = _nominal(_coders(spark, sf_dir)).groupBy((F.col("doc_id") % UNITS).alias("i")).agg(*[F.sum(c).alias(c) for c in (*m.CELLS, "u_1_1", "u_1_0", "u_0_1", "u_0_0")])
    d = spark.range(DRAWS).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(UNITS - 1))).alias("k"))
    d = d.select("b", ((F.col("b") * 7919 + F.col("k") * 104729 + F.col("b") * F.col("k") * 31) % UNITS).alias("i")).groupBy("b", "i").agg(F.count("*").alias("w"))
    return m.intervals(u, AGREE, d, "percentile").select("metric", *[_r(c).alias(c) for c in ("point", "lo", "hi")])


# both sides' ordinals of a bucket; then, mark by mark of the first, what the second has left and the pairs made
GREEDY_SQL = f"""WITH RECURSIVE {MARKS},
u AS (SELECT conv_id, turn, type, list(DISTINCT ordinal) AS a, []::BIGINT[] AS b FROM dgt GROUP BY conv_id, turn, type UNION ALL SELECT conv_id, turn, type, []::BIGINT[], list(DISTINCT ordinal) FROM dpred GROUP BY conv_id, turn, type),
k AS (SELECT conv_id, turn, type, list_sort(flatten(list(a))) AS a, list_sort(flatten(list(b))) AS b FROM u GROUP BY conv_id, turn, type),
z AS (SELECT conv_id, turn, type, a, b, list_sort(list_intersect(a, b)) AS e, list_sort(list_filter(a, lambda v: NOT list_contains(b, v))) AS ra, list_sort(list_filter(b, lambda v: NOT list_contains(a, v))) AS rb FROM k),
g AS (SELECT conv_id, turn, type, ra, rb::BIGINT[] AS rest, []::BIGINT[] AS ds, 1 AS i FROM z
  UNION ALL SELECT conv_id, turn, type, ra, CASE WHEN f[1] <= ra[i] + 1 THEN f[2:] ELSE f END, CASE WHEN f[1] <= ra[i] + 1 THEN list_append(ds, f[1] - ra[i]) ELSE ds END, i + 1
  FROM (SELECT *, list_filter(rest, lambda v: v >= ra[i] - 1) AS f FROM g WHERE i <= len(ra))),
t AS (SELECT z.conv_id, z.turn, z.type, a, b, e, ds FROM z JOIN g ON z.conv_id = g.conv_id AND z.turn = g.turn AND z.type = g.type AND g.i = len(g.ra) + 1)"""


@query(f"{GREEDY_SQL} SELECT conv_id, turn, sum(len(e) + len(ds))::BIGINT AS tp, sum(len(b) - len(e) - len(ds))::BIGINT AS fp, sum(len(a) - len(e) - len(ds))::BIGINT AS fn FROM t GROUP BY conv_id, turn")
def tolerant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact pairs first, then greedily from left to right within one."""
    a, b = (marks.detections(x, *KEYS) for x in _sides(spark, sf_dir))
    return marks.match_counts(a, b, KEYS, 1)


@query(f"""{GREEDY_SQL}, w AS (SELECT conv_id, turn, type, a, b, 1 AS i, 1 AS j, 0::BIGINT AS n FROM k
  UNION ALL SELECT conv_id, turn, type, a, b, CASE WHEN b[j] < a[i] - 1 THEN i ELSE i + 1 END, CASE WHEN b[j] > a[i] + 1 THEN j ELSE j + 1 END, n + (abs(a[i] - b[j]) <= 1)::BIGINT FROM w WHERE i <= len(a) AND j <= len(b)),
m AS (SELECT conv_id, turn, type, n FROM w WHERE i > len(a) OR j > len(b))
SELECT conv_id, turn, type, (len(e) + len(ds))::BIGINT AS greedy, n AS most, n - len(e) - len(ds) AS lost FROM t JOIN m USING (conv_id, turn, type)""")
def lost_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the greedy rule, exact pairs first, loses against a matching of greatest size."""
    a, b = (marks.detections(x, *KEYS) for x in _sides(spark, sf_dir))
    return marks.lost_pairs(a, b, KEYS)


@query(f"""{GREEDY_SQL}, o AS (SELECT unnest(list_concat(list_transform(e, lambda v: 0), ds))::BIGINT AS d FROM t WHERE type = 'circellus')
SELECT count(*)::BIGINT AS n_matched, quantile_cont(d, 0.5)::DOUBLE AS median, quantile_cont(d, 0.25)::DOUBLE AS iqr_lower, quantile_cont(d, 0.75)::DOUBLE AS iqr_upper, count_if(d = -1)::BIGINT AS before, count_if(d = 0)::BIGINT AS same, count_if(d = 1)::BIGINT AS after FROM o""")
def tolerant_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed offsets of tolerant pairs."""
    a, b = (marks.detections(x, *KEYS) for x in _sides(spark, sf_dir))
    o = marks.offsets(marks.match_table(a, b, KEYS, 1))
    return o.select("n_matched", "median", "iqr_lower", "iqr_upper", *[F.col("histogram")[k].alias(n) for k, n in (("-1", "before"), ("+0", "same"), ("+1", "after"))])


# the score matrix row by row, a cell being the least of its diagonal and upper way carried along the row; then the way back
LETTERS_SQL = """WITH RECURSIVE q AS (SELECT p_partkey AS k, string_split(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), '') AS s, string_split(regexp_replace(lower(p_type || p_brand), '[^a-z]', '', 'g'), '') AS b FROM part),
w AS (SELECT k, s, b, 0 AS i, [range(0, len(b) + 1)] AS t FROM q
  UNION ALL SELECT k, s, b, i + 1, list_append(t, list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda x: u[x] + j - x)))) FROM (
    SELECT k, s, b, i, t, list_transform(range(1, len(b) + 2), lambda j: CASE WHEN j = 1 THEN t[i + 1][1] + 1 ELSE least(t[i + 1][j] + 1, t[i + 1][j - 1] + CASE WHEN s[i + 1] = b[j - 1] THEN 0 ELSE 1 END) END) AS u FROM w WHERE i < len(s))),
h AS (SELECT k, s, b, t, len(s) AS i, len(b) AS j, []::BIGINT[] AS kept FROM w WHERE i = len(s)
  UNION ALL SELECT k, s, b, t, CASE WHEN d <= up AND d <= lf OR up <= lf THEN i - 1 ELSE i END, CASE WHEN d <= up AND d <= lf OR up > lf THEN j - 1 ELSE j END, CASE WHEN d <= up AND d <= lf THEN list_prepend(i * 1000 + j, kept) ELSE kept END FROM (
    SELECT *, t[i][j] + CASE WHEN s[i] = b[j] THEN 0 ELSE 1 END AS d, t[i][j + 1] + 1 AS up, t[i + 1][j] + 1 AS lf FROM h WHERE i > 0 AND j > 0))"""


@query(f"{LETTERS_SQL} SELECT k AS p_partkey, len(kept)::BIGINT AS kept, len(s)::BIGINT AS letters, coalesce(list_sum(kept), 0)::BIGINT AS places FROM h WHERE i = 0 OR j = 0")
def letter_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: letters of one text on another's, with the ties' order."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    axes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("verse_ref"), letters("p_name").alias("side"), letters(F.concat("p_type", "p_brand")).alias("backbone"))
    every = axes.select("verse_ref", F.explode(F.sequence(F.lit(1), F.length("side"))).alias("ordinal"))
    got = alignment.reproject(every, axes).groupBy("verse_ref")
    return got.agg(F.count_if("kept").alias("kept"), F.count("*").alias("letters"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("ordinal") * 1000 + F.col("new_ordinal"))), F.lit(0)).cast("long").alias("places")).withColumnRenamed("verse_ref", "p_partkey")


ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _visible_sql(c: str) -> str:
    s = f"regexp_replace({c}, '<!--.*?(-->|$)', '', 'gs')"
    for tag in ("script", "style", "template"):
        s = rf"regexp_replace({s}, '<{tag}\b[^>]*>.*?(</{tag}\s*>|$)', '', 'gsi')"
    s = rf"regexp_replace({s}, '</?[A-Za-z][A-Za-z0-9-]*(\s[^<>]*)?/?>', '', 'g')"
    for old, new in ENTITIES:
        s = f"replace({s}, '{old}', '{new}')"
    return rf"regexp_replace({s}, '\p{{Cf}}|\p{{Mn}}', '', 'g')"


#: Before and after a page: definitions with their titles on the line and below it, links and images without a text, and what is left of them.
DEFINED, EMPTY = ("[page]: https://example.org/a \"a page\"\n[next]: <a b>\n    (below)\n", "\n\n"), (" [ \t](/policy)![](x)[\u200b][page][p](/q)", " [p](/q)")


@query(f"WITH x AS (SELECT page_id, '{DEFINED[1]}' || {_visible_sql(f"html || '{EMPTY[1]}'")} AS t FROM pages) SELECT page_id, sha256(t) AS digest, trim(regexp_replace(t, '[\\s*_`>#.\\-]+', ' ', 'g')) <> '' AS substantive FROM x")
def visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of a page's markup, with definitions before it and empty links after, and whether it says something."""
    page = F.concat(F.lit(DEFINED[0]), F.col("html"), F.lit(EMPTY[0]))
    return _t(spark, sf_dir, "pages").select("page_id", F.sha2(scalars.visible_text(page), 256).alias("digest"), govern.substantive(page).alias("substantive"))


@query("""SELECT event_type || CASE WHEN user_id % 2 = 0 THEN '' ELSE 'x' END AS raw, CASE WHEN user_id % 2 = 1 THEN NULL WHEN event_type = 'view' THEN 'inverted_nun' WHEN event_type = 'click' THEN 'puncta_extraordinaria' WHEN event_type = 'error' THEN 'rafe' ELSE 'double_rafe' END AS canonical,
CASE WHEN event_type = 'error' OR event_type NOT IN ('view', 'click', 'error') THEN 'rafe' ELSE CASE WHEN event_type = 'view' THEN 'reversednun' ELSE 'puncta' END END AS folded, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def mark_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark types by their main names, unknown ones as null, and folded."""
    e = _t(spark, sf_dir, "events")
    named = F.when(F.col("event_type") == "view", "reversednun").when(F.col("event_type") == "click", "puncta").when(F.col("event_type") == "error", "rafe").otherwise("double_rafe")
    odd = F.col("user_id") % 2 == 1
    d = e.select(F.concat("event_type", F.when(odd, "x").otherwise("")).alias("raw"), views.canonical_type(F.when(odd, F.concat(named, F.lit("?"))).otherwise(named), strict=False).alias("canonical"), views.folded_type(named).alias("folded"))
    return d.groupBy("raw", "canonical", "folded").agg(F.count("*").alias("n"))


@query("""SELECT event_id, left(sha256('{"a":null,"k":' || (props->>'$.k') || ',"u":' || user_id || '}'), 16) AS digest, (props->>'$.k')::BIGINT > 80 AS over FROM events""")
def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents whose keys come in another order, and a schema's bound."""
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    d = e.select("event_id", F.concat(F.lit('{"u": '), F.col("user_id").cast("string"), F.lit(', "k": '), k, F.lit(', "a": null}')).alias("value"))
    bad = schema.violations(d, "event_id", "value", {"type": "object", "required": ["a", "k", "u"], "properties": {"k": {"type": "integer", "maximum": 80}}, "additionalProperties": True})
    over = bad.where("detail = '$.k maximum'").select(F.col("subject").cast("long").alias("event_id"), F.lit(True).alias("over"))
    return d.join(over, "event_id", "left").select("event_id", scalars.canonical_hash(F.col("value")).alias("digest"), F.coalesce("over", F.lit(False)).alias("over"))


@query("""WITH g AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber) AS qs, min(l_linenumber) AS x0, max(l_linenumber) AS x1, min(l_quantity::INT) AS y0, max(l_quantity::INT) AS y1 FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(list_avg(qs), 4) AS confidence, x0 || ',' || y0 || ',' || x1 || ',' || y1 AS box FROM g""")
def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P29 and the shaping of a service's answers: boxes around points, mean confidences."""
    g = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("x"), F.col("l_quantity").cast("int").alias("y"))).alias("p"), F.collect_list(F.col("l_quantity").cast("double")).alias("q"))
    return g.select("l_orderkey", scalars.mean_confidence(F.col("q")).alias("confidence"), F.array_join(scalars.polygon_box(F.col("p")).cast("array<string>"), ",").alias("box"))


#: What versions end with, by the part's key: final, post, candidate, development, local, alpha.
ENDINGS = (".0", ".0-1", ".0_rc.1", ".0.dev3", ".0+X.1", "a2")


@query("""WITH x AS (SELECT p_partkey, p_type, p_size AS n, p_partkey % 6 AS k, p_partkey % 7 = 0 AS e FROM part), y AS (SELECT *, k IN (2, 3, 5) AS early FROM x)
SELECT p_partkey, replace(lower(p_type), ' ', '-') AS package, NOT e AND n < 30 AND CASE WHEN early THEN n > 10 WHEN k = 1 THEN n >= 10 ELSE n >= 10 AND n <> 20 END AS admitted,
  NOT e AND NOT early AND n = 10 AS compatible, NOT e AND n = 20 AS prefixed, NOT e AND k = 0 AND n = 12 AS literal, e OR n > 15 AS later, e AND n = 9 AND k = 4 AS labelled FROM y""")
def admitted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package names and version specifiers, with epochs, candidates, post and development releases and local labels."""
    p = _t(spark, sf_dir, "part")
    version = F.concat(F.when(F.col("p_partkey") % 7 == 0, "v1!").otherwise(""), F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 6 + 1).cast("int")))
    specifiers = {"admitted": ">=10,<30,!=20", "compatible": "~=10.0", "prefixed": "==20.*", "literal": "===12.0", "later": ">15", "labelled": "== 1!9+x.1"}
    return p.select("p_partkey", scalars.package_name(F.regexp_replace("p_type", " ", "_.")).alias("package"), *[scalars.version_admitted(version, F.lit(s)).alias(k) for k, s in specifiers.items()])


@query("""SELECT 'pin doesn''t admit' AS rule, s_name AS subject, 'brand-' || split_part(p_brand, '#', 2) || ' <' || (s_suppkey % 40) || ' ' || max_size || '.0' AS detail
FROM (SELECT p_brand, max(p_size) AS max_size FROM part GROUP BY p_brand) JOIN supplier ON split_part(p_brand, '#', 2)::INT % 10 = s_suppkey % 10 WHERE max_size >= s_suppkey % 40""")
def broken_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins that a new version breaks."""
    changes = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("n")).select(F.regexp_replace("p_brand", "#", "_").alias("package"), F.concat(F.col("n").cast("string"), F.lit(".0")).alias("version"))
    brands = changes.select("package").withColumn("d", F.regexp_extract("package", r"(\d+)$", 1).cast("int") % 10)
    pins = _t(spark, sf_dir, "supplier").withColumn("d", (F.col("s_suppkey") % 10).cast("int")).join(brands, "d").select(F.col("s_name").alias("consumer"), "package", F.concat(F.lit("<"), (F.col("s_suppkey") % 40).cast("string")).alias("specifier"))
    return govern.version_cascade(changes, pins)


@query("SELECT 'no such supplier' AS rule, l_suppkey::VARCHAR AS subject FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0))")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a row on the other side; the other way isn't asked."""
    s = _t(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return v.referenced(_t(spark, sf_dir, "lineitem"), s, "l_suppkey", "no such supplier").select("rule", "subject")


@query("SELECT user_id, event_type AS type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS ordinal FROM events")
def running_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running number of a mark among those of its type."""
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("type"), "event_id", "ts")
    return marks.ordinals_by_type(e, ["ts", "event_id"], "user_id").drop("ts")


@query("SELECT c_custkey, upper(c_name) || '!' AS text FROM customer")
def model_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string model in its slot."""
    return _t(spark, sf_dir, "customer").select("c_custkey", runs.text_slot(lambda s: s.upper() + "!")(F.col("c_name")).alias("text"))


@query("""WITH k AS (SELECT event_id, props->>'$.k' AS k FROM events), l AS (SELECT k, min(event_id) AS first FROM k GROUP BY k) SELECT event_id, 'answer ' || k AS response FROM k JOIN l USING (k)""")
def replayed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from a log by the digest of their canonical form."""
    k = F.get_json_object("props", "$.k")
    e = _t(spark, sf_dir, "events").select("event_id", k.alias("k"))
    said = lambda d, order: d.withColumn("request", F.concat(*order))
    log = said(e.select("k").distinct(), [F.lit('{"k": "'), F.col("k"), F.lit('", "b": [1, 2]}')]).select(scalars.canonical_hash(F.col("request"), 64, compact=False).alias("prompt_hash"), F.concat(F.lit("answer "), "k").alias("response"))
    requests = said(e, [F.lit('{"b":[1,2],"k":"'), F.col("k"), F.lit('"}')]).select(F.col("event_id").alias("id"), "request")
    return runs.replayed(requests, log).select(F.col("id").alias("event_id"), "response")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS run, l_linenumber::BIGINT AS at, round(sum(q) OVER (PARTITION BY l_orderkey, f ORDER BY l_linenumber), 2) AS spent_folio, round(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS spent_run FROM c""")
def running_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of a run's calls under caps that they keep to."""
    c = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("at")).agg(F.max("l_returnflag").alias("folio"), F.sum("l_quantity").alias("usd"))
    return runs.within_budget(c, 1e9, 1e9).select("run", F.col("at").cast("long").alias("at"), F.round("spent_folio", 2).alias("spent_folio"), F.round("spent_run", 2).alias("spent_run"))


@query("""WITH f AS (SELECT page_id, url, split_part(split_part(url, '://', 2), '?', 1) AS path, octet_length(encode(html)) AS n FROM pages)
SELECT CASE WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.html', '.pdf') THEN 'extension' WHEN list_contains(string_split(path, '/'), 'en') THEN 'folder' WHEN n > 6000 THEN 'size' END AS rule, path AS subject, n::VARCHAR AS detail FROM f WHERE rule IS NOT NULL""")
def gated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected extensions, folders and sizes."""
    path = F.regexp_extract("url", r"^[^:]*://([^?]*)", 1)
    return govern.tree_gate(_t(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("length")), [".html", ".pdf"], ["en"], 6000)


DIGEST_SQL = "CASE doc_id % 7 WHEN 1 THEN NULL WHEN 2 THEN sha256(text) WHEN 3 THEN upper(left(sha256(text), 16)) WHEN 4 THEN left(sha256(text || 'x'), 16) ELSE left(sha256(text), 16) END"


@query(f"""WITH d AS (SELECT doc_id, sha256(text) AS sha, {DIGEST_SQL} AS digest, CASE doc_id % 7 WHEN 5 THEN NULL ELSE 'd' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '' ELSE '@r1 (of x)' END END AS source FROM documents),
r AS (SELECT doc_id, CASE WHEN digest IS NULL THEN 'no digest' WHEN NOT regexp_full_match(digest, '[0-9a-f]{{16}}') THEN 'malformed digest' WHEN source IS NULL THEN 'no source' WHEN NOT contains(source, '@') THEN 'source without revision'
  WHEN doc_id % 13 = 0 THEN 'file missing' WHEN left(sha, 16) <> digest THEN 'digest differs' END AS rule FROM d)
SELECT rule, doc_id::VARCHAR AS subject FROM r WHERE rule IS NOT NULL""")
def pinned_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded digests against the files that they say they cover."""
    d = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), "text")
    k = F.col("doc_id") % 7
    digest = F.when(k == 1, F.lit(None).cast("string")).when(k == 2, F.col("sha256")).when(k == 3, F.upper(F.left("sha256", F.lit(16)))).when(k == 4, F.left(F.sha2(F.concat("text", F.lit("x")), 256), F.lit(16))).otherwise(F.left("sha256", F.lit(16)))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    source = F.when(k != 5, F.concat(path, F.when(F.col("doc_id") % 11 == 0, "").otherwise("@r1 (of x)")))
    return govern.digests(d.where("doc_id % 13 <> 0").select(path.alias("path"), "sha256"), d.select(F.col("doc_id").alias("id"), source.alias("source"), digest.alias("digest"))).select("rule", "subject")


WORDS, CHARS = ["the", "chtz", "for"], r"\p{L}\p{N}_"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM documents)
{' UNION ALL '.join(f"SELECT doc_id || ':' || place AS subject, '{w}' AS detail FROM l WHERE regexp_matches(line, '(?i)(^|[^{CHARS}]){w}([^{CHARS}]|$)')" for w in WORDS)}""")
def legacy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word that should be gone."""
    return v.whole_words(_t(spark, sf_dir, "documents"), "doc_id", "text", WORDS).select("subject", "detail")


@query("""SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [p_name] WHEN 1 THEN [p_name, p_type] WHEN 2 THEN [p_type] ELSE [p_brand, p_name] END) AS line FROM part""")
def prediction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction documents written and read in each of their shapes."""
    p = _t(spark, sf_dir, "part")
    line = lambda *cs: F.array(*[F.struct(F.col(c).alias("tier2")) for c in cs])
    shaped = p.select(F.col("p_partkey").alias("folio_id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("text"), F.when(F.col("p_partkey") % 4 == 1, line("p_name", "p_type")).alias("lines"), F.when(F.col("p_partkey") % 4 == 2, F.col("p_type")).alias("tier2"))
    written = sinks.prediction_json(shaped).join(p.select(F.col("p_partkey").alias("folio_id"), F.to_json(line("p_brand", "p_name")).alias("listed")), "folio_id")
    value = F.when(F.col("folio_id") % 4 == 3, F.col("listed")).otherwise(F.col("value"))
    return written.select(F.col("folio_id").alias("p_partkey"), F.explode(documents.prediction_lines(value)).alias("line"))


@query("""SELECT conv_id AS folio, count(*)::BIGINT AS verses, sum(length(a.text) - length(b.text))::BIGINT AS difference FROM conversations a JOIN conversations b USING (conv_id, turn) GROUP BY conv_id""")
def paired_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides of the same verses, and a backbone by reference."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("verse_ref"), F.col("conv_id").alias("folio"), F.col("text").alias("chunk"))
    j = agreement.joined(agreement.paired(c, c.select("*")), c, "backbone")
    return j.groupBy("folio").agg(F.count("*").alias("verses"), F.sum(F.length("a_chunk") - F.length("backbone")).alias("difference"))


@query("""SELECT 'schema' AS rule, p_brand AS subject, count(*)::BIGINT AS n FROM part WHERE p_size > 40 GROUP BY p_brand UNION ALL SELECT 'duplicate id', p_brand, 1 FROM part GROUP BY p_brand HAVING count(*) > 1 UNION ALL SELECT 'no catalog entry', 'none', 1""")
def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog's entries, ids and references in one table."""
    p = _t(spark, sf_dir, "part")
    entries = p.select(F.col("p_partkey").alias("at"), F.to_json(F.struct(F.col("p_brand").alias("id"), F.col("p_size").alias("size"), F.col("p_partkey").alias("key"))).alias("value"))
    found = govern.catalog(entries, {"type": "object", "properties": {"size": {"maximum": 40}}, "required": ["id"]}, spark.createDataFrame([("none",), (None,)], "manuscript string"))
    return found.groupBy("rule", "subject").agg(F.count("*").alias("n"))
