"""The operators of this subpackage as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm import fingerprints, language, lengths, line_dedup, ngram_join, packing, periods, quality, repair, substrings, tiling, topk, toxicity
from lectio.llm.common import crc_mod


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_t(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_t(spark, sf_dir, "documents"), derive={"ids_crc32": F.crc32}, keep_ids=False, added=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return language.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_repeated_runs(_t(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings in three grades: 0 poor, 1 sound but toxic, 2 sound and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).alias("grade"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    model = quality.fit(docs, graded(labels.where(crc_mod("doc_id", 5) != 0)))
    return quality.grade(docs, model, at_least=1).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail_probability", "selected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_documents(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")).drop("tag")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_t(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    known = labels.where(crc_mod("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, known))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_t(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_table(lengths.token_lengths(_t(spark, sf_dir, "documents"), added=True))


def made_periodic(docs: DataFrame) -> DataFrame:
    """docs, a tenth of whose texts go round in their own words from some word on: where and how often, the id's CRC-32 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, n, g = F.col("_words"), F.size("_words"), F.expr("_h div 10")
    first = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - first) / (3 + g % 8))).cast("int")
    rounds = F.array_repeat(F.slice(words, first + 1, p), F.ceil((n - first) / p).cast("int"))
    turned = F.array_join(F.concat(F.slice(words, F.lit(1), first), F.slice(F.flatten(rounds), F.lit(1), n - first)), " ")
    split = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return docs.select("doc_id", "text", h.alias("_h"), split.alias("_words")).select("doc_id", F.when(n > 0, turned).otherwise(F.col("text")).alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse(made_periodic(_t(spark, sf_dir, "documents")))
    return found.withColumn("best", periods.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periods.lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a row in twenty each left out, emptied, without ends of sentences, repeated and of another role, by its CRC-32."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(what == 4, "user").otherwise(plain("role"))
    copies = F.when(what == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where(what != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations")
    return repair.repair(damaged(rows), rows)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.following(_t(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_ngram_join, op2_packing, op3_language, op4_line_dedup, op5_quality, op6_decontamination, op7_substrings, op8_toxicity, op9_topk, op10_token_counts, op11_periods, op12_repair, op13_fingerprints, pipeline)
    return {f.__name__: f for f in ops}


WORDS = r"[^\x20\x09-\x0D]+"


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of ASCII text."""
    bits = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ord(s)::BIGINT)), lambda c, x: {bits}))"


SQL = {
    "op1_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)""",
    "op7_substrings": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
r AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS pos, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS run FROM w WHERE len(ws) >= 13),
f AS (SELECT run, min(doc_id) AS first FROM r GROUP BY run),
hit AS (SELECT doc_id, pos FROM r JOIN f USING (run) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM hit),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS t FROM p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id),
lost AS (SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.k, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    "op11_periods": rf"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS turned, (h // 10) % greatest(len(ws), 1) AS a, 3 + (h // 10) % 8 AS parts FROM h),
d AS (
  SELECT doc_id, n, CASE WHEN turned THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE ws END AS ws FROM g),
w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS pos FROM d),
e AS (SELECT x.doc_id, x.pos, y.pos - x.pos AS p FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.pos > x.pos AND 4 * (y.pos - x.pos) <= x.n),
i AS (SELECT doc_id, p, pos, pos - row_number() OVER (PARTITION BY doc_id, p ORDER BY pos) AS island FROM e),
s AS (SELECT doc_id, p, min(pos) AS start, count(*) + p AS length FROM i GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY doc_id, start, length),
b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS spans FROM r GROUP BY doc_id),
k AS (
  SELECT doc_id, start, length, period FROM r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS pos FROM r),
c AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS t FROM w ANTI JOIN x ON x.doc_id = w.doc_id AND x.pos = w.pos GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(spans, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op12_repair": rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, {_crc32("name")} % 20 AS what FROM o),
m AS (
  SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE what WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE what <> 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text), copy) AS pos, left(role, 1) AS i FROM m),
f AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || '.' || i AS pair,
    CASE WHEN NOT regexp_matches(text, '{WORDS}') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault FROM p),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('s.u', 'u.a', 'a.u')) AS illegal, max(pos) AS n FROM f GROUP BY conv_id),
follow(last, later) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
ins(last, edits, later) AS (VALUES ('', '', ''), ('', 'I', 'u'), ('', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'), ('u', '', 'u'), ('u', 'I', 'a'), ('a', '', 'a'), ('a', 'I', 'u')),
ways AS (
  SELECT DISTINCT i.last, i.edits, e.edit, CASE e.edit WHEN 'D' THEN i.later ELSE x.later END AS later
  FROM ins i CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(edit) LEFT JOIN follow x ON x.last = i.later AND e.edit <> 'D' AND (e.edit = 'K' OR x.later <> 's')),
dp AS (
  SELECT conv_id, 0::BIGINT AS t, '' AS last, {{'cost': 0::BIGINT, 'audit': ''}} AS best, '' AS body FROM n
  UNION ALL
  SELECT conv_id, t, last, best, body FROM (
    SELECT d.conv_id, d.t + 1 AS t, w.later AS last, {{'cost': d.best.cost + 5 * length(w.edits) + CASE w.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN w.edit <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END, 'audit': d.best.audit || w.edits || w.edit}} AS best,
      d.body || CASE w.edits WHEN '' THEN '' WHEN 'I' THEN CASE d.last WHEN 'u' THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END
        || CASE w.edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE CASE w.later WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) END AS body
    FROM dp d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.t + 1 JOIN ways w ON w.last = d.last AND (w.edit = 'D' OR f.fault NOT IN ('b', 'd') AND (w.edit = 'R' OR w.later = f.i)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, last ORDER BY best.cost, best.audit) = 1),
z AS (
  SELECT n.*, d.best.cost + 5 * length(i.edits) AS cost, d.best.audit || i.edits AS audit,
    d.body || CASE i.edits WHEN '' THEN '' WHEN 'I' THEN 'assistant:' || chr(10) ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END AS body
  FROM n JOIN dp d ON d.conv_id IS NOT DISTINCT FROM n.conv_id AND d.t = n.n JOIN ins i ON i.last = d.last AND i.later IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY n.conv_id ORDER BY d.best.cost + 5 * length(i.edits), d.best.audit || i.edits) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(body, length(body) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op9_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
