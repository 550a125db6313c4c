"""Data-quality rules as violation tables: each returns (rule, subject, detail) rows, and none is right."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Terms, and bytes of them, that are broadcast at once.
NEEDLES, NEEDLE_BYTES = 1_000_000, 4 << 20
#: Ranges of rows whose order has no key.
RANGES = 200


def _said(d: DataFrame, rule: str, subject: Column, detail: Column | str = "") -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return d.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def rules(d: DataFrame, subject: str, checks: dict[str, Column]) -> DataFrame:
    """One pass over d: a row for each check that doesn't hold; a null check is a violation."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return d.select(F.explode(bad).alias("rule"), F.col(subject).cast("string").alias("subject"), F.lit("").alias("detail"))


def scorer_input_rules(d: DataFrame) -> dict[str, Column]:
    """Rules of scorer inputs read with their path and raw value: required fields, enumerations, ordinals, no other keys."""
    from lectio import codepoints as cp

    keys = F.json_object_keys("value")
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in ("text", "metamarks", "folio_id", "gt_version")]))
    return {
        "is an object": keys.isNotNull(),
        "text is a string": F.col("text").isNotNull(),
        "metamarks is a list": F.col("metamarks").isNotNull(),
        "mark type is known": F.forall("metamarks", lambda m: m["type"].isin(*cp.ALL_TYPES)),
        "mark has a verse": F.forall("metamarks", lambda m: m["verse_ref"].isNotNull()),
        "ordinal is 1 or more": F.forall("metamarks", lambda m: F.coalesce(m["ordinal"] >= 1, F.lit(False))),
        "no other keys": F.size(extra) == 0,
    }


def prediction_rules(baselines: list[str]) -> dict[str, Column]:
    """Rules of prediction documents read with documents.PREDICTION."""
    lines = F.col("lines")
    return {
        "schema version": F.col("schema_version") == "0.1.0",
        "baseline is known": F.col("baseline_id").isin(*baselines),
        "folio is named": F.length("folio_id") > 0,
        "manifest hash": F.length("manifest_hash") > 0,
        "has lines": lines.isNotNull(),
        "line is named": F.forall(lines, lambda x: F.coalesce(F.length(x["line_id"]) > 0, F.lit(False))),
        "bbox has four parts of 0 or more": F.forall(lines, lambda x: F.coalesce((F.size(x["bbox"]) == 4) & F.forall(x["bbox"], lambda v: v >= 0), F.lit(False))),
        "tiers are strings": F.forall(lines, lambda x: x["tier1"].isNotNull() & x["tier2"].isNotNull() & x["tier3"].isNotNull()),
        "confidence is a share": F.forall(lines, lambda x: F.coalesce(x["kraken_confidence"].between(0, 1), F.lit(True))),
    }


def duplicates(d: DataFrame, key: str, rule: str = "duplicate id") -> DataFrame:
    g = d.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return _said(g, rule, F.col(key), F.col("n"))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    one = lambda a, b, rule: _said(a.select(key).distinct().join(b.select(key), key, "left_anti"), rule, F.col(key))
    return all_of(one(expected, found, "missing"), one(found, expected, "extra"))


def referenced(d: DataFrame, target: DataFrame, key: str, rule: str = "not found") -> DataFrame:
    """Keys of d without a row in target; the other way isn't asked."""
    return _said(d.select(key).distinct().join(target.select(key), key, "left_anti"), rule, F.col(key))


def promised(expected: DataFrame, shipped: DataFrame, key: str) -> DataFrame:
    """expected (key, promised) against counts of shipped rows by key."""
    n = shipped.groupBy(key).agg(F.count("*").alias("n"))
    j = expected.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("promised <> n")
    return _said(j, "promised and shipped differ", F.col(key), F.concat_ws(" ", F.col("promised").cast("string"), F.lit("promised,"), F.col("n").cast("string"), F.lit("shipped")))


def bound_to(d: DataFrame, subject: str, value: str, expected: str | None, rule: str) -> DataFrame:
    """Rows whose value, where they have one, isn't the expected one; no expected value is itself a violation."""
    if not expected:
        return _said(d.sparkSession.range(1), rule, F.lit("expected value is missing"))
    return _said(d.where(F.col(value).isNotNull() & (F.col(value) != expected)), rule, F.col(subject), F.col(value))


def needles(texts: DataFrame, subject: str, text: str, terms: DataFrame, whitelist: DataFrame | None = None, allowed: list[str] | None = None, fold: bool = True, block: int = NEEDLES, block_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """(subject, needle): texts that contain a term, whitelisted subjects and allowed strings left out first.

    terms (needle, optional exempt: array of subjects). All terms of a block are one automaton (Aho-Corasick), so that a
    text is read once whatever their number; a block has about `block` terms and block_bytes of them, which is what is
    broadcast, and each block reads the texts once. A text's row is its own: nothing is joined, and no text is copied for its words.
    Null texts and terms take no part; the empty term is in every text; a repeated term is found once for each of its rows.
    """
    spark, body = texts.sparkSession, F.lower(text) if fold else F.col(text)
    for a in allowed or []:
        body = F.replace(body, F.lit(a.lower() if fold else a), F.lit(""))
    d = texts.select(F.col(subject).alias("subject"), body.alias("body")).where("body is not null")
    if whitelist is not None:
        d = d.join(whitelist.select(F.col(whitelist.columns[0]).alias("subject")), "subject", "left_anti")
    exempt = F.col("exempt") if "exempt" in terms.columns else F.array().cast(T.ArrayType(d.schema["subject"].dataType))
    n = terms.where("needle is not null").select("needle", (F.lower("needle") if fold else F.col("needle")).alias("folded"), exempt.alias("exempt"))
    size = F.octet_length("needle") + F.octet_length("folded") + F.octet_length(F.coalesce(F.to_json("exempt"), F.lit("")))
    total = n.agg(F.count("*").alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-total.n // block), -(-total.bytes // block_bytes))
    made = T.StructType([d.schema["subject"], T.StructField("needle", T.StringType())])
    found = []
    for k in range(blocks):
        some = n.where(F.pmod(F.xxhash64("folded"), F.lit(blocks)) == k) if blocks > 1 else n
        held = spark.sparkContext.broadcast([(r.folded, r.needle, frozenset(r.exempt or ())) for r in some.collect()])
        found.append(d.mapInArrow(_scan(held), made))
    return all_of(*found)


def _scan(held):
    """Rows (subject, needle) of Arrow batches (subject, body), with the terms held: (folded, needle, exempt subjects)."""

    def run(batches):
        import ahocorasick

        terms, every, automaton = held.value, [], ahocorasick.Automaton()
        for i, (folded, _, _) in enumerate(terms):
            if folded:
                automaton.add_word(folded, [*automaton.get(folded, ()), i])
            else:
                every.append(i)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            rows, needle = [], []
            for row, (subject, body) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                met = set(every)
                for _, at in automaton.iter(body) if len(automaton) else ():
                    met.update(at)
                hits = [i for i in sorted(met) if subject not in terms[i][2]]
                rows += [row] * len(hits)
                needle += [terms[i][1] for i in hits]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(needle, pa.string())], names=["subject", "needle"])

    return run


def whole_words(texts: DataFrame, subject: str, text: str, words: list[str], rule: str = "legacy word") -> DataFrame:
    """Lines that have one of the words whole, in whatever case: the subject with its line number, and the word.

    Only texts with a hit are taken apart into lines.
    """
    whole = lambda w: rf"(?i)(?<![\p{{L}}\p{{N}}_])\Q{w}\E(?![\p{{L}}\p{{N}}_])"
    some = texts.select(F.col(subject).cast("string").alias("s"), F.col(text).alias("t")).where(reduce(Column.__or__, [F.col("t").rlike(whole(w)) for w in words]))
    lines = some.select("s", F.posexplode(F.split("t", r"\r\n|\n|\r")).alias("at", "line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(whole(w)), F.lit(w)) for w in words]))
    return lines.select(F.lit(rule).alias("rule"), F.concat_ws(":", "s", (F.col("at") + 1).cast("string")).alias("subject"), F.explode(hits).alias("detail"))


def immutable_fields(head: DataFrame, staged: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of rows in both that had a value and have another now."""
    j = head.select(key, *[F.col(f).alias(f"_h_{f}") for f in fields]).join(staged.select(key, *[F.col(f).alias(f"_s_{f}") for f in fields]), key)
    changed = F.array_compact(F.array(*[F.when(F.col(f"_h_{f}").isNotNull() & ~F.col(f"_h_{f}").eqNullSafe(F.col(f"_s_{f}")), F.lit(f)) for f in fields]))
    return _said(j.select(key, F.explode(changed).alias("f")), "immutable field changed", F.col(key), F.col("f"))


def removed(head: DataFrame, staged: DataFrame, key: str, excused: bool, kept: Column) -> DataFrame:
    """Rows of head that are gone: always wrong unless excused, and then still wrong where `kept` holds."""
    gone = head.join(staged.select(key), key, "left_anti")
    return _said(gone.where(F.coalesce(kept, F.lit(False))) if excused else gone, "row removed", F.col(key))


def restored(head: DataFrame, staged: DataFrame, key: str, flag: str) -> DataFrame:
    j = head.where(~F.col(flag)).select(key).join(staged.where(F.col(flag)).select(key), key)
    return _said(j, "flag restored", F.col(key), F.lit(flag))


def append_only(head: DataFrame, staged: DataFrame, order: str) -> DataFrame:
    """Rows of head that staged doesn't have in the same place; order numbers rows from 0."""
    cols = [c for c in head.columns if c != order]
    j = head.select(order, F.struct(*cols).alias("h")).join(staged.select(order, F.struct(*cols).alias("s")), order, "left")
    return _said(j.where(~F.col("h").eqNullSafe(F.col("s"))), "not append-only", F.col(order), F.when(F.col("s").isNull(), "removed").otherwise("edited"))


def chain(rows: DataFrame, order: str, previous: str, new: str, start: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows whose `previous`, where given, isn't the last `new` before them (or start for the first).

    Without keys to partition by, rows are ranged by order: a range takes its start from the last `new` of those before
    it, a row each.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(order)
        expected = F.last(new, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = rows.withColumn("_e", F.coalesce(expected, start) if start is not None else expected)
        return _said(d.where(F.col(previous).isNotNull() & ~F.col(previous).eqNullSafe(F.col("_e"))), "chain broken", F.col(order), F.col(previous))
    cuts = rows.select(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    part = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(order) <= c)) if cuts else F.lit(0)
    ranged = rows.withColumn("_part", part)
    ends = ranged.where(F.col(new).isNotNull()).groupBy("_part").agg(F.max_by(new, order).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.select("_part").distinct().join(ends, "_part", "left").select("_part", F.last("_last", ignorenulls=True).over(before).alias("_start"))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.last(new, ignorenulls=True).over(w), "_start")
    d = ranged.join(F.broadcast(starts), "_part").withColumn("_e", F.coalesce(found, start) if start is not None else found)
    return _said(d.where(F.col(previous).isNotNull() & ~F.col(previous).eqNullSafe(F.col("_e"))), "chain broken", F.col(order), F.col(previous))


def running_budget(calls: DataFrame, by: list[str], order: str, cost: str, cap: float) -> DataFrame:
    """Adds spent (running) and over (strictly above cap) along each run."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.withColumn("spent", F.sum(cost).over(w)).withColumn("over", F.col("spent") > cap)


def first_breach(spent: DataFrame, by: list[str], order: str) -> DataFrame:
    return spent.where("over").groupBy(*by).agg(F.min(order).alias(order), F.min_by("spent", order).alias("spent"))


def real_boxes(lines: DataFrame) -> DataFrame:
    b = F.col("bbox")
    return lines.where((b[2] > b[0]) & (b[3] > b[1]))
