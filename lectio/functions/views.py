"""Nested text views, grapheme clusters and positional scalars, as Column -> Column functions.

Everything stays inside whole-stage code generation but normalize(), for which Spark SQL has no built-in.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio import codepoints as cp


def strip_cgj(s: Column) -> Column:
    return F.replace(s, F.lit(cp.CGJ), F.lit(""))


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", unicodedata.normalize("NFC", x)))


def normalize(s: Column) -> Column:
    """Joiners out first, then composed, then decomposed: the joiner blocks reordering, so the order matters."""
    return _decomposed(strip_cgj(s))


def clusters(s: Column) -> Column:
    """Extended grapheme clusters, as an array; empty for an empty text."""
    return F.regexp_extract_all(s, F.lit(r"\X"), F.lit(0))


def cluster_count(s: Column) -> Column:
    return F.size(clusters(s))


def code_points(s: Column) -> Column:
    """The characters of a text, as an array; empty for an empty text."""
    return F.filter(F.split(s, ""), lambda c: c != "")


# Python's str.strip() and str.split() take these for white space; Java's \s doesn't.
SPACE = r"\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", "")


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, f"[{SPACE}]+"), lambda t: t != "")


def kept(s: Column, chars: str) -> Column:
    """Characters of a class only; runs of spaces collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, f"[^{chars}]", ""), "  +", " "))


def dropped(s: Column, chars: str) -> Column:
    """Without the characters of a class; runs of spaces collapsed, white space at the ends gone."""
    return stripped(F.regexp_replace(F.regexp_replace(s, f"[{chars}]", ""), "  +", " "))


def tier1(s: Column) -> Column:
    """Consonants, spaces and maqaf."""
    return kept(s, f"{cp.CONSONANT} {cp.MAQAF}")


def tier2(s: Column) -> Column:
    """Without cantillation and the marks above tier 2."""
    return dropped(s, cp.TROP + cp.TIER2_EXTRA)


def tier3(s: Column) -> Column:
    return s


TIERS: dict[int, Callable[[Column], Column]] = {1: tier1, 2: tier2, 3: tier3}


def scorer_view(s: Column, tier: int) -> Column:
    """A document scorer's view: normalised, editor tokens untouched."""
    return TIERS[tier](normalize(s))


def strip_editor_tokens(s: Column) -> Column:
    return F.regexp_replace(s, "<[A-Z]+>", "")


def agreement_view(s: Column, tier: int) -> Column:
    """An annotator comparison's view: editor tokens go before normalisation."""
    return TIERS[tier](normalize(strip_editor_tokens(s)))


def loader_view(s: Column, tier: int) -> Column:
    """An edition loader's view: deletions of ranges only, nothing normalised, runs of spaces collapsed; not the scorer's."""
    drop = {1: cp.LOADER_TIER1_DROP, 2: cp.TROP + cp.TIER2_EXTRA}
    bare = F.regexp_replace(s, f"[{drop[tier]}]", "") if tier in drop else s
    return stripped(F.regexp_replace(bare, "  +", " "))


def consonant_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[{cp.CONSONANT}]"))


def consonants_of(s: Column, spaces: bool = False) -> Column:
    """Consonants only; with spaces, spaces and maqaf too, uncollapsed."""
    return F.regexp_replace(s, f"[^{cp.CONSONANT}{' ' + cp.MAQAF if spaces else ''}]", "")


def consonant_records(chunk: Column) -> Column:
    """array<struct<ordinal, letter, dagesh>> of a chunk without its editor tokens."""
    parts = F.regexp_extract_all(strip_editor_tokens(chunk), F.lit(f"[{cp.CONSONANT}][^{cp.CONSONANT}]*"), F.lit(0))
    return F.transform(parts, lambda c, i: F.struct((i + 1).alias("ordinal"), F.left(c, F.lit(1)).alias("letter"), F.contains(c, F.lit(cp.DAGESH)).alias("dagesh")))


def predicted_rafe(chunk: Column) -> Column:
    """Ordinals at which the rule puts a rafe: a begadkefat letter without dagesh."""
    hits = F.filter(consonant_records(chunk), lambda c: c["letter"].isin(*cp.BEGADKEFAT) & ~c["dagesh"])
    return F.transform(hits, lambda c: c["ordinal"])


def mark_names(cluster: Column) -> Column:
    """Names of the points in a cluster, in order; other code points are ignored."""
    names = F.create_map(*[F.lit(x) for k, v in cp.MARK_NAMES.items() for x in (chr(k), v)])
    return F.filter(F.transform(code_points(cluster), lambda c: names[c]), lambda n: n.isNotNull())


def mark_class(name: Column) -> Column:
    return F.when(name.isin(*cp.OWN_CLASS), name).when(name.isin(*cp.DOT_CLASS), "dot").otherwise("vowel")


def vowel_points(cluster: Column) -> Column:
    return F.filter(code_points(cluster), lambda c: c.rlike(f"[{cp.VOWEL_DECISION}]"))


def vowel_decision(cluster: Column) -> Column:
    return F.array_sort(vowel_points(cluster))


def has_consonant(cluster: Column) -> Column:
    return cluster.rlike(f"[{cp.CONSONANT}]")


def verse_ref(book: Column, chapter: Column, verse: Column) -> Column:
    """Book.chapter.verse with the short book name; unknown names stay."""
    names = F.create_map(*[F.lit(x) for kv in cp.BOOKS.items() for x in kv])
    return F.concat_ws(".", F.coalesce(names[book], book), chapter.cast("string"), verse.cast("string"))


def parsed_ref(ref: Column) -> Column:
    """struct<book, chapter, verse>; parts that aren't numbers are null."""
    p = F.split(ref, r"\.")
    return F.struct(F.get(p, F.lit(0)).alias("book"), F.get(p, F.lit(1)).try_cast("int").alias("chapter"), F.get(p, F.lit(2)).try_cast("int").alias("verse"))


def canonical_type(t: Column, strict: bool = True) -> Column:
    """A mark type by its main name. Unknown ones raise, or give null."""
    known = F.when(t.isin(*cp.ALL_TYPES), t)
    for alias, name in cp.ALIASES.items():
        known = known.when(t == alias, name)
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown mark type: "), t)) if strict else F.lit(None))


def folded_type(t: Column, raw: bool = False) -> Column:
    return t if raw else F.when(t == "double_rafe", "rafe").otherwise(t)
