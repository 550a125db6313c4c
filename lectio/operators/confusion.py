"""Confusion of points over aligned clusters, and decision, character, vocalisation and word accuracies."""

from __future__ import annotations

import operator
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio import codepoints as cp
from lectio.functions import views

CONSONANT, VOWEL = re.compile(f"[{cp.CONSONANT}]"), re.compile(f"[{cp.VOWEL_DECISION}]")


def _counted(names: Column) -> Column:
    """array<struct<class, name, n>> of distinct names."""
    return F.transform(F.array_distinct(names), lambda x: F.struct(views.mark_class(x).alias("c"), x.alias("name"), F.size(F.filter(names, lambda y: y == x)).alias("n")))


def mark_confusion(pairs: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys…, gt_mark, pred_mark, n) over an array<struct<g, p>> column of aligned clusters.

    In a pair, equal names match as multisets; what is left of a class is zipped in order of name, and the rest is
    confused with the absent label. Distinct pairs are counted first, where they are aligned, and each is settled once.
    """
    counted = pair_numbers(pairs, column, keys).groupBy(*keys, "g", "p").agg(F.sum("n").alias("n"))
    met = _confused(counted).select(*keys, "n", F.explode("m").alias("m"))
    return met.groupBy(*keys, F.col("m.gt").alias("gt_mark"), F.col("m.pred").alias("pred_mark")).agg(F.sum("n").alias("n"))


def pair_numbers(pairs: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys…, g, p, n): how often each pair of clusters stands in an aligned column, counted in each Arrow batch; other batches may have the same pairs."""
    d = pairs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(column).alias("pairs"))
    named = [f"k{i}" for i in range(len(keys))]

    def run(batches):
        for b in batches:
            lists = b.column(len(named))
            rows, inside = pa.compute.list_parent_indices(lists), lists.flatten()
            t = pa.table([*(b.column(i).take(rows) for i in range(len(named))), inside.field(0), inside.field(1)], names=[*named, "g", "p"])
            t = t.group_by([*named, "g", "p"]).aggregate([([], "count_all")])
            for out in t.select([*named, "g", "p", "count_all"]).rename_columns([*named, "g", "p", "n"]).to_batches():
                yield out

    kinds = [T.StructField(f"k{i}", d.schema[f"k{i}"].dataType) for i in range(len(keys))]
    made = T.StructType([*kinds, T.StructField("g", T.StringType()), T.StructField("p", T.StringType()), T.StructField("n", T.LongType())])
    return d.mapInArrow(run, made).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def _confused(flat: DataFrame) -> DataFrame:
    """Adds m, array<struct<gt, pred>>, to pairs of clusters (g, p); clusters hold a handful of points, so a pair is settled in its row."""
    empty = F.array().cast("array<string>")
    side = lambda c: F.when(F.col(c).isNull(), empty).otherwise(views.mark_names(F.col(c)))
    flat = flat.withColumns({"ng": side("g"), "np": side("p")}).where("size(ng) + size(np) > 0")
    g, p = F.col("ng"), F.col("np")
    n = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    hits = F.flatten(F.transform(F.array_distinct(F.array_intersect(g, p)), lambda x: F.array_repeat(F.struct(x.alias("gt"), x.alias("pred")), F.least(n(g, x), n(p, x)))))
    left = lambda a, b: F.array_sort(F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(n(a, x) - n(b, x), F.lit(0))))))
    flat = flat.withColumns({"hits": hits, "lg": left(g, p), "lp": left(p, g)})
    classes = F.array(*[F.lit(c) for c in ("vowel", "dot", *cp.OWN_CLASS)])
    of = lambda a, c: F.filter(a, lambda x: views.mark_class(x) == c)
    absent = lambda x: F.coalesce(x, F.lit(cp.ABSENT))
    zipped = F.flatten(F.transform(classes, lambda c: F.zip_with(of(F.col("lg"), c), of(F.col("lp"), c), lambda x, y: F.struct(absent(x).alias("gt"), absent(y).alias("pred")))))
    return flat.withColumn("m", F.concat("hits", zipped))


@lru_cache(maxsize=200_000)
def _judged(g: str, p: str) -> tuple[int, ...]:
    """Of a pair of clusters: vowel decisions, code points and vowel points, each to be judged and right."""
    vg, vp = VOWEL.findall(g), VOWEL.findall(p)
    decides, same = CONSONANT.search(g) is not None, lambda a, b: sum(map(operator.eq, a, b))
    return int(decides), int(decides and sorted(vg) == sorted(vp)), max(len(g), len(p)), same(g, p), max(len(vg), len(vp)), same(vg, vp)


JUDGED = ("_dt", "_dc", "_ct", "_cc", "_vt", "_vc")


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in JUDGED]))
def pair_counts(pairs: pa.Array) -> pa.Array:
    """Sums of what _judged() says over an array of aligned pairs, a gap counting as an empty cluster; null for null.

    A batch has few distinct pairs: each is judged once.
    """
    sizes = pa.compute.fill_null(pa.compute.list_value_length(pairs), 0).to_numpy(zero_copy_only=False)
    inside = pairs.flatten()
    g, p = (pa.compute.fill_null(inside.field(k), "").dictionary_encode() for k in range(2))
    key = g.indices.to_numpy().astype(np.int64) * (len(p.dictionary) + 1) + p.indices.to_numpy()
    distinct, of = np.unique(key, return_inverse=True)
    names_g, names_p = g.dictionary.to_pylist(), p.dictionary.to_pylist()
    each = np.asarray([_judged(names_g[k // (len(names_p) + 1)], names_p[k % (len(names_p) + 1)]) for k in distinct.tolist()], np.int64).reshape(-1, len(JUDGED))
    sums = np.vstack([np.zeros((1, len(JUDGED)), np.int64), np.cumsum(each[of], axis=0)])
    ends = np.cumsum(sizes)
    total = sums[ends] - sums[ends - sizes]
    return pa.StructArray.from_arrays([pa.array(total[:, k]) for k in range(len(JUDGED))], list(JUDGED), mask=pairs.is_null())


def factoring(df: DataFrame, pairs: str, gt: str, pred: str) -> DataFrame:
    """Adds dec, cha, voc of an aligned column and wor of the two views; nothing to judge gives 1. Null alignments and views give null."""
    equal = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda z: z))
    words = {"_wt": F.greatest(F.size("_wg"), F.size("_wp")), "_wc": equal(F.col("_wg"), F.col("_wp"))}
    counted = df.withColumns({"_j": pair_counts(pairs), "_wg": views.tokens(F.col(gt)), "_wp": views.tokens(F.col(pred))})
    counted = counted.withColumns({**{c: F.col(f"_j.{c}") for c in JUDGED}, **words})
    share = lambda c, t: F.when(F.col(t) == 0, 1.0).otherwise(F.col(c) / F.col(t))
    out = counted.withColumns({"dec": share("_dc", "_dt"), "cha": share("_cc", "_ct"), "voc": share("_vc", "_vt"), "wor": share("_wc", "_wt")})
    return out.drop(*JUDGED, *words, "_j", "_wg", "_wp")


def multiset(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys…, item, common, a_only, b_only): multiset intersection and differences."""
    both = a.select(*keys, item, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, item, F.lit(0).alias("x"), F.lit(1).alias("y")))
    n = both.groupBy(*keys, item).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    common = F.least("x", "y")
    return n.select(*keys, item, common.alias("common"), (F.col("x") - common).alias("a_only"), (F.col("y") - common).alias("b_only"))
