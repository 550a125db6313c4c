"""Sequence alignment of grapheme clusters and of letters.

Alignments of an Arrow batch's rows are filled and read back together, in bands (banded.py). Totals need no way back: where
every cluster is one code point they are the built-in edit distance or bit vectors of a column's differences, in
verse-length texts a nested aggregate, else the batch's tables without their choices.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.functions import views
from lectio.functions.scalars import rate
from lectio.operators.banded import shared

#: Clusters up to which the native form is the faster one; products of lengths up to which the built-in edit distance is.
NATIVE_CLUSTERS, BUILT_IN = 32, 4_000_000
#: Rows and bytes of an Arrow batch of cluster arrays, of which each Python step of a task holds some, several times over.
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20
PAIRS = T.ArrayType(T.StructType([T.StructField("g", T.StringType()), T.StructField("p", T.StringType())]))


def _lists(*columns: pa.Array) -> tuple[list[list[np.ndarray]], list[np.ndarray], np.ndarray]:
    """(each column's rows as numbers of elements, begin of each row among the column's elements, which rows have a null)."""
    flat = [c.flatten().dictionary_encode() for c in columns]
    numbers = shared().numbers([x for f in flat for x in f.dictionary.to_pylist()])
    rows, begins, at = [], [], 0
    for c, f in zip(columns, flat, strict=True):
        sizes = pa.compute.fill_null(pa.compute.list_value_length(c), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        codes = numbers[at : at + len(f.dictionary)][f.indices.to_numpy()] if len(f) else np.zeros(0, np.int64)
        rows.append([codes[i:j] for i, j in zip(ends - sizes, ends, strict=True)])
        begins.append(ends - sizes)
        at += len(f.dictionary)
    return rows, begins, np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])


def small_batches(spark: SparkSession) -> None:
    """From now on, rows go to Python ARROW_ROWS, or fewer if the session says so, and about ARROW_BYTES at once."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def align_clusters(g: list[str], p: list[str]) -> list[tuple[str | None, str | None]]:
    """Columns of the optimal alignment; ties go to the pair, then to a deletion from g, then to an insertion from p."""
    numbers = shared().numbers([*g, *p])
    left, right = shared().ways([numbers[: len(g)]], [numbers[len(g) :]])[0]
    return [(None if i < 0 else g[i], None if j < 0 else p[j]) for i, j in zip(left.tolist(), right.tolist(), strict=True)]


def _places(left: np.ndarray, right: np.ndarray) -> list[int | None]:
    """For each place on the left the 1-based place on the right that it stands for."""
    return [None if j < 0 else j + 1 for j in right[left >= 0].tolist()]


def align_letters(side: str, backbone: str) -> list[int | None]:
    """For each letter of side, the 1-based letter of backbone it stands for, or None. Ties: match, substitution, deletion, insertion."""
    numbers = shared().numbers([*side, *backbone])
    return _places(*shared().ways([numbers[: len(side)]], [numbers[len(side) :]])[0])


def cluster_cost(g: list[str], p: list[str]) -> int:
    numbers = shared().numbers([*g, *p])
    return int(shared().totals([numbers[: len(g)]], [numbers[len(g) :]])[0])


@F.arrow_udf(PAIRS)
def aligned(g: pa.Array, p: pa.Array) -> pa.Array:
    """Aligned pairs of two cluster arrays; null stands for a gap."""
    (gs, ps), (g_at, p_at), none = _lists(g, p)
    ways = shared().ways(*([x[:0] if skip else x for x, skip in zip(side, none, strict=True)] for side in (gs, ps)))
    ends, sides = np.r_[0, np.cumsum([len(x) for x, _ in ways])], []
    for k, (column, begin) in enumerate(((g, g_at), (p, p_at))):
        at = np.concatenate([w[k] for w in ways]) if ways else np.zeros(0, np.int64)
        gap, at = at < 0, at + np.repeat(begin, np.diff(ends))
        sides.append(column.flatten().take(pa.array(at, pa.int64(), mask=gap)))
    pairs = pa.StructArray.from_arrays(sides, ["g", "p"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=pa.array(none, pa.bool_()))


# a filter on a column of it, such as explode() brings along, would else align all over again below the column
aligned = aligned.asNondeterministic()


@F.arrow_udf(T.IntegerType())
def edit_total(g: pa.Array, p: pa.Array) -> pa.Array:
    """Cost of the optimal alignment of two cluster arrays of any length."""
    (gs, ps), _, none = _lists(g, p)
    return pa.array(shared().totals(gs, ps), pa.int32(), mask=none)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def letter_alignment(side: pa.Array, backbone: pa.Array) -> pa.Array:
    """For each letter of side its place on the backbone, as align_letters() has it."""
    letters = [pa.array([None if x is None else list(x) for x in c.to_pylist()], pa.list_(pa.string())) for c in (side, backbone)]
    (a, b), _, none = _lists(*letters)
    return pa.array([None if skip else _places(*way) for skip, way in zip(none, shared().ways(a, b), strict=True)], pa.list_(pa.int32()))


def native_edit_total(g: Column, p: Column) -> Column:
    """The same cost by built-in functions: a rolling row of scores folded over the clusters of g."""
    start = F.aggregate(p, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x)))

    def step(row: Column, gc: Column) -> Column:
        first = F.array(F.element_at(row, 1) + F.length(gc))
        cells = F.arrays_zip(F.slice(row, 1, F.size(p)).alias("diag"), F.slice(row, 2, F.size(p)).alias("up"), p.alias("p"))

        def cell(acc: Column, c: Column) -> Column:
            return F.array_append(acc, F.least(c["diag"] + F.levenshtein(gc, c["p"]), c["up"] + F.length(gc), F.element_at(acc, -1) + F.length(c["p"])))

        return F.when(F.size(p) == 0, first).otherwise(F.aggregate(cells, first, cell))

    return F.element_at(F.aggregate(g, start, step), -1)


def alignment_cost(pairs: Column) -> Column:
    """Edits of an aligned column: distances of its pairs, a gap costing the other side's length."""
    part = lambda x: F.levenshtein(F.coalesce(x["g"], F.lit("")), F.coalesce(x["p"], F.lit("")))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + part(x)).cast("long")


def cer(pairs: DataFrame, gt: str, pred: str, name: str = "", native: bool = True) -> DataFrame:
    """Adds edits, denominator and cer of two cluster-array columns.

    native: rows whose clusters are single code points take the built-in edit distance, others of up to NATIVE_CLUSTERS
    clusters a side the nested aggregate, and only the rest the Arrow form; all give the same integers. Null arrays give
    null.
    """
    g, p = F.col(gt), F.col(pred)
    length = F.length(F.array_join(g, ""))
    total = edit_total(g, p)
    if native:
        single = (length == F.size(g)) & (F.length(F.array_join(p, "")) == F.size(p)) & (F.size(g).cast("long") * F.size(p) <= BUILT_IN)
        short = ~single & (F.greatest(F.size(g), F.size(p)) <= NATIVE_CLUSTERS)
        # a row that isn't meant for a form passes it empty arrays
        only = lambda c, here: F.when(here, c).otherwise(F.array().cast("array<string>"))
        distance = F.levenshtein(F.array_join(g, ""), F.array_join(p, ""))
        total = F.when(single, distance).when(short, native_edit_total(only(g, short), only(p, short))).otherwise(edit_total(only(g, ~single & ~short), only(p, ~single & ~short)))
    total = F.when(g.isNotNull() & p.isNotNull(), total)
    out = pairs.withColumn(f"{name}edits", total.cast("long")).withColumn(f"{name}denominator", length.cast("long"))
    return out.withColumn(f"{name}cer", rate(F.col(f"{name}edits"), F.col(f"{name}denominator")))


def reproject(marks: DataFrame, axes: DataFrame) -> DataFrame:
    """Marks (…, verse_ref, ordinal) with their place on the backbone: kept is false where the letter has none.

    axes: (verse_ref, side, backbone) letters of both; ordinals out of range are dropped too.
    """
    at = axes.select("verse_ref", letter_alignment("side", "backbone").alias("alignment"))
    new = F.try_element_at("alignment", F.when(F.col("ordinal") > 0, F.col("ordinal")).otherwise(F.lit(2**31 - 1)))
    return marks.join(at, "verse_ref", "left").withColumn("new_ordinal", new).withColumn("kept", F.col("new_ordinal").isNotNull()).drop("alignment")


MATCHES = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


def _sets(lists: pa.Array, step: int) -> np.ndarray:
    """The distinct values of all rows' lists, ascending, each as row * step + value."""
    rows = pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    keep = flat.is_valid().to_numpy(zero_copy_only=False)
    return np.unique(rows[keep] * step + flat.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))


def _islands(a: np.ndarray, b: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Ascending values of two sides cut where a step exceeds the tolerance: (single a's, their b's) of the islands that have
    one of each, and the spans (a from, to, b from, to) of larger ones. Nothing across a cut can be matched."""
    both = np.concatenate([a, b])
    by = np.argsort(both, kind="stable")
    island = np.empty(len(both), np.int64)
    island[by] = np.cumsum(np.diff(both[by], prepend=both[by][:1]) > tolerance)
    ia, ib = island[: len(a)], island[len(a) :]
    n = int(island.max(initial=-1)) + 1
    na, nb = np.bincount(ia, minlength=n), np.bincount(ib, minlength=n)
    ea, eb = np.cumsum(na), np.cumsum(nb)
    one, more = np.flatnonzero((na == 1) & (nb == 1)), np.flatnonzero((na > 0) & (nb > 0) & (na + nb > 2))
    spans = [(int(ea[k] - na[k]), int(ea[k]), int(eb[k] - nb[k]), int(eb[k])) for k in more]
    return ea[one] - 1, eb[one] - 1, spans


def _greedy(a: list[int], b: list[int], tolerance: int) -> Iterator[tuple[int, int]]:
    """Places matched from left to right: each a with the first b left within tolerance; both sides are passed once."""
    j = 0
    for i, x in enumerate(a):
        while j < len(b) and b[j] < x - tolerance:
            j += 1
        if j < len(b) and b[j] <= x + tolerance:
            yield i, j
            j += 1


def _most(a: list[int], b: list[int], tolerance: int) -> Iterator[tuple[int, int]]:
    """Places of a matching of greatest size: each b, from left to right, with the a in reach whose reach ends first (Glover)."""
    reach, i = [], 0
    for j, y in enumerate(b):
        while i < len(a) and a[i] - tolerance <= y:
            heapq.heappush(reach, (a[i] + tolerance, i))
            i += 1
        while reach and reach[0][0] < y:
            heapq.heappop(reach)
        if reach:
            yield heapq.heappop(reach)[1], j


def _matches(way, exact_first: bool):
    def run(a: pa.Array, b: pa.Array, tolerance: pa.Array) -> pa.Array:
        within = tolerance[0].as_py() if len(tolerance) else 0
        step = 1 << 33  # more than the range of an ordinal and any tolerance
        x, y = _sets(a, step), _sets(b, step)
        both = np.intersect1d(x, y, assume_unique=True) if exact_first else x[:0]
        x, y = (np.setdiff1d(s, both, assume_unique=True) if exact_first else s for s in (x, y))
        i, j, spans = _islands(x, y, within)
        pairs = [(x[i], y[j])] if len(i) else []
        for k, m, p, q in spans:
            found = list(way(x[k:m].tolist(), y[p:q].tolist(), within))
            pairs.append((x[k + np.asarray([f for f, _ in found], np.int64)], y[p + np.asarray([g for _, g in found], np.int64)]))
        left, right = (np.concatenate([both, *[pair[k] for pair in pairs]]) for k in range(2))
        by = np.lexsort((right, left))
        left, right = left[by], right[by]
        row = left + (step >> 1) >> 33
        ends = np.searchsorted(row, np.arange(len(a) + 1))
        sides = [pa.array(s - row * step, pa.int32()) for s in (left, right)]
        none = np.logical_or(a.is_null().to_numpy(zero_copy_only=False), b.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["a", "b"]), mask=pa.array(none, pa.bool_()))

    return F.arrow_udf(run, MATCHES)


def matched(a: Column, b: Column, tolerance: int = 1) -> Column:
    """Pairs array<struct<a, b>> of two ordinal arrays: equal ones first, then greedily left to right within tolerance.

    Deliberately not a matching of greatest size: {1, 2} and {2, 3} give the one pair (2, 2). Repeated and null ordinals
    count once and not at all; null arrays give null. What is left after the equal ones is cut into islands, and each side
    of an island is passed once.
    """
    if tolerance == 0:
        return F.array_sort(F.transform(F.array_intersect(F.array_compact(a), F.array_compact(b)), lambda x: F.struct(x.cast("int").alias("a"), x.cast("int").alias("b"))))
    return _matches(_greedy, True)(a, b, F.lit(tolerance))


def most_matched(a: Column, b: Column, tolerance: int = 1) -> Column:
    """Pairs array<struct<a, b>> of a matching of two ordinal arrays within tolerance that has as many pairs as any."""
    return _matches(_most, False)(a, b, F.lit(tolerance))


def with_clusters(df: DataFrame, **cols: Column) -> DataFrame:
    """Cluster arrays under the names given."""
    return df.withColumns({k: views.clusters(v) for k, v in cols.items()})
