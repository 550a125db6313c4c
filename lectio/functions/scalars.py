"""Hashes, rates, costs and reshaping scalars."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio import codepoints as cp
from lectio.functions.versions import version_admitted  # noqa: F401
from lectio.functions.visible import visible_text  # noqa: F401


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    """tp / (tp + fp); with nothing predicted 1 where nothing was to be found, else 0."""
    return F.when(tp + fp == 0, F.when(tp + fn == 0, 1.0).otherwise(0.0)).otherwise(tp / (tp + fp))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return precision(tp, fn, fp)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Harmonic mean of the two: 1 for two empty sides, 0 where both are 0."""
    p, r = precision(tp, fp, fn), recall(tp, fp, fn)
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def rate(edits: Column, denominator: Column) -> Column:
    """An error rate: 0 for nothing over nothing, 1 for edits over nothing."""
    return F.when(denominator == 0, F.when(edits == 0, 0.0).otherwise(1.0)).otherwise(edits / denominator)


def composite(c1: Column, c2: Column, c3: Column) -> Column:
    return sum((F.lit(w) * F.coalesce(c, F.lit(0.0)) for w, c in zip(cp.WEIGHTS[1:], (c2, c3), strict=True)), F.lit(cp.WEIGHTS[0]) * F.coalesce(c1, F.lit(0.0)))


def sha256_hex(content: Column, length: int = 64) -> Column:
    return F.left(F.sha2(content, 256), F.lit(length))


def model_hash(name: Column, version: Column, sha: Column) -> Column:
    """Of "name==version:sha", cut to 16 digits."""
    return sha256_hex(F.concat(name, F.lit("=="), version, F.lit(":"), sha), 16)


def canonical_hash(document: Column, length: int = 16, compact: bool = True) -> Column:
    """sha256 of a JSON document with sorted keys; compact leaves no space after separators. Spark's to_json doesn't sort."""
    separators = (",", ":") if compact else None

    @F.pandas_udf(T.StringType())
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=separators).encode()).hexdigest()[:length])

    return of(document)


def cost_usd(tokens_in: Column, tokens_out: Column, usd_in: Column, usd_out: Column, per: float = 1e6) -> Column:
    """Cost of a call at prices for `per` tokens; missing counts cost nothing."""
    return (F.coalesce(tokens_in, F.lit(0)) * usd_in + F.coalesce(tokens_out, F.lit(0)) * usd_out) / per


TOKENS = "array<struct<sep:boolean,str:string,options:array<string>>>"


def reconstructed(response: Column) -> Column:
    """A service's token list (JSON) as text: separators as they are, other tokens' first option, or the token itself."""
    return F.array_join(F.transform(F.from_json(response, TOKENS), lambda t: F.when(t["sep"], t["str"]).otherwise(F.coalesce(F.get(t["options"], F.lit(0)), t["str"]))), "")


def mean_confidence(scores: Column, places: int = 4) -> Column:
    """Rounded mean of an array; null for an empty one."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(scores) > 0, F.round(total / F.size(scores), places))


def polygon_box(points: Column) -> Column:
    """[x0, y0, x1, y1] around array<struct<x, y>>; zeros for none."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))
    return F.when(F.size(points) > 0, box.cast("array<int>")).otherwise(F.array(*[F.lit(0)] * 4))


def package_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))
