"""Named predictors, and the command that runs one: python -m lectio.plans.registry --baseline NAME …"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.plans import runs
from lectio.sources import documents

#: name -> "module:function" of a folios -> (folio_id, value) predictor, as runs.run() takes it.
PREDICTORS: dict[str, str] = {}


def register(name: str, target: str) -> None:
    """A name stands for one target; registering another under it is an error."""
    if PREDICTORS.setdefault(name, target) != target:
        raise ValueError(f"{name} is registered as {PREDICTORS[name]}")


def predictor(name: str) -> Callable[[DataFrame], DataFrame]:
    """Loaded only now, so that a registry may name predictors whose libraries aren't there."""
    module, _, function = PREDICTORS[name].partition(":")
    return getattr(importlib.import_module(module), function)


def unfinished(folios: DataFrame, results: Path) -> DataFrame:
    """Ids of frozen folios without a result yet."""
    done = [p.stem for p in results.glob("*.json") if p.name != "run_meta.json"]
    return folios.where("in_frozen_scope").where(~F.col("id").isin(done)).select("id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 when the run stands; 1, with the kind of error, when it doesn't. Of all folios, or of one, whatever stands already."""
    p = argparse.ArgumentParser(prog="python -m lectio.plans.registry", description=__doc__)
    p.add_argument("--baseline", required=True)
    p.add_argument("--target", help="module:function, registered under the baseline's name first")
    p.add_argument("--manifest", required=True)
    p.add_argument("--results", required=True)
    p.add_argument("--folio", help="this folio only; by default all that have no result yet")
    p.add_argument("--meta", default="{}", help="JSON object for the run's own document")
    a = p.parse_args(argv)
    try:
        if a.target:
            register(a.baseline, a.target)
        if a.baseline not in PREDICTORS:
            raise LookupError(f"unknown baseline {a.baseline!r}; there are: {', '.join(sorted(PREDICTORS)) or 'none'}")
        if not Path(a.manifest).exists():
            raise FileNotFoundError(a.manifest)
        spark = spark or SparkSession.builder.getOrCreate()
        folios = documents.folios(documents.manifest(spark, a.manifest))
        wanted = spark.createDataFrame([(a.folio,)], "id string") if a.folio else unfinished(folios, Path(a.results) / a.baseline)
        n = runs.run(a.baseline, folios, wanted, predictor(a.baseline), a.results, a.manifest, json.loads(a.meta))
    except Exception as e:  # noqa: BLE001 - the command reports any failure by its kind
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(f"{a.baseline}: {n} reports")
    return 0


if __name__ == "__main__":
    sys.exit(main())
