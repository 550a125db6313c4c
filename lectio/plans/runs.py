"""Batch runs of a pluggable line predictor: preflight, staged writes, paired promotion, counts and budgets."""

from __future__ import annotations

import datetime as dt
import json
import os
import shutil
import time
import warnings
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.functions.scalars import canonical_hash
from lectio.operators import validate
from lectio.sources.sinks import atomic_json

#: Changelog rows from which a promotion warns, and at which it fails.
WARN_ROWS, FAIL_ROWS = 40, 50


class ScopeViolation(RuntimeError):
    """A folio outside the frozen scope was asked for."""


class CountMismatch(RuntimeError):
    """A run wrote another number of reports than the manifest declares."""


class BudgetExceeded(RuntimeError):
    """Running costs went over a cap."""


class ReplayMiss(RuntimeError):
    """A recorded run met a request that wasn't recorded."""


def preflight(wanted: DataFrame, frozen: DataFrame) -> None:
    """Raise unless every wanted id is in the frozen scope."""
    outside = [r.id for r in wanted.join(frozen.select("id"), "id", "left_anti").select("id").limit(10).collect()]
    if outside:
        raise ScopeViolation(f"not in the frozen scope: {', '.join(sorted(outside))}")


def expected_reports(manifest: dict, baseline: str) -> int:
    """The mapping counts wherever it has any key; the scalar of old manifests only where it has none."""
    by = manifest.get("expected_reports_per_baseline") or {}
    if by:
        return by[baseline]
    total = manifest.get("expected_total_reports")
    if not isinstance(total, int):
        raise KeyError(baseline)
    return total


def check_counts(manifest: dict, baseline: str, written: int) -> None:
    try:
        expected = expected_reports(manifest, baseline)
    except KeyError as e:
        raise CountMismatch(f"no expected reports are declared for {baseline!r}") from e
    if written != expected:
        raise CountMismatch(f"{baseline}: {written} reports written, {expected} declared")


def bumped(manifest: dict, baseline: str, folio: str, now: str | None = None) -> dict:
    """A manifest with one more expected report and a changelog row; the old one is left as it was."""
    new = json.loads(json.dumps(manifest))
    by = new.setdefault("expected_reports_per_baseline", {})
    by[baseline] = by.get(baseline, 0) + 1
    now = now or dt.datetime.now(dt.UTC).isoformat(timespec="seconds").replace("+00:00", "Z")
    log = new.setdefault("manifest_changelog", [])
    log.append({"prev_frozen_at": new.get("frozen_at", ""), "new_frozen_at": now, "reason": f"phase 3.1: {baseline} {folio} promoted"})
    new["frozen_at"] = now
    if len(log) >= FAIL_ROWS:
        raise OverflowError(f"the changelog has {len(log)} rows")
    if len(log) >= WARN_ROWS:
        warnings.warn(f"the changelog has {len(log)} rows", stacklevel=2)
    return new


class Staging:
    """A run's folder, kept on failure; documents move from it one by one, each with its manifest."""

    def __init__(self, root: str | Path, baseline: str):
        self.stage, self.final = Path(root) / ".in_progress" / baseline, Path(root) / baseline

    def __enter__(self) -> Staging:
        shutil.rmtree(self.stage, ignore_errors=True)
        self.stage.mkdir(parents=True)
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            shutil.rmtree(self.stage, ignore_errors=True)

    def write(self, folio: str, data: dict, diagnostic: dict | None = None, check: Callable[[dict], None] | None = None, beside: dict[str, dict] | None = None) -> None:
        """A folio's document, its diagnostic and the documents (name -> data) of its own folder."""
        atomic_json(data, self.stage / f"{folio}.json", check)
        if diagnostic is not None:
            atomic_json(diagnostic, self.stage / "diagnostic" / f"{folio}.gt_fed.json")
        for name, document in (beside or {}).items():
            atomic_json(document, self.stage / folio / name)

    def promote(self, folio: str, manifest_path: str | Path, bump: Callable[[dict], dict]) -> None:
        """Move a folio's document, its folder and its diagnostic, and write its manifest, or none of them.

        A folder that stood in the final place is put aside until all is done, and put back if it isn't.
        """
        if not (self.stage / f"{folio}.json").exists():
            raise FileNotFoundError(self.stage / f"{folio}.json")
        names = [f"{folio}.json", *(n for n in (folio, f"diagnostic/{folio}.gt_fed.json") if (self.stage / n).exists())]
        moved, aside = [], self.stage / f".{folio}.before"
        try:
            for n in names:
                (self.final / n).parent.mkdir(parents=True, exist_ok=True)
                if (self.final / n).is_dir():
                    os.replace(self.final / n, aside)
                os.replace(self.stage / n, self.final / n)
                moved.append(n)
                _settled(self.final / n)
            atomic_json(bump(json.loads(Path(manifest_path).read_text(encoding="utf-8"))), manifest_path)
            _settled(Path(manifest_path))
        except BaseException:
            for n in reversed(moved):
                os.replace(self.final / n, self.stage / n)
            if aside.exists():
                os.replace(aside, self.final / folio)
            raise
        shutil.rmtree(aside, ignore_errors=True)

    def promote_all(self) -> None:
        """Move everything of the run; each file at once, a folder in place of the one that stood there. The last step of a run."""
        self.final.mkdir(parents=True, exist_ok=True)
        for source in sorted(self.stage.iterdir()):
            target = self.final / source.name
            if target.is_dir():
                shutil.rmtree(target)
            os.replace(source, target)
            _settled(target)

    def count(self) -> int:
        return len([p for p in self.final.glob("*.json") if p.name != "run_meta.json"])


def _settled(path: Path) -> None:
    fd = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def affordable(estimates: DataFrame, manifest: dict) -> None:
    """estimates (id, usd): raise before any call if a folio, or all together, would go over the manifest's caps."""
    per_folio, per_run = cost_caps(manifest)
    e = estimates.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("all"), F.max_by("id", "usd").alias("id"), F.coalesce(F.max("usd"), F.lit(0.0)).alias("most")).first()
    if e.most > per_folio:
        raise BudgetExceeded(f"{e.id}: {e.most} USD expected, {per_folio} allowed a folio")
    if e.all > per_run:
        raise BudgetExceeded(f"{e['all']} USD expected, {per_run} allowed a run")


def run(
    baseline: str, folios: DataFrame, wanted: DataFrame, infer: Callable[[DataFrame], DataFrame], root: str | Path, manifest_path: str | Path,
    meta: dict | None = None, check: Callable[[dict], None] | None = None, estimates: DataFrame | None = None, meta_check: Callable[[dict], None] | None = None,
) -> int:
    """Predict the wanted folios and promote each with its manifest; returns how many reports stand.

    In this order: every wanted folio is in the frozen scope; the estimates, if any, keep to the manifest's caps; then,
    folio by folio, its scope once more by the manifest as it stands, its document checked and written, and promoted;
    last the run's own document, checked too, and the count. A failure leaves the staged documents where they are.

    folios: the manifest's, with in_frozen_scope; infer: folios -> (folio_id, value) prediction documents as JSON,
    distributed however it likes, and called for folios in scope alone. Documents arrive one at a time, in order of folio.
    """
    frozen = folios.where("in_frozen_scope")
    preflight(wanted, frozen)
    stands = lambda: json.loads(Path(manifest_path).read_text(encoding="utf-8"))
    if estimates is not None:
        affordable(estimates.join(wanted.select("id"), "id", "left_semi"), stands())
    made = infer(frozen.join(wanted.select("id"), "id", "left_semi"))
    with Staging(root, baseline) as s:
        for r in made.orderBy("folio_id").toLocalIterator():
            if not any(f.get("id", f.get("folio_id")) == r.folio_id and f.get("in_frozen_scope", True) for f in stands()["folios"]):
                raise ScopeViolation(f"not in the frozen scope: {r.folio_id}")
            s.write(r.folio_id, json.loads(r.value), check=check)
            s.promote(r.folio_id, manifest_path, lambda m, f=r.folio_id: bumped(m, baseline, f))
        atomic_json({"baseline_id": baseline, **(meta or {})}, s.final / "run_meta.json", meta_check)
        check_counts(stands(), baseline, s.count())
        return s.count()


def attempted(call: Callable[[dict], object], request: dict, usd: float, charge: Callable[[float], None], retryable: tuple[type[Exception], ...], attempts: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[object, float]:
    """(response, USD charged): a call tried again after an error that may pass, each try charged before it is made.

    The pause doubles from `base` seconds; the last error is raised, other errors at once. charge raises at a cap.
    """
    spent = 0.0
    for k in range(attempts):
        charge(usd)
        spent += usd
        try:
            return call(request), spent
        except retryable:
            if k == attempts - 1:
                raise
            sleep(base * 2**k)
    raise ValueError("no attempt allowed")


def cost_caps(manifest: dict) -> tuple[float, float]:
    """(per folio, per run) in USD; only the manifest sets them, so a manifest without either refuses the run."""
    caps = manifest.get("cost_caps_usd") or {}
    if "per_folio" not in caps or "per_run" not in caps:
        raise BudgetExceeded("the manifest has no cost caps")
    return float(caps["per_folio"]), float(caps["per_run"])


def text_slot(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A string -> string model as a Column function, called in Arrow batches; null stays null."""

    @F.pandas_udf(T.StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return apply


def line_slot(f: Callable[[dict], list[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A folio -> lines model as run()'s infer: one prediction document a folio, made where the folio's row is."""

    def infer(folios: DataFrame) -> DataFrame:
        def made(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                docs = [json.dumps({"folio_id": r["id"], "lines": f(r)}, ensure_ascii=False) for r in pdf.to_dict("records")]
                yield pd.DataFrame({"folio_id": pdf["id"], "value": docs})

        return folios.mapInPandas(made, "folio_id string, value string")

    return infer


def within_budget(calls: DataFrame, per_folio: float, per_run: float) -> DataFrame:
    """calls (run, folio, at, usd) with running totals; raises at the first call over a cap."""
    spent = validate.running_budget(calls, ["run", "folio"], "at", "usd", per_folio).withColumnsRenamed({"spent": "spent_folio", "over": "over_folio"})
    spent = validate.running_budget(spent, ["run"], "at", "usd", per_run).withColumnsRenamed({"spent": "spent_run", "over": "over_run"})
    over = F.col("over_folio") | F.col("over_run")
    return spent.withColumn("usd", F.when(over, F.raise_error(F.concat(F.lit("budget exceeded at "), F.col("at").cast("string")))).otherwise(F.col("usd")))


def replayed(requests: DataFrame, log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """requests (id, request as JSON) with the first recorded response to the same request; a miss raises.

    order: columns of log that say which record is first, such as its file and line; else rows count as they are read,
    which is the order of one file alone.
    """
    q = requests.withColumn("prompt_hash", canonical_hash(F.col("request"), 64, compact=False))
    first = log.withColumn("_at", F.struct(*order) if order else F.monotonically_increasing_id()).groupBy("prompt_hash").agg(F.min_by("response", "_at").alias("response"))
    j = q.join(first, "prompt_hash", "left")
    return j.withColumn("response", F.when(F.col("response").isNull(), F.raise_error(F.concat(F.lit("not recorded: "), "prompt_hash"))).otherwise(F.col("response")))


def pinned(files: DataFrame, pins: dict[str, str], force: bool = False) -> None:
    """Raise unless files (path, sha256) have the digests given; force only looks."""
    got = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.select("path", "sha256").collect()}
    wrong = sorted(n for n, d in pins.items() if got.get(n) != d)
    if wrong and not force:
        raise ValueError(f"inputs aren't the pinned ones: {', '.join(wrong)}")
