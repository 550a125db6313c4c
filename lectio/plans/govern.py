"""Release gates over a tree of documents, as one violation table."""

from __future__ import annotations

import datetime as dt
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.functions import views
from lectio.functions.scalars import package_name, version_admitted, visible_text
from lectio.operators import schema
from lectio.operators import validate as v
from lectio.sources import documents

#: Bytes a tracked file may have.
MOST_BYTES = 5 * 1024 * 1024

# Bodies that stand where a statement should and say nothing, and fields a sign-off needs.
PLACEHOLDERS = ("tbd", "todo", "tba", "n/a", "na", "none", "nil", "xxx", "pending", "coming soon")
SIGNOFF_FIELDS = ("Version", "Authorized by", "Authorization", "Signed off")
#: A requirement: a package's name, its extras in brackets, its specifier; what follows a semicolon is a condition.
REQUIREMENT = re.compile(r"\s*(?P<name>[A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?P<pin>[^;@]*)")
#: Documents that are checked against a schema of the same tree, where both are there.
SCHEMAS = {"leaderboard.json": "schemas/leaderboard.schema.json", "iaa_report.json": "schemas/iaa_report.schema.json"}
IMMUTABLE = ("manuscript", "book", "folio", "gt_hash", "gt_source")


def tree_gate(files: DataFrame, extensions: list[str], folders: list[str], most: int = MOST_BYTES) -> DataFrame:
    """files (path, length): rejected extensions, folders and sizes; a file breaks the first rule it meets."""
    name = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    inside = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in folders])) if folders else F.lit(False)
    rule = F.when(name.isin(*extensions), "extension").when(inside, "folder").when(F.col("length") > most, "size")
    return files.select(rule.alias("rule"), F.col("path").alias("subject"), F.col("length").cast("string").alias("detail")).where("rule is not null")


def scope(folios: DataFrame, manuscript: str, book: str) -> DataFrame:
    return v.rules(folios.withColumn("id", F.coalesce("id", F.lit("<unknown>"))), "id", {"manuscript in scope": F.col("manuscript") == manuscript, "book in scope": F.col("book") == book})


def frozen(folios: DataFrame, manuscript: str | None = None) -> DataFrame:
    """Folios inside the frozen scope, of one manuscript if named."""
    d = folios.where("in_frozen_scope")
    return d.where(F.col("manuscript") == manuscript) if manuscript else d


def report_bindings(reports: DataFrame, expected: str | None) -> DataFrame:
    """reports (path, value): documents whose manifest_hash isn't the manifest's."""
    return v.bound_to(reports.withColumn("h", F.get_json_object("value", "$.manifest_hash")), "path", "h", expected, "manifest hash")


def report_status(reports: DataFrame, wanted: str = "real") -> DataFrame:
    """A release's report must say that it is real; none at all is a violation too."""
    n = reports.select(F.count("*").alias("n"), F.count_if(F.get_json_object("value", "$.iaa_status") == wanted).alias("ok"))
    return n.where("n = 0 or ok < n").select(F.lit("report status").alias("rule"), F.when(F.col("n") == 0, "missing").otherwise("placeholder").alias("subject"), F.lit(wanted).alias("detail"))


def front_matter(cards: DataFrame, keys: tuple[str, ...] = ("language:", "license:", "tags:")) -> DataFrame:
    head = F.lower(F.regexp_extract("value", r"(?s)\A---\n(.*?)---", 1))
    return v.rules(cards, "path", {"has front matter": F.col("value").rlike(r"(?s)\A---\n.*?---"), **{f"has {k.rstrip(':')}": F.contains(head, F.lit(k)) for k in keys}})


def digests(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """recorded (id, source, digest) of frozen folios, source as "path@revision (…)", against files (path, sha256).

    A digest is the first 16 lower-case hexadecimal digits of the file's sha256, no more and no fewer, and says which
    file it is of. Each row breaks the first rule that it meets; no rows at all are a violation too.
    """
    head = F.substring_index("source", " ", 1)
    j = recorded.withColumn("path", F.regexp_extract(head, r"(?s)^(.*)@", 1)).join(files.select("path", "sha256"), "path", "left")
    rule = (
        F.when(F.col("digest").isNull(), "no digest").when(~F.col("digest").rlike(r"\A[0-9a-f]{16}\z"), "malformed digest")
        .when(F.coalesce("source", F.lit("")) == "", "no source").when(~F.contains(head, F.lit("@")), "source without revision")
        .when(F.col("sha256").isNull(), "file missing").when(F.left("sha256", F.lit(16)) != F.col("digest"), "digest differs")
    )
    none = recorded.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("nothing frozen").alias("rule"), F.lit("").alias("subject"), F.lit("").alias("detail"))
    return j.select(rule.alias("rule"), F.col("id").cast("string").alias("subject"), F.col("path").alias("detail")).where("rule is not null").unionByName(none)


def fused(folios: DataFrame, files: DataFrame, golden: str, golden_revision: str, source: str, source_revision: str) -> DataFrame:
    """folios with the digest of each frozen folio's golden file, once and for all; digests() holds afterwards.

    files: (path, sha256); golden: a path with {id}, a projection of source. Raises where a frozen folio has a digest
    already or no golden file. Other folios stay as they are.
    """
    path = F.concat(F.lit(golden.split("{id}")[0]), F.col("id"), F.lit(golden.split("{id}")[1]))
    j = folios.withColumn("_path", path).join(files.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha")), "_path", "left")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("id")))
    digest = F.when(F.col("gt_hash").isNotNull(), fail("digest already set: ")).when(F.col("_sha").isNull(), fail("no golden file: ")).otherwise(F.left("_sha", F.lit(16)))
    said = F.concat("_path", F.lit(f"@{golden_revision} (projection of {source}@{source_revision})"))
    return j.withColumns({"gt_hash": F.when(F.col("in_frozen_scope"), digest).otherwise(F.col("gt_hash")), "gt_source": F.when(F.col("in_frozen_scope"), said).otherwise(F.col("gt_source"))}).drop("_path", "_sha")


def successor(head: DataFrame, staged: DataFrame, head_log: DataFrame, staged_log: DataFrame, head_frozen_at: str, staged_frozen_at: str, reason: str = r"^phase \d+(\.\d+)?: ") -> DataFrame:
    """Illegal changes from one manifest to the next: folio tables, and their changelogs numbered by at."""
    n = head_log.count()
    new = staged_log.where(F.col("at") >= n)
    added = new.agg(F.count("*").alias("n"), F.count_if(F.col("reason").rlike(reason)).alias("ok"), F.max_by("new_frozen_at", F.when(F.col("new_frozen_at").isNotNull(), F.col("at"))).alias("last")).first()
    fuse = added.n == 1 and added.ok == 1
    found = [
        v.append_only(head_log, staged_log, "at"),
        v.chain(new, "at", "prev_frozen_at", "new_frozen_at", F.lit(head_frozen_at)),
        v.removed(head, staged, "id", fuse, F.col("iaa_folio") | F.col("gt_hash").isNotNull()),
        v.immutable_fields(head, staged, "id", list(IMMUTABLE)),
        v.restored(head, staged, "id", "in_frozen_scope"),
    ]
    out = v.all_of(*found)
    if added.n and (added.last or head_frozen_at) != staged_frozen_at:
        out = out.unionByName(head.sparkSession.createDataFrame([("chain broken", "end", staged_frozen_at)], out.schema))
    return out


def sections(texts: DataFrame) -> DataFrame:
    """(path, heading, body) of a markdown text's second-level sections, in place."""
    parts = F.slice(F.split("value", r"(?m)^##[ \t]+"), 2, 1_000_000)
    return texts.select("path", F.posexplode(parts).alias("at", "s")).select("path", "at", F.trim(F.substring_index("s", "\n", 1)).alias("heading"), F.regexp_extract("s", r"(?s)\A[^\n]*\n?(.*)", 1).alias("body"))


def versioned(texts: DataFrame, tag: str) -> DataFrame:
    """The first section whose heading has the tag at the end of a word, and not as the end of a longer name or version."""

    def names(word):
        before = F.substr(word, F.length(word) - len(tag), F.lit(1))
        return F.endswith(word, F.lit(tag)) & ((F.length(word) == len(tag)) | ~before.rlike(r"[\p{L}\p{N}_.-]"))

    hit = sections(texts).where(F.exists(views.tokens(F.col("heading")), names))
    return hit.groupBy("path").agg(F.min_by("body", "at").alias("body"))


#: Marks of markdown that say nothing by themselves.
MARKUP = "*_`>#.-"


def substantive(body):
    """Whether a body says something once it is read as a reader sees it."""
    words = views.tokens(F.translate(visible_text(body), MARKUP, " " * len(MARKUP)))
    return (F.size(words) > 0) & ~F.lower(F.array_join(words, " ")).isin(*PLACEHOLDERS)


def _level(line):
    """How many number signs a heading has; 0 for other lines."""
    return F.length(F.regexp_extract(line, r"^(#+)[ \t\r]", 1))


def under(body, heading: str):
    """The lines under the first third-level heading that begins so, up to the next heading of its level or above; null without one."""
    lines = F.split(body, "\n")
    names = F.transform(lines, lambda x: (_level(x) == 3) & F.startswith(F.ltrim(F.substr(x, F.lit(4))), F.lit(heading)))
    first = F.array_position(names, True)
    rest = F.slice(lines, first + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: _level(x).between(1, 3)), True)
    return F.when(first > 0, F.array_join(F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest), "\n"))


def signoff(texts: DataFrame, tag: str, today: dt.date | None = None) -> DataFrame:
    """Violations of a version's sign-off entry: each field given, the same version, a real date that isn't to come."""
    d = versioned(texts, tag)
    value = lambda f: F.trim(F.regexp_replace(F.regexp_extract("body", rf"(?m)^\s*[-*]?\s*\**{re.escape(f)}\**[ \t]*:([^\n]*)", 1), r"^[\s*]+|[\s*]+$", ""))
    d = d.withColumns({f"f{i}": value(f) for i, f in enumerate(SIGNOFF_FIELDS)})
    day = F.when(F.col("f3").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("f3").try_cast("date"))
    checks = {**{f"has {f}": F.col(f"f{i}") != "" for i, f in enumerate(SIGNOFF_FIELDS)}, "version agrees": (F.col("f0") == "") | (F.col("f0") == tag), "signed on a day that was": (F.col("f3") == "") | F.coalesce(day <= F.date_add(F.lit(today or dt.date.today()), 1), F.lit(False))}
    return _or_missing(d, v.rules(d, "path", checks), "no sign-off", tag)


def disclosure(texts: DataFrame, tag: str, heading: str = "Governance") -> DataFrame:
    """Violations of a version's changelog: a third-level section under that heading that says something."""
    d = versioned(texts, tag)
    body = under(F.col("body"), heading)
    checks = {"has a disclosure": body.isNotNull(), "discloses something": body.isNotNull() & substantive(F.coalesce(body, F.lit("")))}
    return _or_missing(d, v.rules(d, "path", checks), "no changelog entry", tag)


def _or_missing(d: DataFrame, found: DataFrame, rule: str, subject: str) -> DataFrame:
    none = d.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), F.lit("").alias("detail"))
    return found.unionByName(none)


PIN = T.StructType([T.StructField(c, T.StringType()) for c in ("package", "specifier", "extra")])


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("pins", T.ArrayType(PIN))]))
def project(toml: pd.Series) -> pd.DataFrame:
    """Name, version and requirements of a project file, optional ones with their group; nulls and no requirements for what isn't one."""

    def of(text: str | None) -> dict:
        try:
            p = tomllib.loads(text or "").get("project")
        except tomllib.TOMLDecodeError:
            p = None
        p = p if isinstance(p, dict) else {}
        optional = p.get("optional-dependencies")
        groups = [(None, p.get("dependencies")), *(optional.items() if isinstance(optional, dict) else ())]
        wanted = [(extra, REQUIREMENT.match(r)) for extra, rs in groups if isinstance(rs, list) for r in rs if isinstance(r, str)]
        pins = [{"package": m["name"], "specifier": (m["pin"] or "").strip(" ()"), "extra": extra} for extra, m in wanted if m]
        return {**{k: p[k] if isinstance(p.get(k), str) else None for k in ("name", "version")}, "pins": pins}

    return pd.DataFrame([of(t) for t in toml], columns=["name", "version", "pins"])


def consumers(files: DataFrame) -> DataFrame:
    """(path, consumer, package, specifier, extra) of every requirement in project files (path, value)."""
    p = files.select("path", project("value").alias("p"))
    return p.select("path", F.col("p.name").alias("consumer"), F.explode("p.pins").alias("x")).select("path", "consumer", "x.*")


def changed_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, package, version) of project files (path, value) whose version isn't the old one's; a new file counts as changed."""
    of = lambda d, *as_: d.select("path", project("value").alias("p")).select("path", F.col("p.name").alias(as_[0]), F.col("p.version").alias(as_[1]))
    j = of(new, "package", "version").where("package is not null and version is not null").join(of(old, "_name", "_version"), "path", "left")
    return j.where(~F.col("version").eqNullSafe(F.col("_version"))).select("path", "package", "version")


def version_cascade(changes: DataFrame, consumers: DataFrame) -> DataFrame:
    """changes (package, version), consumers (consumer, package, specifier): pins that the new version breaks, itself left out.

    Where both have a path, the changed package's own file is left out instead of the consumer of its name. A pin
    without a specifier admits every version.
    """
    by_path = "path" in changes.columns and "path" in consumers.columns
    c = changes.select(package_name(F.col("package")).alias("p"), "version", *([F.col("path").alias("own")] if by_path else []))
    j = consumers.withColumn("p", package_name(F.col("package"))).join(c, "p")
    j = j.where(F.col("path") != F.col("own")) if by_path else j.where(package_name(F.col("consumer")) != F.col("p"))
    return j.where(~version_admitted("version", "specifier")).select(F.lit("pin doesn't admit").alias("rule"), F.col("consumer").alias("subject"), F.concat_ws(" ", "p", "specifier", "version").alias("detail"))


def catalog(entries: DataFrame, schema_of_entry: dict, folios: DataFrame) -> DataFrame:
    """entries (at, value as JSON) of a catalog: each valid, ids unique, and an entry for every manuscript of the folios; no entries is a violation."""
    ids = entries.select(F.get_json_object("value", "$.id").alias("id")).where("id is not null")
    labelled = entries.withColumn("label", F.coalesce(F.get_json_object("value", "$.id"), F.concat(F.lit("entry "), F.col("at").cast("string"))))
    wanted = folios.where("manuscript is not null").select(F.col("manuscript").alias("id"))
    none = entries.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no entries").alias("rule"), F.lit("").alias("subject"), F.lit("").alias("detail"))
    return v.all_of(schema.violations(labelled, "label", "value", schema_of_entry), v.duplicates(ids, "id"), v.referenced(wanted, ids, "id", "no catalog entry"), none)


def reverified(metrics: DataFrame, pinned: DataFrame, tolerance: float = 5e-5) -> DataFrame:
    """pinned (metric, value): values that recomputing (metric, point) doesn't give."""
    j = pinned.join(metrics.select("metric", "point"), "metric", "left")
    bad = j.where(~F.coalesce(F.abs(F.col("point") - F.col("value")) <= tolerance, F.lit(False)))
    return bad.select(F.lit("pinned value").alias("rule"), F.col("metric").alias("subject"), F.concat_ws(" ", F.col("value").cast("string"), F.col("point").cast("string")).alias("detail"))


def audit(spark: SparkSession, root: str, manuscript: str, book: str, terms: DataFrame, whitelist: DataFrame | None = None, release: bool = False, folders: list[str] | None = None, extensions: list[str] | None = None, legacy: list[str] | None = None, legacy_allowed: tuple[str, ...] = ()) -> DataFrame:
    """All release checks of a tree with manifest.json, results/<baseline>/*.json and README.md, as one table.

    legacy: words that no file may have any more, but those at the paths (from the root) in legacy_allowed.
    """
    man = documents.manifest(spark, f"{root}/manifest.json")
    folios, files = documents.folios(man), documents.files(spark, root, content=False)
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,md,txt,yaml}").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    results = texts.where(F.col("path").rlike(r"/results/.*\.json$"))
    m = man.select(F.coalesce(F.get_json_object("value", "$.manifest_hash"), "raw_hash").alias("h"), "scorer_version").first()
    meta = results.where(F.col("path").rlike(r"/results/[^/]+/run_meta\.json$")).withColumn("sv", F.coalesce(F.get_json_object("value", "$.scorer_version"), F.lit("")))
    shipped = results.where(F.col("path").rlike(r"/results/[^/]+/[^/]+\.json$") & ~F.col("path").endswith("run_meta.json")).select(F.regexp_extract("path", r"/results/([^/]+)/", 1).alias("baseline"))
    expected = man.select(F.explode("expected_reports_per_baseline").alias("baseline", "promised"))
    found = [
        scope(folios, manuscript, book),
        tree_gate(files, extensions or [], folders or ["scans"]),
        v.needles(texts, "path", "value", terms, whitelist).select(F.lit("needle").alias("rule"), "subject", F.col("needle").alias("detail")),
        report_bindings(results, m.h),
        v.bound_to(meta, "path", "sv", m.scorer_version, "scorer version"),
        v.promised(expected, shipped, "baseline"),
        front_matter(texts.where(F.col("path").endswith("/data/README.md"))),
    ]
    at_root = lambda name: texts.where(F.col("path").endswith(f"{root.rstrip('/').rpartition('/')[2]}/{name}"))
    for name, schema_name in SCHEMAS.items():
        if rules := at_root(schema_name).first():
            found.append(schema.violations(at_root(name), "path", "value", json.loads(rules.value), f"schema of {name}"))
    if legacy:
        kept = [at_root(p).select("path") for p in legacy_allowed]
        rest = texts.join(v.all_of(*kept), "path", "left_anti") if kept else texts
        found.append(v.whole_words(rest, "path", "value", legacy))
    if release:
        found.append(report_status(texts.where(F.col("path").endswith("/iaa_report.json"))))
    return v.all_of(*found)
