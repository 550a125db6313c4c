"""Versions and specifiers of PEP 440 as columns.

A version is a struct whose order is that of versions: epoch; release without the zeros at its end; pre-release, which a
development release of a final one comes before; post-release; development release; local label, of which numbers come
after words. A specifier is an array of clauses, and each is a comparison of such structs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a version, in place: epoch, release, pre-release and its number, post-release in two spellings, development release, local label.
FORM = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|rc|c)(?:[-_.]?(\d+))?)?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)(?:[-_.]?(\d+))?)?"
    r"(?:[-_.]?(dev)(?:[-_.]?(\d+))?)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
#: Spellings of pre-releases, their order, and operators, longer ones first.
PRE = {"a": 0, "alpha": 0, "b": 1, "beta": 1, "c": 2, "rc": 2, "pre": 2, "preview": 2}
SHORT = ("a", "b", "rc")
OPERATORS = ("===", "~=", "==", "!=", ">=", "<=", ">", "<")
FINAL, NONE = 3, -1
MOST = (1 << 63) - 1


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _numbers(dotted: Column) -> Column:
    return F.transform(F.split(dotted, r"\."), lambda x: x.try_cast("bigint"))


def _significant(release: Column) -> Column:
    """release without the zeros at its end."""
    kept = F.array_max(F.transform(release, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(release, F.lit(1), kept)


def parsed(version: Column) -> Column:
    """A version's parts, and `key`, which orders versions; null for what isn't one."""
    text = F.lower(version)
    part = lambda k: F.regexp_extract(text, FORM, k)
    number = lambda k: F.coalesce(F.when(part(k) != "", part(k)).try_cast("bigint"), F.lit(0))
    release = _numbers(part(2))
    rank = reduce(lambda c, x: c.when(part(3) == x, PRE[x]), PRE, F.when(part(3) == "", F.lit(None)))
    post = F.when(part(5) != "", number(5)).when(part(6) != "", number(7))
    dev = F.when(part(8) != "", number(9))
    segment = lambda x: F.struct(x.rlike(r"^\d+$").cast("int").alias("kind"), F.coalesce(x.try_cast("bigint"), F.lit(0)).alias("n"), F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("word"))
    local = F.when(part(10) != "", F.transform(F.split(part(10), "[-_.]"), segment)).otherwise(F.array().cast("array<struct<kind:int,n:bigint,word:string>>"))
    parts = F.struct(number(1).alias("epoch"), release.alias("release"), rank.alias("rank"), number(4).alias("pre"), post.alias("post"), dev.alias("dev"), local.alias("local"))

    def with_key(p: Column) -> Column:
        bare = p["rank"].isNull() & p["post"].isNull() & p["dev"].isNotNull()
        pre = F.struct(F.when(bare, NONE).otherwise(F.coalesce(p["rank"], F.lit(FINAL))).alias("rank"), p["pre"].alias("n"))
        rest = F.struct(pre.alias("pre"), F.coalesce(p["post"], F.lit(NONE)).alias("post"), F.coalesce(p["dev"], F.lit(MOST)).alias("dev"))
        base = F.struct(p["epoch"].alias("epoch"), _significant(p["release"]).alias("release"))
        return F.struct(*[p[c].alias(c) for c in ("epoch", "release", "rank", "pre", "post", "dev", "local")], base.alias("base"), F.struct(base.alias("base"), rest.alias("rest")).alias("public"))

    fine = text.rlike(FORM) & ~F.exists(release, lambda x: x.isNull())
    return F.when(fine, _let(parts, with_key))


def normalized(p: Column) -> Column:
    """A version's canonical spelling."""
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ".")
    given = lambda c, before: F.when(c.isNull(), "").otherwise(F.concat(F.lit(before), c.cast("string")))
    pre = reduce(lambda c, k: c.when(p["rank"] == k, F.concat(F.lit(SHORT[k]), p["pre"].cast("string"))), range(3), F.when(p["rank"].isNull(), "")).otherwise("")
    local = F.array_join(F.transform(p["local"], lambda x: F.when(x["kind"] == 1, x["n"].cast("string")).otherwise(x["word"])), ".")
    return F.concat(F.when(p["epoch"] > 0, F.concat(p["epoch"].cast("string"), F.lit("!"))).otherwise(""), joined(p["release"]), pre, given(p["post"], ".post"), given(p["dev"], ".dev"), F.when(local != "", F.concat(F.lit("+"), local)).otherwise(""))


def clauses(specifier: Column) -> Column:
    """array<struct<op, bound, wide, v>> of a comma-separated specifier; wide: `.*` at its end; without an operator a clause is ==."""
    texts = F.filter(F.transform(F.split(specifier, ","), lambda x: F.trim(x)), lambda x: x != "")

    def clause(x: Column) -> Column:
        found = reduce(lambda c, o: c.when(F.startswith(x, F.lit(o)), F.lit(o)), OPERATORS[1:], F.when(F.startswith(x, F.lit(OPERATORS[0])), F.lit(OPERATORS[0]))).otherwise("")
        bound = F.trim(F.substr(x, F.length(found) + 1))
        wide = F.endswith(bound, F.lit(".*"))
        return F.struct(F.when(found == "", "==").otherwise(found).alias("op"), bound.alias("bound"), wide.alias("wide"), parsed(F.regexp_replace(bound, r"\.\*$", "")).alias("v"))

    return F.transform(texts, clause)


def _holds(text: Column, p: Column, c: Column) -> Column:
    """Whether a clause admits a version, pre-releases too."""
    v, n = c["v"], F.size(c["v"]["release"])
    padded = lambda size: F.slice(F.concat(p["release"], F.array_repeat(F.lit(0).cast("bigint"), size)), F.lit(1), size)
    begins = lambda size: (p["epoch"] == v["epoch"]) & (padded(size) == F.slice(v["release"], F.lit(1), size))
    labelled = F.size(v["local"]) > 0
    equal = F.when(c["wide"], begins(n)).otherwise((p["public"] == v["public"]) & (~labelled | (p["local"] == v["local"])))
    early = lambda x: x["rank"].isNotNull() | x["dev"].isNotNull()
    same_base = p["base"] == v["base"]
    whole = lambda x: F.struct(x["public"].alias("public"), x["local"].alias("local"))
    below = (whole(p) < whole(v)) & ~(~early(v) & early(p) & same_base)
    above = (whole(p) > whole(v)) & ~(v["post"].isNull() & p["post"].isNotNull() & same_base) & ~((F.size(p["local"]) > 0) & same_base)
    at_least = p["public"] >= v["public"]
    op = c["op"]
    compared = F.when(op == "==", equal).when(op == "!=", ~equal).when(op == ">=", at_least).when(op == "<=", p["public"] <= v["public"]).when(op == "<", below).when(op == ">", above).when(op == "~=", at_least & (n > 1) & begins(n - 1))
    as_written = F.lower(F.coalesce(normalized(p), text)) == F.lower(c["bound"])
    return F.coalesce(F.when(op == "===", as_written).otherwise(compared), F.lit(False))


def version_admitted(version: Column | str, specifier: Column | str) -> Column:
    """Whether a specifier admits a version, pre-releases too; null for null. The empty specifier admits every version;
    what is no version is admitted by === alone, and a clause whose bound is none admits nothing else."""
    text, spec = (F.col(c) if isinstance(c, str) else c for c in (version, specifier))
    admitted = _let(parsed(text), lambda p: F.forall(clauses(spec), lambda c: _holds(text, p, c)))
    return F.when(text.isNotNull() & spec.isNotNull(), admitted)
