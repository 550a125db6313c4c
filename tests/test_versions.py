import itertools

from pyspark.sql import functions as F

from lectio.functions import versions

#: In order, those of one row equal.
ORDER = [
    ["1.dev0"], ["1.0.dev456", "1.dev456"], ["1.0a1", "1alpha1", "1.0-A.1"], ["1.0a2.dev456"], ["1.0a2"], ["1.0a12.dev456"], ["1.0a12"], ["1.0b1.dev456"], ["1.0b2", "1.0beta2"], ["1.0b2.post345.dev456"], ["1.0b2.post345", "1.0b2-345"],
    ["1.0rc1.dev456"], ["1.0rc1", "1.0c1", "1.0pre1", "1.0_preview_1"], ["1", "1.0", "v1.0.0", " 1.0 "], ["1.0+abc.5"], ["1.0+abc.7"], ["1.0+5", "1+05"], ["1.0.post456.dev34"], ["1.0.post456", "1.0-456", "1.0.rev456", "1r456"], ["1.0.15"], ["1.1.dev1"], ["1.1"], ["1!0.1"], ["1!1.0"], ["2!0"],
]
#: (version, specifier, whether it is admitted).
CASES = [
    ("1.0.post1", ">=1.0", True), ("1.0+x", "==1.0", True), ("1.0", "===1.0", True), ("1!1.0", ">=2.0", True), ("v1.0", "==1", True), ("2.0rc1", ">=1.0,<2.0", False), ("2.0rc1", "<2.0rc2", True), ("2.0.dev1", "<2.0", False), ("1.9rc1", "<2.0", True),
    ("1.5", "==1.*", True), ("1!1.5", "==1.*", False), ("1", "==1.0.*", True), ("1.1a1", "==1.1.*", True), ("1.10", "==1.1.*", False), ("1.2", "!=1.*", False), ("2.2", "~=2.2", True), ("2.9", "~=2.2", True), ("3.0", "~=2.2", False), ("2.2.1", "~=2.2.0", True), ("2.3", "~=2.2.0", False),
    ("2.2.post4", "~=2.2.post3", True), ("2.2.post2", "~=2.2.post3", False), ("1.4.6", "~=1.4.5a4", True), ("1.5", "~=1.4.5a4", False), ("2", "~=2", False), ("1.0.post1", ">1.0", False), ("1.0.post2", ">1.0.post1", True), ("1.0+x", ">1.0", False), ("1.1", ">1.0", True), ("1.0+x", "==1.0+y", False),
    ("1.0+X.01", "==1.0+x.1", True), ("1.0+x", "<=1.0", True), ("1.0.post1", "<=1.0", False), ("1.0.0", "===1.0", False), ("1.0RC1", "===1.0rc1", True), ("weird", "===weird", True), ("weird", ">=0", False), ("weird", "", True), ("1.0", "", True), ("1.0", ">=0.9 , < 1.1", True), ("1.0", "1.0", True), ("1.0", ">=x", False),
    ("1.0", None, None), (None, ">=1", None), ("1.0", "!=1.0", False), ("1.0a1", "!=1.0", True), ("1.0-1", "==1.0.post1", True), ("0", "==0.0.0", True), ("2024.10", ">=2024.9,!=2024.11", True), ("10.0", "<9", False),
]


def test_versions_are_in_order(spark):
    rows = [(v, k) for k, same in enumerate(ORDER) for v in same]
    d = spark.createDataFrame(rows, "v string, k int").withColumn("p", versions.parsed(F.col("v")))
    d = d.select("v", "k", F.struct("p.public", "p.local").alias("key")).persist()
    pairs = d.alias("a").crossJoin(d.alias("b")).select(F.col("a.v"), F.col("b.v"), (F.col("a.key") < F.col("b.key")).alias("less"), (F.col("a.key") == F.col("b.key")).alias("same"))
    got = {(r[0], r[1]): (r.less, r.same) for r in pairs.collect()}
    for (v, j), (w, k) in itertools.product(rows, rows):
        assert got[v, w] == (j < k, j == k), (v, w)


def test_specifiers_admit(spark):
    d = spark.createDataFrame([(i, v, s) for i, (v, s, _) in enumerate(CASES)], "i int, v string, s string")
    got = {r.i: r.ok for r in d.select("i", versions.version_admitted("v", "s").alias("ok")).collect()}
    assert [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[2]] == []


def test_canonical_spellings(spark):
    want = {"v1!01.0-alpha": "1!1.0a0", "1.0-5": "1.0.post5", "1.0.REV": "1.0.post0", "1_c3.dev": "1rc3.dev0", "1+A_01.b": "1+a.1.b", "x1": None}
    d = spark.createDataFrame([(v,) for v in want], "v string")
    assert {r.v: r.n for r in d.select("v", versions.normalized(versions.parsed(F.col("v"))).alias("n")).collect()} == want
