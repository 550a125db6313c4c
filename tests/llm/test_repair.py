import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from lectio.llm import queries, repair

SHAPE = re.compile(r"(s?(ua)+)?")


def faulty(rows):
    """(role, text, fault) of a conversation's rows in order."""
    out, seen = [], set()
    for role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        fault = "b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "-"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(marked):
    """(cost, audit, repaired) over all edits with at most two insertions in a row."""
    ways = {(0, "", ())}
    for role, text, fault in marked:
        new = {}
        for cost, audit, made in ways:
            for k in range(3):
                for fill in itertools.product(("user", "assistant"), repeat=k):
                    begun, more = made + tuple((r, "") for r in fill), 5 * k
                    choices = [("D", 2, begun)]
                    if fault not in ("b", "d"):
                        late = 5 if fault == "t" else 0
                        choices += [("K", late, (*begun, (role, text)))]
                        choices += [("R", 1 + late, (*begun, (r, text))) for r in ("user", "assistant")]
                    for edit, price, then in choices:
                        shape = "".join(r[:1] or "?" for r, _ in then)
                        if not SHAPE.fullmatch(shape) and not SHAPE.fullmatch(shape + "a") and not SHAPE.fullmatch(shape + "ua"):
                            continue
                        way = (cost + more + price, audit + "I" * k + edit, then)
                        key = shape[-1:]
                        if key not in new or way[:2] < new[key][:2]:
                            new[key] = way
        ways = set(new.values())
    ends = []
    for cost, audit, made in ways:
        for k in range(3):
            for fill in itertools.product(("user", "assistant"), repeat=k):
                then = made + tuple((r, "") for r in fill)
                if SHAPE.fullmatch("".join(r[:1] or "?" for r, _ in then)):
                    ends.append((cost + 5 * k, audit + "I" * k, then))
    return min(ends)


def exhaustive(marked):
    """(cost, audit) of the least of all edit strings whatever, up to two insertions before each row and at the end."""
    best = None
    gaps = ["", "I", "II"]
    for fill in itertools.product(gaps, repeat=len(marked) + 1):
        for edits in itertools.product("DKR", repeat=len(marked)):
            cost, shapes = 0, {""}
            for i, (row, edit) in enumerate(zip([*marked, None], [*edits, ""], strict=True)):
                for _ in fill[i]:
                    shapes, cost = {s + x for s in shapes for x in "ua"}, cost + 5
                if row is None:
                    break
                role, _, fault = row
                cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if fault == "t" and edit != "D" else 0)
                if edit != "D" and fault in ("b", "d"):
                    shapes = set()
                elif edit == "K":
                    shapes = {s + (role[:1] or "?") for s in shapes}
                elif edit == "R":
                    shapes = {s + x for s in shapes for x in "ua"}
            if any(SHAPE.fullmatch(s) for s in shapes):
                audit = "".join(a + b for a, b in itertools.zip_longest(fill, edits, fillvalue=""))
                best = min(best or (99, ""), (cost, audit))
    return best


ROLES = ["system", "user", "assistant", "tool", "", "user", "assistant"]
TEXTS = ["a.", "b", "c!", "", " \n", "d?", "e", "f. "]


def signature(marked):
    return "".join("d" if f in ("b", "d") else (x := r[:1] if r[:1] in ("s", "u", "a") else "x").upper() if f == "t" else (r[:1] if r[:1] in ("s", "u", "a") else "x") for r, _, f in marked)


def test_trie_equals_enumeration():
    r = random.Random(2)
    for _ in range(60):
        marked = faulty([(r.choice(ROLES), r.choice(TEXTS)) for _ in range(r.randint(0, 3))])
        assert repair.Trie().solve(signature(marked)) == exhaustive(marked) == cheapest(marked)[:2]


def test_trie_in_order_equals_each_alone():
    r = random.Random(3)
    marked = [faulty([(r.choice(ROLES), r.choice(TEXTS) + (r.choice("xyz.") if r.random() < 0.8 else "")) for _ in range(r.randint(0, 12))]) for _ in range(400)]
    trie = repair.Trie()
    for m in sorted(marked, key=signature):
        assert trie.solve(signature(m)) == cheapest(m)[:2]
    long = "ua" * 50_000 + "d"
    assert trie.solve(long) == (2, "K" * 100_000 + "D")
    assert trie.solve(long[:-1] + "s") == (2, "K" * 100_000 + "D") and len(trie.layers) == 100_002


def expected(rows):
    """By conv_id, what the contract says of rows (conv_id, turn, role, text) as they are."""
    by = defaultdict(list)
    for conv_id, turn, role, text in rows:
        by[conv_id].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv_id, all_ in by.items():
        all_.sort(key=lambda x: (x[0], x[1], x[2], hashlib.sha256(f"{len(x[2])}:{x[2]}:{x[3]}".encode()).digest()))
        marked = faulty([x[2:] for x in all_])
        cost, audit, made = cheapest(marked)
        turns, faults = {t for has, t, *_ in all_ if has}, [f for *_, f in marked]
        initials = [x[2][:1] for x in all_]
        illegal = sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv_id] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest(), made)
    return out


def some_rows(r, n):
    rows = []
    for conv_id in [None, *range(n)]:
        for turn in range(r.choice([1, 2, 4, 8, 20])):
            rows.append((conv_id, r.choice([turn, turn, turn, turn + 1, None]), r.choice([*ROLES, None]), r.choice([*TEXTS, None, f"t{turn}.", f"u{turn}", "é!"])))
    return rows


DDL = "conv_id long, turn long, role string, text string"


def test_operator_equals_brute_force(spark):
    r = random.Random(4)
    rows = some_rows(r, 40)
    want = expected(rows)
    r.shuffle(rows)
    d = spark.createDataFrame([(*x, 7, "k") for x in rows], f"{DDL}, row long, key string").repartition(5)
    extra = spark.createDataFrame([(1,), (900,), (900,)], "conv_id long")
    got = {x.conv_id: tuple(x)[1:] for x in repair.repair(d, extra).collect()}
    assert got.pop(900) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {k: v[:-1] for k, v in want.items()}
    made = defaultdict(list)
    for x in sorted(repair.repaired(d, repair.plans(repair.signatures(d))).collect(), key=lambda x: x.place):
        made[x.conv_id].append((x.role, x.text))
    assert {k: tuple(v) for k, v in made.items()} == {k: v[-1] for k, v in want.items() if v[-1]}
    assert repair.repair(d.where("false")).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = some_rows(random.Random(seed), 60)
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/conversations.parquet")
    after = []
    for conv_id, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        what = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        after += [(conv_id, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    want = expected(after)
    got = {x.conv_id: tuple(x)[1:] for x in queries.op12_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {x[0] for x in rows}
    for k, v in got.items():
        assert v == (want[k][:-1] if k in want else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
