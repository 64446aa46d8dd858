"""The audit against every order walked document by document."""

import random
import re
from itertools import permutations

from corpusloom.llm import filter_audit as M

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(i, rows):
    doc_id, text, _ = rows[i]
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = set()
    if len(w) < 200:
        out.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
        out.add("C")
    if re.search("[#$%&*|]", t):
        out.add("D")
    if doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    failed = [fails(i, rows) for i in range(len(rows))]
    out = {}
    for part in {p or "" for *_, p in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in failed[i]}
                left -= gone
                total[f] += len(gone)
                redundant = [i for i in mine if f in failed[i] and i not in gone]
                out[part, order, step] = [len(left), len(gone), len(redundant), sum(failed[i] == {f} for i in mine), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def held(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, 1, "x") for d, t, p in rows], "doc_id long, text string, source string, n int, failed string")
    marks = spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, toxic int, n int")
    got = {(r.part, r.filter_order, r.step): [*(r[c] for c in COUNTS), r.shapley] for r in M.interaction_audit(docs, marks).collect()}
    assert got == brute(rows, labels)
    return got


def test_lattice():
    assert len(M.EDGES) == len({(a, f) for a, f, _ in M.EDGES}) == 80 and len(M.STEPS) == 600
    assert all(sum(w for _, f, w in M.EDGES if f == bit) == 120 for bit in (1, 2, 4, 8, 16))


def test_equals_brute_force(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(200))
    texts = [None, "", " \t\n ", "short", "SHOUT $", long, long + " $ 5", long.upper(), "same " * 250, "Same " * 250 + "|", "a b c d", "\U0001f600" * 40 + "A", long + " " + long, " ".join(["x"] * 199), "x\x0by z" * 100, "É" * 300]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(150)]
    rows += [(3, "twice", "a"), (3, "twice", "a"), (3, "twice", "b"), (2, "twice", "b"), (None, "twice", "a")]
    labels = [(rng.choice([None, *range(45)]), rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1])) for _ in range(60)]
    got = held(spark, rows, labels)
    assert len(got) == 3 * 600 and sum(x[1] for x in got.values()) > 0
    held(spark, [(5, "only", None)], [])


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert M.interaction_audit(empty, labels).count() == 0
    held(spark, [(1, "word " * 300_000, "a"), (2, "word " * 300_000, "a"), (3, "y" * 1_500_000, "a")], [(2, 1, 1), (2, 0, 0)])
