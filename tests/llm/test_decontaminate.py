import hashlib
import random
import re

from corpusloom.llm import decontaminate as M


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = [(i, tuple(w[s : s + 13])) for i, t in items if i is not None and (w := split(t)) for s in range(max(1, len(w) - 12))]
    out = []
    for d, t in docs:
        w, hit, its = split(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    its.add(str(i))
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, term string, pos int")
    i = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, len int")
    got = M.contamination(d, i).drop("tkey")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, items)


def test_against_brute_force(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["the", "of", "Éa", "x9", "and", "tion", "ou"]) for _ in range(n))
    items = [(2, say(30)), (11, say(13)), (3, "Short one"), (4, None), (5, "!!"), (6, "the the"), (7, "lone"), (None, say(20)), (12, "the " * 20)]
    items.append((13, items[0][1]))
    docs = [(0, None), (1, ""), (2, items[0][1].upper().replace("É", "É") + " " + say(300)), (3, say(50) + ", short--ONE. " + say(9)), (4, "lone"), (4, "lone"), (4, "other text"), (None, "a lone word"), (5, "the " * 400), (6, say(2000) + " " + items[1][1]), (7, items[1][1][:-3])]
    run(spark, docs, items)
    run(spark, docs, [])
    run(spark, [], items)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "zeta q q alpha"), (2, "zeta q q q q q q q q q q q alpha"), (3, "alpha zeta")], "doc_id long, text string")
    i = spark.createDataFrame([(9, "zeta q alpha")], "item_id long, text string")
    index = M.build_index(d, i)
    assert [tuple(r) for r in M.proximity_matches(index, 3).orderBy("doc_id").collect()] == [(1, 9, 1), (3, 9, 1)]


def test_kept_rows_keep_all_columns(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, item, "p", 1), (1, "clean", "q", 2), (None, None, "r", 3), (2, item + " x" * 400, "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _bad_id string, _bad_key int")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = M.keep_uncontaminated(df, items)
    assert got.columns == df.columns
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(rows[1:], key=str)


def test_a_very_long_text(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["ta", "re", "mi", "so"]) + rng.choice(["na", "vo", "k"])
    items = [(1, " ".join(word() for _ in range(20))), (2, "zzz")]
    long = " ".join(word() for _ in range(60_000))
    run(spark, [(1, long[:200_000] + " " + items[0][1] + " " + long[200_000:]), (2, long + " zzz")], items)


def test_proximity_equals_brute_force(spark):
    """Windows whose two rarest words (by count over all documents, then place) stand within the slop of their distance."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["the", "of", "x9", "and", "tion", "ou", "rare", "odd"]) for _ in range(n))
    docs = [(i, say(rng.randint(0, 60))) for i in range(30)] + [(30, None), (4, "rare odd")]
    items = [(1, say(20)), (2, say(6)), (3, "rare zz"), (4, "the"), (5, None)]
    counts = {}
    for _, t in docs:
        for w in split(t):
            counts[w] = counts.get(w, 0) + 1
    want = {}
    for d, t in docs:
        w = split(t)
        for i, it in items:
            x = split(it)
            near = set()
            for s in range(max(1, len(x) - 12) if x else 0):
                win = x[s : s + 13]
                if len(win) < 2 or any(v not in counts for v in win):
                    continue
                (_, a, u), (_, b, v) = sorted((counts[v], k, v) for k, v in enumerate(win))[:2]
                if any(w[p] == u and w[q] == v and abs(q - p - (b - a)) <= 3 for p in range(len(w)) for q in range(len(w))):
                    near.add(tuple(win))
            if near:
                want[d, i] = want.get((d, i), set()) | near
    index = M.build_index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.n_near for r in M.proximity_matches(index, 3).collect()}
    assert got == {k: len(v) for k, v in want.items()} and len(got) > 20
