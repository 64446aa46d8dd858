import random
import re

import numpy as np
import xxhash

from corpusloom.llm import simhash as M


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    return {f: find(f) for f in u}


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", "  ", "One", "One two", "a b c d a b c", "É é x y Z"] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (3, 4, 254, 257, 600)]
    assert M.fingerprint_batch(texts).tolist() == [brute(t) for t in texts]


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string, fp int, root string")
    got = sorted(M.simhash_groups(docs, **kw).collect(), key=str)
    fps = {r[1]: brute(r[1]) for r in rows}
    root = groups(list(fps.values()))
    least = {}
    for r in rows:
        if r[0] is not None:
            k = root[fps[r[1]]]
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted([(r[0], f"{fps[r[1]]:016x}", least.get(root[fps[r[1]]])) for r in rows], key=str)
    assert [tuple(x) for x in got] == want


def test_groups_edges(spark):
    rng = random.Random(2)
    base = [rng.choice("abcdefghijkl") * rng.randint(1, 4) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate([None, "", "One two", "one TWO", " ".join(base)] * 2)] + [(None, "alone here"), (50, "same id a"), (50, "same id b")]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "x"
        rows.append((100 + i, " ".join(w)))
    check(spark, [(a, t, "q", 1, "z") for a, t in rows])
    assert M.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def linked(spark, fps, **kw):
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in M.near_links(df, **kw).collect():
        a, b = (int(np.int64(x).view(np.uint64)) for x in (a, b))
        assert (a ^ b).bit_count() <= 3
        up[find(a)] = find(b)
    want = groups(fps)
    as_sets = lambda of: sorted(sorted(f for f in fps if of(f) == r) for r in {of(f) for f in fps})
    assert as_sets(find) == as_sets(lambda f: want[f])


def test_trie_join_loses_no_link(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for k in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    linked(spark, sorted(fps))
    dense = rng.getrandbits(64)
    cloud = sorted({dense ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(250)})
    linked(spark, cloud)
    linked(spark, cloud, subtree=20)  # cut into smaller subtrees


def test_kept_rows_keep_all_columns(spark):
    rows = [(1, "a b c", "p", 1, "q"), (2, "a b c", None, 2, "r"), (None, "other words here", "s", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key int, _None string")
    got = M.keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([rows[0], rows[2]], key=str)


def test_a_very_long_text():
    text = " ".join(f"w{i % 997}" for i in range(400_000))
    assert M.fingerprint_batch([text, None]).tolist() == [brute(text), 0]
