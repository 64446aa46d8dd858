import numpy as np
import pytest

from corpusloom.llm import embeddings as M


def brute(rows, cosine=0.95):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up, deg = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ok):
        for j in ok[:n]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                deg[i] += 1
                deg[j] += 1
                up[find(i)] = find(j)
    low = {}
    for i in ok:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted([(k, deg[i], low.get(find(i), k) if i in ok else k, k == low.get(find(i), k) if i in ok else True) for i, (k, _) in enumerate(rows)], key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, n long, v string")
    assert sorted([tuple(r) for r in M.near_vectors(df, **kw).collect()], key=str) == brute(rows)


def made(dim, n, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    near = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dim)) * rng.choice([0.01, 0.1, 0.2, 0.33, 0.4], (n, 1))
    return [v.tolist() for v in np.vstack([base, near])]


@pytest.mark.parametrize("dim", [64, 20])
def test_all_links_found(spark, dim):
    vectors = made(dim, 240, dim)
    rows = list(enumerate(vectors)) + [(900 + i, vectors[7]) for i in range(5)] + [(950, [2 * x for x in vectors[7]])]
    run(spark, rows)
    if dim == 20:
        run(spark, rows, chunk=12)  # cells cut into pairs of chunks


def test_odd_vectors(spark):
    v = [1.0, 2.0, 0.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0, 0.0]), (6, [float("inf")] + v[1:]), (7, v), (8, [1.0, 2.0, -0.0, 3.0]), (9, v[:3]), (7, v), (None, v), (10, [-x for x in v]), (7, [9.0, -1.0, 4.0, 0.0])]
    run(spark, rows)
    run(spark, [])


def test_very_small_and_very_large_vectors(spark):
    v = [1.0, 2.0, 0.5, 3.0, -1.0, 0.25]
    scaled = lambda k: [x * k for x in v]
    rows = [(i, scaled(k)) for i, k in enumerate((1e-200, 2e-200, 1e200, 2e200, 1.0, 5e-310, 4e307))] + [(8, [3e-300, -1e-300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in M.near_vectors(df).collect()}
    assert got == {**{i: (6, 0) for i in range(7)}, 8: (0, 8)}
